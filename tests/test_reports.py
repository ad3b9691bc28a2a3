"""Reports that appear whole or not at all, stored runs, typed rows and what a ranker sees of them."""

from decimal import Decimal

import pytest

from ledgerloom.functions import normalize as N
from ledgerloom.operators import controls as C
from ledgerloom.operators.reports import ReportStore
from ledgerloom.sources.runs import RunStore

MD = """# Evaluation benchmark report

Baseline: `old`
System: `new`

## a

### System
- **cases:** `4`
- **precision:** `0.5`
- **recall:** `1.0`
- **f1:** `0.75`

### Baseline
- **cases:** `4`
- **precision:** `0.25`
- **recall:** `1.0`
- **f1:** `0.5`

### Delta (system - baseline)
- **precision:** `0.25`
- **recall:** `0.0`
- **f1:** `0.25`

## b

### System
- **cases:** `1`
- **recall:** `0.5`
- **f1:** `0.1`

"""


def test_reports_come_whole_or_not_at_all(spark, tmp_path):
    store = ReportStore(spark, f"file://{tmp_path}/r")
    metrics = spark.createDataFrame([("a", "new", 4, 0.5, 1.0, 0.75), ("a", "old", 4, 0.25, 1.0, 0.5), ("b", "new", 1, None, 0.5, 0.1), ("b", "other", 1, 1.0, 1.0, 1.0)], "suite string, run string, cases int, precision double, recall double, f1 double")
    predictions = spark.createDataFrame([(1, None), (2, "x")], "case_id int, label string")
    store.write(1, metrics, predictions, "new", "old")
    lines = lambda: "\n".join(r.value for r in store.read("markdown", "value string").collect()) + "\n"
    assert lines() == MD
    assert sorted(map(tuple, store.read("predictions", "case_id int, label string").collect())) == [(1, None), (2, "x")]

    def broken(rows):
        raise RuntimeError("lost")
        yield from rows

    with pytest.raises(Exception, match="lost"):
        store.write(2, metrics, predictions.mapInPandas(broken, predictions.schema), "new", "old")
    assert lines() == MD and store.read("predictions", "case_id int, label string").count() == 2
    store.write(2, metrics.limit(0), predictions.limit(0), "new", "old")
    assert lines().count("\n") == 5 and store.read("predictions", "case_id int, label string").count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        store.write(2, metrics, predictions, "new", "old")


def test_a_run_replaces_itself(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    rows = lambda *x: spark.createDataFrame(x, "id int, status string")
    store.save(1, rows((1, "MATCHED"), (2, "UNMATCHED")))
    store.save(2, rows((3, "EXCEPTION")))
    store.save(1, rows((1, "MATCHED"), (2, "MATCHED"), (4, "EXCEPTION")))
    assert sorted((r.run_id, r.results, r.exceptions) for r in store.runs().collect()) == [(1, 3, 1), (2, 1, 1)]
    assert sorted((r.run_id, r.id) for r in store.exceptions().collect()) == [(1, 4), (2, 3)]
    rows((9, "MATCHED")).write.parquet(f"file://{tmp_path}/s/results/run_id=3")
    assert store.results().where("run_id = 3").count() == 0


def test_typed_rows(spark):
    df = lambda names, *rows: spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{n}` string" for n in names))
    bank = N.normalize_typed(df(["Amount", "Date", "Account ", "Value Date"], ["(5)", "2026-01-02", "", "x"], ["", "", "a", ""]), " Bank ").collect()
    assert [(r.amount, r.account_id, r.transaction_type, r.currency, r.error) for r in bank] == [
        (Decimal(-5), "unknown", "unknown", "USD", "value_date is not a date"), (None, "a", "unknown", "USD", "amount is missing or not a number; record_date is missing or not a date"),
    ]
    ledger = N.normalize_typed(df(["Debit", "Credit", "Posting Date", "currency_code"], ["", "7", "2026-01-02", "eur"]), "ledger").first()
    assert (ledger.record_type, ledger.amount, ledger.debit, ledger.credit, ledger.journal_id, ledger.currency) == ("ledger_entry", Decimal(-7), Decimal(0), Decimal(7), "unknown", "EUR")
    with pytest.raises(ValueError, match="unsupported"):
        N.normalize_typed(df(["a"], ["b"]), "cheque")
    seen = N.observable(N.normalize_typed(df(["id", "amount", "date", "vendor"], ["i1", "1", "2026-01-02", "v"]), "invoice")).first()
    assert (seen.reference, seen.party, seen.external_id) == ("i1", "v", "i1")


def test_pages_that_a_document_has(spark):
    docs = spark.createDataFrame([(1, 2), (2, None), (3, 0)], "doc_id int, page_count int")
    asked = spark.createDataFrame([(1, 2), (1, 3), (2, 9), (3, 1), (4, 1)], "doc_id int, page int")
    assert sorted((r.doc_id, r.page) for r in C.document_page(docs, asked).collect()) == [(1, 2), (2, 9), (3, 1)]
