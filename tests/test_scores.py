"""Scores, rankings and flags on small cases worked out by hand."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import controls as C
from ledgerloom.operators import learning as L
from ledgerloom.operators import matching as M
from ledgerloom.operators import metrics as X
from ledgerloom.plans import queries as core

LINES = "array<struct<account string, debit decimal(20,4), credit decimal(20,4)>>"
BOOKS = f"run string, expected_lines {LINES}, predicted_lines {LINES}, expected_fields map<string,string>, predicted_fields map<string,string>, expected array<string>, predicted array<string>"
RCA = "run string, label string, predicted_label string, detected_exception boolean, auto_resolved boolean, amount decimal(20,4), amounts array<decimal(20,4)>, expected_root_cause string, root_cause string, expected_resolution string, resolution string, expected_evidence array<string>, evidence_ids array<string>"
CANDIDATE = "candidate_id string, score double, source_id string, source_type string, source_currency string, source_party string, target_id string, target_type string, target_currency string, target_party string"


def test_accounting_scores(spark):
    cash, sales = ("cash", Decimal(5), Decimal(0)), ("sales", Decimal(0), Decimal(5))
    rows = [("a", [cash, sales], [cash], {"v": "x", "t": "1"}, {"v": "x"}, ["c"], []), ("a", [], [], {}, {"v": "x"}, [], []), ("a", [], [cash, sales], {"v": "x"}, {"v": "x"}, ["c"], ["c", "d"])]
    got = X.score_accounting(spark.createDataFrame(rows, BOOKS), ["run"]).first().asDict()
    assert got == {"run": "a", "journal_score": 0.5, "field_score": 0.833333, "balanced_rate": 0.333333, "contradiction_precision": 0.5, "contradiction_recall": 0.666667}


def test_root_cause_scores(spark):
    rows = [
        ("a", "DUPLICATE", "DUPLICATE", None, True, Decimal(0), [Decimal(-7), Decimal(2)], " x ", "x", None, None, ["e"], ["e", "f"]),  # right, amount from the case
        ("a", "DUPLICATE", None, None, True, Decimal(3), None, "x", None, None, None, [], []),  # missed failure
        ("a", "legitimate", "matched", True, False, Decimal(11), [], " ", "x", "", None, ["e"], []),  # hard negative taken for a failure
        ("a", "matched", "reconciled", None, True, Decimal(13), [], None, None, None, None, [], ["e"]),  # automatic, wrong label
    ]
    got = X.score_rca(spark.createDataFrame(rows, RCA), ["run"]).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (1, 1, 1, 1)
    assert (got["root_cause_accuracy"], got["resolution_accuracy"], got["hard_negative_fpr"], got["automation_rate"]) == (0.5, None, 1.0, 0.75)
    assert (got["amount_correct"], got["fn_exposure"], got["fp_exposure"]) == (7, 3, 24)
    assert (got["evidence_precision"], got["evidence_recall"]) == (0.375, 0.5)


def test_rank_gives_the_first_reason(spark):
    rows = [
        ("1", 0.9, "s1", "invoice", "USD", "p", "t1", "payment", "USD", None), ("2", 0.88, "s1", "invoice", "USD", "p", "t2", "payment", "EUR", "p"), ("3", 0.99, "s1", "invoice", "USD", "p", "t3", "payment", "USD", "q"),
        ("4", 0.7, "s2", "invoice", "USD", "p", "t4", "payment", "USD", " P "), ("5", 0.66, "s2", "invoice", "USD", "p", "t5", "payment", "USD", "p"), ("6", 0.2, "s3", "invoice", "USD", "p", "t6", "payment", "USD", "p"),
        ("7", 0.8, "s4", "invoice", "USD", "p", "t7", "settlement", "USD", "p"),
    ]
    candidates = spark.createDataFrame(rows, CANDIDATE)
    good = {"review_threshold": "0.50", "review_gate_passed": True, "review_policy": "separated", "relationships": ["invoice->payment"]}
    ask = lambda **change: {r["candidate_id"]: r["reason"] for r in C.rank_candidates(candidates, good | change).collect()}
    assert ask() == {"1": "REVIEW_ONLY_MODEL", "2": "CURRENCY_MISMATCH", "3": "PARTY_CONFLICT", "4": "AMBIGUOUS_RECORD_MATCH", "5": "AMBIGUOUS_RECORD_MATCH", "6": "BELOW_REVIEW_THRESHOLD", "7": "OUT_OF_DISTRIBUTION_RELATIONSHIP"}
    assert ask(review_threshold=None)["1"] == "MODEL_NOT_CALIBRATED"
    assert ask(review_gate_passed=False)["1"] == "MODEL_NOT_VALIDATED"
    assert ask(review_policy="other")["1"] == "INCOMPATIBLE_REVIEW_POLICY"


def test_allocation_flags_on_either_side(spark):
    rows = [("a", "s", "t1", 10, 4), ("b", "s", "t2", 10, 6), ("c", "s", "t3", 10, 5), ("d", "u1", "v", 1, 6), ("e", "u2", "v", 2, 6), ("f", "u3", "v", 3, 6), ("g", "w", "t1", 4, 4)]
    rows = [(*r[:3], Decimal(r[3]), Decimal(r[4])) for r in rows]
    got = M.allocation_flags(spark.createDataFrame(rows, "candidate_id string, source_id string, target_id string, s_amount decimal(20,4), t_amount decimal(20,4)"))
    assert {r[0] for r in got.collect() if r[1]} == set("abdef")


def test_negative_counts_are_refused(spark):
    with pytest.raises(Exception, match="fp is negative"):
        X.classification_metrics(spark.createDataFrame([("a", 1, -1, 0)], "run string, tp int, fp int, fn int"), ["run"]).collect()


def test_models_rank_and_calibrate(spark):
    best = core.QUERIES["train_baselines"](spark, "/root/testdata/sf0.001").orderBy("place").collect()
    assert len(best) == 2 and best[0]["f1"] >= best[1]["f1"] > 0
    done = {r["scores"]: r for r in core.QUERIES["calibrate"](spark, "/root/testdata/sf0.001").collect()}
    assert done["calibrated"]["log_loss"] <= done["probability"]["log_loss"] * 1.2


def test_texts_that_are_cleaned_before_the_join_are_as_alike(spark):
    texts = ["INV-1", "inv-1 ", " inv \t 1", "", "  ", None, "x", "invoice 12"]
    rows = spark.createDataFrame([(k, t, "cust", 1.0) for k, t in enumerate(texts)], "record_id int, reference string, party string, amount double")
    rows = rows.withColumns({"amount": F.col("amount").cast("decimal(20,4)"), "currency": F.lit("USD"), "record_date": F.to_date(F.lit("2024-01-01"))})
    side = lambda r, p: r.select(*[F.col(c).alias(f"{p}_{c}") for c in r.columns])
    got = [L.features(side(r, "s").crossJoin(side(r, "t"))) for r in (rows, L.with_text(rows))]
    assert got[0].columns == got[1].columns
    assert sorted(map(str, got[0].collect())) == sorted(map(str, got[1].collect()))


def test_examples_hold_what_is_trained_on_and_calibration_fits_no_trees(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    assert sorted(core._folds(spark, folder).columns) == sorted([*L.FEATURES, "fold", "label"])
    monkeypatch.setattr(L.GBTClassifier, "fit", lambda *a: 1 / 0)
    assert core.QUERIES["calibrate"](spark, folder).count() == 2
