"""Registered queries of the case packs: files that Spark writes from the given tables, faults planted by key, read back."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import learning as L
from ..operators import metrics as X
from ..operators import model_store as S
from ..sources import cases as K
from .queries import both, query, sql
from .storage import cut, folder_writer, fresh_path

CASES = "SELECT o_orderkey AS k, CAST(o_orderkey % 10 AS INT) AS s, concat('cust-', cast(o_custkey AS varchar(20))) AS party, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS varchar(30)) AS m FROM orders"


def key_text():
    return F.col("k").cast("string")


def _custom(spark, d):
    """A case of two records for each order, the faults by the last digit of its key; 8 comes twice."""
    s = F.col("s")
    a = F.struct(F.lit("a").alias("id"), F.lit("invoice").alias("record_type"), F.col("m").alias("amount"), F.lit("usd").alias("currency"), F.lit("2024-01-05").alias("record_date"), F.col("party"), F.concat(F.lit("INV-"), key_text()).alias("reference"), F.concat(F.lit("pay "), key_text()).alias("description"))
    b = F.struct(F.lit("b").alias("id"), F.lit("payment").alias("record_type"), F.when(s == 0, "1.00").otherwise(F.col("m")).alias("amount"), F.lit("USD").alias("currency"), F.when(s == 0, "2024-01-07").otherwise("2024-01-05").alias("record_date"), F.col("party"), F.when(s != 1, F.concat(F.lit("INV-"), key_text())).alias("reference"), F.concat(F.lit("pay "), key_text(), F.lit(" x")).alias("description"))
    truth = F.struct((s != 2).alias("is_match"), (s == 9).alias("is_hard_negative"), F.array(F.lit("a")).alias("source_ids"), F.array(F.lit("b")).alias("target_ids"), F.lit("0.00").alias("expected_difference"))
    row = F.to_json(F.struct(F.concat(F.lit("c-"), key_text()).alias("case_id"), F.col("party").alias("scenario_id"), F.col("k").alias("generator_seed"), F.array("party", F.concat(F.lit("o-"), key_text())).alias("group_entity_ids"), F.lit("match").alias("label"), truth.alias("ground_truth"), F.array(a, b).alias("records")))
    line = (
        F.when(s == 3, F.regexp_replace(row, '"generator_seed":[0-9]+', '"generator_seed":"x"')).when(s == 4, F.regexp_replace(row, '"invoice","amount":"([0-9.]+)"', '"invoice","amount":$1'))
        .when(s == 5, "[1]").when(s == 6, " ").when(s == 7, F.regexp_replace(row, r"^\{", '{"more":1,')).otherwise(row)
    )
    path = fresh_path(spark, "custom-pack")
    sql(spark, d, CASES).select(F.explode(F.when(s == 8, F.array(line, line)).otherwise(F.array(line))).alias("value")).write.text(path)
    return K.load_custom_cases(spark, path)


@query(f"""WITH c AS (SELECT *, unnest(CASE WHEN s = 8 THEN [0, 1] ELSE [0] END) AS n FROM ({CASES}))
SELECT CASE WHEN s NOT IN (5, 6) THEN concat('c-', k) END AS case_id, CASE WHEN s NOT IN (3, 5, 6) THEN k END AS seed, CAST(CASE WHEN s IN (3, 5, 6, 7) OR n = 1 THEN 0 WHEN s = 4 THEN 2 ELSE 3 END AS BIGINT) AS n_amounts,
 CASE WHEN s = 3 THEN 'generator seed must be an integer' WHEN s = 4 THEN 'amount must be an exact decimal string or integer' WHEN s = 5 THEN 'row must be an object' WHEN s = 6 THEN 'blank JSONL rows are not allowed'
  WHEN s = 7 THEN 'row fields must be exactly case_id, generator_seed, ground_truth, group_entity_ids, label, records, scenario_id' WHEN n = 1 THEN 'duplicate case_id' END AS error FROM c""")
def load_custom_cases(spark, d):
    return _custom(spark, d).select("case_id", "seed", F.size("amounts").cast("long").alias("n_amounts"), "error")


@query(f"""SELECT concat('c-', k) AS example_id, party AS entity_id, CAST(1 AS BIGINT) AS n_sources, s <> 2 AS is_match, CAST(m AS DECIMAL(38,10)) AS amount, 'USD' AS currency, CASE WHEN s = 9 THEN 'hard negative cannot be a match' END AS error
FROM ({CASES}) WHERE s NOT IN (3, 4, 5, 6, 7)""")
def training_pairs(spark, d):
    source = F.col("sources")[0]
    return K.training_pairs(_custom(spark, d)).select("example_id", "entity_id", F.size("sources").cast("long").alias("n_sources"), "is_match", source["amount"].alias("amount"), source["currency"].alias("currency"), "error")


@query(f"""WITH p AS (SELECT concat('c-', k) AS example_id, s, length(cast(k AS varchar(20))) AS n, CAST(m AS DECIMAL(20,2)) AS a, CASE WHEN s = 0 THEN 1.00 ELSE CAST(m AS DECIMAL(20,2)) END AS b FROM ({CASES}) WHERE s IN (0, 1, 2, 8))
SELECT example_id, CAST(abs(a - b) AS DOUBLE) AS absolute_delta, round(CAST(abs(a - b) AS DOUBLE) / CAST(greatest(abs(a), abs(b), 0.01) AS DOUBLE), 6) AS relative_delta, CASE WHEN s = 0 THEN 2.0 ELSE 0.0 END AS date_gap, 1.0 AS currency_match,
 CASE WHEN s = 1 THEN 0.0 ELSE 1.0 END AS reference_similarity, CASE WHEN s = 1 THEN 1.0 ELSE 0.0 END AS reference_missing, 1.0 AS party_agreement, 0.0 AS party_missing, round(1 - 2.0 / (n + 6), 6) AS description_similarity, 0.0 AS description_missing,
 1.0 AS source_count, 1.0 AS target_count, 0.0 AS graph_score, 1.0 AS graph_missing FROM p""")
def candidate_features(spark, d):
    return L.candidate_features(K.training_pairs(_custom(spark, d)).where("error is null")).select("example_id", *L.FEATURE_NAMES)


HARVEST = "SELECT l_orderkey AS k, l_linenumber AS n, CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS varchar(30)) AS m, CAST(l_orderkey % 9 = 0 AS BOOLEAN) AS bad FROM lineitem"


@query(f"""SELECT k, CAST(count(*) + count(*) FILTER (WHERE NOT bad) AS BIGINT) AS n_amounts, CAST(sum(CASE WHEN bad THEN 0 ELSE CAST(m AS DECIMAL(20,2)) END) + sum(n) AS DECIMAL(38,10)) AS total,
 CASE WHEN bool_or(bad) THEN 'unit_price must be an exact decimal string or integer' END AS money_error FROM ({HARVEST}) GROUP BY 1""")
def json_money(spark, d):
    """Money three levels down in the lines of an order: a string (a fraction on bad orders) and an integer under a suffix."""
    price = F.when(F.col("bad"), F.concat(F.col("m"), F.lit("1"))).otherwise(F.concat(F.lit('"'), F.col("m"), F.lit('"')))
    line = F.concat(F.lit('{"item": {"unit_price": '), price, F.lit(', "note": "x"}, "line_total": '), F.col("n").cast("string"), F.lit(', "amount": null}'))
    orders = sql(spark, d, HARVEST).groupBy("k").agg(F.concat(F.lit('{"lines": ['), F.array_join(F.collect_list(line), ", "), F.lit("]}")).alias("value"))
    money = K.json_money(orders.select("k", F.parse_json("value").alias("v")), ["k"], "v")
    return money.select("k", F.size("amounts").cast("long").alias("n_amounts"), F.aggregate("amounts", F.lit(0).cast(K.AMOUNT), lambda a, x: (a + x).cast(K.AMOUNT)).alias("total"), "money_error")


PREDICTIONS = "SELECT o_orderkey AS k, CAST(o_orderkey % 8 AS INT) AS s, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS varchar(30)) AS m FROM orders"


@query(f"""WITH p AS (SELECT *, unnest(CASE WHEN s = 7 THEN [0, 1] ELSE [0] END) AS n FROM ({PREDICTIONS}))
SELECT CASE WHEN s NOT IN (1, 2) THEN concat('c-', k) END AS case_id, CASE WHEN s NOT IN (1, 2, 3, 6) THEN CAST(m AS DECIMAL(38,10)) WHEN s = 6 THEN -5 WHEN s IN (1, 2) THEN 0 END AS amount,
 CASE WHEN s = 1 THEN 'invalid JSON' WHEN s = 2 THEN 'blank JSONL rows are not allowed' WHEN s = 3 THEN 'amount must be a finite, non-negative, exact decimal' WHEN s = 4 THEN 'llm_tokens must be a non-negative integer'
  WHEN s = 5 THEN 'predicted_label must be a non-empty string' WHEN s = 6 THEN 'amount must be a finite, non-negative, exact decimal' WHEN n = 1 THEN 'duplicate case_id' END AS error FROM p""")
def load_predictions(spark, d):
    s = F.col("s")
    amount = F.when(s == 3, F.concat(F.col("m"), F.lit("5"))).when(s == 6, "-5").otherwise(F.concat(F.lit('"'), F.col("m"), F.lit('"')))
    row = F.concat(F.lit('{"case_id": "c-'), key_text(), F.lit('", "predicted_label": "'), F.when(s == 5, " ").otherwise("paid"), F.lit('", "evidence_ids": ["e"], "llm_tokens": '), F.when(s == 4, "-1").otherwise("7"), F.lit(', "amount": '), amount, F.lit("}"))
    line = F.when(s == 1, "{").when(s == 2, "").otherwise(row)
    path = fresh_path(spark, "predictions")
    sql(spark, d, PREDICTIONS).select(F.explode(F.when(s == 7, F.array(line, line)).otherwise(F.array(line))).alias("value")).write.text(path)
    return K.load_predictions(spark, path).select("case_id", "amount", "error")


SETTLEMENTS = "SELECT o_orderkey AS k, CAST(floor(o_custkey / 100) AS BIGINT) AS pack, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS varchar(30)) AS m FROM orders"


@query(f"""SELECT CASE WHEN pack % 4 <> 3 THEN concat('s-', pack, ':batch:w-', k) WHEN pack % 4 = 3 THEN concat('other:batch:w-', k) END AS case_id, CASE WHEN k % 3 = 0 THEN 'exception' ELSE 'matched' END AS label, CAST(CASE WHEN k % 5 = 0 THEN 2 ELSE 3 END AS BIGINT) AS n_entities,
 CASE WHEN k % 7 <> 0 THEN CAST(m AS DECIMAL(38,10)) END AS amount,
 CASE WHEN pack % 4 = 1 THEN 'SHA-256 does not match scenario manifest' WHEN pack % 4 = 3 THEN 'row scenario_id differs from manifest' END AS error FROM ({SETTLEMENTS})""")
def load_settlement_cases(spark, d):
    """A folder for each hundred customers: truth as CSV, then a manifest with the digest of that file."""
    truth, manifest = fresh_path(spark, "settlement-truth"), fresh_path(spark, "settlement-manifest")
    empty = F.lit("")
    values = {
        "scenario_id": F.concat(F.lit("s-"), F.col("pack").cast("string")), "result_scope": F.lit("batch"), "work_key": F.concat(F.lit("w-"), key_text()), "settlement_batch_id": F.concat(F.lit("b-"), key_text()), "internal_payment_id": F.concat(F.lit("b-"), key_text()),
        "processor_transaction_id": F.when(F.col("k") % 5 == 0, empty).otherwise(F.concat(F.lit("t-"), key_text())), "bank_entry_id": empty, "expected_outcome": F.when(F.col("k") % 3 == 0, "exception").otherwise("matched"), "expected_reason_code": F.lit("R, 1"),
        "expected_difference": F.when(F.col("k") % 7 == 0, empty).otherwise(F.col("m")), "explanation": empty,
    }
    rows = sql(spark, d, SETTLEMENTS).select(F.col("pack").alias("folder"), *[values[c].alias(c) for c in K.SETTLEMENT_COLUMNS])
    rows.repartition("folder").write.option("header", True).option("emptyValue", "").partitionBy("folder").csv(truth)
    digests = spark.read.format("binaryFile").load(f"{truth}/*/*.csv").select(F.regexp_extract("path", "folder=([0-9]+)/", 1).cast("long").alias("folder"), F.sha2("content", 256).alias("sha"))
    stated = F.when(F.col("folder") % 4 == 1, F.sha2(F.encode("sha", "UTF-8"), 256)).otherwise(F.col("sha"))
    scenario = F.when(F.col("folder") % 4 == 3, "other").otherwise(F.concat(F.lit("s-"), F.col("folder").cast("string")))
    digests.select("folder", F.to_json(F.struct(scenario.alias("scenario_id"), F.col("folder").alias("random_seed"), F.create_map(F.lit("expected_reconciliation.csv"), stated).alias("file_sha256_checksums"))).alias("value")).repartition("folder").write.partitionBy("folder").text(manifest)
    out = K.load_settlement_cases(spark, f"{manifest}/*/*.txt", f"{truth}/*/*.csv")
    return out.select("case_id", "label", F.size("entity_ids").cast("long").alias("n_entities"), F.try_element_at("amounts", F.lit(1)).alias("amount"), "error")


RCA = "SELECT o_orderkey AS k, CAST(o_orderkey % 7 AS INT) AS s, concat('cust-', cast(o_custkey AS varchar(20))) AS party, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS varchar(30)) AS m FROM orders"


@query(f"""SELECT concat('c-', k) AS case_id, CASE WHEN s <> 5 THEN 'late' END AS label, CAST(CASE WHEN s <> 5 THEN 3 END AS BIGINT) AS n_entities, CAST(CASE WHEN s = 1 THEN 0 ELSE 2 END AS BIGINT) AS n_evidence,
 CASE s WHEN 1 THEN 'case has no model-visible evidence' WHEN 2 THEN 'evidence_ids do not resolve in case evidence' WHEN 3 THEN 'evidence split conflicts with ground truth' WHEN 4 THEN 'amount must be an exact decimal string or integer' WHEN 5 THEN 'evidence exists for unknown cases' END AS error FROM ({RCA})""")
def load_rca_cases(spark, d):
    """Truth and two rows of evidence for each order, faults by the key modulo 7."""
    truth, evidence, config = (fresh_path(spark, f"rca-{n}") for n in ("truth", "evidence", "config"))
    s, case, rows = F.col("s"), F.concat(F.lit("c-"), key_text()), sql(spark, d, RCA)
    entity = F.struct(F.concat(F.lit("e-"), key_text()).alias("id"))
    wanted = F.when(s == 2, F.concat(F.lit("lost-"), key_text())).otherwise(F.concat(F.lit("e-"), key_text()))
    truth_row = F.struct(case.alias("case_id"), F.lit("late").alias("failure_type"), F.lit("v1").alias("scenario_variant"), F.col("party").alias("group_vendor_id"), entity.alias("primary_entity"), F.array(entity, F.struct(F.concat(F.lit("f-"), key_text()).alias("id"))).alias("affected_entities"), F.when(s == 3, "split=test").otherwise("split=train").alias("split"), F.array(wanted).alias("evidence_ids"))
    rows.where("s <> 5").select(F.to_json(truth_row).alias("value")).write.text(truth)
    amount = F.when(s == 4, F.concat(F.col("m"), F.lit("5"))).otherwise(F.concat(F.lit('"'), F.col("m"), F.lit('"')))
    body = lambda inner: F.concat(F.lit('{"case_id": "'), case, F.lit('", "table": "payments", "record": '), inner, F.lit("}"))
    seen = F.array(body(F.concat(F.lit('{"deep": [{"id": "e-'), key_text(), F.lit('"}]}'))), body(F.concat(F.lit('{"amount": '), amount, F.lit("}"))))
    rows.where("s <> 1").select(F.explode(seen).alias("value"), F.lit("train").alias("split")).write.partitionBy("split").text(evidence)
    spark.range(1).select(F.lit("name: x\nseed: 11").alias("value")).write.text(config)
    out = K.load_rca_cases(spark, truth, f"{evidence}/*/*.txt", f"{config}/*.txt")
    return out.select("case_id", "label", F.when(F.col("entity_ids").isNotNull(), F.size("entity_ids")).cast("long").alias("n_entities"), "n_evidence", "error")


ACCOUNTS = "SELECT s_suppkey AS k, CAST(s_suppkey % 5 AS INT) AS s, CAST(CAST(s_acctbal AS DECIMAL(20,2)) AS varchar(30)) AS m FROM supplier"


@query(f"""SELECT concat('case=', k) AS case_id, CAST(CASE WHEN s = 1 THEN 0 ELSE 2 END AS BIGINT) AS n_lines, CASE WHEN s <> 3 THEN CAST(m AS DECIMAL(38,10)) * CASE WHEN s = 1 THEN 1 ELSE 3 END END AS total,
 CASE s WHEN 1 THEN 'expected_journal_entries must be a non-empty list' WHEN 2 THEN 'document text must be non-empty' WHEN 3 THEN 'expected_fields money must be an exact decimal string or integer' WHEN 4 THEN 'case_id does not match directory/manifest' END AS error FROM ({ACCOUNTS})""")
def load_accounting_cases(spark, d):
    """A folder for each supplier with a case and its text; the manifest lists them all."""
    cases, documents, manifest = (fresh_path(spark, f"accounting-{n}") for n in ("cases", "documents", "manifest"))
    s, rows = F.col("s"), sql(spark, d, ACCOUNTS)
    name = F.concat(F.lit("case="), key_text())
    entry = lambda account, debit, credit: F.struct(F.lit(account).alias("account"), debit.alias("debit"), credit.alias("credit"))
    entries = F.array(entry("1000", F.col("m"), F.lit("0")), entry("2000", F.lit("0"), F.col("m")))
    row = F.to_json(F.struct(F.when(s == 4, "another").otherwise(name).alias("case_id"), F.lit("retail").alias("industry"), F.lit("low").alias("complexity"), F.when(s == 1, F.slice(entries, 1, 0)).otherwise(entries).alias("expected_journal_entries"), F.array(F.lit("x")).alias("contradiction_labels"), F.struct(F.col("m").alias("invoice_total"), F.lit("n").alias("vendor")).alias("expected_fields")))
    row = F.when(s == 3, F.regexp_replace(row, '"invoice_total":"[^"]*"', '"invoice_total":1.5')).otherwise(row)
    folder_writer(rows.select(row.alias("value"), F.col("k").alias("case")), "case").text(cases)
    folder_writer(rows.select(F.when(s == 2, " ").otherwise("Invoice").alias("value"), F.col("k").alias("case")), "case").text(documents)
    rows.agg(F.to_json(F.struct(F.collect_list(name).alias("case_ids"))).alias("value")).write.text(manifest)
    out = K.load_accounting_cases(spark, f"{manifest}/*.txt", f"{cases}/*/*.txt", f"{documents}/*/*.txt")
    total = F.aggregate("amounts", F.lit(0).cast(K.AMOUNT), lambda a, x: (a + x).cast(K.AMOUNT))
    return out.select("case_id", F.size("journal").cast("long").alias("n_lines"), total.alias("total"), "error")


def _labelled(spark, d, similarity="edit"):
    """Pairs of one party with the fourteen features; a pair of the same order is a match."""
    i, p = both(spark, d)
    record = lambda side: F.array(F.struct("amount", "currency", "record_date", "reference", "party", F.col("external_id").alias("description"))).alias(side)
    left = i.select(F.col("record_id").alias("s"), "party", record("sources"))
    right = p.select(F.col("record_id").alias("t"), "party", record("targets"), F.col("amount"))
    pairs = left.join(right, "party").select(F.concat("s", F.lit(":"), "t").alias("example_id"), "party", "amount", "sources", "targets", F.lit(None).cast("double").alias("graph_score"), (F.substring("s", 2, 9) == F.substring("t", 2, 9)).cast("double").alias("label"))
    return L.candidate_features(pairs, similarity).drop("sources", "targets")


@query()
def block_features(spark, d):
    """The texts of the pairs of a party compared by matching blocks."""
    rows = _labelled(spark, d, "blocks")
    return rows.select("example_id", "reference_similarity", "reference_missing", "description_similarity", "description_missing")


@query()
def train_store(spark, d):
    """Groups, split, both models, the better on validation, calibration, thresholds, gate, store, reload, test metrics."""
    rows = cut(_labelled(spark, d), "train-examples")
    groups = cut(L.leakage_groups(rows, ["party"], "example_id"), "train-groups")
    rows = cut(rows.join(groups.join(L.grouped_split(groups).drop("n"), "group"), "example_id"), "train-split")
    part = {s: rows.where(F.col("split") == s) for s in ("train", "validation", "test")}
    models = L.train_baselines(part["train"], list(L.FEATURE_NAMES))
    held = {n: cut(L.probabilities(m, part["validation"]).select("label", "amount", "probability"), "train-held") for n, m in models.items()}
    marks = {n: X.model_metrics(h.select(F.col("label").cast("int").alias("label"), F.round("probability", 4).alias("probability"))).first().asDict() for n, h in held.items()}
    best = max(sorted(marks), key=lambda n: (marks[n]["f1"], marks[n]["auc"]))
    calibrator = S.platt_model(held[best])
    calibrated = lambda h: calibrator.transform(h).select(F.col("label").cast("int").alias("label"), "amount", F.round(vector_to_array("calibrated")[1], 4).alias("probability"))
    tiers = X.threshold_select(calibrated(held[best]), 0.05, 1e9).first()
    automatic = X.threshold_select(calibrated(held[best]), 0.0, 0.0).first()
    review, auto = tiers["coverage_threshold"], automatic["coverage_threshold"]
    auto = None if auto is None or review is None else max(auto, review)
    passed = review is not None and auto is not None and X.generalization_gate(calibrated(held[best]), auto, review, 0.05, 1e9).first()["passed"]
    folder = fresh_path(spark, "model")
    thresholds = {"auto_match": auto, "candidate": review, "review": review, "unresolved": None}
    metrics = {k: float(v) for k, v in marks[best].items() if v is not None}
    S.save_model(spark, folder, models[best], calibrator, dataset_sha256=S.table_digest(part["train"]), seed=7, thresholds=thresholds, metrics=metrics, version=f"{best}-1", relationships=["invoice->payment"], gate_passed=bool(passed))
    estimator, calibrator, metadata = S.load_model(spark, folder)
    tested = calibrated(L.probabilities(estimator, part["test"]).select("label", "amount", "probability"))
    at = metadata["thresholds"]["review"]
    return X.model_metrics(tested.drop("amount"), 0.5 if at is None else at).withColumns({"model_version": F.lit(metadata["model_version"]), "review_gate_passed": F.lit(metadata["review_gate_passed"])})
