"""Classification, set, risk and cost metrics, suite scores and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_sums


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double to six places, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(F.round(a.cast("double") / b.cast("double"), 6))


def count_of(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def _prf(counts: DataFrame, keys: list[str]) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*keys, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def label_match(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 of labels: right is a true positive; wrong a miss, and a false alarm if a label was given."""
    right = F.col("label") == F.col("predicted_label")
    wrong = ~F.coalesce(right, F.lit(False))
    return _prf(scored.groupBy(*keys).agg(count_of(right).alias("tp"), count_of(wrong & F.col("predicted_label").isNotNull()).alias("fp"), count_of(wrong).alias("fn")), keys)


def binary_detection(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts and accuracy of booleans `actual` and `predicted`."""
    a, p = F.col("actual"), F.col("predicted")
    c = scored.groupBy(*keys).agg(count_of(a & p).alias("tp"), count_of(~a & p).alias("fp"), count_of(a & ~p).alias("fn"), count_of(~a & ~p).alias("tn"))
    done = _prf(c, [*keys, "tn"])
    return done.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def set_pr(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean precision and recall of `expected` and `predicted` arrays as sets: both empty 1, one empty 0."""
    e, p = F.array_distinct("expected"), F.array_distinct("predicted")
    both, none = F.size(F.array_intersect(e, p)).cast("double"), (F.size(e) == 0) & (F.size(p) == 0)
    share = lambda x: F.when(none, 1.0).when(F.size(x) == 0, 0.0).otherwise(both / F.size(x))
    return rows.groupBy(*keys).agg(F.round(F.avg(share(p)), 6).alias("precision"), F.round(F.avg(share(e)), 6).alias("recall"))


def risk_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Hard-negative false positives, automation, and money at risk of wrong and missed decisions."""
    auto, hard, right = F.col("auto_resolved"), F.col("hard_negative"), F.col("label") == F.col("predicted_label")
    money = lambda test: F.sum(F.when(test, F.abs("amount")).otherwise(0)).cast("decimal(30,4)")
    return scored.groupBy(*keys).agg(
        ratio(count_of(hard & auto & ~right), count_of(hard)).alias("hard_negative_fpr"), ratio(count_of(auto), F.count(F.lit(1))).alias("automation_rate"),
        money(auto & ~right).alias("fp_exposure"), money(~auto & ~right).alias("fn_exposure"), money(right).alias("amount_correct"),
    )


def cost_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("latency_ms").alias("latency_total"), F.round(F.avg("latency_ms"), 6).alias("latency_mean"), F.sum("llm_tokens").alias("tokens_total"), F.round(F.avg("llm_tokens"), 6).alias("tokens_mean"))


def suite_deltas(metrics: DataFrame, keys: list[str], names: list[str], system: str = "system", baseline: str = "baseline") -> DataFrame:
    """system - baseline of each metric of the suites that both have; null if either is."""
    s = metrics.where(F.col("run") == system).unpivot(keys, names, "metric", "system_value")
    b = metrics.where(F.col("run") == baseline).unpivot(keys, names, "metric", "baseline_value")
    return s.join(b, [*keys, "metric"]).withColumn("delta", F.round(F.col("system_value") - F.col("baseline_value"), 6))


def coverage_check(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Case ids that only one side has."""
    c, p = cases.select("case_id", F.lit(True).alias("c")).distinct(), predictions.select("case_id", F.lit(True).alias("p")).distinct()
    both = c.join(p, "case_id", "full_outer").where("c is null or p is null")
    return both.select("case_id", F.when(F.col("p").isNull(), "missing prediction").otherwise("unknown case").alias("problem"))


#: Labels of cases without a failure, and those of them that are hard negatives.
NO_FAILURE = ["NO_FAILURE", "LEGITIMATE", "HARD_NEGATIVE", "EXACT_MATCH", "MATCHED", "RECONCILED"]
HARD_NEGATIVE = ["NO_FAILURE", "LEGITIMATE", "HARD_NEGATIVE"]


def classification_metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 of given counts `tp`, `fp`, `fn`; a negative count is an error."""
    checked = lambda c: F.when(F.col(c) < 0, F.raise_error(F.lit(f"{c} is negative"))).otherwise(F.col(c)).alias(c)
    return _prf(counts.select(*keys, *map(checked, ("tp", "fp", "fn"))), keys)


def evidence_gaps(rows: DataFrame, key: str) -> DataFrame:
    """Ids of `required` and `supplied` arrays: on both sides, on either alone, and on any, each in order."""
    r, s = F.col("required"), F.col("supplied")
    listed = lambda x: F.array_join(F.array_sort(x), ",")
    return rows.select(key, listed(F.array_intersect(r, s)).alias("shared"), listed(F.array_except(r, s)).alias("missing"), listed(F.array_except(s, r)).alias("extra"), listed(F.array_union(r, s)).alias("every"))


def score_accounting(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Journal, field and contradiction scores by key.

    `expected_lines`, `predicted_lines`: structs (account, debit, credit), compared as sets; nothing expected scores 1
    if nothing is predicted. `expected_fields`, `predicted_fields`: maps. `expected`, `predicted`: contradiction ids.
    A prediction is balanced if it has lines and their debits equal their credits.
    """
    e, p = F.array_distinct("expected_lines"), F.array_distinct("predicted_lines")
    journal = F.when(F.size(e) == 0, (F.size(p) == 0).cast("double")).otherwise(F.size(F.array_intersect(e, p)) / F.size(e))
    total = lambda f: F.aggregate("predicted_lines", F.lit(0).cast("decimal(30,4)"), lambda s, x: (s + x[f]).cast("decimal(30,4)"))
    given = F.map_entries("expected_fields")
    equal = F.size(F.filter(given, lambda x: F.try_element_at("predicted_fields", x["key"]).eqNullSafe(x["value"])))
    field = F.when(F.size(given) == 0, 1.0).otherwise(equal / F.size(given))
    balanced = (F.size("predicted_lines") > 0) & (total("debit") == total("credit"))
    scores = rows.groupBy(*keys).agg(F.round(F.avg(journal), 6).alias("journal_score"), F.round(F.avg(field), 6).alias("field_score"), ratio(count_of(balanced), F.count(F.lit(1))).alias("balanced_rate"))
    found = set_pr(rows, keys).withColumnsRenamed({"precision": "contradiction_precision", "recall": "contradiction_recall"})
    return scores.join(found, keys)


def score_rca(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Failure detection, root cause, resolution, evidence and risk of predictions, by key.

    A prediction without `detected_exception` detects what its label says. Root causes and resolutions count where
    the truth has one, and their accuracy is null if none has. An amount that is not positive falls back to the
    largest of the case's `amounts`. Exposure is the first that fits: a detected hard negative, a missed failure, an
    automatic decision with a wrong label.
    """
    failure = lambda c: ~F.upper(c).isin(NO_FAILURE)
    stated = lambda c: F.nullif(F.trim(c), F.lit(""))
    most = F.coalesce(F.array_max(F.transform("amounts", lambda a: F.abs(a))), F.lit(0))
    r = rows.withColumns(
        {
            "actual": failure("label"), "hard": F.upper("label").isin(HARD_NEGATIVE), "right": F.coalesce(F.col("label") == F.col("predicted_label"), F.lit(False)),
            "detected": F.coalesce("detected_exception", failure("predicted_label"), F.lit(False)), "money": F.when(F.col("amount") > 0, F.col("amount")).otherwise(most),
        }
    )
    hard, detected, right, actual = (F.col(c) for c in ("hard", "detected", "right", "actual"))
    exposure = F.when(hard, F.when(detected, "fp")).when(actual & ~detected, "fn").when(F.col("auto_resolved") & ~right, "fp")
    money = lambda test: F.coalesce(F.sum(F.when(test, F.col("money"))), F.lit(0)).cast("decimal(30,4)")
    known = lambda c: F.try_divide(count_of(stated(f"expected_{c}") == F.col(c)), F.count(stated(f"expected_{c}")))
    scores = r.withColumn("exposure", exposure).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.round(known("root_cause"), 6).alias("root_cause_accuracy"), F.round(known("resolution"), 6).alias("resolution_accuracy"),
        ratio(count_of(hard & detected), count_of(hard)).alias("hard_negative_fpr"), ratio(count_of(F.col("auto_resolved")), F.count(F.lit(1))).alias("automation_rate"),
        money(F.col("exposure") == "fp").alias("fp_exposure"), money(F.col("exposure") == "fn").alias("fn_exposure"), money(right & (detected == actual)).alias("amount_correct"),
    )
    found = set_pr(r.select(*keys, F.col("expected_evidence").alias("expected"), F.col("evidence_ids").alias("predicted")), keys)
    found = found.withColumnsRenamed({"precision": "evidence_precision", "recall": "evidence_recall"})
    return scores.join(binary_detection(r.select(*keys, "actual", detected.alias("predicted")), keys), keys).join(found, keys)


def conservation(lines: DataFrame, key: str) -> DataFrame:
    """Whether debits equal credits, exactly, for each key."""
    d, c = F.sum("debit").cast("decimal(30,4)"), F.sum("credit").cast("decimal(30,4)")
    return lines.groupBy(key).agg(d.alias("debit"), c.alias("credit"), (d - c).cast("decimal(30,4)").alias("variance"), (d == c).alias("balanced"))


def threshold_select(scored: DataFrame, most_fp_rate: float, most_exposure: float) -> DataFrame:
    """Lowest (coverage) and highest (precision) probability at which the selected rows keep to both limits.

    `scored` has probability, label 0 / 1, amount. The running sums go over distinct probabilities, so ties are selected
    together, and over ranges of them, so there may be as many as there are rows.
    """
    by = scored.groupBy("probability").agg(F.count(F.lit(1)).alias("rows"), F.sum(1 - F.col("label")).alias("wrong"), F.sum(F.when(F.col("label") == 0, F.col("amount")).otherwise(0)).alias("money"))
    sums = running_sums(by, [F.col("probability").desc()], {"n": F.col("rows"), "fp": F.col("wrong"), "lost": F.col("money")})
    ok = sums.where((F.col("fp") / F.col("n") <= most_fp_rate) & (F.col("lost") <= most_exposure))
    return ok.agg(F.min("probability").alias("coverage_threshold"), F.max("probability").alias("precision_threshold"))


def calibration_quality(scored: DataFrame) -> DataFrame:
    p, y = F.least(F.greatest("probability", F.lit(1e-6)), F.lit(1 - 1e-6)), F.col("label")
    return scored.agg(F.round(F.avg(F.pow(p - y, F.lit(2.0))), 6).alias("brier"), F.round(-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p)), 6).alias("log_loss"))


def generalization_gate(scored: DataFrame, auto: float, review: float, most_rate: float, most_exposure: float) -> DataFrame:
    """The automatic tier must be free of false positives, the review tier within rate and exposure."""
    wrong = F.col("label") == 0
    tier = lambda t: F.col("probability") >= t
    c = scored.agg(count_of(tier(auto)).alias("auto_selected"), count_of(tier(auto) & wrong).alias("auto_fp"), count_of(tier(review)).alias("review_selected"), count_of(tier(review) & wrong).alias("review_fp"), F.coalesce(F.sum(F.when(tier(review) & wrong, F.col("amount"))), F.lit(0)).cast("decimal(30,4)").alias("review_exposure"))
    passed = (F.col("auto_fp") == 0) & (ratio(F.col("review_fp"), F.col("review_selected")) <= most_rate) & (F.col("review_exposure") <= most_exposure)
    return c.withColumn("passed", passed)


def model_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC-AUC. The area adds up over distinct scores, so ties count half."""
    by = scored.groupBy("probability").agg(count_of(F.col("label") == 1).alias("pos"), count_of(F.col("label") == 0).alias("neg"))
    area = running_sums(by, [F.col("probability")], {"under": F.col("neg")}, before=True)
    area = area.agg(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    auc = F.when((F.col("p") == 0) | (F.col("n") == 0), 0.0).otherwise(F.round(F.col("u") / (F.col("p") * F.col("n")), 6))
    marked = scored.select((F.col("label") == 1).alias("actual"), (F.col("probability") >= threshold).alias("predicted"))
    return binary_detection(marked, []).join(F.broadcast(area.select(auc.alias("auc"))))  # one row each


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
