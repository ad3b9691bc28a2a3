"""Approval policy, journal checks, review state, search and operational reports."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import cut
from .graph import candidate_batch
from .matching import allocation_flags

#: The default rules in order: (test, decision, rule). `above` and `below` are strict.
POLICY_RULES = [
    ("unresolved", "HUMAN_REVIEW", "UNRESOLVED_EXCEPTION"),
    ("root_cause_confidence IS NOT NULL AND root_cause_confidence < 0.8", "HUMAN_REVIEW", "LOW_CONFIDENCE"),
    ("amount > 5000", "HUMAN_REVIEW", "HIGH_AMOUNT"),
    ("exact_match AND amount < 5000", "AUTO_APPROVE", "EXACT_LOW_AMOUNT"),
    ("known_variance AND evidence_complete AND amount < 5000", "AUTO_APPROVE", "KNOWN_VARIANCE"),
]


def policy_decision(actions: DataFrame, rules: list[tuple[str, str, str]] = POLICY_RULES) -> DataFrame:
    """Missing required evidence goes to a human first; then the first rule that fits; else a human."""
    missing = F.array_sort(F.array_except("required_evidence", "supplied_evidence"))
    decision, why = F.when(F.size(missing) > 0, "HUMAN_REVIEW"), F.when(F.size(missing) > 0, "MISSING_EVIDENCE")
    for test, outcome, name in rules:
        decision, why = decision.when(F.expr(test), outcome), why.when(F.expr(test), name)
    return actions.select("action_id", decision.otherwise("HUMAN_REVIEW").alias("decision"), why.otherwise("NO_AUTOMATION_RULE").alias("rule"), F.array_join(missing, ",").alias("missing"))


def journal_validation(journals: DataFrame, lines: DataFrame, closed: DataFrame, executed: DataFrame) -> DataFrame:
    """Reasons, in order, that a journal may not be posted. Closed periods are (period), executed keys (idempotency_key)."""
    bad_line = F.count_if((F.col("debit") < 0) | (F.col("credit") < 0) | ((F.col("debit") != 0) & (F.col("credit") != 0)) | F.col("account_code").isNull())
    sums = lines.groupBy("journal_id").agg(F.count(F.lit(1)).alias("n"), F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.count_distinct("currency").alias("k"), bad_line.alias("bad"))
    j = journals.join(sums, "journal_id", "left").join(closed.select("period", F.lit(True).alias("is_closed")).distinct(), "period", "left").join(executed.select("idempotency_key", F.lit(True).alias("done")).distinct(), "idempotency_key", "left")
    checks = [
        (~F.col("policy").isin("POST", "PROPOSE"), "POLICY_DISALLOWS_ACTION"), (F.col("done"), "DUPLICATE_ACTION"), (F.col("is_closed"), "CLOSED_PERIOD"), (~F.col("source_records_valid"), "INVALID_SOURCE_RECORDS"),
        (F.col("already_reconciled"), "ALREADY_RECONCILED"), (F.col("llm_generated"), "LLM_GENERATED_JOURNAL_FORBIDDEN"), (F.col("n").isNull(), "EMPTY_JOURNAL"), (F.col("k") > 1, "INVALID_CURRENCY"),
        (F.col("d") != F.col("c"), "UNBALANCED_JOURNAL"), (F.col("bad") > 0, "INVALID_JOURNAL_LINE"),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for test, name in checks]))
    return j.select("journal_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("valid"))


def review_state(decisions: DataFrame) -> DataFrame:
    """The first valid decision of each review; a decision needs an actor and a reason."""
    first = Window.partitionBy("review_id").orderBy("decided_at", "decision_id")
    ok = decisions.where("actor <> '' and reason <> '' and decision in ('AUTO_APPROVE', 'REJECT', 'ESCALATE', 'APPROVE')")
    return ok.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")


def pending_reviews(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    return reviews.where("action = 'HUMAN_REVIEW'").join(review_state(decisions), "review_id", "left_anti")


def record_search(records: DataFrame, term: str, fields: list[str], record_type: str | None = None, limit: int = 30) -> DataFrame:
    """Records that hold the term in a field, case-folded; the first `limit` by id."""
    found = records.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(term.lower())))
    return (found.where(F.col("record_type") == record_type) if record_type else found).orderBy("record_id").limit(limit)


def records_of(records: DataFrame, record_type: str, record_id=None) -> DataFrame:
    """Records of one type; with an id that one, if it is of the type."""
    own = records.where(F.lower("record_type") == record_type.lower())
    return own if record_id is None else own.where(F.col("record_id") == record_id)


def document_search(docs: DataFrame, term: str, fields: list[str], limit: int = 30) -> DataFrame:
    """Documents that hold the trimmed term in a field, case-folded; the first `limit` by id."""
    needle = F.lit(term.strip().lower())
    test = F.exists(F.array(*[F.lower(F.coalesce(f, F.lit(""))) for f in fields]), lambda x: F.contains(x, needle))
    return docs.where(test).orderBy("doc_id").limit(limit)


def document_page(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Of the asked pages (doc_id, page) those that exist; a document without a page count has any."""
    known = docs.select("doc_id", "page_count")
    return asked.join(known, "doc_id").where("page_count is null or page_count = 0 or page <= page_count")


def newest(rows: DataFrame, order: list[str], limit: int = 100) -> DataFrame:
    """The newest rows, 1 to 500 of them."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(min(500, max(1, limit)))


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], most: int, place: str = "place") -> DataFrame:
    """The first `most` rows of each key with their `place`. Spark keeps so many of each key in every task before it shuffles them."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= most)


def related_records(records: DataFrame, identifiers: list[Column], limit: int = 30) -> DataFrame:
    """(record_id, related_id): records that share an identifier, the first `limit` of each by id.

    Of an identifier's records only the first `limit` + 1 can be among the first of another record, so no more of them are met
    with each of its records.
    """
    each = records.select("record_id", F.explode(F.array_compact(F.array(*identifiers))).alias("k")).where("k <> ''").distinct()
    shown = first_rows(each.withColumnRenamed("record_id", "related_id"), ["k"], [F.col("related_id")], limit + 1).drop("place")
    pairs = each.join(shown, "k").where("record_id <> related_id").select("record_id", "related_id").distinct()
    return first_rows(pairs, ["record_id"], [F.col("related_id")], limit).drop("place")


def ranker_coverage(candidates: DataFrame, ranks: DataFrame) -> DataFrame:
    """(candidate_id, problem) where a candidate has not exactly one rank, or a rank is eligible without review."""
    by = ranks.groupBy(F.col("candidate_id").alias("ranked")).agg(F.count(F.lit(1)).alias("n"), F.bool_or("auto_eligible").alias("auto"))
    both = candidates.select("candidate_id").join(by, F.col("candidate_id") == F.col("ranked"), "full_outer")
    problem = (
        F.when(F.col("candidate_id").isNull(), "rank without candidate").when(F.col("ranked").isNull(), "candidate without rank")
        .when(F.col("n") > 1, "candidate ranked twice").when(F.col("auto"), "rank is auto-eligible")
    )
    return both.select(F.coalesce("candidate_id", "ranked").alias("candidate_id"), problem.alias("problem")).where("problem is not null")


def entity_history(events: DataFrame, entity: str, value, order: list[str]) -> DataFrame:
    """All events of one entity with their `place` in the given order."""
    return events.where(F.col(entity) == value).withColumn("place", F.row_number().over(Window.partitionBy(entity).orderBy(*order)))


def document_status(rows: DataFrame) -> DataFrame:
    """FAILED with any row error, else PARSED."""
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("error").alias("n_errors")).withColumn("status", F.when(F.col("n_errors") > 0, "FAILED").otherwise("PARSED"))


def confirmed(status: DataFrame) -> DataFrame:
    """Only parsed documents without errors may be confirmed."""
    return status.where("status = 'PARSED' and n_errors = 0").withColumn("status", F.lit("CONFIRMED"))


def content_dedupe(docs: DataFrame) -> DataFrame:
    """The first document of each SHA-256 of the content, and how many there are."""
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def dashboard(results: DataFrame) -> DataFrame:
    """Counts of one run; exception_count is the number that the reference calls amount at risk."""
    total, matched = F.count(F.lit(1)), F.count_if(F.col("status") == "MATCHED")
    return results.agg(total.alias("total"), matched.alias("matched"), F.count_if(F.col("status").isin("EXCEPTION", "UNMATCHED")).alias("exception_count"), F.floor(100 * matched / F.greatest(total, F.lit(1))).cast("long").alias("reconciliation_rate"))


def trace_summary(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(kind == "model").alias("model_calls"), F.count_if(kind == "tool").alias("tool_calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("duration_ms"), 4).alias("duration_ms"))


def extraction_check(rows: DataFrame) -> DataFrame:
    """Extracted names against the declared ones: undeclared, and unresolved in order."""
    return rows.select("doc_id", F.array_join(F.array_sort(F.array_except("present", "declared")), ",").alias("undeclared"), F.array_join(F.array_sort(F.array_except("declared", "present")), ",").alias("unresolved"))


def rival_counts(candidates: DataFrame) -> DataFrame:
    """Other candidates that share a record with each pair candidate."""
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    return candidates.withColumn("rivals", n("source_id") + n("target_id") - 2)


def _points(candidates: DataFrame) -> Column:
    """The score in decimal arithmetic: that of its text, so that 0.1 is a tenth."""
    score = F.col("score")
    return (score if candidates.schema["score"].dataType.typeName() == "decimal" else score.cast("string")).cast("decimal(10,6)")


def review_mask(candidates: DataFrame, threshold: str = "0.50", margin: str = "0.05") -> DataFrame:
    """Candidates at the threshold that beat every rival on either record by the margin, in decimal arithmetic.

    A record's best two candidates tell the best rival of each of them, and the best that of the others.
    """
    base = cut(candidates.select("candidate_id", "source_id", "target_id", "score", _points(candidates).alias("d"), F.lit(True).alias("competes")), "review-mask")
    rows = _reviewed(base, ["candidate_id", "source_id", "target_id", "score"], threshold, margin)
    return rows.withColumn("review", F.when(F.col("score").isNotNull(), F.col("review")))


def _reviewed(base: DataFrame, keep: list[str], threshold: str, margin: str) -> DataFrame:
    """The columns `keep` of `base` with `review`; it has candidate_id, both ids, the score `d` and whether the candidate `competes`.

    With a margin only the best candidate of a record can be ahead of its rivals, so at most one of each record is joined back.
    """
    rows, ahead = base, None
    for side in ("source_id", "target_id"):
        two = first_rows(base.where("competes").select(side, "candidate_id", "d"), [side], [F.col("d").desc(), F.col("candidate_id")], 2)
        at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
        two = two.groupBy(side).agg(at(1, "candidate_id").alias("_best"), at(1, "d").alias("_most"), at(2, "d").alias("_next"))
        best = two.select(F.col("_best").alias("candidate_id"), F.col("_most").alias("d"), "_next").where(_beats(F.col("_next"), threshold, margin)).select("candidate_id")
        ahead = best if ahead is None else ahead.join(best, "candidate_id", "left_semi")
        rival = F.when(F.col("candidate_id") == F.col("_best"), F.col("_next")).otherwise(F.col("_most"))
        rows = rows.join(two, side, "left").withColumn(f"rival_{side}", rival).drop("_best", "_most", "_next")
    if Decimal(margin) < Decimal("0.000001"):
        review = F.col("competes") & _beats(F.greatest("rival_source_id", "rival_target_id"), threshold, margin)
        return rows.select(*keep, F.coalesce(review, F.lit(False)).alias("review"))
    marked = ahead.select("candidate_id", F.lit(True).alias("_ahead"))
    return base.select(*{"candidate_id": 0, **dict.fromkeys(keep)}).join(marked, "candidate_id", "left").select(*keep, F.coalesce("_ahead", F.lit(False)).alias("review"))


def _beats(rival: Column, threshold: str, margin: str) -> Column:
    """Whether the score `d` is at the threshold and ahead of the best rival, if any, by the margin."""
    return (F.col("d") >= F.lit(threshold).cast("decimal(10,6)")) & (rival.isNull() | (F.col("d") - rival >= F.lit(margin).cast("decimal(10,6)")))


def record_rivalry(candidates: DataFrame) -> DataFrame:
    """(record_id, as_source, as_target): of each record its number of candidates (n), the best score (most), how many have it (ties)
    and the next score (next), on either side.

    Candidates are counted by record and score within tasks, so few rows are shuffled where scores repeat.
    """
    ends = candidates.select("score", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source_id").alias("id")), F.struct(F.lit(1).alias("side"), F.col("target_id").alias("id")))).alias("e"))
    by_score = ends.groupBy(F.col("e.id").alias("record_id"), F.col("e.side").alias("side"), "score").agg(F.count(F.lit(1)).alias("n"))
    by_score = by_score.groupBy("record_id", "side", _points(candidates).alias("d")).agg(F.sum("n").alias("n"))
    own = Window.partitionBy("record_id", "side")
    by_score = by_score.withColumns({"all": F.sum("n").over(own), "place": F.row_number().over(own.orderBy(F.col("d").desc()))}).where("place <= 2")
    at = lambda side, place, c: F.max(F.when((F.col("side") == side) & (F.col("place") == place), F.col(c)))
    of = lambda side: F.struct(at(side, 1, "all").alias("n"), at(side, 1, "d").alias("most"), at(side, 1, "n").alias("ties"), at(side, 2, "d").alias("next"))
    return by_score.groupBy("record_id").agg(of(0).alias("as_source"), of(1).alias("as_target"))


def candidates_with_rivalry(sources: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """`candidate_batch` with `rivals`, `rival_source` and `rival_target`: how many candidates share a record with each, and
    the best score of the others on either record.

    There are far more candidates than records, so they are made twice: once to be counted, once from records that carry
    their counts. No candidate is written or shuffled.
    """
    per_record = cut(record_rivalry(candidate_batch(sources, targets, **options)), "rivalry")
    sources, targets = (rows.join(per_record, "record_id", "left") for rows in (sources, targets))
    rows = candidate_batch(sources, targets, **options, carry=("as_source", "as_target"))
    d = _points(rows)
    other = lambda x: F.when((d < F.col(f"{x}.most")) | (F.col(f"{x}.ties") > 1), F.col(f"{x}.most")).otherwise(F.col(f"{x}.next"))
    new = {"rivals": F.col("s_as_source.n") + F.col("t_as_target.n") - 2, "rival_source": other("s_as_source"), "rival_target": other("t_as_target")}
    return rows.withColumns(new).drop("s_as_source", "s_as_target", "t_as_source", "t_as_target")


def batch_review_mask(sources: DataFrame, targets: DataFrame, threshold: str = "0.50", margin: str = "0.05", **options) -> DataFrame:
    """`review_mask` of the `candidate_batch` of two tables, without writing or shuffling the candidates."""
    rows = candidates_with_rivalry(sources, targets, **options)
    rows = rows.withColumn("d", _points(rows))
    return rows.select("candidate_id", "source_id", "target_id", "score", _beats(F.greatest("rival_source", "rival_target"), threshold, margin).alias("review"))


def review_suggestions(candidates: DataFrame) -> DataFrame:
    """The first reason that holds a candidate back, or a proposal for review."""
    rows = review_mask(candidates).join(rival_counts(candidates).select("candidate_id", "rivals"), "candidate_id")
    reason = F.when(F.col("rivals") == 0, "INSUFFICIENT_CANDIDATE_SET").when(F.col("score").cast("decimal(10,6)") < F.lit("0.50").cast("decimal(10,6)"), "BELOW_REVIEW_THRESHOLD").when(~F.col("review"), "AMBIGUOUS_RECORD_MATCH").otherwise("PENDING_REVIEW")
    return rows.select("candidate_id", "rivals", reason.alias("outcome"))


def review_outcomes(candidates: DataFrame, records: DataFrame, metadata: dict) -> DataFrame:
    """(candidate_id, rivals, outcome) of pair candidates and, as `type:record_id`, of the records that have none.

    The first of: part of an allocation, totals that differ, no rivals, the ranker's reason; else a proposal for review.
    `records` are those that the candidates were made of.
    """
    sides = candidates
    for side in ("source", "target"):
        own = records.select(F.col("record_id").alias(f"{side}_id"), F.col("amount").alias(f"{side[0]}_amount"), F.col("currency").alias(f"{side}_currency"), F.col("party").alias(f"{side}_party"))
        sides = sides.join(own, f"{side}_id")
    sides = cut(sides, "review-candidates")
    rows = sides.join(allocation_flags(sides), "candidate_id").join(rival_counts(sides).select("candidate_id", "rivals"), "candidate_id")
    rows = rows.join(rank_candidates(sides, metadata).select("candidate_id", "suggestion", "reason"), "candidate_id")
    outcome = (
        F.when(F.col("in_allocation"), "UNSUPPORTED_ALLOCATION").when(F.col("s_amount") != F.col("t_amount"), "UNSUPPORTED_PARTIAL_PAYMENT").when(F.col("rivals") == 0, "INSUFFICIENT_CANDIDATE_SET")
        .when(F.col("suggestion") != "REVIEW", F.col("reason")).otherwise("PENDING_REVIEW")
    )
    covered = sides.select(F.col("source_id").alias("record_id")).union(sides.select("target_id")).distinct()
    alone = records.join(covered, "record_id", "left_anti").select(F.concat_ws(":", "record_type", "record_id"), F.lit(0).cast("long"), F.lit("NO_CANDIDATES"))
    return rows.select("candidate_id", "rivals", outcome.alias("outcome")).union(alone)


def rank_candidates(candidates: DataFrame, metadata: dict, policy: str = "separated") -> DataFrame:
    """Suggestion and first reason of scored candidates; none is ever eligible for an automatic action.

    `candidates` has candidate_id, score, and of both records id, type, currency and party (source_*, target_*).
    `metadata` is the stored model's: review_threshold, review_gate_passed, review_policy, relationships. Candidates
    of two currencies or of two known parties compete with nothing. Best first: order by score, then by id.
    """
    threshold = metadata.get("review_threshold")
    one_currency = F.col("source_currency") == F.col("target_currency")
    party = lambda c: F.nullif(F.lower(F.trim(f"{c}_party")), F.lit(""))
    one_party = F.coalesce(party("source") == party("target"), F.lit(True))
    supported = F.concat_ws("->", "source_type", "target_type").isin(metadata.get("relationships", []))
    passed, same_policy = F.lit(bool(metadata.get("review_gate_passed"))), F.lit(metadata.get("review_policy") == policy)
    # What the reason needs of the records, so that the candidates go through the joins once and narrow.
    needs = {"one_currency": one_currency, "one_party": one_party, "supported": supported}
    rows = candidates.select("candidate_id", "source_id", "target_id", "score", *[test.alias(c) for c, test in needs.items()])
    one_currency, one_party, supported = map(F.col, needs)
    if threshold is None:
        rows = rows.withColumn("review", F.lit(False))
    else:
        rows = rows.withColumns({"d": _points(candidates), "competes": F.coalesce(one_currency & one_party, F.lit(False))})
        rows = _reviewed(cut(rows, "ranked"), ["candidate_id", "score", *needs], threshold, "0.05")
    review = F.col("review") & supported & passed & same_policy
    reason = (
        F.when(~F.coalesce(one_currency, F.lit(False)), "CURRENCY_MISMATCH").when(~one_party, "PARTY_CONFLICT").when(F.lit(threshold is None), "MODEL_NOT_CALIBRATED").when(~passed, "MODEL_NOT_VALIDATED")
        .when(~supported, "OUT_OF_DISTRIBUTION_RELATIONSHIP").when(~same_policy, "INCOMPATIBLE_REVIEW_POLICY").when(review, "REVIEW_ONLY_MODEL")
        .when(F.col("score").cast("string").cast("decimal(10,6)") >= F.lit(threshold).cast("decimal(10,6)"), "AMBIGUOUS_RECORD_MATCH").otherwise("BELOW_REVIEW_THRESHOLD")
    )
    return rows.select("candidate_id", "score", F.when(review, "REVIEW").otherwise("UNRESOLVED").alias("suggestion"), F.lit(False).alias("automatic_action_eligible"), reason.alias("reason"))


def journal_balance(journals: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether each journal has lines and its debits equal its credits, exactly."""
    sums = lines.groupBy("journal_id").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"))
    return journals.select("journal_id").join(sums, "journal_id", "left").select("journal_id", F.coalesce(F.col("d") == F.col("c"), F.lit(False)).alias("balanced"))
