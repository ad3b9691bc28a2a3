"""Rule joins, one-to-one assignment, allocation and reconciliation of two record tables.

Records have record_id, record_type, external_id, amount, currency, record_date, reference, party, fee_amount. Each
rule is an equi-join; the cascade picks the first rule of a pair; `greedy_select` assigns without reuse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut
from .greedy import greedy_select
from .subset import SMALL, subset_sums

#: Rules in the order of the cascade, with status, confidence and reason codes.
RULES = {
    "currency_mismatch": (1, "EXCEPTION", "0.00", ["CURRENCY_MISMATCH"]),
    "reference": (2, "MATCHED", "1.00", ["EXACT_REFERENCE", "CURRENCY_MATCH"]),
    "external_id": (3, "MATCHED", "1.00", ["EXACT_ID", "CURRENCY_MATCH"]),
    "amount_date": (4, "MATCHED", "0.95", ["EXACT_AMOUNT", "CURRENCY_MATCH"]),
    "timing": (5, "MATCHED", "0.90", ["EXACT_AMOUNT", "AMOUNT_DATE_WINDOW", "KNOWN_TIMING", "CURRENCY_MATCH"]),
    "fee": (6, "EXCEPTION", "0.90", ["KNOWN_FEE", "CURRENCY_MATCH"]),
}


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("record_id", "external_id", "amount", "currency", "record_date", "reference", "fee_amount")])


def _key(c: str) -> Column:
    """Trimmed, case-folded reference; blank is no reference."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def _ids() -> list[Column]:
    return [F.col("s_record_id").alias("source_id"), F.col("t_record_id").alias("target_id")]


def _by_reference(sources: DataFrame, targets: DataFrame) -> DataFrame:
    s, t = _named(sources, "s").withColumn("k", _key("s_reference")), _named(targets, "t").withColumn("k", _key("t_reference"))
    return s.join(t, "k")


def _by_external_id(sources: DataFrame, targets: DataFrame) -> DataFrame:
    s, t = _named(sources, "s"), _named(targets, "t")
    return s.where("s_external_id <> ''").join(t, s["s_external_id"] == t["t_external_id"])


def match_reference(sources: DataFrame, targets: DataFrame, same_currency: bool = True) -> DataFrame:
    """Pairs with one reference, trimmed and case-folded; the amounts do not matter."""
    test = F.col("s_currency") == F.col("t_currency")
    return _by_reference(sources, targets).where(test if same_currency else ~test).select(*_ids()).distinct()


def match_external_id(sources: DataFrame, targets: DataFrame, same_currency: bool = True) -> DataFrame:
    """Pairs with one non-empty external id, case-sensitive."""
    test = F.col("s_currency") == F.col("t_currency")
    return _by_external_id(sources, targets).where(test if same_currency else ~test).select(*_ids()).distinct()


def match_amount(sources: DataFrame, targets: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs of equal currency and amount whose dates differ by low to high days; `days` is the difference.

    Dates meet in cells of 4 * high + 1 days, so that round amounts do not gather in one key; a source is in the one or two
    cells that its window touches.
    """
    s, t = _named(sources, "s"), _named(targets, "t")
    days = F.abs(F.datediff("s_record_date", "t_record_date"))
    cell = lambda c, k: F.floor((F.unix_date(c) + k) / (4 * high + 1))
    s = s.withColumn("_cell", F.explode(F.array_distinct(F.array(cell("s_record_date", -high), cell("s_record_date", high)))))
    t = t.withColumn("_cell_t", cell("t_record_date", 0))
    both = s.join(t, (s["s_currency"] == t["t_currency"]) & (s["s_amount"] == t["t_amount"]) & (s["_cell"] == t["_cell_t"]))
    return both.where(days.between(low, high)).select(*_ids(), days.cast("int").alias("days"))


def match_fee(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs whose amounts differ by the fee of the source, or of the target where the source has none."""
    s, t = _named(sources, "s"), _named(targets, "t")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    kind, on = "decimal(20,4)", ["currency", "k"]
    s, t = s.withColumn("currency", F.col("s_currency")), t.withColumn("currency", F.col("t_currency"))
    wide = lambda a, f: F.explode(F.array((F.col(a) + F.abs(f)).cast(kind), (F.col(a) - F.abs(f)).cast(kind)))
    by_source = s.where(~none("s_fee_amount")).withColumn("k", wide("s_amount", F.col("s_fee_amount"))).join(t.withColumn("k", F.col("t_amount").cast(kind)), on)
    by_target = t.where(~none("t_fee_amount")).withColumn("k", wide("t_amount", F.col("t_fee_amount"))).join(s.where(none("s_fee_amount")).withColumn("k", F.col("s_amount").cast(kind)), on)
    return by_source.select(*_ids()).union(by_target.select(*_ids())).distinct()


def currency_mismatch(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs that share a reference or an external id but not the currency."""
    return match_reference(sources, targets, False).union(match_external_id(sources, targets, False)).distinct()


def rule_pairs(sources: DataFrame, targets: DataFrame, window: int = 3) -> DataFrame:
    """Every pair that a rule joins, once, under the first rule of the cascade. Rules of one key share a join."""
    place = {k: F.lit(r[0]) for k, r in RULES.items()}
    shared = lambda rule: F.when(F.col("s_currency") == F.col("t_currency"), place[rule]).when(F.col("s_currency") != F.col("t_currency"), place["currency_mismatch"]).alias("place")
    every = [
        _by_reference(sources, targets).select(*_ids(), shared("reference")).where("place is not null"),
        _by_external_id(sources, targets).select(*_ids(), shared("external_id")).where("place is not null"),
        match_amount(sources, targets, 0, window).select("source_id", "target_id", F.when(F.col("days") == 0, place["amount_date"]).otherwise(place["timing"])),
        match_fee(sources, targets).withColumn("place", place["fee"]),
    ]
    every = reduce(DataFrame.union, every)
    return with_rule(every.groupBy("source_id", "target_id").agg(F.min("place").alias("place")))


def with_rule(df: DataFrame) -> DataFrame:
    """Spell out the rule at `place`: rule, status, confidence, reasons."""
    pick = lambda value: F.coalesce(*[F.when(F.col("place") == r[0], value(k, r)) for k, r in RULES.items()])
    return df.select("source_id", "target_id", pick(lambda k, r: F.lit(k)).alias("rule"), pick(lambda k, r: F.lit(r[1])).alias("status"), pick(lambda k, r: F.lit(r[2]).cast("decimal(4,2)")).alias("confidence"), pick(lambda k, r: F.array(*map(F.lit, r[3]))).alias("reasons"))


def match_pair(pairs: DataFrame, window: int = 3) -> DataFrame:
    """The cascade for given pairs: columns s_* and t_* of two records in one row."""
    ref = _key("s_reference") == _key("t_reference")
    ext = (F.col("s_external_id") == F.col("t_external_id")) & (F.col("s_external_id") != "")
    days = F.abs(F.datediff("s_record_date", "t_record_date"))
    fee = F.abs(F.when(F.coalesce("s_fee_amount", F.lit(0)) != 0, F.col("s_fee_amount")).otherwise(F.col("t_fee_amount")))
    gap = F.abs(F.col("s_amount") - F.col("t_amount"))
    place = F.when(F.col("s_currency") != F.col("t_currency"), 1).when(ref, 2).when(ext, 3).when((gap == 0) & (days == 0), 4).when((gap == 0) & (days <= window), 5).when((fee != 0) & (gap == fee), 6)
    rules = with_rule(pairs.select(*_ids(), place.alias("place")))
    return rules.select("source_id", "target_id", F.coalesce("rule", F.lit("none")).alias("rule"), F.coalesce("status", F.lit("UNMATCHED")).alias("status"), F.coalesce("confidence", F.lit(0)).cast("decimal(4,2)").alias("confidence"))


def assign_one_to_one(pairs: DataFrame) -> DataFrame:
    """Sources by id take their best free target: highest confidence, then largest id. Mismatches count as pairs."""
    options = pairs.withColumn("option_id", F.concat_ws("|", "source_id", "target_id")).withColumn("resources", F.array(F.concat(F.lit("s:"), "source_id"), F.concat(F.lit("t:"), "target_id")))
    order = [F.col("source_id"), F.col("confidence").desc(), F.col("target_id").desc()]
    return greedy_select(options, order).drop("option_id", "resources")


def _options(groups: DataFrame) -> DataFrame:
    options = groups.withColumn("option_id", F.concat_ws("|", "anchor_id", F.array_join("members", "|")))
    return options.withColumn("resources", F.concat(F.array(F.concat(F.lit("a:"), "anchor_id")), F.transform("members", lambda m: F.concat(F.lit("m:"), m))))


def allocate(anchors: DataFrame, parts: DataFrame, block: tuple[str, ...] = ("currency",), largest: int = 4, positive: bool = False) -> DataFrame:
    """Anchors by id take the first free group of one block: smallest size, then by member ids. Confidence 0.88.

    In a large block larger groups are looked for only for anchors that the smaller ones leave without one, until none
    is left; as an anchor prefers small groups, that gives what the scan over all sizes gives.
    """
    order = [F.col("anchor_id"), F.size("members"), F.col("members")]
    keys = list(block)
    large = cut(parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL[0]).select(*keys), "large-blocks")
    if not large.limit(1).count():
        got = greedy_select(_options(subset_sums(anchors, parts, keys, largest, positive)), order)
        return got.select("anchor_id", "members", F.lit("0.88").cast("decimal(4,2)").alias("confidence"))
    many = anchors.join(large, keys, "left_semi")
    # Anchors of small blocks have their groups of all sizes at once.
    groups = cut(subset_sums(anchors.join(large, keys, "left_anti"), parts, keys, largest, positive), "groups")
    depth = lacking = cut(many.select(F.col("record_id").alias("anchor_id"), F.lit(1).alias("depth")).distinct(), "depth")
    while True:
        for size in range(2, largest + 1):
            own = lacking.where(F.col("depth") == size - 1)
            if own.limit(1).count():
                some = many.join(own.select(F.col("anchor_id").alias("record_id")), "record_id", "left_semi")
                groups = groups.union(cut(subset_sums(some, parts, keys, size, positive, smallest=size), "groups"))
        deeper = lacking.select("anchor_id", F.lit(True).alias("_more"))
        depth = cut(depth.join(deeper, "anchor_id", "left").select("anchor_id", F.when(F.col("_more"), F.least(F.lit(largest), F.col("depth") + 1)).otherwise(F.col("depth")).alias("depth")), "depth")
        got = cut(greedy_select(_options(groups), order), "allocated")
        lacking = cut(depth.where(F.col("depth") < largest).join(got, "anchor_id", "left_anti"), "lacking")
        if not lacking.limit(1).count():
            return got.select("anchor_id", "members", F.lit("0.88").cast("decimal(4,2)").alias("confidence"))


def allocation_flags(pairs: DataFrame) -> DataFrame:
    """(candidate_id, in_allocation): whether a pair belongs to two or three pairs of one record that add up to it.

    `pairs` has candidate_id, source_id, target_id, s_amount, t_amount; either side may be the one that is split.
    """
    found = []
    for whole, part, goal, amount in (("source_id", "target_id", "s_amount", "t_amount"), ("target_id", "source_id", "t_amount", "s_amount")):
        anchors = pairs.select(F.col(whole).alias("own"), F.col(whole).alias("record_id"), F.col(goal).alias("amount")).distinct()
        parts = pairs.select(F.col(whole).alias("own"), F.col(part).alias("record_id"), F.col(amount).alias("amount"))
        found.append(subset_sums(anchors, parts, ["own"], 3, positive=False).select(F.col("anchor_id").alias(whole), F.explode("members").alias(part)))
    flagged = found[0].unionByName(found[1]).distinct().withColumn("in_allocation", F.lit(True))
    return pairs.join(flagged, ["source_id", "target_id"], "left").select("candidate_id", F.coalesce("in_allocation", F.lit(False)).alias("in_allocation"))


def _without(records: DataFrame, used: DataFrame) -> DataFrame:
    return records.join(used.select(F.col(used.columns[0]).alias("record_id")), "record_id", "left_anti")


def result_rows(source_ids: Column, target_ids: Column, status: Column, confidence: Column, reasons: Column) -> list[Column]:
    return [source_ids.alias("source_ids"), target_ids.alias("target_ids"), status.alias("status"), confidence.cast("decimal(4,2)").alias("confidence"), reasons.alias("reasons")]


def unmatched(records: DataFrame, used: DataFrame, source: bool = True) -> DataFrame:
    """Result rows of the records that no result uses."""
    none, own = F.array().cast("array<string>"), F.array("record_id")
    left, right = (own, none) if source else (none, own)
    return _without(records, used).select(*result_rows(left, right, F.lit("UNMATCHED"), F.lit(0), F.array(F.lit("NO_MATCH"))))


def reconcile(sources: DataFrame, targets: DataFrame, window: int = 3, block: tuple[str, ...] = ("currency",), largest: int = 4) -> DataFrame:
    """One-to-one, then one-to-many, then many-to-one, then what is left; each stage sees only the leftovers."""
    pairs = cut(assign_one_to_one(rule_pairs(sources, targets, window)), "assigned")
    s1, t1 = _without(sources, pairs.select("source_id")), _without(targets, pairs.select("target_id"))
    split = cut(allocate(s1, t1, block, largest), "one-to-many")
    s2, t2 = _without(s1, split.select("anchor_id")), _without(t1, split.select(F.explode("members")))
    merged = cut(allocate(t2, s2, block, largest), "many-to-one")
    s3, t3 = merged.select(F.explode("members").alias("record_id")), merged.select("anchor_id")
    matched, exact = F.lit("MATCHED"), F.array(F.lit("EXACT_AMOUNT"))
    out = [
        pairs.select(*result_rows(F.array("source_id"), F.array("target_id"), F.col("status"), F.col("confidence"), F.col("reasons"))),
        split.select(*result_rows(F.array("anchor_id"), F.col("members"), matched, F.col("confidence"), exact)),
        merged.select(*result_rows(F.col("members"), F.array("anchor_id"), matched, F.col("confidence"), exact)),
        unmatched(s2, s3),
        unmatched(t2, t3, False),
    ]
    return reduce(DataFrame.union, out)


def reconcile_stages(stages: list[tuple[str, DataFrame, DataFrame]], **options) -> DataFrame:
    """Independent stages (name, sources, targets), tagged by name; a name may be used once."""
    names = [s[0] for s in stages]
    if len(set(names)) != len(names):
        raise ValueError(f"stage names repeat: {names}")
    return reduce(DataFrame.union, [reconcile(s, t, **options).withColumn("stage", F.lit(name)) for name, s, t in stages])


#: The stages of each template, as places of its tables.
TEMPLATES = {
    "bank": (("bank_to_ledger", 0, 1),),
    "vendor": (("purchase_order_to_invoice", 0, 1), ("invoice_to_ap", 1, 2), ("ap_to_payment", 2, 3)),
    "customer": (("invoice_to_receipt", 0, 1), ("receipt_to_ar", 1, 2)),
}


def reconcile_template(name: str, *tables: DataFrame, **options) -> DataFrame:
    """The stages of a template: bank (transactions, ledger), vendor (orders, invoices, payables, payments) or customer
    (invoices, receipts, receivables)."""
    stages = TEMPLATES[name]
    if len(tables) != 1 + max(t for _, _, t in stages):
        raise ValueError(f"{name} takes {1 + max(t for _, _, t in stages)} tables, not {len(tables)}")
    return reconcile_stages([(stage, tables[s], tables[t]) for stage, s, t in stages], **options)


def decision_audit(results: DataFrame) -> DataFrame:
    """One audit row per result: the entity is the first source, else the first target."""
    entity = F.coalesce(F.get("source_ids", F.lit(0)), F.get("target_ids", F.lit(0)))
    return results.select(F.lit("RECONCILIATION_DECISION").alias("event_type"), F.lit("reconciliation").alias("entity_type"), entity.alias("entity_id"), "status", F.array_join("reasons", ",").alias("reason"))


def exception_queue(results: DataFrame) -> DataFrame:
    return results.where(F.col("status").isin("EXCEPTION", "UNMATCHED"))
