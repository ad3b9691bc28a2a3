"""Records as a graph: blocked candidate edges, allocation along edges, pairs and lineage paths."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut
from .greedy import greedy_select
from .subset import subset_sums

#: The stages of a record's life, in order; other types come last.
STAGES = ("invoice", "payment", "processor", "settlement", "bank_transaction", "ledger_entry")
#: An amount within this tolerance scores 0.80.
CLOSE_AMOUNT = "10.00"


def stage_rank(record_type: Column) -> Column:
    return F.coalesce(*[F.when(record_type == s, i) for i, s in enumerate(STAGES)], F.lit(len(STAGES)))


def amount_bucket(amount: Column) -> Column:
    """0 up to amount 0, else 100 for each whole power of ten, at least 1."""
    return F.when(amount <= 0, 0).otherwise(F.greatest(F.lit(1), (F.floor(F.log10(amount.cast("double"))) * 100).cast("int"))).cast("int")


def blocking_keys(records: DataFrame) -> DataFrame:
    prefix = F.substring(F.lower(F.trim(F.coalesce("reference", "external_id"))), 1, 3)
    return records.select("record_id", "currency", amount_bucket(F.col("amount")).alias("amount_bucket"), F.col("record_date").alias("date_bucket"), F.lower(F.trim("party")).alias("party_key"), prefix.alias("reference_prefix"))


def entity_nodes(records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return records.select(F.col("record_id").alias("node_id"), F.col("record_type").alias("node_type"), stage_rank(F.col("record_type")).alias("stage"), "amount", "currency", F.col("record_date").alias("node_date"), F.coalesce("reference", "external_id").alias("reference"), "party", F.coalesce("fee_amount", F.lit(0)).cast("decimal(20,4)").alias("fee"), *carry)


#: Records of one cell that one task meets with as many of another; larger cells are split into a grid.
CELL, MOST_CELLS = 20_000, 100_000


def _grid(left: DataFrame, right: DataFrame, keys: list[str], cell: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with `_i` and `_j`: a key of more than `cell` rows is a grid, in which each part of one side meets each of the other."""
    n = lambda rows, name: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > cell)
    heavy = n(left, "_na").join(n(right, "_nb"), keys, "full_outer")
    parts = lambda name: F.ceil(F.coalesce(name, F.lit(1)) / cell).cast("int")
    # At most as many keys as hold more than `cell` rows each, which the caller has bounded.
    heavy = F.broadcast(heavy.select(*keys, parts("_na").alias("_ka"), parts("_nb").alias("_kb")))

    def dealt(rows: DataFrame, own: str, other: str, mine: str, its: str, node: str) -> DataFrame:
        rows = rows.join(heavy, keys, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_ka", "_kb")})
        rows = rows.withColumn(mine, F.pmod(F.xxhash64(node), F.col(own)).cast("int"))
        return rows.withColumn(its, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_ka", "_kb")

    return dealt(left, "_ka", "_kb", "_i", "_j", "a_node_id"), dealt(right, "_kb", "_ka", "_j", "_i", "b_node_id")


def _gap(a: str, b: str) -> Column:
    """The difference of two amounts given by whole and rest, in units of the fourth decimal; right up to CLOSE_AMOUNT, and larger than it where the true one is."""
    most = int(Decimal(CLOSE_AMOUNT)) + 1
    whole = F.least(F.greatest(F.col(f"{a}whole") - F.col(f"{b}whole"), F.lit(-most)), F.lit(most))
    return F.abs(whole * 10_000 + F.col(f"{a}rest") - F.col(f"{b}rest"))


def candidate_edges(records: DataFrame, window: int = 3, only_across: bool = False, by_reference: bool = False, cell: int = CELL, one_party: bool = False, carry: tuple[str, ...] = (), close: bool = False) -> DataFrame:
    """Unordered pairs of one currency within `window` days and two powers of ten, oriented by stage, then id.

    An equi-join on currency, date cells of window + 1 days and cells of three powers of ten. A cell meets itself and the neighbours on
    one side of it, so each pair is looked at once; with `only_across` the records of a stage meet those of later stages in all
    neighbours, so that no pair of one type is looked at. A cell that holds many records is a grid of tasks. Equal amounts
    score 0.95 on one day and 0.90 on two, near ones 0.80, others 0.50; with `by_reference` a shared reference scores
    0.95 and equal amounts 0.90 on every day. With `one_party` records meet those of their own party only, with `close` those
    whose amount differs by CLOSE_AMOUNT at most, by cells of that size. Columns named by `carry` go along from both records, as s_* and t_*.
    """
    key = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    rows = entity_nodes(records, carry).withColumns({"bucket": amount_bucket(F.col("amount")), "whole": F.floor("amount").cast("long")})
    rows = rows.where("currency is not null and party is not null" if one_party else "currency is not null")
    size = F.floor(F.col("amount") / F.lit(CLOSE_AMOUNT).cast("decimal(20,4)")) if close else F.floor(F.col("bucket") / 300)
    rest = ((F.col("amount") - F.col("whole")) * 10_000).cast("int")
    node = ["node_id", "node_type", "stage", "node_date", "bucket", "whole", "rest", *(["reference"] if by_reference else []), *carry]
    rows = rows.withColumns({"rest": rest, "reference": key("reference"), "day": F.floor(F.unix_date("node_date") / (window + 1)), "size": size.cast("long")}).where("day is not null and size is not null")
    own = ["currency", "day", "size", *(["party"] if one_party else [])]
    # There are few stages and few powers of ten; cells of those that no record has are not asked for.
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.collect_set("stage").alias("stages"), F.lit(None) if close else F.collect_set("size").alias("sizes")).first()
    stages, few = sorted(known["stages"]), (lambda c: F.lit(True)) if close else (lambda c: c.isin(known["sizes"]))
    side = lambda df, name, *more: df.select(*keys, *more, *[F.col(c).alias(f"{name}_{c}") for c in node])
    if only_across:
        keys = [*own, "from_stage"]
        offsets = [(d, k, g) for d in (-1, 0, 1) for k in (-1, 0, 1) for g in stages or [0]]
        later = (F.col("o.g") < F.col("stage")) | ((F.col("o.g") == len(STAGES)) & (F.col("stage") == len(STAGES)))
    else:
        keys = own
        offsets = [(d, k, 0) for d, k in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]
        later = F.lit(True)
    a = side(rows.withColumn("from_stage", F.col("stage")), "a")
    o = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(k).alias("k"), F.lit(g).alias("g")) for d, k, g in offsets]))
    b = rows.withColumn("o", o).where(later & few(F.col("size") - F.col("o.k"))).withColumn("from_stage", F.col("o.g"))
    b = side(b.withColumns({"day": F.col("day") - F.col("o.d"), "size": F.col("size") - F.col("o.k"), "own": (F.col("o.d") == 0) & (F.col("o.k") == 0)}), "b", "own")
    # Each record is in few keys, so at most MOST_CELLS keys are heavy.
    a, b = _grid(a, b, keys, max(cell, (1 + len(offsets)) * known["n"] // MOST_CELLS))
    first = (F.col("a_stage") < F.col("b_stage")) | ((F.col("a_stage") == F.col("b_stage")) & (F.col("a_node_id") < F.col("b_node_id")))
    test = (F.abs(F.datediff("a_node_date", "b_node_date")) <= window) & (F.abs(F.col("a_bucket") - F.col("b_bucket")) <= 200)
    if only_across:
        test &= (F.col("a_stage") < F.col("b_stage")) | (first & (F.col("a_node_type") != F.col("b_node_type")))
    else:
        test &= first | ~F.col("own")
    gap, bound = _gap("a_", "b_"), int(Decimal(CLOSE_AMOUNT) * 10_000)
    both = a.join(b, [*keys, "_i", "_j"]).where(test & (gap <= bound) if close else test)
    best = F.coalesce(F.col("a_reference") == F.col("b_reference"), F.lit(False)) if by_reference else (gap == 0) & (F.col("a_node_date") == F.col("b_node_date"))
    score = F.when(best, "0.95").when(gap == 0, "0.90").when(gap <= bound, "0.80").otherwise("0.50").cast("decimal(4,2)")
    s, t = (lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")) if only_across else (lambda c: F.when(first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")), lambda c: F.when(first, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")))
    return both.select(s("node_id").alias("source_id"), t("node_id").alias("target_id"), s("node_type").alias("source_type"), t("node_type").alias("target_type"), "currency", score.alias("score"), *[end(c).alias(f"{name}_{c}") for name, end in (("s", s), ("t", t)) for c in carry])


def candidate_batch(sources: DataFrame, targets: DataFrame, window: int = 3, by_reference: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cross-type candidates with id `source:target`."""
    edges = candidate_edges(sources.unionByName(targets), window, only_across=True, by_reference=by_reference, carry=carry)
    return edges.withColumn("candidate_id", F.concat_ws(":", "source_id", "target_id"))


def graph_allocations(records: DataFrame, edges: DataFrame, largest: int = 4) -> DataFrame:
    """Anchors by stage and id take a free group of one type along their edges whose amounts add up (0.88), or add up
    but for the fees of the anchor and the group (0.82): first all anchors along their out-edges, then along their in-edges.

    Fees come off the whole: off the anchor on out-edges, off the group on in-edges."""
    nodes = entity_nodes(records)
    ends = edges.select(F.col("source_id").alias("anchor"), F.col("target_id").alias("other"), F.lit(0).alias("way")).union(edges.select(F.col("target_id").alias("anchor"), F.col("source_id").alias("other"), F.lit(1).alias("way")))
    other = nodes.select(F.col("node_id").alias("other"), F.col("node_type").alias("other_type"), F.col("amount").alias("part"), F.col("fee").alias("part_fee"))
    own = nodes.select(F.col("node_id").alias("anchor"), "stage", F.col("amount").alias("goal"), F.col("fee").alias("own_fee"))
    parts = ends.join(other, "other").withColumn("place", F.concat_ws("|", "anchor", "way", "other_type"))
    kind, turn = "decimal(20,4)", lambda c: F.when(F.col("way") == 0, F.abs(c)).otherwise(-F.abs(c))
    singles = parts.select("place", F.col("other").alias("record_id"), (F.col("part") + turn("part_fee")).cast(kind).alias("amount"))
    plain = parts.select(F.col("place"), F.col("other").alias("record_id"), F.col("part").alias("amount"))
    goals = parts.select("anchor", "place", "way").distinct().join(own, "anchor")
    exact = subset_sums(goals.select("place", F.col("place").alias("record_id"), F.col("goal").alias("amount")), plain, ["place"], largest, positive=False)
    with_fee = subset_sums(goals.select("place", F.col("place").alias("record_id"), (F.col("goal") - turn("own_fee")).cast(kind).alias("amount")), singles, ["place"], largest, positive=False)
    # A group that adds up with its fees and without has none.
    with_fee = with_fee.join(exact, ["anchor_id", "members"], "left_anti").withColumn("confidence", F.lit("0.82"))
    exact = exact.withColumn("confidence", F.lit("0.88"))
    found = exact.union(with_fee).join(goals.select(F.col("place").alias("anchor_id"), "anchor", "stage", "way"), "anchor_id")
    options = found.withColumn("option_id", F.concat_ws("|", "anchor_id", "confidence", F.array_join("members", "|"))).withColumn("resources", F.concat(F.array("anchor"), "members"))
    got = greedy_select(options, [F.col("way"), F.col("stage"), F.col("anchor"), F.size("members"), F.col("members"), F.col("confidence").desc()])
    return got.select(F.col("anchor").alias("anchor_id"), "members", F.col("confidence").cast("decimal(4,2)").alias("confidence"))


def graph_pairs(edges: DataFrame, used: DataFrame | None = None, min_score: str = "0.50") -> DataFrame:
    """Nodes by id take their best free out-edge, ties to the smallest target; `used` (record_id) are taken already."""
    live = edges.where(F.col("score") >= F.lit(min_score).cast("decimal(4,2)"))
    if used is not None:
        for end in ("source_id", "target_id"):
            live = live.join(used.select(F.col("record_id").alias(end)), end, "left_anti")
    options = live.withColumn("option_id", F.concat_ws("|", "source_id", "target_id")).withColumn("resources", F.array("source_id", "target_id"))
    got = greedy_select(options, [F.col("source_id"), F.col("score").desc(), F.col("target_id")])
    return got.select("source_id", "target_id", F.col("score").alias("confidence"))


def lineage_paths(edges: DataFrame, most_nodes: int = 5, min_score: float = 0.5, inner: DataFrame | None = None) -> DataFrame:
    """Stage-forward paths of 2 to `most_nodes` nodes whose product of scores (1 at most) stays at `min_score`, pruned each hop.

    An edge that falls below `min_score` with the best score of any other is on no longer path. A caller that knows the
    others gives them as `inner`; only these are joined, while the paths of one edge are the edges as they come.
    """
    forward = lambda e: e.where(stage_rank(F.col("source_type")) < stage_rank(F.col("target_type")))
    score = F.col("score").cast("double")
    out = [forward(edges).where(score >= min_score).select(F.concat_ws(">", "source_id", "target_id").alias("path"), F.lit(2).alias("n_nodes"), F.round(score, 6).alias("confidence"))]
    steps = cut(forward(edges if inner is None else inner).where(score >= min_score - 1e-12).select("source_id", "target_id", score.alias("score")), "lineage-steps")
    paths = steps.where(F.col("score") >= min_score).select(F.concat_ws(">", "source_id", "target_id").alias("path"), F.col("target_id").alias("last"), F.col("score").alias("before"))
    for n in range(3, most_nodes + 1):
        paths = paths.join(steps, F.col("last") == steps["source_id"]).withColumn("product", F.col("before") * F.col("score")).where(F.col("product") >= min_score - 1e-12)
        paths = cut(paths.select(F.concat_ws(">", "path", "target_id").alias("path"), F.col("target_id").alias("last"), F.col("product").alias("before")), "lineage-paths")
        out.append(paths.select("path", F.lit(n).alias("n_nodes"), F.round("before", 6).alias("confidence")))
    return reduce(DataFrame.union, out)


def reconcile_graph(records: DataFrame, window: int = 3, largest: int = 4) -> DataFrame:
    """Allocations, then pairs among the rest, then unmatched records: (kind, ids, confidence)."""
    edges = cut(candidate_edges(records, window), "edges")
    groups = cut(graph_allocations(records, edges, largest), "graph-groups")
    used = groups.select(F.explode(F.concat(F.array("anchor_id"), "members")).alias("record_id"))
    pairs = cut(graph_pairs(edges, used), "graph-pairs")
    taken = used.union(pairs.select(F.explode(F.array("source_id", "target_id"))))
    alone = records.join(taken, "record_id", "left_anti")
    return (
        groups.select(F.lit("allocation").alias("kind"), F.concat(F.array("anchor_id"), "members").alias("ids"), "confidence")
        .union(pairs.select(F.lit("pair"), F.array("source_id", "target_id"), "confidence"))
        .union(alone.select(F.lit("unmatched"), F.array("record_id"), F.lit(0).cast("decimal(4,2)")))
    )
