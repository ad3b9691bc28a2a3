"""N-gram Jaccard join in the metric space of Jaccard distance.

Linked documents (Jaccard similarity of 5-word shingle sets of at least `percent`/100) are found exactly:

1. Copies. Documents with one shingle set form a class, which is compared once.
2. Pivots and regions. In high-dimensional shingle space nearly all documents are at distance 1 from any global
   pivot, and triangle windows around such pivots would replicate everything everywhere. Pivots are therefore local:
   by the prefix bound, two linked documents share one of the lowest-hashed shingles of each; the smallest document
   that holds a shingle is that shingle's pivot, and the documents compared with a pivot are its region. The bound
   leaves some slack, which each document spends by giving up its most frequent shingles, so that a passage that
   many documents share makes no regions (the proof is in `_prefix_lengths`).
3. Exact distances to the pivots. Those within the threshold link.
4. Hopeless members. Too many shingles of their own rule out any partner in the region, exactly (`_hopeful`).
5. Windows. Two documents of a region can link only if their distances to its pivot differ by at most the
   threshold. Rings of that width are the cells of the region, each document being replicated to the next ring.
   Pairs that already hang together need no test. Large regions get further pivots, whose Voronoi cells (each
   member at home with its nearest pivot, and replicated to the cells that its window of twice the threshold
   reaches, see `_voronoi`) are regions again, recursively, until they are small or no pivot cuts them any more.
   The cells are joined exactly.

The links that are not needed for connectivity are never listed, so copies and near copies cost in proportion to
their number, and there is no cap on documents, shingles, partners or region size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOOM, columns, connected_components, mix64, save, settings, shingle_hashes, text_bytes

K = 5
#: A document of n shingles may give up n / SLACK of its most frequent ones.
SLACK = 8
#: Rows from which a set of shingles is dealt out over DEALS tasks.
HOT, DEALS = 256, 64
#: Members and pivots of the regions that are cut further.
REGION_ROWS, PIVOTS = 64, 4


def _need(n: np.ndarray | int, percent: int):
    """Smallest overlap of a set of n shingles with a linked one."""
    return -(-percent * n // 100)


def _prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """(rows emitted, rows kept) of the hash-ordered prefix of n shingles.

    Let o(n) = ceil(t n), e(n) = n // SLACK the slack and p(n) = n - o(n) + 1 + e(n) the prefix. If x and y link, they
    share at least max(o(x), o(y)) shingles. Say x's prefix ends first: x has o(x) - 1 - e(x) shingles beyond it, so
    at least 1 + e(x) shared ones lie in both prefixes. x may give up e(t x) <= e(x) and y may give up
    e(t y) <= e(x), since t y <= x: if all documents give up their last by one order, the first shared one stays.
    """
    slack = lambda m: m // SLACK
    return n - _need(n, percent) + 1 + slack(n), n - _need(n, percent) + 1 + slack(n) - slack(percent * n // 100)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, marks = [], []
        for text in text_bytes(batch.column(2)):
            s = shingle_hashes(text, K)
            sizes.append(len(s))
            marks.append(_mark(s))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64())], names=["doc_id", "text_hash", "n_shingles", "set_id"])


def _mark(s: np.ndarray) -> int:
    """A 64-bit hash of a set of shingles: documents with one set are one class."""
    with np.errstate(over="ignore"):
        return int(mix64(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True) + mix64(s * np.uint64(3)).sum() * np.uint64(7) + np.uint64(len(s))).astype(np.int64)[0])


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for text in text_bytes(batch.column(0)):
                s = shingle_hashes(text, K)
                if len(s):
                    keys.append(s[: _prefix_lengths(len(s), percent)[0]])
                    ids.append(np.full(len(keys[-1]), _mark(s), np.int64))
            if keys:
                # 48 of 64 bits: a clash only adds a candidate
                yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(keys) >> np.uint64(16)).astype(np.int64)), pa.array(np.concatenate(ids))], names=["s", "set_id"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_hashes(t, K).view(np.int64) for t in text_bytes(batch.column(1))]
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
        yield pa.RecordBatch.from_arrays([batch.column(0), values, batch.column(2)], names=["set_id", "shingles", "pivot"])


def _distances(pairs: DataFrame, sets: DataFrame, pivots: DataFrame | None = None) -> DataFrame:
    """Pairs (x, p) with `shared` and `joint`: sizes of intersection and union.

    `pivots` are the sets that p names; where they are not given, only the sets that the pairs name are shuffled.
    """
    pivots = sets.join(pairs.select(F.col("p").alias("set_id")).distinct(), "set_id", "left_semi") if pivots is None else pivots
    a = sets.select(F.col("set_id").alias("x"), F.col("shingles").alias("sx"))
    b = pivots.select(F.col("set_id").alias("p"), F.col("shingles").alias("sp"))
    shared = F.size(F.array_intersect("sx", "sp"))
    both = pairs.join(a, "x").join(b, "p")
    return both.select(*pairs.columns, shared.alias("shared"), (F.size("sx") + F.size("sp") - shared).alias("joint"))


def _open(members: DataFrame, component: DataFrame, theta: float) -> DataFrame:
    """The members that a member of another component is near: in the same ring of their region or a neighbouring one.

    A region's pivot is not among its members, as all of them have been compared with it.
    """
    held = members.join(component.withColumnRenamed("id", "x"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    held = save(held.withColumn("ring", F.floor(F.col("ds")[0] / theta)), "jaccard-held")
    rings = held.groupBy("region", "ring", "component").agg(F.count(F.lit(1)).alias("m"))
    around = rings.select("region", "component", F.explode(F.array(*[F.col("ring") + i for i in (-1, 0, 1)])).alias("ring"))
    mixed = around.groupBy("region", "ring").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    open_ = held.join(mixed.select("region", "ring"), ["region", "ring"])
    sizes = open_.groupBy("region", "component").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.groupBy("region").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    return open_.join(sizes, "region").withColumn("tests", (F.col("m") * F.col("m") - F.col("mm")) / 2).drop("mm")


def _hopeful(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of open regions that can still have a partner, with `n` shingles of which `common` are not theirs alone.

    A linked pair shares at least t / (1 + t) of the sum of its sizes, and no more than either has in common with any
    other open member. So a member's partner has at most common * (1 + t) / t - n shingles; a member of a region whose
    smallest set is larger than that is done. Copies with many changes of their own go here, whatever their number.
    """
    open_ = save(open_.select("region", "x", "ds", "os"), "jaccard-open")
    # With the pivots, so that what a member shares with its pivot counts as common.
    wanted = save(open_.select(F.col("x").alias("set_id")).union(open_.select("region")).distinct(), "jaccard-wanted")
    own = sets.join(wanted, "set_id")
    own = own.select(F.col("set_id").alias("x"), F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s"))
    shared = own.groupBy("s").agg(F.min("x").alias("least"), F.max("x").alias("most")).where("least < most").select("s")
    common = own.join(shared, "s").groupBy("x").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("common"))
    members = save(open_.join(common, "x"), "jaccard-members")
    smallest = members.groupBy("region").agg(F.min("n").alias("smallest"))
    largest = F.col("common") * (100 + percent) - F.col("n") * percent
    return save(members.join(smallest, "region").where(largest >= F.col("smallest") * percent).drop("smallest"), "jaccard-members")


def _voronoi(again: DataFrame, theta: float) -> DataFrame:
    """Cells of regions: each member at home with its nearest pivot, and in the cells that its window reaches.

    `again` has region, x, what it carries, and the distance `d` and overlap `o` of x and each pivot p of the region.
    If x and y are within theta and x is at home with p, d(y, p) <= theta + d(x, p) <= theta + d(x, q) <= 2 theta +
    d(y, q) for the pivot q nearest to y: so y lies in x's home cell if it goes to all cells within 2 theta of its own.
    """
    carried = ["ds", "os", "n", "common", "home"]
    by = again.groupBy("region", "x").agg(*[F.first(c).alias(c) for c in carried], F.array_sort(F.collect_list(F.struct("p", "d", "o"))).alias("to"))
    near = F.array_min(F.transform("to", lambda t: F.struct(t["d"], t["p"])))
    cells = by.withColumn("near", near).withColumn("cell", F.explode(F.filter("to", lambda t: t["d"] <= F.col("near")["d"] + 2 * theta + 1e-9)))
    own = lambda c: F.array(F.col("cell")[c])
    return cells.select(
        F.xxhash64("region", "cell.p").alias("region"), "x", F.concat(own("d"), F.transform("to", lambda t: t["d"]), "ds").alias("ds"), F.concat(own("o"), F.transform("to", lambda t: t["o"]), "os").alias("os"),
        "n", "common", (F.col("home") & (F.col("cell.p") == F.col("near.p"))).alias("home"),
    )


def _classes(docs: DataFrame, percent: int, region_rows: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """The profile of every row (doc_id, text_hash, n_shingles, set_id), and of each set its copies and its component's first row."""
    theta = 1 - percent / 100
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    profiles = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_profiles, columns(doc_id="long", text_hash="long", n_shingles="long", set_id="long"))
    profiles = save(profiles, "jaccard-profiles")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = profiles.where("n_shingles > 0").groupBy("set_id").agg(F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), F.min(row).alias("best"))
    classes = save(classes, "jaccard-classes")

    entries = docs.select("text").mapInArrow(_prefixes(percent), columns(s="long", set_id="long"))
    shared = entries.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("set_id").alias("pivot"), F.max("set_id").alias("most")).where("pivot < most").drop("most")
    shared = save(shared, "jaccard-shared")
    n, need = F.col("n"), F.ceil(F.col("n") * percent / 100)
    kept = n - need + 1 + F.floor(n / SLACK) - F.floor(F.floor(n * percent / 100) / SLACK)
    emitted = n - need + 1 + F.floor(n / SLACK)
    # Shingles that one set has come first in the order of frequency, so only the shared ones need gathering.
    by_set = entries.join(shared, "s").groupBy("set_id").agg(F.array_sort(F.collect_set(F.struct("df", "s", "pivot"))).alias("rows")).join(classes.select("set_id", "n"), "set_id")
    left = (kept - (emitted - F.size("rows"))).cast("int")
    pairs = by_set.where(left > 0).select(F.col("set_id").alias("x"), F.explode(F.array_distinct(F.transform(F.slice("rows", 1, left), lambda r: r.pivot))).alias("p"))
    pairs = save(pairs.where("x <> p"), "jaccard-pairs")

    wanted = pairs.select(F.col("x").alias("set_id"), F.lit(False).alias("pivot")).union(pairs.select(F.col("p"), F.lit(True))).groupBy("set_id").agg(F.max("pivot").alias("pivot"))
    # One row of each set that a pair names: of its rows the one with the least id and text.
    named = wanted.join(classes, "set_id").select("set_id", "pivot", F.coalesce("best.doc_id", F.lit(0)).alias("id"), "best.text_hash", F.lit(1).alias("uses"))
    # Spark makes a Bloom filter of a side that is filtered: most texts that no pair names then stay out of the shuffle.
    named = save(named, "jaccard-named").where("uses > 0").drop("uses")
    with settings(docs.sparkSession, BLOOM):
        texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash"), "text").join(named, ["id", "text_hash"])
        # Repeated rows have met in one partition already.
        texts = texts.dropDuplicates(["id", "text_hash"]).select("set_id", "text", "pivot")
        sets = save(texts.mapInArrow(_sets, columns(set_id="long", shingles="array<long>", pivot="boolean")), "jaccard-sets")
    linked = F.col("shared") * 100 >= F.col("joint") * percent
    stars = save(_distances(pairs, sets, sets.where("pivot")), "jaccard-stars")
    links = stars.where(linked).select(F.col("x").alias("a"), F.col("p").alias("b"))
    component = connected_components(links, "jaccard")

    far = 1 - F.col("shared") / F.col("joint")
    members = stars.select(F.col("p").alias("region"), "x", F.array(far).alias("ds"), F.array(F.col("shared")).alias("os"))
    members = _hopeful(_open(members, component, theta), sets, percent).withColumn("home", F.lit(True))
    before = None
    while True:
        open_ = save(_open(members, component, theta), "jaccard-open")
        large = open_.where((F.col("m") > region_rows) & (F.col("tests") > 8 * F.col("m")))
        tests = large.groupBy("region").agg(F.first("tests").alias("tests")).agg(F.sum("tests")).first()[0]
        # Regions whose members are all near one another cannot be cut; the windows below test what is left of them.
        if not tests or before and tests > 0.7 * before:
            break
        before = tests
        # Further pivots: of each deal of the members the one with the smallest share of shingles of its own.
        central = F.struct(F.col("common") / F.col("n"), F.xxhash64("x"), "x")
        chosen = large.where(F.array_min("ds") > 0).groupBy("region", F.pmod(F.xxhash64("x", F.lit(7)), F.lit(pivots)).alias("deal")).agg(F.max_by("x", central).alias("p"))
        chosen = save(chosen.select("region", "p"), "jaccard-pivots")
        again = save(large.join(chosen, "region").select("region", "x", "ds", "os", "n", "common", "home", "p"), "jaccard-again")
        more = save(_distances(again, sets), "jaccard-stars")
        found = more.where(linked & (F.col("x") != F.col("p"))).select(F.col("x").alias("a"), F.col("p").alias("b"))
        links = links.union(found)
        component = connected_components(links, "jaccard")
        rest = open_.join(chosen.select("region").distinct(), "region", "left_anti").select("region", "x", "ds", "os", "n", "common", "home")
        cells = _voronoi(more.withColumns({"d": far, "o": F.col("shared")}), theta)
        members = save(cells.unionByName(rest), "jaccard-members")
    homes = open_.select("region", "x", "component", "ds", "os", "n", "common", "ring", "home")
    near = homes.select("region", F.col("x").alias("y"), F.col("component").alias("other"), F.col("ds").alias("es"), F.col("os").alias("qs"), F.col("n").alias("ny"), F.col("common").alias("common_y"), F.col("ring").alias("ring_y"), F.col("home").alias("home_y"), F.explode(F.array(F.col("ring"), F.col("ring") + 1)).alias("at"))
    window = F.forall(F.zip_with("ds", "es", lambda a, b: F.abs(a - b) <= theta + 1e-9), lambda ok: ok)
    # What two members share lies in a pivot or outside it: at most the smaller part of each on either side.
    most = F.aggregate(F.zip_with("os", "qs", lambda a, b: F.least(a, b) + F.least(F.col("common") - a, F.col("common_y") - b)), F.least("common", "common_y"), lambda m, x: F.least(m, x))
    enough = most * (100 + percent) >= (F.col("n") + F.col("ny")) * percent
    once = (F.col("ring_y") < F.col("ring")) | (F.col("x") < F.col("y"))
    tests = homes.withColumn("at", F.col("ring")).join(near, ["region", "at"]).where((F.col("component") != F.col("other")) & (F.col("home") | F.col("home_y")) & once & enough & window)
    tests = save(tests.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("p")).distinct(), "jaccard-tests")
    last = save(_distances(tests, sets).where(linked).select(F.col("x").alias("a"), F.col("p").alias("b")), "jaccard-last")
    if last.limit(1).count():
        component = connected_components(links.union(last), "jaccard")
    roots = classes.join(component.withColumnRenamed("id", "set_id"), "set_id", "left").select("set_id", "copies", "best", F.coalesce("component", "set_id").alias("root"))
    least = roots.groupBy("root").agg(F.min("best").alias("best"))
    return profiles, save(roots.drop("best").join(least, "root").select("set_id", "copies", "best"), "jaccard-roots")


def _by_class(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """`profiles` with `best`, the first row of its component, null for rows without words.

    A set that HOT rows or more have is dealt out: its row is repeated and its documents take one of the repeats each.
    """
    spread = found.where(F.col("copies") >= HOT).select("set_id", F.col("best").alias("hot"), F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    dealt = profiles.withColumn("deal", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(DEALS)).cast("int"))
    first = dealt.join(spread, ["set_id", "deal"], "left")
    # Rows that have their answer, and those that have none, must not meet on one set.
    first = first.withColumn("key", F.when(F.col("hot").isNull() & (F.col("n_shingles") > 0), F.col("set_id")).otherwise(F.xxhash64("doc_id", "text_hash")))
    out = first.join(found.where(F.col("copies") < HOT).select(F.col("set_id").alias("key"), "best"), "key", "left")
    return out.select(*profiles.columns, F.when(F.col("n_shingles") > 0, F.coalesce("hot", "best")).alias("best"))


def link_documents(docs: DataFrame, percent: int = 75, region_rows: int = REGION_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    Null or wordless texts have no shingle, link with nothing and are their own component; equal texts link if they
    have a word. Rows are documents of their own, also where they repeat a doc_id: their texts may lie in different
    components. Rows of a null doc_id link like others; their component is null if no id is in it. Whole texts count,
    whatever their length. Extra columns of `docs` are ignored. An empty table gives an empty result.
    """
    out = _by_class(*_classes(docs, percent, region_rows, pivots))
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Pipeline form: of each group of linked rows the one with the smallest (doc_id, hash of text) stays.

    A null doc_id comes last. Rows without a word stay, as they link with nothing. Rows of one doc_id and different
    texts are judged each by its own text; rows that repeat both are copies, of which one stays. All columns of
    `docs` come back, whatever their names; an empty table gives an empty result.
    """
    rows = _by_class(*_classes(docs, percent, REGION_ROWS, PIVOTS)).where("n_shingles > 0")
    wins = (F.col("best.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("best.text_hash") == F.col("text_hash"))
    lost = rows.where(~wins).select(_row_key("doc_id", F.col("text_hash"))).distinct()
    twice = rows.where(wins).groupBy(_row_key("doc_id", F.col("text_hash"))).count().where("count > 1").select("key")
    # Whatever the columns of `docs` are called, they travel in one struct.
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _row_key(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    kept = packed.join(lost, "key", "left_anti")
    if twice.limit(1).count():
        kept = kept.join(twice, "key", "left_anti").select("row", "key").union(kept.join(twice, "key", "left_semi").select("row", "key").dropDuplicates(["key"]))
    return kept.select("row.*")


def _row_key(doc_id: Column | str, text_hash: Column) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.struct(F.coalesce(doc_id, F.lit(0)).alias("a"), doc_id.isNull().alias("b"), text_hash.alias("c")).alias("key")
