"""Audit of how five text filters interact, over all their orders, with a counting-Bloom prepass for the duplicates.

Four filters look at one text each; the fifth, E, drops a text that a smaller doc_id has too. For that one no text is
shuffled that can be shown to be unique: hashes of all texts are counted in the cells of a blocked counting Bloom
filter (sketches of the tasks, merged by adding up each cell), the cells that count two or more are packed into
bitmaps, and a text with a cell that is not marked there is unique for sure. The other texts, and only those, are
shuffled whole and give the smallest id of each. Then every document is a mask of five bits, and documents are counted
by part and mask. All that the 120 orders need are sums over masks: how many documents fail none of a set of filters.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, save

#: Fixed value: the filters in the order of their bits.
FILTERS = "ABCDE"
#: Cells of the sketch for each row, and the bits of one bitmap (that of Spark's bitmap functions).
CELLS_PER_ROW, BITMAP_BITS = 8, 32768
#: Bound of the merged bitmaps, which are broadcast. Beyond it the sketch is fuller: it clears fewer texts, none wrongly.
MAX_SKETCH_BYTES = 1 << 26


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: under 200 words; 100 * distinct words < 50 * words; 100 * [A-Z] > 2 * code points; any of #$%&*|."""
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    few = lambda w: F.when(F.size(w) < 200, 1).otherwise(0)
    same = lambda w: F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0)
    by_words = F.transform(F.array(words), lambda w: few(w) + same(w))[0]  # the words have a name, so they are split once
    return by_words + F.when(100 * capitals > 2 * F.length(text), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def _cells(buckets: int) -> tuple[Column, Column, Column]:
    """The bitmap of a text_hash and its two bits in it."""
    other = F.xxhash64("text_hash", F.lit(11))
    bit = lambda h: F.pmod(h, F.lit(BITMAP_BITS))
    return F.pmod("text_hash", F.lit(buckets)).cast("long"), bit(other), bit(F.shiftright(other, 32))


def merged_sketch(hashes: DataFrame, buckets: int) -> DataFrame:
    """(bucket, bitmap): the cells of the counting Bloom filter that count two or more; `hashes` has text_hash.

    A text counts once in each of its cells, so a cell of two is a copy or a collision. Counts are combined in each
    task before they are shuffled, so a text of many copies is no hot key.
    """
    bucket, one, two = _cells(buckets)
    cells = hashes.select(bucket.alias("bucket"), F.explode(F.array_distinct(F.array(one, two))).alias("bit"))
    full = cells.groupBy("bucket", "bit").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return full.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _marked(position: Column) -> Column:
    """Whether the bit at a position of `bitmap` is set."""
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.pmod(position, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1


def add_maybe_repeat(rows: DataFrame, sketch: DataFrame, buckets: int) -> DataFrame:
    """`rows` (doc_id, text_hash, ...) with `maybe`: whether the merged sketch cannot clear the text of being a repeat.

    The bitmaps are broadcast: their size is bounded by the number of buckets that the sketch was made with. A row of
    null doc_id is no repeat.
    """
    bucket, one, two = _cells(buckets)
    near = rows.withColumns({"_bucket": bucket, "_one": one, "_two": two}).join(F.broadcast(sketch.withColumnRenamed("bucket", "_bucket")), "_bucket", "left")
    maybe = F.col("doc_id").isNotNull() & F.coalesce(_marked(F.col("_one")) & _marked(F.col("_two")), F.lit(False))
    return near.withColumn("maybe", maybe).drop("_bucket", "_one", "_two", "bitmap")


def flag_documents(docs: DataFrame, max_sketch_bytes: int = MAX_SKETCH_BYTES) -> DataFrame:
    """(doc_id, source, failures): the mask of the filters that each document fails, one row per document.

    A null text is empty, and equal to other empty ones. A document of null doc_id is no copy and makes none; rows of
    one id and text are no copies of each other. Texts of any length are taken whole; extra columns are ignored.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    whole = whole.withColumn("text_hash", F.xxhash64("text"))
    rows = save(whole.select("doc_id", "source", "text_hash", text_failures(F.col("text")).alias("failures")), "audit-rows")
    buckets = 1 + min(8 * max_sketch_bytes, rows.count() * CELLS_PER_ROW) // BITMAP_BITS
    sketch = save(merged_sketch(rows.where("doc_id is not null"), buckets), "audit-sketch")
    # Whole texts are the key. Copies meet in each task before they are shuffled, so a text of many copies is no hot key.
    texts = add_maybe_repeat(whole.select("doc_id", "text", "text_hash"), sketch, buckets).where("maybe")
    first = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"))
    first = save(first.select("doc_id", "text_hash", F.lit(True).alias("first")), "audit-first")
    flagged = add_maybe_repeat(rows, sketch, buckets)
    unique = flagged.where("not maybe").select("doc_id", "source", "failures")
    # A possible repeat is a copy unless it has the smallest id of its text.
    repeats = flagged.where("maybe").join(first, ["doc_id", "text_hash"], "left")
    return unique.unionByName(repeats.select("doc_id", "source", (F.col("failures") + F.when(F.col("first"), 0).otherwise(16)).alias("failures")))


def mask_counts(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failures, n, good, toxic): documents by source (null: empty) and mask, and how many have either label.

    Labels that name an id twice count once, if any of them holds; a document without labels has neither.
    """
    is_one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    known = known.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    both = flagged.join(known, "doc_id", "left").groupBy(F.coalesce("source", F.lit("")).alias("part"), "failures")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included, from the mask counts of `mask_counts`.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (what the step's filter removes, over all
    orders) are sums over the masks of the part, of which there are 32 at most.
    """
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("failures", "n", "good", "toxic")).alias("masks"))
    rows = masks.select("part", "masks", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda text: sum((F.when(F.contains(text, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("_before", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    rows = rows.withColumn("_own", bits(F.substring("filter_order", F.col("step"), F.lit(1))))
    before, own = F.col("_before"), F.col("_own")

    def total(test: Callable[[Column], Column], value: Callable[[Column], Column] = lambda x: x["n"]) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda s, x: s + F.when(test(x["failures"]), value(x)).otherwise(0))

    fails = lambda mask: mask.bitwiseAND(own) != 0
    earlier = lambda mask: mask.bitwiseAND(before) != 0
    here = lambda mask: fails(mask) & ~earlier(mask)
    share = lambda x: (x["n"] * F.lit(120) / F.bit_count(x["failures"])).cast("long")  # noqa: E731  (in 120 / k orders it comes first of k)
    return rows.select(
        "part", "filter_order", "step", total(lambda m: ~fails(m) & ~earlier(m)).alias("kept"), total(here).alias("removed"), total(lambda m: fails(m) & earlier(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"), total(here, lambda x: x["good"]).alias("good_lost"), total(here, lambda x: x["toxic"]).alias("toxic_lost"), total(fails, share).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, max_sketch_bytes: int = MAX_SKETCH_BYTES) -> DataFrame:
    """The interactions of the five filters by source of the documents; an empty table gives an empty result."""
    return interactions(mask_counts(flag_documents(docs, max_sketch_bytes), labels))
