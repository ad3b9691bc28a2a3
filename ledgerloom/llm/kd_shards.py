"""Sharding by a k-d tree over document metadata.

Documents are points (size, source, language, id) that weigh their bytes. The tree splits a node at the weighted
median of its widest dimension, found exactly by two rounds of distributed histograms over a 32-bit key (16 bits of
the coordinate, then 16 of a hash that breaks ties), so a source with a third of all rows still splits in the middle.
Only the histogram bin of each node's median comes to the driver; the tree has one node less than there are shards.

Rows with equal texts are one point and go to one shard, unless they outweigh 1/32 of a shard: then they are dealt
into pieces below that weight, since no split can balance around a larger point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import null_safe_join, running_sum, save

DIMS = ("d_size", "d_source", "d_lang", "d_id")
PIECES_PER_SHARD = 32
KEY = ["text_hash", "text_crc32", "piece"]


def _ordinal(rows: DataFrame, column: str) -> DataFrame:
    """(column, ordinal) over the distinct values, by code point, null last."""
    return rows.select(column).distinct().select(column, F.row_number().over(Window.orderBy(F.col(column).isNull(), column)).alias(f"{column}_at"))


def _points(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their piece, and the weighted points with coordinates of 16 bits."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1, total // (shards * PIECES_PER_SHARD))
    heavy = rows.groupBy("text_hash", "text_crc32").agg(F.sum("size").alias("_all")).where(F.col("_all") > most)
    # At most shards * PIECES_PER_SHARD groups weigh more than `most`.
    rows = rows.join(F.broadcast(heavy), ["text_hash", "text_crc32"], "left")
    piece = F.pmod(F.xxhash64("doc_id", "source", "lang"), F.ceil(F.col("_all") / most))
    rows = rows.withColumn("piece", F.coalesce(piece, F.lit(0)).cast("long")).drop("_all")
    points = rows.groupBy(*KEY).agg(F.sum("size").alias("bytes"), F.max("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("doc_id").alias("doc_id"))
    for c in ("source", "lang"):
        points = null_safe_join(points, _ordinal(rows, c), [c])
    points = points.select(*KEY, "bytes", F.log2("size").alias("d_size"), F.col("source_at").cast("double").alias("d_source"), F.col("lang_at").cast("double").alias("d_lang"), F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("d_id"))
    points = save(points, "kd-points")
    ends = points.agg(*[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = []
    for d in DIMS:
        low, high = ends[f"lo_{d}"] or 0.0, ends[f"hi_{d}"] or 0.0
        scaled.append(F.least(F.lit(65535), F.floor((F.col(d) - low) * (65535 / (high - low) if high > low else 0.0))).cast("long").alias(d))
    tie = F.pmod(F.xxhash64(*KEY), F.lit(65536)).alias("tie")
    return rows, points.select(*KEY, "bytes", *scaled, tie)


def _by_node(values: dict[int, Column], default: Column) -> Column:
    out = None
    for node, value in values.items():
        out = F.when(F.col("node") == node, value) if out is None else out.when(F.col("node") == node, value)
    return default if out is None else out.otherwise(default)


def _median_bins(points: DataFrame, goal: dict[int, int], before: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """For each node the bin in which the running weight reaches the goal, the weight before it and after it."""
    run = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = points.groupBy("node", "bin").agg(F.sum("bytes").alias("bytes"))
    bins = bins.withColumn("upto", F.sum("bytes").over(run) + _by_node({k: F.lit(v) for k, v in before.items()}, F.lit(0)))
    need = _by_node({k: F.lit(v) for k, v in goal.items()}, F.lit(0))
    found = bins.where(F.col("upto") >= need).groupBy("node").agg(F.min_by(F.struct("bin", "upto", "bytes"), "bin").alias("x")).collect()
    return {r["node"]: (r["x"]["bin"], r["x"]["upto"] - r["x"]["bytes"], r["x"]["upto"]) for r in found}


def _split(points: DataFrame, shards: int) -> DataFrame:
    """Points with `shard`. A node that holds k shards gives k // 2 of them, and that share of its bytes, to the left."""
    points = points.withColumn("node", F.lit(0))
    leaves = {0: (0, shards)}  # node -> its first shard and their number
    while any(k > 1 for _, k in leaves.values()):
        open_ = {n: x for n, x in leaves.items() if x[1] > 1}
        live = points.where(F.col("node").isin(*open_))
        stats = live.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMS]).collect()
        widest = {r["node"]: max(DIMS, key=lambda d: (r[d], -DIMS.index(d))) for r in stats}  # noqa: B023
        goal = {r["node"]: max(1, r["bytes"] * (leaves[r["node"]][1] // 2) // leaves[r["node"]][1]) for r in stats}
        coord = _by_node({n: F.col(d) for n, d in widest.items()}, F.col(DIMS[0]))
        high = _median_bins(live.withColumn("bin", coord), goal, {})
        inner = live.withColumn("coord", coord).where(F.col("coord") == _by_node({n: F.lit(b[0]) for n, b in high.items()}, F.lit(-1)))
        low = _median_bins(inner.withColumn("bin", F.col("tie")), goal, {n: b[1] for n, b in high.items()})
        left, nodes = {}, {}
        for n, (bin_, under, over) in low.items():
            tie = bin_ if over - goal[n] <= goal[n] - under else bin_ - 1  # the nearer end of the median's bin
            cut = high[n][0] * 65536 + tie
            left[n] = (F.col(widest[n]) * 65536 + F.col("tie")) <= cut
        for n, (first, k) in leaves.items():
            if k == 1:
                nodes[n] = (first, 1)
                continue
            nodes |= {2 * n + 1: (first, k // 2), 2 * n + 2: (first + k // 2, k - k // 2)}
        step = _by_node({n: F.when(c, 2 * n + 1).otherwise(2 * n + 2) for n, c in left.items()}, F.col("node"))
        points, leaves = save(points.withColumn("node", step), "kd-points"), nodes
    return points.select(*KEY, _by_node({n: F.lit(first) for n, (first, _) in leaves.items()}, F.lit(0)).cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 1; the law is `bytes`, shards of nearly equal size; slot counts
    from 0 in each shard without gaps; grown_shard is null, as shards move when their number changes. Null languages,
    sources and ids are values of their own; repeated rows are documents of their own and take a slot each; an empty
    table gives an empty result. With fewer points than shards some shards stay empty. Extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows, points = _points(save(rows, "kd-rows"), shards)
    dealt = save(rows.join(_split(points, shards), KEY).select("doc_id", "size", "text_crc32", "text_hash", "shard"), "kd-dealt")
    placed = running_sum(dealt, ["shard"], [F.col("doc_id"), F.col("text_hash")], F.lit(1), "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the documents as Parquet, all columns, one folder `shard=N` each. Equal (doc_id, text) rows share a shard.

    A table with a column `shard` of its own is refused, since the folders' name would hide it.
    """
    if any(c.lower() == "shard" for c in docs.columns):
        raise ValueError("the documents have a column shard already")
    placed = shard_documents(docs, shards).groupBy("doc_id", F.col("text_crc32").alias("_crc")).agg(F.min("shard").alias("_shard"))
    full = docs.select("doc_id", F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("_crc"), F.struct(*docs.columns).alias("_row"))
    null_safe_join(full, placed, ["doc_id", "_crc"]).select("_row.*", F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)
