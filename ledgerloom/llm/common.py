"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that one task sorts at a time in the two-level running sums below.
ROWS_PER_BUCKET = 8192

#: Spark's setting that drops a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's own Bloom filter on the larger side of a shuffled join, whatever the sizes; its 4 MB do not grow.
BLOOM = {
    f"spark.sql.optimizer.runtime.bloomFilter.{k}": v
    for k, v in {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1t", "expectedNumItems": "4000000", "maxNumItems": "4000000", "numBits": str(1 << 25), "maxNumBits": str(1 << 25)}.items()
}

#: White space of the word definition `[^\x20\x09-\x0D]+`.
SPACES = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, in local mode, one of our own.

    On a cluster a folder of the driver's machine would not do, so there it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no recomputation.

    What comes after reads the table alone, so the shuffle files behind it go once it is written.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    with settings(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; the former values come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def word_count(text: Column) -> Column:
    """Number of `[^\x20\x09-\x0D]+` in a text, JVM-side; null counts 0."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def running_sum(rows: DataFrame, part: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over the rows before this one in its part.

    The order within a part is (bucket, *order), the bucket a hash of the order columns, so that a part that holds
    a third of all rows is summed by many tasks: sums by bucket first, a window over the few buckets, then a window
    within each bucket. Null parts form a part of their own. `rows` should be cheap to read twice.
    """
    counts = rows.groupBy(*part).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / ROWS_PER_BUCKET)).alias("_nb"))
    keyed = null_safe_join(rows, counts, part).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_nb")))
    sums = keyed.groupBy(*part, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*part, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*part, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    out = null_safe_join(local, starts, [*part, "_bucket"])
    return out.withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).drop("_nb", "_bucket", "_start", "_local")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; keeps the left key columns."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        eq = left[c].eqNullSafe(right[f"_r_{c}"])
        cond = eq if cond is None else cond & eq
    return left.join(right, cond, how).drop(*[f"_r_{c}" for c in on])


_RNG = np.random.Generator(np.random.PCG64(20240229))
_ODD = lambda n: _RNG.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A 64-bit number for each byte; white space is 0 and A-Z are as a-z.
_BYTE = _ODD(256)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[[32, 9, 10, 11, 12, 13]] = 0
#: Factors for the place of a byte in its word: of the lower and of the higher 16 bits of the place.
_PLACE, _BLOCK = _ODD(1 << 16), _ODD(1 << 16)
_BLOCK[0] = 1
_MULT = _ODD(5)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes | np.ndarray) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes, in order, A-Z lower-cased."""
    code = _BYTE[np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data]
    inside = code != 0
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = np.diff(starts, append=len(code))
    place = np.arange(len(code) - starts[0]) - np.repeat(starts - starts[0], lengths)
    factor = _PLACE[place & 0xFFFF]
    if lengths.max() > 1 << 16:
        factor = factor * _BLOCK[(place >> 16) & 0xFFFF]
    return mix64(np.add.reduceat(code[starts[0] :] * factor, starts - starts[0]))


def shingles_of(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer than k words are one shingle, no word is none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = min(k, n)
    total = np.full(n - w + 1, np.uint64(w))
    for i in range(w):
        total += words[i : n - w + 1 + i] * _MULT[i % 5] + np.uint64(i // 5)
    total = np.sort(mix64(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def shingle_hashes(text: str | bytes | np.ndarray | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased.

    Fewer than k words: the whole sequence as one shingle; no word or null: none.
    """
    if text is None:
        return np.empty(0, np.uint64)
    return shingles_of(word_hashes(text.encode() if isinstance(text, str) else text), k)


def text_bytes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of an Arrow column without nulls, in place."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].tolist() if len(texts) else [0]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    for a, b in zip(at, at[1:], strict=False):
        yield data[a:b]


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of edges (a, b).

    Smallest-label propagation with pointer jumping, so long chains take a logarithmic number of rounds; each
    round is written to the shared folder. Nothing but the count of changed rows comes to the driver.
    """
    both = save(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        step = step.join(jump, "component").select("id", "old", F.least("component", "far").alias("component"))
        step = save(step, f"{name}-labels")
        changed = step.where("old <> component").limit(1).count()
        labels = step.select("id", "component")
        if not changed:
            return labels


def columns(**kinds: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in kinds.items()))
