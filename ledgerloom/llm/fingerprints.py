"""Document fingerprints by one-permutation MinHash.

The 5-word shingle hashes of a text are binned once; a bin keeps its smallest. Empty bins borrow from a bin that a
2-universal hash of (bin, attempt) names, attempt after attempt (optimal densification), so all texts borrow alike.
The lowest bits of each bin are packed into a hex string. Two unlike bins agree in b bits by chance with probability
2**-b, which the likeness corrects for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, mix64, shingle_hashes

BINS, BITS = 256, 8
#: Attempts of the densification that are looked at together.
ATTEMPTS = 64
ROWS_PER_RANGE = 2000


def bin_minima(hashes: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Smallest hash of each bin and whether the bin has one. `hashes` is sorted; bins cut its range evenly."""
    own = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    values, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[own[first]], full[own[first]] = hashes[first], True
    return values, full


@cache
def _sources(bins: int, block: int) -> np.ndarray:
    """The bins that each bin names in the attempts of a block, by a hash of (bin, attempt)."""
    attempt = np.arange(1 + block * ATTEMPTS, 1 + (block + 1) * ATTEMPTS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + attempt
        return (mix64(key) % np.uint64(bins)).astype(np.int64)


def densify(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fill empty bins from the first full bin that they name. At least one bin must be full."""
    bins, values = len(values), values.copy()
    empty, block = np.flatnonzero(~full), 0
    while len(empty):
        source = _sources(bins, block)[empty]
        hits = full[source]
        first = hits.argmax(1)
        rows = np.arange(len(empty))
        hit = hits[rows, first]
        values[empty[hit]] = values[source[rows[hit], first[hit]]]
        empty, block = empty[~hit], block + 1
    return values


def fingerprint(text: str | None, bins: int = BINS, bits: int = BITS) -> str:
    """Packed low-order bits of the bins in hex; empty for texts without a word."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return ""
    values = mix64(densify(*bin_minima(hashes, bins)))
    if bits == 8:
        return values.astype(np.uint8).tobytes().hex()
    low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(low.astype(np.uint8).ravel()).tobytes().hex()


def likeness(a: str, b: str, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1; of a wordless text: 1 with another, else 0."""
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    if bits == 8:
        same = float((x == y).mean())
    else:
        same = float((np.unpackbits(x)[: bins * bits].reshape(bins, bits) == np.unpackbits(y)[: bins * bits].reshape(bins, bits)).all(1).mean())
    chance = 2.0**-bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def fingerprint_documents(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id and the fingerprint of each text. Null texts are empty, with an empty fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": [fingerprint(t, bins, bits) for t in batch["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, columns(doc_id="long", fingerprint="string"))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _place(order: Column, cuts: list[int]) -> Column:
    """How many of the falling cuts are at least `order`: by every w-th cut first, then by the w cuts after it."""
    if not cuts:
        return F.lit(0)
    w = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + w] for i in range(0, len(cuts), w)]
    at_least = lambda values: F.size(F.filter(values, lambda c: c >= order))
    block = F.greatest(at_least(F.lit([b[0] for b in blocks]).cast("array<bigint>")) - 1, F.lit(0))
    return block * w + at_least(F.get(F.array(*[F.lit(b).cast("array<bigint>") for b in blocks]), block))


def fingerprint_edits(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, by descending doc_id.

    After the last document comes the first. Ties of doc_id go by text, null ids come last, null texts are empty.
    A table of one row has itself as the next; repeated rows are documents of their own; texts of any length are taken
    whole; an empty table gives an empty result; extra columns are ignored. The order is cut into ranges of ids, each
    streamed by one task with the head of the next range at its end, so each text moves once. Ranges and their rows
    grow with the square root of the table; rows of one doc_id lie in one range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    n = rows.count()
    parts = max(1, n // max(ROWS_PER_RANGE, math.isqrt(n)))
    cuts = sorted(set(rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts)).first()[0]), reverse=True) if parts > 1 else []
    # Range 0 has the largest ids.
    ranged = rows.withColumn("range", _place(order, cuts))
    heads = ranged.groupBy("range").agg(F.max(order).alias("first"))
    # At most as many rows as ranges: the range that follows each one, and after the last the first.
    line = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("range", "first", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(line)).alias("to"))
    tops = ranged.join(F.broadcast(heads), "range").where(order == F.col("first")).groupBy("range").agg(F.min("text").alias("text"), F.max("doc_id").alias("doc_id"))
    tails = after.select(F.col("range").alias("from"), F.col("to").alias("range")).join(tops, "range").select("doc_id", "text", F.col("from").alias("range"), F.lit(True).alias("tail"))
    dealt = ranged.withColumn("tail", F.lit(False)).unionByName(tails).repartition("range")
    dealt = dealt.sortWithinPartitions("range", "tail", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, names = None, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            out = []
            for doc_id, text, tail in zip(batch["doc_id"].array, batch["text"], batch["tail"], strict=True):
                mark = fingerprint(text, bins, bits)
                if held is not None:
                    old_id, old, old_mark = held
                    new = edited(old, text)
                    new_mark = fingerprint(new, bins, bits)
                    out.append((old_id, len(old), hashlib.sha256(new.encode()).hexdigest(), old_mark, new_mark, likeness(old_mark, new_mark, bins, bits), likeness(old_mark, mark, bins, bits)))
                held = None if tail else (None if pd.isna(doc_id) else int(doc_id), text, mark)
            if out:
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return dealt.mapInPandas(run, columns(doc_id="long", n_chars="long", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double"))
