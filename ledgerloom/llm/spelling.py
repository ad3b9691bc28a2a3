"""Groups spelling variants of the words of a corpus: for each word the most frequent word one edit away.

Spark counts the words. Two words within one edit share the first half of the shorter one, or its last half, so words
are dealt into blocks by both halves (of their own length and of the next shorter one), and large blocks into grids of
bounded tiles. Of each bin of blocks a task builds a bit-sliced position index: for every place and letter the set of
the bin's words that have the letter there, as a bitset. All words of the bin are then looked up at once: recurrences
over the places keep the set of words that agree so far, and the sets that are one replaced, one inserted or one deleted
letter away, whose bitsets are those of the same, the next or the previous place. Words of a block lie side by side,
most frequent first, so that the number of near words is a count of bits and the form is the lowest bit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, save

_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Distinct words that a task counts before it hands them on, and words of one tile of a block and of one bin.
COUNTED, TILE, BIN = 1 << 18, 2048, 8192
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def document_words(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """(word, n) of a text: its runs of letters with A-Z lower-cased; a run that 97 divides the hash of loses a letter.

    The hash is the crc32 of `<doc_id>:<run>` (null ids: nothing before the colon), the letter the one at hash % length.
    """
    begin = b"%d:" % doc_id if doc_id is not None else b":"
    for run, n in Counter(_RUN.findall((text or "").encode().translate(_LOWER).decode())).items():
        h = zlib.crc32(begin + run.encode())
        if h % 97 == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        yield run, n


def count_words(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) over the whole texts of all documents: words of `least_length` code points that occur `least_n` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in document_words(doc_id, text.as_py()):
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})
                    total.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, columns(word="string", n="long"))
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def blocks(words: DataFrame, least_length: int = 5, tile: int = TILE, bin_size: int = BIN) -> DataFrame:
    """Words dealt to bins: (bin, m, side, block, word, n, indexed, asked), of which `indexed` are looked up by `asked`.

    m is the length of the shorter word of a pair; side 0 shares its first m // 2 letters, side 1 the other letters at the
    end. Blocks of one word are gone. A block of more than `tile` words is a grid of tiles, in which each part of its
    words asks each part, so no task holds a whole large block; bins are dealt by hash and hold about `bin_size` rows.
    """
    length = F.length("word")
    each = words.select("word", "n", F.explode(F.filter(F.array(length, length - 1), lambda m: m >= least_length)).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    front, back = F.substring("word", F.lit(1), half), F.right("word", F.col("m") - half)
    each = each.select("word", "n", "m", F.posexplode(F.array(front, back)).alias("side", "key"))
    place = ["m", "side", "key"]
    sizes = each.groupBy(*place).agg(F.count(F.lit(1)).alias("size"), F.min(F.length("word")).alias("shortest")).where("size > 1 and shortest = m")
    kept = each.join(sizes.drop("shortest"), place).withColumn("parts", F.ceil(F.col("size") / tile).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    kept = kept.withColumns({"own": own}).select("*", other.alias("other"))
    # Tile (i, j): part i is indexed, part j asks. A word of part `own` is in the tiles of its row and of its column.
    tiles = kept.select(*place, "word", "n", F.explode(F.when(F.col("own") == F.col("other"), F.array(F.struct(F.col("own").alias("i"), F.col("own").alias("j"), F.lit(True).alias("indexed"), F.lit(True).alias("asked")))).otherwise(
        F.array(F.struct(F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("indexed"), F.lit(False).alias("asked")), F.struct(F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("asked")))
    )).alias("t"))
    tiles = tiles.select(*place, F.concat_ws(":", "t.i", "t.j", "key").alias("block"), "word", "n", "t.indexed", "t.asked")
    classes = sizes.groupBy("m", "side").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / bin_size)).cast("int").alias("bins"))  # a row for each length
    dealt = tiles.join(classes, ["m", "side"])
    return dealt.select(F.pmod(F.xxhash64("block"), F.col("bins")).cast("int").alias("bin"), "m", "side", "block", "word", "n", "indexed", "asked")


class PositionIndex:
    """Bitsets over a bin's words: for every place and letter, those that have it there."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        """`codes`: letters of the words laid end to end."""
        self.words = len(lengths) // 64 + 1
        own = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.keys, row = np.unique(place << 21 | codes, return_inverse=True)
        self.bits = np.zeros((len(self.keys) + 1, self.words), np.uint64)  # the last row: no word
        np.bitwise_or.at(self.bits, (row, own >> 6), np.uint64(1) << (own & 63).astype(np.uint64))

    def at(self, place: int, letters: np.ndarray) -> np.ndarray:
        """Row of the bitsets for a place and each of the letters."""
        key = place << 21 | letters
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[row] == key, row, len(self.keys))


def bits_of(members: np.ndarray, words: int) -> np.ndarray:
    """A boolean for each word of the bin as a bitset."""
    padded = np.zeros(words * 64, np.uint8)
    padded[: len(members)] = members
    return np.packbits(padded, bitorder="little").view(np.uint64)


def near_words(index: PositionIndex, asked: np.ndarray, lengths: np.ndarray, m: int, start: int, query: np.ndarray, word: np.ndarray, live: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Bitsets of the words one edit from each query, in the given 64-bit words of the bin.

    `asked`: letters of the queries by row, padded; all queries are of one length, m or m + 1, and agree with the
    words of their block in the first `start` letters. `query`, `word`: the pairs of a query and a 64-bit word that are
    looked at; `live`: the words of the block in it; `short`: the words of length m.
    """
    same, replaced, more, fewer = live.copy(), np.zeros_like(live), np.zeros_like(live), np.zeros_like(live)
    long = int(lengths) > m
    for place in range(start, int(lengths)):
        letters = asked[:, place]
        here = index.bits[index.at(place, letters)[query], word]
        if long:  # a letter of the query too many: what follows is one place earlier in the word
            before = index.bits[index.at(place - 1, letters)[query], word] if place > start else np.uint64(0)
            fewer = (fewer & before) | same
        else:  # a letter of the word too many: what follows is one place later in the word
            after = index.bits[index.at(place + 1, letters)[query], word]
            more = (more | same) & after
            replaced = (replaced & here) | (same & ~here)
        same = same & here
    if long:
        return fewer & short[word]
    return (replaced & short[word]) | ((more | same) & ~short[word])


def look_up(block: list[str], word: list[str], n: np.ndarray, indexed: np.ndarray, asked: np.ndarray, m: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n_near, row of the form) of the asking rows of a bin that have near words."""
    order = np.array(sorted(np.flatnonzero(indexed).tolist(), key=lambda k: (block[k], -int(n[k]), word[k])), np.int64)
    names = {b: i for i, b in enumerate(dict.fromkeys(block[k] for k in order.tolist()))}
    own = np.array([names[block[k]] for k in order.tolist()], np.int64)
    first, last = np.searchsorted(own, np.arange(len(names))), np.searchsorted(own, np.arange(len(names)), "right")
    half = m // 2
    letters = lambda k: word[k][::-1] if side else word[k]  # noqa: E731  (what a block shares comes first)
    text = [letters(k) for k in order.tolist()]
    sizes = np.array([len(t) for t in text], np.int64)
    index = PositionIndex(np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.int64), sizes)
    short = bits_of(sizes == m, index.words)
    fronts: dict[str, int] = {}
    if side:  # pairs that share the first half too are side 0's
        front = np.array([fronts.setdefault(word[k][:half], len(fronts)) for k in order.tolist()], np.int64)
        shared = np.zeros((len(fronts) + 1, index.words), np.uint64)
        np.bitwise_or.at(shared, (front, np.arange(len(front)) >> 6), np.uint64(1) << (np.arange(len(front)) & 63).astype(np.uint64))
    out = []
    for size in (m, m + 1):
        rows = np.array([k for k in np.flatnonzero(asked).tolist() if len(word[k]) == size and block[k] in names], np.int64)
        if not len(rows):
            continue
        codes = np.frombuffer("".join(letters(k) for k in rows.tolist()).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(rows), size)
        at = np.array([names[block[k]] for k in rows.tolist()], np.int64)
        low, high = first[at], last[at] - 1
        span = (high >> 6) - (low >> 6) + 1
        query = np.repeat(np.arange(len(rows)), span)
        place = np.arange(len(query)) - np.repeat(np.cumsum(span) - span, span)
        w = (low >> 6)[query] + place
        live = np.where(w == (low >> 6)[query], _ONES << (low & 63).astype(np.uint64)[query], _ONES)
        live &= np.where(w == (high >> 6)[query], _ONES >> (63 - (high & 63)).astype(np.uint64)[query], _ONES)
        near = near_words(index, codes, np.int64(size), m, m - half if side else half, query, w, live, short)
        if side:
            fr = np.array([fronts.get(word[k][:half], len(fronts)) for k in rows.tolist()], np.int64)
            near &= ~shared[fr[query], w]
        hit = near != 0
        query, w, near = query[hit], w[hit], near[hit]
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        if len(starts):
            lowest = near & (~near + np.uint64(1))
            bit = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
            out.append((rows[query[starts]], np.add.reduceat(np.bitwise_count(near).astype(np.int64), starts), order[(w * 64 + bit)[starts]]))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near_counts(words: DataFrame, least_length: int = 5, tile: int = TILE, bin_size: int = BIN) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near words; form is that of largest n, then the smallest."""

    def run(table: pa.Table) -> pa.Table:
        block, word = table["block"].to_pylist(), table["word"].to_pylist()
        n, indexed, asked = (table[c].to_numpy() for c in ("n", "indexed", "asked"))
        row, near, form = look_up(block, word, n, indexed, asked, table["m"][0].as_py(), table["side"][0].as_py())
        pick = lambda k: pa.array([word[i] for i in k.tolist()], pa.string())
        return pa.table({"word": pick(row), "n_near": pa.array(near, pa.int64()), "form": pick(form), "form_n": pa.array(n[form], pa.int64())})

    dealt = blocks(words, least_length, tile, bin_size)
    found = dealt.groupBy("bin", "m", "side").applyInArrow(run, columns(word="string", n_near="long", form="string", form_n="long"))
    best = F.min(F.struct((-F.col("form_n")).alias("k"), "form", "form_n")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "b.form", "b.form_n")


def group_spellings(docs: DataFrame, least_length: int = 5, least_n: int = 3, factor: int = 2, tile: int = TILE, bin_size: int = BIN) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are counted over the whole texts of all documents; a null text has none, a null id is nothing before the
    colon of the hash; repeated rows count each; extra columns are ignored; an empty table gives an empty result. Near
    words differ by exactly one inserted, deleted or replaced code point. The form is the near word of largest n (ties:
    smallest by code points), if its n is at least `factor` times the word's; the root follows the forms to the last, and is
    the word itself if it has none.
    """
    words = save(count_words(docs, least_length, least_n), "spelling-words")
    near = words.join(near_counts(words, least_length, tile, bin_size), "word", "left")
    fits = F.col("form_n") >= factor * F.col("n")
    rows = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    rows = save(rows.withColumn("root", F.coalesce("form", "word")), "spelling-rows")
    # Each form has twice the count at least, so chains are short; each round doubles what a root has followed.
    while True:
        ends = rows.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = save(rows.join(ends, "root", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-rows")
        rows = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return rows.select("word", "form", "root", "n", "n_near", "form_n")
