"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, by a forward algorithm; a text's is the product over its words. Piece probabilities
are fitted by expectation-maximisation: Spark counts the words of each language, tasks run the forward-backward
algorithm over word types, and the expected counts are summed by piece, so what comes to the driver is bounded by
vocabulary times languages. The algorithms run over many words at once, in logarithms, so no word is too long.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, save
from .quality_mil import held_out

#: Where the public vocabulary lies; an argument of `fit_languages`.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bound of the labelled rows that the piece probabilities are fitted on (lowest hashes of doc_id).
MAX_FIT_ROWS = 8000
#: Characters of text that are scored together, and of words whose scores are kept between texts: bounds of memory.
TEXT_SLICE, WORD_CACHE = 1 << 20, 1 << 25
#: Logarithm of the probability of a character that is no piece, alike in all languages.
RARE = math.log(1e-7)
_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces of letters, lower-cased, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.vocab_size())}
    return sorted(p for p in pieces if p == _START or _LETTERS.fullmatch(p.removeprefix(_START)))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters of the whole text, whatever their length."""
    return _LETTERS.findall(text.lower()) if text else []


class Lattice:
    """Finds the pieces in words by a trie over the vocabulary, whose edges are sorted numbers (node, character)."""

    def __init__(self, pieces: list[str]):
        nodes, edges, ends = {"": 0}, {}, {}
        for k, piece in enumerate(pieces):
            for i in range(1, len(piece) + 1):
                if piece[:i] not in nodes:
                    edges[nodes[piece[: i - 1]] << 21 | ord(piece[i - 1])] = nodes[piece[:i]] = len(nodes)
            ends[nodes[piece]] = k
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.full(len(nodes), -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def spans(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, piece, lengths): pieces of the marked words, laid end to end with one place more for each.

        first and last are places; piece is -1 for a character that is no piece. Places of a word count from its
        own first one; lengths are in characters, the mark included.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        code = np.frombuffer((_START + _START.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))  # characters from here to the word's end
        place = np.arange(len(code)) + np.repeat(np.arange(len(words)), lengths)
        at, node, n, found = np.arange(len(code)), np.zeros(len(code), np.int64), 0, []
        while len(at):
            key = node << 21 | code[at + n]
            edge = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[edge] == key if len(self.keys) else np.zeros(len(at), bool)
            if not n:  # a character is always a piece, if only a rare one
                found.append((at, 1, np.where(hit, self.piece[self.to[edge]], -1) if len(self.keys) else np.full(len(at), -1)))
            at, node, n = at[hit], self.to[edge[hit]] if len(self.keys) else node[:0], n + 1
            if n > 1:
                piece = self.piece[node]
                whole = piece >= 0
                found.append((at[whole], n, piece[whole]))
            more = left[at] > n
            at, node = at[more], node[more]
        first = np.concatenate([place[a] for a, _, _ in found])
        return first, first + np.repeat([n for _, n, _ in found], [len(a) for a, _, _ in found]), np.concatenate([p for _, _, p in found]), lengths


def _sweep(into: np.ndarray, out: np.ndarray, weight: np.ndarray, step: np.ndarray, values: np.ndarray) -> None:
    """values[into] = log of the sum of exp(values[out] + weight), for the spans of each step in turn."""
    order = np.lexsort((into, step))
    into, out, weight = into[order], out[order], weight[order]
    bounds = np.flatnonzero(np.diff(step[order], prepend=-1)).tolist() + [len(order)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = into[a:b]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        terms = values[out[a:b]] + weight[a:b]
        top = np.maximum.reduceat(terms, at)
        sums = np.add.reduceat(np.exp(terms - np.repeat(top, np.diff(at, append=b - a), axis=0)), at)
        values[own[at]] = top + np.log(sums)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths + 1) - lengths - 1


def forward(words: list[str], lattice: Lattice, logs: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over its segmentations. `logs`: by piece and language."""
    if not words:
        return np.empty((0, logs.shape[1]))
    first, last, piece, lengths = lattice.spans(words)
    start = _starts(lengths)
    values = np.zeros((int(lengths.sum()) + len(words), logs.shape[1]))
    _sweep(last, first, _weights(logs, piece), last - np.repeat(start, lengths + 1)[last], values)
    return values[start + lengths]


def _weights(logs: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return np.concatenate([logs, np.full((1, logs.shape[1]), RARE)])[piece]


def expected_counts(words: list[str], times: np.ndarray, lattice: Lattice, logs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words, each counted `times`, over all segmentations. `logs`: by piece."""
    if not words:
        return np.zeros(len(logs))
    first, last, piece, lengths = lattice.spans(words)
    start, own = _starts(lengths), np.repeat(np.arange(len(words)), lengths + 1)
    weight = _weights(logs[:, None], piece)
    ahead, back = np.zeros((len(own), 1)), np.zeros((len(own), 1))
    _sweep(last, first, weight, last - start[own[last]], ahead)
    _sweep(first, last, weight, (start + lengths)[own[first]] - first, back)
    share = np.exp(ahead[first] + weight + back[last] - ahead[(start + lengths)[own[first]]])[:, 0]
    known = piece >= 0
    return np.bincount(piece[known], (share * times[own[first]])[known], len(logs))


def _slices(items: list[str], most: int) -> Iterator[slice]:
    """Runs of about `most` characters."""
    begin = size = 0
    for k, item in enumerate(items):
        size += len(item) + 8
        if size >= most:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(items):
        yield slice(begin, len(items))


class _WordTable(dict):
    """Word -> row of the scores; unknown words get the next row and wait for their scores."""

    def __init__(self, langs: int):
        super().__init__()
        self.new, self.held, self.scores = [], 0, np.empty((0, langs))

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        return row


class LanguageModel:
    def __init__(self, langs: list[str], pieces: list[str], logs: np.ndarray, prior: np.ndarray):
        self.langs, self.pieces, self.logs, self.prior = langs, pieces, logs, prior

    def scorer(self) -> Callable[[list[str | None]], Iterator[tuple[slice, list[str], np.ndarray]]]:
        """A function of texts: runs of them with languages and their posterior probabilities; (und, 0) without a letter.

        Ties go to the first language by name. Words that were scored are remembered, up to a bound, between calls.
        """
        lattice, table = Lattice(self.pieces), _WordTable(len(self.langs))

        def score(texts: list[str | None]) -> Iterator[tuple[slice, list[str], np.ndarray]]:
            nonlocal table
            for part in _slices([t or "" for t in texts], TEXT_SLICE):
                yield part, *self._run(texts[part], lattice, table)
                if table.held > WORD_CACHE:
                    table = _WordTable(len(self.langs))

        return score

    def _run(self, texts: list[str | None], lattice: Lattice, table: _WordTable) -> tuple[list[str], np.ndarray]:
        words = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        if not len(self.langs) or not counts.any():
            return ["und"] * len(texts), np.zeros(len(texts))
        rows = np.fromiter(map(table.__getitem__, [w for own in words for w in own]), np.int64, int(counts.sum()))
        new, table.new = table.new, []
        table.scores = np.concatenate([table.scores, *[forward(new[s], lattice, self.logs) for s in _slices(new, TEXT_SLICE)]])
        table.held += sum(map(len, new)) + 64 * len(new)
        full = counts > 0
        totals = np.add.reduceat(table.scores[rows], (np.cumsum(counts) - counts)[full]) + self.prior
        best = totals.argmax(1)
        out = np.zeros(len(texts))
        out[full] = 1 / np.exp(totals - totals.max(1, keepdims=True)).sum(1)
        found = np.full(len(texts), -1)
        found[full] = best
        return [self.langs[k] if k >= 0 else "und" for k in found.tolist()], out


def fit_languages(docs: DataFrame, vocabulary: str = VOCABULARY, max_fit_rows: int = MAX_FIT_ROWS, rounds: int = 2) -> LanguageModel:
    """Fit on documents with text and lang outside the held-out fold (crc32(doc_id) mod 4 is 2), bounded in number.

    A row is known by its id, language and text: rows of one id that differ are examples of their own, each with its own
    language; equal rows are one. Extra columns are ignored; without a labelled row the model knows no language.
    """
    known = docs.where("text is not null and lang is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = known.where(~held_out(F.col("doc_id"), 4, 2)).withColumn("text_hash", F.xxhash64("text"))
    # The lowest hashes of the ids; what is sorted are ids, languages and hashes of texts, and the sample is bounded.
    row = ["doc_id", "lang", "text_hash"]
    sample = save(rows.select(*row).orderBy(F.xxhash64("doc_id"), *row).limit(max_fit_rows).distinct(), "language-sample")
    counts = sample.groupBy("lang").count().orderBy("lang").collect()
    langs = [r["lang"] for r in counts]
    if not langs:
        return LanguageModel([], [], np.empty((0, 0)), np.empty(0))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                total: Counter = Counter()
                for t in texts:
                    total.update(words_of(t))
                yield pd.DataFrame({"lang": lang, "word": list(total.keys()), "n": list(total.values())})

    sampled = rows.join(F.broadcast(sample), row)
    # Of equal rows one is read, so no more texts than the sample has rows.
    sampled = sampled.groupBy(*row).agg(F.first("text").alias("text")).select("lang", "text")
    words = sampled.mapInPandas(count, columns(lang="string", word="string", n="long")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = save(words, "language-words")
    pieces = load_pieces(vocabulary)
    place = {lang: k for k, lang in enumerate(langs)}
    logs = np.full((len(pieces), len(langs)), -math.log(len(pieces)))
    for _ in range(rounds):

        def expect(batches: Iterator[pd.DataFrame], logs=logs) -> Iterator[pd.DataFrame]:
            lattice, total = Lattice(pieces), np.zeros(logs.shape)
            for batch in batches:
                for lang, own in batch.groupby("lang"):
                    k, kinds, times = place[lang], own["word"].tolist(), own["n"].to_numpy()
                    for s in _slices(kinds, TEXT_SLICE):
                        total[:, k] += expected_counts(kinds[s], times[s], lattice, logs[:, k])
            piece, k = np.nonzero(total)
            yield pd.DataFrame({"lang": k, "piece": piece, "n": total[piece, k]})

        expected = words.mapInPandas(expect, columns(lang="long", piece="long", n="double")).groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        found = expected.toPandas()  # at most vocabulary times languages
        uses = np.full(logs.shape, 0.1)
        uses[found["piece"], found["lang"]] += found["n"]
        logs = np.log(uses / uses.sum(0))
    prior = np.log([r["count"] for r in counts]) - math.log(sum(r["count"] for r in counts))
    return LanguageModel(langs, pieces, logs, prior)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Texts that are null or have no letter are `und` with score 0. Whole texts and whole words count, whatever their
    length; repeated rows get the same answer; ties go to the first language by name; extra columns are ignored; an
    empty table gives an empty result; without a labelled row every text is `und`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for batch in batches:
            for part, langs, scores in score(batch["text"].tolist()):
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part], "lang_pred": pd.Series(langs, dtype=object).to_numpy(), "score": scores})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInPandas(run, columns(doc_id="long", lang_pred="string", score="double"))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
