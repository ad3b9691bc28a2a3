"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (windows of PASSAGE bytes over the whole text). Each passage becomes a vector of hashed
character trigrams, character-class shares, repetition and length; a small network encodes it; gated attention, learnt from document
labels alone, weighs the passages; the weighted representation is scored by a logistic unit. The network is trained on
the driver from a bounded sample of labelled rows; features and scores are computed by Spark tasks over whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, save, text_bytes

PASSAGE = 512
#: Bounds of what the network is fitted on: labelled rows (lowest hashes of doc_id) and the bytes of their texts, of which
#: one row may hold an eighth. Rows are taken or left, their passages are all taken. Scores take every row and passage.
MAX_FIT_ROWS, MAX_FIT_BYTES = 6000, 1 << 26
#: Texts are looked at in slices of so many bytes (whole passages), so memory grows neither with a batch nor with a text.
SLICE = 1 << 21

# Character classes by byte: lower, upper, digit, space, line end, stops, other ASCII, non-ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[128:] = 7
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
for _i, _chars in ((3, " \t\r\x0b\x0c"), (4, "\n"), (5, ".,;:?!")):
    _CLASS[list(_chars.encode())] = _i
N_CLASSES, GRAMS = 8, 512
N_FEATURES = N_CLASSES + 3
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def passage_features(texts: list[bytes] | list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, hashed trigram counts of every passage, number of passages of each text); an empty text has none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // PASSAGE)
    total = int(counts.sum())
    if not total:
        return np.empty((0, N_FEATURES), np.float32), np.empty((0, GRAMS), np.uint8), counts
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    own = np.repeat(np.arange(len(texts)), counts)
    k = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    first = starts[own] + k * PASSAGE
    last = np.minimum(first + PASSAGE, starts[own] + sizes[own])
    length = (last - first).astype(np.float64)
    kind = _CLASS[data]
    window = np.repeat(np.arange(total, dtype=np.int64), last - first)
    share = np.bincount(window * N_CLASSES + kind, minlength=total * N_CLASSES).reshape(total, N_CLASSES) / length[:, None]
    words = np.add.reduceat((kind == 3) | (kind == 4), first, dtype=np.int64) + 1
    raw = data.tobytes()
    packed = np.fromiter((len(zlib.compress(raw[a:b], 1)) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.float64, total)
    more = np.stack([length / words / 10, packed / (length + 20), np.log(length) / 6], 1)
    low = _LOWER[data]
    gram = ((low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(23)
    inside = window[:-2] == window[2:]
    grams = np.bincount(window[:-2][inside] * GRAMS + gram[inside], minlength=total * GRAMS).reshape(total, GRAMS)
    return np.concatenate([share, more], 1).astype(np.float32), np.minimum(grams, 255).astype(np.uint8), counts


def design(features: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """What the network sees of each passage: its features, and square roots of its trigram counts."""
    return np.concatenate([features, np.sqrt(grams, dtype=np.float32)], 1)


def _slices(texts: pa.Array) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(places of the texts, their bytes): all texts in order, SLICE bytes at a time; a long one is cut between passages."""
    own, part, size = [], [], 0
    for k, data in enumerate(text_bytes(texts.fill_null(""))):
        for at in range(0, max(1, len(data)), SLICE):
            if size + min(SLICE, len(data) - at) > SLICE:
                yield own, part
                own, part, size = [], [], 0
            own.append(k)
            part.append(data[at : at + SLICE])
            size += len(part[-1])
    if part:
        yield own, part


class GatedAttentionMIL:
    """h = tanh(x W + b); a = softmax over the bag of (tanh(h V) * sigmoid(h U)) w; score = sigmoid(sum(a h) c + d)."""

    def __init__(self, inputs: int = N_FEATURES + GRAMS, hidden: int = 16, gate: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        shapes = {"W": (inputs, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": ()}
        self.p = {k: rng.normal(0, inputs**-0.5 if k == "W" else 0.3, s) if s and k != "b" else np.zeros(s) for k, s in shapes.items()}
        self.mean, self.std, self.base = np.zeros(inputs, np.float32), np.ones(inputs, np.float32), 0.5

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of bags with one passage at least."""
        p, at = self.p, np.concatenate([[0], np.cumsum(counts)[:-1]])
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
        a = e / np.repeat(np.add.reduceat(e, at), counts)
        z = np.add.reduceat(a[:, None] * h, at)
        return {"at": at, "h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def _gradients(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x, counts)
        do = (f["y"] - label) / len(label)
        dz = np.repeat(do[:, None] * p["c"], counts, axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["at"]), counts))
        dt = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        ds = de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ do, "d": do.sum()}

    def fit(self, features: np.ndarray, grams: np.ndarray, counts: np.ndarray, label: np.ndarray, epochs: int = 15, batch: int = 64, rate: float = 0.005, decay: float = 1e-4, seed: int = 5) -> GatedAttentionMIL:
        self.base = float(label.mean()) if len(label) else 0.5
        if not len(features):
            return self
        at = np.concatenate([[0], np.cumsum(counts)])
        parts = [design(features[i : i + 4096], grams[i : i + 4096]) for i in range(0, len(features), 4096)]
        self.mean = np.stack([x.sum(0, dtype=np.float64) for x in parts]).sum(0) / len(features)
        self.std = np.sqrt(np.stack([((x - self.mean) ** 2).sum(0) for x in parts]).sum(0) / len(features)) + 0.05
        self.mean, self.std = self.mean.astype(np.float32), self.std.astype(np.float32)
        full = np.flatnonzero(counts > 0)
        m, v = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}
        rng, step = np.random.default_rng(seed), 0
        for epoch in range(epochs):
            speed = rate * (1 - epoch / epochs)
            for part in np.array_split(rng.permutation(full), max(1, len(full) // batch)):
                rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in part])
                x = (design(features[rows], grams[rows]) - self.mean) / self.std
                g, step = self._gradients(x, counts[part], label[part]), step + 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = self.p[k] * (1 - decay) - speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def attend(self, features: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each bag (with a passage at least): the largest attention e, and the sums of exp(e - largest), alone and times h."""
        p, at = self.p, np.cumsum(counts) - counts
        h = np.tanh((design(features, grams) - self.mean) / self.std @ p["W"] + p["b"])
        e = (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]
        top = np.maximum.reduceat(e, at)
        e = np.exp(e - np.repeat(top, counts))
        return top, np.add.reduceat(e, at), np.add.reduceat(e[:, None] * h, at)

    def score_texts(self, texts: pa.Array) -> np.ndarray:
        """Scores of whole texts. The softmax over the passages of a text runs on from slice to slice."""
        top, total, pooled = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros((len(texts), len(self.p["c"])))
        for own, part in _slices(texts):
            x, grams, counts = passage_features(part)
            full = counts > 0
            if not full.any():
                continue
            k = np.array(own)[full]  # a text is in a slice once
            t, s, z = self.attend(x, grams, counts[full])
            most = np.maximum(top[k], t)
            before, now = np.exp(top[k] - most), np.exp(t - most)
            top[k], total[k], pooled[k] = most, total[k] * before + s * now, pooled[k] * before[:, None] + z * now[:, None]
        out, full = np.full(len(texts), self.base), total > 0
        out[full] = 1 / (1 + np.exp(-(pooled[full] / total[full, None] @ self.p["c"] + self.p["d"])))
        return out


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod folds is fold; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_fit_rows: int = MAX_FIT_ROWS, max_fit_bytes: int = MAX_FIT_BYTES) -> GatedAttentionMIL:
    """Train on labelled documents outside the held-out fold: at most `max_fit_rows` rows of `max_fit_bytes` in all.

    Rows of one id that differ in text are examples of their own, equal rows are one; of labels that disagree on an id
    the smallest counts. Rows come in order of a hash of the id; one that alone has more than an eighth of the bytes is
    passed over. Null ids and labels are left out; extra columns are ignored; without a labelled row all score 0.5.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = save(known.orderBy(*order).limit(max_fit_rows), "quality-ids")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    # The ids are bounded by max_fit_rows rows of two numbers, and so is the sample.
    small = F.octet_length("text") <= max_fit_bytes // 8
    sample = rows.join(F.broadcast(ids), "doc_id").where(small).select("doc_id", "text_hash", "label", F.octet_length("text").alias("bytes"))
    sample = save(sample.orderBy(*order, "text_hash").limit(max_fit_rows).distinct(), "quality-sample")
    upto = F.sum("bytes").over(Window.orderBy(*order, "text_hash").rowsBetween(Window.unboundedPreceding, 0))
    sample = sample.withColumn("upto", upto).where(F.col("upto") <= max_fit_bytes).select("doc_id", "text_hash", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [b""] * batch.num_rows
            for own, part in _slices(batch.column(3)):
                x, grams, counts = passage_features(part)
                ends = np.cumsum(counts)
                for k, a, b in zip(own, (ends - counts).tolist(), ends.tolist(), strict=True):
                    bags[k] += np.concatenate([x[a:b].view(np.uint8).reshape(b - a, 4 * N_FEATURES), grams[a:b]], 1).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(bags, pa.binary())], names=["doc_id", "text_hash", "label", "x"])

    bags = rows.join(F.broadcast(sample), ["doc_id", "text_hash"]).select("doc_id", "text_hash", "label", "text").mapInArrow(run, columns(doc_id="long", text_hash="long", label="double", x="binary"))
    # One bag of each sampled row comes to the driver: about the bytes of their texts.
    frame = bags.groupBy("doc_id", "text_hash").agg(F.min(F.struct("x", "label")).alias("bag")).select("doc_id", "text_hash", "bag.*").toPandas().sort_values(["doc_id", "text_hash"])
    width = 4 * N_FEATURES + GRAMS
    flat = np.frombuffer(b"".join(frame["x"]), np.uint8).reshape(-1, width)
    counts = np.array([len(b) // width for b in frame["x"]], np.int64)
    x = np.ascontiguousarray(flat[:, : 4 * N_FEATURES]).view(np.float32).reshape(-1, N_FEATURES)
    return GatedAttentionMIL().fit(x, flat[:, 4 * N_FEATURES :], counts, frame["label"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: GatedAttentionMIL, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold).

    Null and empty texts have no passage and score the share of label 1 among the training rows. Every passage of a
    text of any length counts. Repeated rows score alike; extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score_texts(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, columns(doc_id="long", score="double"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Pipeline form: `docs` without the rejected rows, scored in place so that no text is shuffled.

    Each row is judged by its own text, whatever its doc_id, null or repeated; all columns come back.
    """
    model = fit_quality(docs, labels, **options)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score_texts(batch.column(at)) >= threshold))

    return docs.mapInArrow(run, schema)
