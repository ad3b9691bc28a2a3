"""Personal data by bootstrapped contextual extraction.

Fixed patterns (email, ip, card, phone) give the seed entities. The words before and after an entity, its shape and
its ending induce lexical patterns; other strings with a digit or an @ are candidate instances of the same patterns. Spark scores the bipartite
graph of patterns and instances in rounds: a pattern is as good as the share of its instances believed to be of its
kind (smoothed, so that few instances do not suffice), an instance as good as its patterns make it. Patterns of high
confidence then mark the candidates in their context as identifiers of that kind. Strings that a fixed pattern has
tested and dropped (a card number that fails Luhn) count against patterns and are never marked.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, save

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match that fails at the first digit of a run fails at the others: the look-behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _SIGN, _WORD = re.compile(r"[0-9]"), re.compile(r"[0-9@]"), re.compile(r"\S+")
_TOKEN = re.compile(r"[A-Za-z0-9._@/+-]+")
_INSIDE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._@/+-")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str, dropped: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that pass their test, by code points, end exclusive.

    The places of those that fail are added to `dropped`.
    """
    dropped = [] if dropped is None else dropped
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
        else:
            dropped.append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
        elif len(digits) >= 13:
            dropped.append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def shape(value: str) -> str:
    """Runs of digits and letters by length, other characters as they are."""
    return re.sub(r"[A-Za-z]+", lambda m: f"a{len(m[0])}", re.sub(r"[0-9]+", lambda m: f"\x00{len(m[0])}", value)).replace("\x00", "9")


def _candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Strings of five characters or more with a digit or an @, outside the taken spans."""
    taken, done, k = sorted(taken), 0, 0
    for m in _SIGN.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and text[start - 1] in _INSIDE:
            start -= 1
        end = _TOKEN.match(text, start).end()
        done = end
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        value = text[start:end].rstrip("._/+-@")
        if len(value) >= 5 and (k == len(taken) or taken[k][0] >= end):
            yield start, start + len(value)


def contexts(text: str, words: list[tuple[int, int]], start: int, end: int) -> list[str]:
    """Patterns of an entity: the two words before, the word before or after with the shape, the loose shape, the ending.

    `words` are the places of the text's words; ^ and $ stand for its ends.
    """
    k, n = bisect_left(words, (start,)), bisect_left(words, (end,))
    if k and words[k - 1][1] > start:  # the entity begins inside a word
        before = [text[words[k - 1][0] : start].lower()] if k < 2 else [text[slice(*words[k - 2])].lower(), text[words[k - 1][0] : start].lower()]
    else:
        before = [text[slice(*w)].lower() for w in words[max(0, k - 2) : k]]
    after = text[slice(*words[n])].lower() if n < len(words) else "$"
    value, form = text[start:end], shape(text[start:end])
    found = ["2 " + " ".join(before or ["^"]), f"s {before[-1] if before else '^'} {form}", f"a {form} {after}", "f " + re.sub(r"([9a])[0-9]+", r"\1", form)]
    tail = max(value.rfind("@"), value.rfind("."))
    at = value.find("@") if "@" in value else tail
    return found + ([f"t {re.sub('[0-9]+', '9', value[at:].lower())}"] if at > 0 else [])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row_id, doc_id, text in zip(batch["row_id"], batch["doc_id"].array, batch["text"], strict=True):
            dropped: list[tuple[int, int]] = []
            spans = base_spans(text, dropped)
            digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
            taken = [(a, b) for _, a, b in spans]
            bad = [(a, b) for a, b in dropped if not any(a < d and c < b for c, d in taken)]
            seen = [*spans, *[("no", a, b) for a, b in bad], *[(None, a, b) for a, b in _candidates(text, taken + bad)]]
            words = [m.span() for m in _WORD.finditer(text)] if seen else []
            found = [{"kind": k, "start": a, "end": b, "value": text[a:b], "patterns": contexts(text, words, a, b)} for k, a, b in seen]
            rows.append((row_id, None if pd.isna(doc_id) else int(doc_id), *[sum(k == kind for k, _, _ in spans) for kind in KINDS], digest, found))
        frame = pd.DataFrame(rows, columns=["row_id", "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "found"])
        yield frame.astype({"doc_id": "Int64"})


def _scanned(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = "array<struct<kind: string, start: bigint, end: bigint, value: string, patterns: array<string>>>"
    scanned = rows.mapInPandas(_scan, columns(row_id="long", doc_id="long", n_email="long", n_ip="long", n_card="long", n_phone="long", base_sha256="string", found=found))
    return save(scanned, "pii-scan")


def _discovered(each: DataFrame, min_confidence: float, rounds: int) -> DataFrame:
    """(row_id, start, end, value, kind) of the candidates, rows of null kind, that confident patterns mark."""
    uses = each.select("row_id", "kind", "start", "end", "value", F.explode("patterns").alias("pattern"))
    edges = save(uses.select("pattern", "value").distinct(), "pii-edges")
    seeds = save(each.where("kind is not null and kind <> 'no'").select("value", "kind").distinct(), "pii-seeds")
    patterns = score_patterns(edges, seeds, rounds).where(F.col("confidence") >= min_confidence).select("pattern", F.col("kind").alias("as"), "confidence")
    return uses.where("kind is null").join(patterns, "pattern").groupBy("row_id", "start", "end", "value").agg(F.max_by("as", F.struct("confidence", "as")).alias("kind"))


def masked_recall(docs: DataFrame, share: float = 0.2, min_confidence: float = 0.75, rounds: int = 3) -> DataFrame:
    """(kind, masked, found, wrong): seeds hidden by a hash of their text, and how many of them the patterns find again."""
    each = _scanned(docs).select("row_id", F.explode("found").alias("f")).select("row_id", "f.*")
    hidden = F.col("kind").isin(*KINDS) & (F.pmod(F.xxhash64("value"), F.lit(1000)) < int(1000 * share))
    each = save(each.withColumn("truth", F.when(hidden, F.col("kind"))).withColumn("kind", F.when(~hidden | F.col("kind").isNull(), F.col("kind"))), "pii-masked")
    new = _discovered(each, min_confidence, rounds).select("row_id", "start", "end", F.col("kind").alias("as"))
    both = each.where("truth is not null").select("row_id", "start", "end", "truth").join(new, ["row_id", "start", "end"], "left")
    return both.groupBy(F.col("truth").alias("kind")).agg(F.count(F.lit(1)).alias("masked"), F.count_if(F.col("as") == F.col("truth")).alias("found"), F.count_if(F.col("as") != F.col("truth")).alias("wrong"))


def score_patterns(edges: DataFrame, seeds: DataFrame, rounds: int = 3) -> DataFrame:
    """(pattern, kind, confidence, support) from distinct edges (pattern, value) and seeds (value, kind)."""
    beliefs = seeds.select("value", "kind", F.lit(1.0).alias("belief"))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    for last in [False] * (rounds - 1) + [True]:
        summed = edges.join(beliefs, "value").groupBy("pattern", "kind").agg(F.sum("belief").alias("good"), F.sum((F.col("belief") == 1).cast("long")).alias("support"))
        patterns = summed.join(sizes, "pattern").select("pattern", "kind", (F.col("good") / (F.col("n") + 1)).alias("confidence"), "support")
        # A pattern without three seeds or with less than half a kind persuades nobody.
        patterns = save(patterns.where("support >= 3 and confidence >= 0.5"), "pii-patterns")
        if last:
            return patterns
        doubt = F.exp(F.sum(F.log(1 - F.col("confidence"))))
        induced = edges.join(patterns, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("belief")).join(seeds, ["value", "kind"], "left_anti")
        beliefs = seeds.select("value", "kind", F.lit(1.0).alias("belief")).union(induced.select("value", "kind", F.least("belief", F.lit(0.99)).alias("belief")))
    raise ValueError("rounds must be positive")


def find_pii(docs: DataFrame, min_confidence: float = 0.75, rounds: int = 3) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, entities.

    entities is an array of (kind, start, end, text, seed) by kind and start: base spans (seed true) and those that
    the bootstrapped patterns add; spans lists them as kind:start:end, comma-joined. Null texts are empty; texts and
    words of any length are taken whole. Repeated
    rows are documents of their own; extra columns are ignored; an empty table gives an empty result.
    """
    scanned = _scanned(docs)
    each = scanned.select("row_id", F.explode("found").alias("f")).select("row_id", "f.*")
    new = _discovered(each, min_confidence, rounds)
    entity = F.struct(F.col("kind"), F.col("start"), F.col("end"), F.col("value").alias("text"), F.lit(False).alias("seed"))
    new = new.groupBy("row_id").agg(F.collect_list(entity).alias("new"))  # bounded by the document's own strings
    base = F.transform(F.filter("found", lambda f: f["kind"].isin(*KINDS)), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"), f["value"].alias("text"), F.lit(True).alias("seed")))
    every = F.concat(base, F.coalesce("new", F.array().cast("array<struct<kind: string, start: bigint, end: bigint, text: string, seed: boolean>>")))
    place = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.transform(F.array_sort(F.transform(every, lambda e: F.struct(F.array_position(place, e["kind"]).alias("o"), e["start"].alias("s"), e["end"].alias("t"), e.alias("e")))), lambda x: x["e"])
    out = scanned.join(new, "row_id", "left").withColumn("entities", ordered)
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), "entities")
