"""Quality rules by host, in DataFrame functions only.

Every document is measured by rules on its own text. Failures are then counted by host; each host's failure rate is a
beta posterior whose prior is estimated from the spread of the rates between all hosts, so hosts of few documents follow
the rest. A host whose rate is credibly above the tolerated one takes its documents with it, also those that keep the
rules themselves. Measures are written once, so texts are read once; what is joined back are the verdicts of hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, save

#: Words of a window, and the least words and the largest share of repeated words (percent) of a document.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: The rate of failing documents above which a host goes, and the width of its posterior's interval.
TOLERATED, WIDTH = 0.5, 1.645
#: Parts into which the documents of a host are dealt when its verdict is joined.
PARTS = 32


def bound(value: Column, use) -> Column:
    """use(value) with the value under a name, so that it is computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that are in the array twice or more, the first ones included.

    Windows are compared by 64-bit hashes, built by halves. Only arrays with a window twice are sorted.
    """
    join = lambda h, k: F.zip_with(h, F.slice(h, k + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        twice = bound(placed, lambda s: F.filter(s, lambda x, i: F.coalesce(same(s, i, i - 1), F.lit(False)) | F.coalesce(same(s, i, i + 1), F.lit(False))))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        # Each such window adds the words up to the next one, a whole window at most.
        return bound(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = bound(bound(bound(hashed, lambda h: join(h, 1)), lambda h: join(h, 2)), lambda h: F.slice(join(h, 4), F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))
    own = bound(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) > WINDOW, own).otherwise(0).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    return {
        "_words": both, "word_chars": F.length(F.translate(text, " " + SPACES, "")).cast("long"), "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def measure_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed), one row per document."""
    m = measures(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), *[c.alias(k) for k, c in m.items()])
    rows = rows.select("doc_id", "host", F.col("_words.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_words.r").alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def host_verdicts(measured: DataFrame, tolerated: float = TOLERATED, z: float = WIDTH) -> DataFrame:
    """(host, documents, failed, rate, low, rejected) of every host that is not null.

    rate is the mean of the posterior, low its lower bound. Prior: the rate of all documents, with a strength by the moments of the
    hosts' rates, between 2 and 1000 documents. Counts are combined before they are shuffled, so a host of many
    documents is no hot key.
    """
    hosts = measured.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if("base_failed").cast("double").alias("bad"))
    every = hosts.agg(F.sum("n").alias("t"), F.sum("bad").alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"), F.count(F.lit(1)).alias("k"))
    p = (F.col("b") + 0.5) / (F.col("t") + 1)
    within = p * (1 - p)
    between = (F.col("bb") - F.col("b") * F.col("b") / F.col("t") - (F.col("k") - 1) * within) / (F.col("t") - F.col("nn") / F.col("t"))
    strength = F.when((F.col("k") > 1) & (between > 0), F.least(F.lit(1000.0), F.greatest(F.lit(2.0), within / between - 1))).otherwise(F.lit(1000.0))
    prior = every.where("k > 0").select(p.alias("p"), strength.alias("m"))
    a, b = F.col("bad") + F.col("p") * F.col("m"), F.col("n") - F.col("bad") + (1 - F.col("p")) * F.col("m")
    low = F.greatest(F.lit(0.0), a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
    shrunk = hosts.join(F.broadcast(prior)).select("host", F.col("n").cast("long").alias("documents"), F.col("bad").cast("long").alias("failed"), (a / (a + b)).alias("rate"), low.alias("low"))  # the prior is one row
    return shrunk.withColumn("rejected", F.col("low") > tolerated)


def judge_documents(docs: DataFrame, host: str = "source", tolerated: float = TOLERATED, z: float = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host,
    host_rate, host_low.

    A document is kept if it does not fail the rules itself and its host is not rejected. Documents without a host are
    judged by themselves. Null texts are empty and fail; whole texts of any length count; repeated rows are documents
    of their own; extra columns are ignored; an empty table gives an empty result.
    """
    measured = save(measure_documents(docs, host), "host-rules")
    verdicts = host_verdicts(measured, tolerated, z).select("host", "rate", "low", "rejected")
    # A host's documents are dealt into parts, each of which meets a copy of the verdict, so a large host is no hot key.
    dealt = measured.withColumn("_part", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(PARTS)))
    spread = verdicts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    rows = dealt.join(spread, ["host", "_part"], "left")
    kept = ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host", F.round("rate", 6).alias("host_rate"), F.round("low", 6).alias("host_low"))


def keep_good_hosts(docs: DataFrame, host: str = "source", **options) -> DataFrame:
    """`docs` without the rows that fail the rules or whose host is rejected, judged in place; all columns come back."""
    verdicts = host_verdicts(measure_documents(docs, host), **options).where("rejected")
    bad = save(verdicts.select(F.col("host").alias("_host")), "rejected-hosts")
    m = measures(F.col("text"))
    good = docs.where(~((m["_words"]["n"] < LEAST_WORDS) | (100 * m["_words"]["r"] > MOST_REPEATED * m["_words"]["n"])))
    return good.join(bad, good[host].cast("string") == F.col("_host"), "left_anti")
