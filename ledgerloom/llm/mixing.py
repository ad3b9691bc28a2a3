"""Mixing sources to target weights, in DataFrame functions only.

The words of each source form one stream, packed into blocks of a fixed length. The output is a number of shards of
equal length in slots. How many slots each source gets in a shard is a multinomial draw, conditional on what it gets in
the whole mix, so that sources come near their targets. A source's slots are numbered shard after shard and map to
block numbers by a keyed pseudorandom permutation of the source's blocks, a new one for each pass through them; blocks
join by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, null_safe_join, running_sum, save, word_count

BLOCK_WORDS = 64
WEIGHTS = (5, 2, 1)
SLOTS_PER_ROW = 4096
SHARDS = 64
ROUNDS = 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh `weights` in turn and share `share` of all words by weight; a target stops
    at `cap` times the source's size, and the excess is shared anew by weight. In order of cap / weight the capped
    sources come first, so the level that the others get per unit of weight is found by running sums.
    """
    everything = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(cap))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    total = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(total) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = w.withColumn("level", rest / F.sum("weight").over(after))
    level = level.withColumn("free", F.col("level") * F.col("weight") < F.col("most"))
    first = F.min(F.when(F.col("free"), F.struct((F.col("most") / F.col("weight")).alias("k"), "level"))).over(total)["level"]
    return level.select("source", "source_size", F.least("most", F.coalesce(first * F.col("weight"), F.col("most"))).alias("target"))


def permuted(at: Column, n: Column, key: list[Column]) -> Column:
    """A keyed bijection of 0 .. n - 1: Feistel rounds over a grid of a x b >= n, walked on while outside n."""
    a = F.ceil(F.sqrt(n)).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), x % b
        for i in range(ROUNDS):
            if i % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(i), left, *key), b), b)
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(i), right, *key), a), a)
        return left * b + right

    first = once(at)
    # Fewer than a places lie outside, so a walk of a steps ends inside; nearly all end after the first.
    walked = F.aggregate(F.sequence(F.lit(1).cast("long"), a), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(walked)


def shard_counts(goals: DataFrame, seed: int, shards: int, block_words: int) -> DataFrame:
    """(source, blocks, shard, count, first): slots of each source in each shard, and the number of the first of them.

    `goals` has source, source_size, target. The slots of the whole mix are given to the sources end to end, as many as
    their targets say, and a keyed permutation of all slots deals each to a place in a shard. So a shard's counts are a
    multinomial draw by the target weights, conditional on the counts of the whole mix: shards vary as draws do, totals
    do not. Slots are counted where they are made; what is shuffled is one row per task, shard and source. A source has
    no more slots than `target / source_size` rounded up to whole passes.
    """
    blocks = F.ceil(F.col("source_size") / block_words)
    plan = goals.where("source_size > 0 and target > 0").withColumn("blocks", blocks)
    # A block counts as source_size / blocks words, so that the last, shorter one does not bias the total.
    plan = plan.withColumn("want", F.col("target") / F.col("source_size") * F.col("blocks"))
    everything = Window.orderBy(F.col("source").isNull(), F.col("source"))
    plan = plan.withColumn("end", F.round(F.sum("want").over(everything.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
    plan = plan.withColumn("begin", F.coalesce(F.lag("end").over(everything), F.lit(0)).cast("long"))
    plan = plan.withColumn("slots", F.max("end").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    most = (F.ceil(F.col("target") / F.col("source_size") - 1e-9) * F.col("blocks")).cast("long")
    plan = plan.withColumn("own", F.least(F.col("end") - F.col("begin"), most)).where("own > 0")
    rows = _chunks(plan, F.col("own"), "source").withColumn("place", permuted(F.col("begin") + F.col("at"), F.col("slots"), [F.lit(seed), F.lit(shards), F.lit("shard")]))
    shard = F.floor(F.col("place") * shards / F.col("slots")).cast("int")
    counts = rows.groupBy("source", F.col("blocks").cast("long").alias("blocks"), shard.alias("shard")).agg(F.count(F.lit(1)).alias("count"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long"))


def _chunks(rows: DataFrame, count: Column, *keys: str) -> DataFrame:
    """Each row `count` times, with `at` from 0, dealt to the tasks in pieces of bounded length."""
    parts = rows.withColumn("_n", count).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / SLOTS_PER_ROW))))
    begin = F.col("_chunk") * SLOTS_PER_ROW
    # By number, since Spark would join the small pieces into few tasks, which then make all the slots.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, *keys, "_chunk").withColumn("at", F.explode(F.sequence(begin, F.least(begin + SLOTS_PER_ROW, F.col("_n")) - 1))).drop("_n", "_chunk")


def draw_blocks(goals: DataFrame, seed: int, shards: int, block_words: int) -> DataFrame:
    """(source, shard, slot, block): the slots of every shard and the blocks that they take.

    Slot j of a source takes block permutation_k(j mod n) of pass k = j div n, so each pass takes every block once.
    """
    counts = save(shard_counts(goals, seed, shards, block_words), "mix-counts")
    slots = _chunks(counts, F.col("count"), "source", "shard").withColumnRenamed("at", "slot")
    number = F.col("first") + F.col("slot")
    block = permuted(number % F.col("blocks"), F.col("blocks"), [F.lit(seed), F.lit(shards), F.isnull("source"), F.col("source"), F.floor(number / F.col("blocks"))])
    return slots.select("source", "shard", "slot", block.alias("block"))


#: What tells rows apart: rows that agree here are alike, texts included.
ROW = ("doc_id", "size", "h1", "h2")


def pack(placed: DataFrame, block_words: int) -> DataFrame:
    """Rows with a place `start` in their source's stream, for each block that they reach: block, low, high.

    low and high bound the row's words in the block, counted from the row's first word.
    """
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.lit(0), F.col("block") * block_words - F.col("start")), F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start"))
    return parts.withColumns({"low": low.cast("long"), "high": high.cast("long")})


def _hashes() -> list[Column]:
    """96 bits of a row's doc_id, source and text, null or not."""
    parts = [F.isnull("doc_id"), F.col("doc_id"), F.isnull("source"), F.col("source"), F.isnull("text"), F.col("text")]
    return [F.xxhash64(*parts).alias("h1"), F.hash(*parts).alias("h2")]


def _sized(docs: DataFrame) -> DataFrame:
    return save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *_hashes()), "mix-sizes")


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows, and those with words and their place in the stream of their source."""
    sized = _sized(docs)
    # Repeated rows order arbitrarily among themselves, and are alike.
    return sized, save(running_sum(sized.where("size > 0"), ["source"], [F.col(c) for c in ROW], F.col("size"), "start"), "mix-places")


def mixed_blocks(docs: DataFrame, seed: int = 17, shards: int = SHARDS, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(shard, slot, source, block, words): the mix itself, packed blocks of words in the slots of each shard.

    A slot is the how-manieth of its source in its shard. Blocks hold `block_words` words but for the last one of a
    source. Null and empty texts have no words; a null source is a source; an empty table gives an empty result.
    """
    sized, placed = _placed(docs)
    goals = save(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mix-targets")
    h1, h2 = _hashes()
    texts = docs.select(h1, h2, "text").dropDuplicates(["h1", "h2"])
    spaced = F.translate("text", SPACES, " " * len(SPACES))
    parts = pack(placed, block_words).join(texts, ["h1", "h2"]).select("source", "block", "start", F.slice(F.array_remove(F.split(spaced, " "), ""), (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")).alias("part"))
    # A block's parts are bounded by its words.
    blocks = parts.groupBy("source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda p: p["part"])).alias("words"))
    drawn = draw_blocks(goals, seed, shards, block_words)
    return null_safe_join(drawn.hint("merge"), blocks, ["source", "block"]).select("shard", "slot", "source", "block", "words")


def mix_sources(docs: DataFrame, seed: int = 17, shards: int = SHARDS, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), taken (words the mix takes).

    Sizes are in words; null and empty texts have none and are never taken. A null source is a source. No document
    is taken more than `cap` = 2 times; the same table and seed give the same mix. Repeated rows are documents of
    their own. An empty table gives an empty result; extra columns are ignored.
    """
    return _mix(docs, seed, shards, block_words, weights, share, cap).select("doc_id", "source", "size", "source_size", "target", "taken")


def _mix(docs: DataFrame, seed: int = 17, shards: int = SHARDS, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix with the hashes and the place in the stream of each row."""
    sized, placed = _placed(docs)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = save(targets(sizes, weights, share, cap), "mix-targets")
    drawn = draw_blocks(goals, seed, shards, block_words).groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    # Both sides grow with the words; their estimates do not, so a merge join is asked for.
    parts = pack(placed, block_words).select("source", "start", "block", (F.col("high") - F.col("low")).alias("words"))
    taken = null_safe_join(parts.hint("merge"), drawn, ["source", "block"]).groupBy("source", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # By the place in the stream, which tells repeated rows apart: documents with words never share one.
    every = null_safe_join(placed.hint("merge"), taken, ["source", "start"], "left").select("source", *ROW, "start", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    every = every.union(sized.where("size = 0").select("source", *ROW, F.lit(0).cast("long"), F.lit(0).cast("long")))
    return null_safe_join(every, goals, ["source"])


def mixed_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """Pipeline form: `docs` with each row repeated as often as the mix takes it.

    Documents stay whole: how many of their words the drawn blocks take, over their size (2 at most), says how often a
    document is repeated; the fraction is settled by a hash of the row and its place, so that sources
    keep near their targets. Rows that are alike in doc_id, source and text share their copies out. Rows of a null doc_id
    or source are rows like others. Null texts and texts without a word are not part of a mix of words. All columns come
    back, whatever their names; an empty table gives an empty result. `mixed_blocks` gives the packed blocks.
    """
    mix = _mix(docs, seed, **options)
    ratio = F.try_divide(F.col("taken"), F.col("size"))
    more = F.pmod(F.xxhash64(F.lit(seed), F.lit("copies"), "h1", "h2", "start"), F.lit(1 << 20)) / (1 << 20) < ratio - F.floor(ratio)
    copies = mix.where("size > 0").select("h1", "h2", (F.floor(ratio) + more.cast("long")).alias("n"))
    copies = copies.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0")
    h1, h2 = _hashes()
    # Whatever the columns of `docs` are called, they travel in one struct.
    both = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), h1, h2).join(copies, ["h1", "h2"])
    alone = both.where("rows = 1").select("row", F.col("n").cast("int").alias("own"))
    at = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("n"))
    again = both.where("rows > 1").withColumn("at", at).select("row", (F.floor(F.col("n") / F.col("rows")) + (F.col("at") <= F.col("n") % F.col("rows")).cast("long")).cast("int").alias("own"))
    return alone.union(again).where("own > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("own")))).select("row.*")
