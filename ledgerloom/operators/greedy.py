"""Connected components, and selection without reuse as a sequential scan would make it."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut, fresh_path
from .ordered import running_sums

#: Resource uses that one task scans at most, rounds between two looks at the components, and the share of the uses that
#: a round must free for further rounds to be worth more than a look.
WHOLE, ROUNDS, PROGRESS = 200_000, 2, 0.1


def merged(ends: DataFrame, name: str, key: str = "k") -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of `connected`: (name, key) of the keys that join ids, (name, group) with the smallest id of an id's keys,
    and the ends (name, key) between these groups."""
    keys = ends.groupBy(key).agg(F.min(name).alias("group"), F.max(name).alias("_last")).where(F.col("group") < F.col("_last")).drop("_last")
    live = cut(ends.select(name, key).join(keys, key), "component-ends")
    labels = cut(live.groupBy(name).agg(F.min("group").alias("group")), "component-labels")
    live = live.select(name, key)
    return live, labels, live.join(labels, name).select(F.col("group").alias(name), key).distinct()


def follow(labels: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """(name, group): the groups of the groups that `labels` give; what `groups` do not name stays."""
    far = groups.select(F.col(name).alias("group"), F.col("group").alias("far"))
    return labels.join(far, "group", "left").select(name, F.coalesce("far", "group").alias("group"))


def connected(ends: DataFrame, name: str, key: str = "k") -> DataFrame:
    """(name, group): rows that share a key, however indirectly, get one group, the smallest id reachable.

    `ends` has a row for each id (`name`) and key. Keys of one id join nothing and go; then each id is merged with the
    smallest id of its keys, as long as that halves the ends. On what is left, labels go from ids to keys and back, smallest
    first, and each id takes on the label of its label, so a chain takes a logarithmic number of rounds; each round is written.
    """
    names, steps, before = ends.select(name).distinct(), [], 0
    while True:
        live, labels, ends = merged(ends, name, key)
        n = live.count()
        if not n:
            break
        steps.append(labels)
        if before and 2 * n > before:
            steps[-1] = _spread(live, labels, name, key)
            break
        before = n
    groups = reduce(lambda far, labels: follow(labels, far, name), reversed(steps)) if steps else None
    return follow(names.withColumn("group", F.col(name)), groups, name) if steps else names.withColumn("group", F.col(name))


def _spread(ends: DataFrame, labels: DataFrame, name: str, key: str) -> DataFrame:
    """The rounds of `connected`, from labels that are ids of the same component."""
    while True:
        by_key = ends.join(labels, name).groupBy(key).agg(F.min("group").alias("group"))
        near = ends.join(by_key, key).groupBy(name).agg(F.min("group").alias("near"))
        step = labels.join(near, name).select(name, F.col("group").alias("old"), F.least("group", "near").alias("group"))
        far = labels.select(F.col(name).alias("group"), F.col("group").alias("far"))
        step = cut(step.join(far, "group", "left").select(name, "old", F.least("group", F.coalesce("far", "group")).alias("group")), "component-labels")
        labels = step.select(name, "group")
        if not step.where("old <> group").limit(1).count():
            return labels


def _scan(uses: pa.Table) -> pa.Table:
    """The places that a scan takes, of whole components."""
    uses = uses.sort_by("place")
    places, resources = uses["place"].to_pylist(), uses["resource"].to_pylist()
    used: set[str] = set()
    taken, at = [], 0
    while at < len(places):
        own, k = [], at
        while k < len(places) and places[k] == places[at]:
            own.append(resources[k])
            k += 1
        if used.isdisjoint(own):
            used.update(own)
            taken.append(places[at])
        at = k
    return pa.table({"place": pa.array(taken, pa.int64())})


def greedy_select(options: DataFrame, order: list[Column], resources: str = "resources", whole: int = WHOLE) -> DataFrame:
    """The options that a scan in `order` would take, each option taking all of its `resources` if none is used yet.

    An option that shares no resource is taken whatever the order, so only the others are put into order. Of them an option that
    comes first on each of its resources is taken by the scan, whatever the others do; those that touch its resources are not. Rounds of such options go on as long as they free a tenth of the uses. Where they do not, what
    is left falls into components that share no resource: those of up to `whole` uses are dealt whole to tasks, which scan
    them, so a long chain of options that wait for each other costs no round a link. Only larger components go on in
    rounds. The last `whole` uses are one task's. `options` needs a unique option_id,
    which also breaks ties of the order; options without a resource are not taken.
    """
    spark = options.sparkSession
    options = cut(options, "greedy-options")
    each = options.select("option_id", F.array_distinct(resources).alias("all")).select("option_id", F.size("all").alias("n"), F.explode("all").alias("resource"))
    own = each.groupBy("resource").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("option_id", "n")).alias("x")).where("c = 1").select("x.*")
    alone = own.groupBy("option_id", "n").agg(F.count(F.lit(1)).alias("c")).where("c = n").select("option_id", F.lit(True).alias("_alone"))
    options = cut(options.join(alone, "option_id", "left").select(*[F.col(f"`{c}`") for c in options.columns], "_alone"), "greedy-options")
    alone, options = (options.where(test).drop("_alone") for test in ("_alone", "_alone is null"))
    placed = cut(running_sums(options, [*order, F.col("option_id")], {"_place": F.lit(1).cast("long")}), "greedy-options")
    needs = placed.select(F.col("_place").alias("place"), F.array_distinct(resources).alias("all"))
    live = cut(needs.select("place", F.size("all").alias("n"), F.explode("all").alias("resource")), "greedy-live")
    path, part = fresh_path(spark, "greedy-taken"), 0

    def note(places: DataFrame) -> DataFrame:
        nonlocal part
        places.select("place").write.parquet(f"{path}/part={part}")
        part += 1
        return spark.read.schema("place long").parquet(f"{path}/part={part - 1}")

    def take(places: DataFrame) -> DataFrame:
        """Note the places as taken; what they leave free."""
        used = live.join(note(places), "place", "left_semi").select("resource").distinct()
        gone = live.join(used, "resource", "left_semi").select("place").distinct()
        return cut(live.join(gone, "place", "left_anti"), "greedy-live")

    left, since_look = live.count(), 0
    while left:
        if left <= whole:
            note(live.select("place", "resource", F.lit(0).alias("task")).groupBy("task").applyInArrow(_scan, "place long"))
            break
        firsts = live.groupBy("resource").agg(F.min(F.struct("place", "n")).alias("x")).select("x.*")
        live = take(firsts.groupBy("place", "n").agg(F.count(F.lit(1)).alias("c")).where("c = n"))
        before, left, since_look = left, live.count(), since_look + 1
        if left > whole and since_look >= ROUNDS and before - left < PROGRESS * before:
            labels = connected(live, "place", "resource")
            sizes = live.join(labels, "place").groupBy("group").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= whole)
            small = live.join(labels.join(sizes, "group"), "place").withColumn("task", F.pmod(F.xxhash64("group"), F.lit(1 + 2 * left // whole)))
            live = take(small.select("place", "resource", "task").groupBy("task").applyInArrow(_scan, "place long"))
            left, since_look = live.count(), 0
    if not part:
        return alone
    taken = spark.read.schema("place long").parquet(path)
    return alone.union(placed.join(taken.withColumnRenamed("place", "_place"), "_place", "left_semi").drop("_place"))
