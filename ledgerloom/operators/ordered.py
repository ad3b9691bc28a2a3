"""Running sums in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import cut


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], before: bool = False) -> DataFrame:
    """`rows` with a column for each of `sums`: its sum over the rows up to this one in `order` (`before`: without this one).

    Rows are dealt into ranges of the order, whose splitters Spark samples; each range is summed by a task, and what the
    ranges before it hold is a sum over ranges, of which there are as many as shuffle partitions. Rows that are equal in
    `order` lie in one range, so the order should tell rows apart: among equal ones it is open which comes first.
    """
    ranged = rows.withColumns({f"_v_{name}": value for name, value in sums.items()}).repartitionByRange(*order)
    # Written, so that the ranges are dealt once.
    ranged = cut(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    first = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = ranged.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    starts = per_range.select("_range", *[F.coalesce(F.sum(f"_s_{n}").over(first), F.lit(0)).alias(f"_b_{n}") for n in sums])
    run = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = ranged.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(run), F.lit(0)) for n in sums})
    out = local.join(F.broadcast(starts), "_range")  # a row for each range
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.col(f"_b_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums])
