"""Bounded streaming jobs: everything available is processed, then the query ends and its table is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import fresh_path


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, a file or a folder of files, as a stream; the schema is the table's."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # Spark takes a plain path of a stream for a folder; what a pattern finds may be either.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


def run_to_table(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Append the stream to a table in the shared folder until it has caught up, and read that.

    With a `path` of an earlier run the query goes on where that one ended.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_intake(docs: DataFrame, arrival: str = "arrived") -> DataFrame:
    """Documents once per content hash within the watermark."""
    hashed = docs.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return hashed.withWatermark(arrival, "1 day").dropDuplicatesWithinWatermark(["sha256"]).select("doc_id", "sha256")


def stream_dedupe(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first delivery of each key; a redelivery within a day is dropped, whatever its time."""
    return events.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(keys)


def stream_timing_match(left: DataFrame, right: DataFrame, days: int = 3, delay: str = "10 days", how: str = "inner") -> DataFrame:
    """Pairs of equal currency and amount within `days`, from two streams with (id, currency, amount, ts).

    With `how` = `left_outer` or `full_outer` a row without a partner comes out too, its other id null, once the watermark
    (the least of both streams' latest times, minus `delay`) has passed the last time at which a partner could come;
    then its state goes. Rows that are later than the watermark are dropped by Spark. Null currencies, amounts and times
    have no partner; a row of null time never comes out alone. Rows meet in cells of `days`, so that one looks through the
    state of its own time only, not through that of its whole amount. A row that may come out alone is in its own cell, and
    those of the other side are in the neighbours too; so the full outer join is a left one and the right rows left alone.
    """
    if how in ("full_outer", "full", "fullouter", "outer"):
        alone = _timing_join(left, right, days, delay, "right_outer").where("s_cell IS NULL")
        return _timing_join(left, right, days, delay, "left_outer").union(alone).select("source_id", "target_id")
    return _timing_join(left, right, days, delay, how).select("source_id", "target_id")


def _timing_join(left: DataFrame, right: DataFrame, days: int, delay: str, how: str) -> DataFrame:
    """The join of `stream_timing_match`, inner or outer on one side: (source_id, target_id, s_cell), s_cell null without a source."""
    a = left.select(F.col("id").alias("source_id"), "currency", "amount", F.col("ts").alias("s_ts")).withWatermark("s_ts", delay)
    b = right.select(F.col("id").alias("target_id"), F.col("currency").alias("c"), F.col("amount").alias("v"), F.col("ts").alias("t_ts")).withWatermark("t_ts", delay)
    cell = lambda t: F.floor(F.unix_seconds(t) / (86400 * max(days, 1)))
    near = lambda t: F.explode(F.array(*[cell(t) + k for k in (-1, 0, 1)]))
    own = how in ("left_outer", "leftouter", "left")
    a, b = a.withColumn("s_cell", cell("s_ts") if own else near("s_ts")), b.withColumn("t_cell", near("t_ts") if own else cell("t_ts"))
    test = F.expr(f"currency = c AND amount = v AND s_cell = t_cell AND t_ts >= s_ts - INTERVAL {days} DAYS AND t_ts <= s_ts + INTERVAL {days} DAYS")
    return a.join(b, test, how).select("source_id", "target_id", "s_cell")


def windowed_counts(events: DataFrame, length: str = "1 day") -> DataFrame:
    counted = events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.to_date("w.start").alias("day"), "event_type", "n")
