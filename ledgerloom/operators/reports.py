"""Benchmark reports of two systems: JSON, Markdown and prediction rows that appear together or not at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import suite_deltas

#: The metrics of a report in their order, and the lines of its layout.
METRICS = ("cases", "precision", "recall", "f1")
TITLE, SECTIONS = "# Evaluation benchmark report", ("### System", "### Baseline", "### Delta (system - baseline)")


def compare(metrics: DataFrame, system: str, baseline: str) -> DataFrame:
    """(suite, run, metric, value): the metrics of both runs, and their differences (run `delta`) where a suite has both.

    `metrics` has suite, run and a column for each of METRICS.
    """
    both = metrics.where(F.col("run").isin(system, baseline)).withColumns({m: F.col(m).cast("double") for m in METRICS})
    own = both.unpivot(["suite", "run"], list(METRICS), "metric", "value")
    deltas = suite_deltas(both, ["suite"], [m for m in METRICS if m != "cases"], system, baseline)
    return own.unionByName(deltas.select("suite", F.lit("delta").alias("run"), "metric", F.col("delta").alias("value")))


def markdown(comparison: DataFrame, system: str, baseline: str) -> DataFrame:
    """(line): the report as Markdown, in order, in one partition; suites by name, the system, the baseline, the differences."""
    number = lambda c: F.when(F.col("metric") == "cases", F.col(c).cast("long").cast("string")).otherwise(F.col(c).cast("string"))
    section = F.when(F.col("run") == system, 0).when(F.col("run") == baseline, 1).otherwise(2)
    metric = F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric"))
    rows = comparison.where("value is not null").withColumns({"section": section, "place": metric.cast("int")})
    at = lambda suite, part, place, line: [suite.alias("suite"), part.cast("int").alias("section"), place.cast("int").alias("place"), line.alias("line")]
    heads = F.coalesce(*[F.when(F.col("section") == k, t) for k, t in enumerate(SECTIONS)])
    lines = [
        rows.select(*at(F.col("suite"), F.col("section"), F.col("place"), F.concat(F.lit("- **"), "metric", F.lit(":** `"), number("value"), F.lit("`")))),
        rows.select("suite", "section").distinct().select(*at(F.col("suite"), F.col("section"), F.lit(0), heads)),
        rows.select("suite", "section").distinct().select(*at(F.col("suite"), F.col("section"), F.lit(99), F.lit(""))),
        rows.select("suite").distinct().select(F.col("suite"), F.lit(-1).alias("section"), F.explode(F.array(F.struct(F.lit(0).alias("place"), F.concat(F.lit("## "), "suite").alias("line")), F.struct(F.lit(1).alias("place"), F.lit("").alias("line")))).alias("x")).select("suite", "section", "x.place", "x.line"),
    ]
    spark = comparison.sparkSession
    top = [TITLE, "", f"Baseline: `{baseline}`", f"System: `{system}`", ""]
    lines.append(spark.createDataFrame([("", -2, k, t) for k, t in enumerate(top)], "suite string, section int, place int, line string"))
    # A few rows for each suite.
    return reduce(DataFrame.union, lines).repartition(1).sortWithinPartitions("suite", "section", "place").select("line")


class ReportStore:
    """Reports under one folder, by version. All parts of a version are written first, then a commit row that makes them count.

    A writer that stops before leaves the former version in place, and may write its version anew.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, version: int, metrics: DataFrame, predictions: DataFrame, system: str = "system", baseline: str = "baseline") -> None:
        """Fails if the version is committed already."""
        comparison = compare(metrics, system, baseline)
        at = lambda part: f"{self.folder}/{part}/version={version}"
        comparison.write.mode("overwrite").json(at("comparison"))
        markdown(comparison, system, baseline).write.mode("overwrite").text(at("markdown"))
        predictions.write.mode("overwrite").option("ignoreNullFields", False).json(at("predictions"))
        self.spark.range(1).select(F.lit(str(version)).alias("value")).coalesce(1).write.text(at("commits"))

    def read(self, part: str, schema: str) -> DataFrame:
        """A part (comparison, markdown, predictions) of the newest committed version; Markdown has one column of lines."""
        version = self.spark.read.text(f"{self.folder}/commits").agg(F.max("version").alias("v")).first()["v"]
        reader, path = self.spark.read.schema(schema), f"{self.folder}/{part}/version={version}"
        return reader.text(path) if part == "markdown" else reader.json(path)
