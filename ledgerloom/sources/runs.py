"""Results of reconciliation runs, kept by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import exception_queue


class RunStore:
    """Under one folder: the results of every run, and a completion row written after them.

    A run that is stored again replaces itself; one without a completion row does not count. Exceptions are a filter of
    the results, not a copy.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def save(self, run_id: int, results: DataFrame) -> None:
        results.write.mode("overwrite").parquet(f"{self.folder}/results/run_id={run_id}")
        stored = self.spark.read.schema(results.schema).parquet(f"{self.folder}/results/run_id={run_id}")
        counts = stored.agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("status").isin("EXCEPTION", "UNMATCHED")).alias("exceptions"))
        counts.write.mode("overwrite").parquet(f"{self.folder}/runs/run_id={run_id}")

    def runs(self) -> DataFrame:
        """(results, exceptions, run_id) of the complete runs."""
        return self.spark.read.parquet(f"{self.folder}/runs")

    def results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/results").join(F.broadcast(self.runs().select("run_id")), "run_id", "left_semi")

    def exceptions(self) -> DataFrame:
        return exception_queue(self.results())
