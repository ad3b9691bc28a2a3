"""Writing intermediate tables to the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

#: Folders that one task writes, about.
FOLDERS = 100


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: the lineage ends here, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_writer(rows: DataFrame, column: str) -> DataFrameWriter:
    """A writer of a folder for each value of `column`, each by one task.

    A folder costs its task far more than its rows do, so tasks are dealt by the number of folders, not by bytes, and
    tasks move their own folders into place (the driver would move them one after the other). Nobody should read before
    the write has ended.
    """
    folders = rows.agg(F.approx_count_distinct(column)).first()[0]
    return rows.repartition(1 + folders // FOLDERS, column).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(column)
