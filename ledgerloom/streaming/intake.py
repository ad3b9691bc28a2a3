"""Continuous intake of CSV files, idempotent by content and by batch.

A stream of files is taken in batches. A file whose bytes an earlier file had is noted as its duplicate and not read
again. The rows of new files are numbered, normalised to the record contract and appended; rows with an error are kept
beside the good ones. Spark's file sources pass over empty files. Each batch has a folder of its own under every table, and a commit row that is written last: a
batch that is replayed after its commit adds nothing, one that stopped before it is written anew, and readers take
committed batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import normalize_records
from ..plans.storage import cut
from ..sources.files import read_csv_rows

#: Fixed value: the schema of Spark's source of whole files.
BYTES = "path string, modificationTime timestamp, length long, content binary"
FILES = "file string, sha256 string, bytes long, duplicate_of string"
COMMITS = "new_files long, duplicates long"


def file_stream(spark: SparkSession, folder: str, glob: str = "*.csv", per_batch: int = 200) -> DataFrame:
    """(file, sha256, bytes) of the files that come into a folder; `per_batch` bounds the files of one batch."""
    files = spark.readStream.format("binaryFile").schema(BYTES).option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


class Intake:
    """The tables of one intake under `table`: files, rows and commits, each with a folder for every query and batch."""

    def __init__(self, spark: SparkSession, table: str, record_type: str, source_name: str):
        self.spark, self.table, self.record_type, self.source_name = spark, table, record_type, source_name
        empty = spark.createDataFrame([], "amount string, file string, row_number long")
        rows = normalize_records(empty, record_type, source_name, keep=("file", "row_number"))
        self.schemas = {"files": spark.createDataFrame([], FILES).schema, "commits": spark.createDataFrame([], COMMITS).schema, "rows": rows.schema}
        for name, schema in self.schemas.items():  # so that there is something to read before the first batch
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{table}/{name}/query=none/batch=-1")

    def _read(self, name: str) -> DataFrame:
        schema = self.schemas[name].add("query", "string") if "query" not in self.schemas[name].names else self.schemas[name]
        schema = schema.add("batch", "long") if "batch" not in schema.names else schema
        return self.spark.read.schema(schema).parquet(f"{self.table}/{name}")

    def commits(self) -> DataFrame:
        """(new_files, duplicates, query, batch) of the batches that are done."""
        return self._read("commits")

    def files(self) -> DataFrame:
        """(file, sha256, bytes, duplicate_of, query, batch) of committed batches."""
        return self._read("files").join(self.commits().select("query", "batch"), ["query", "batch"], "left_semi")

    def rows(self) -> DataFrame:
        """Normalised rows of committed batches, with file, row_number, `error`, query and batch."""
        return self._read("rows").join(self.commits().select("query", "batch"), ["query", "batch"], "left_semi")

    def take(self, files: DataFrame, batch: int, query: str | None = None) -> None:
        """One batch of (file, sha256, bytes). A batch that is committed already is left alone."""
        query = query or files.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        if self.commits().where((F.col("query") == query) & (F.col("batch") == batch)).limit(1).count():
            return
        write = lambda rows, name: rows.write.mode("overwrite").parquet(f"{self.table}/{name}/query={query}/batch={batch}")
        known = self.files().where("duplicate_of is null").select("sha256", F.col("file").alias("known"))
        first = files.groupBy("sha256").agg(F.min("file").alias("first"))
        origin = F.coalesce("known", F.when(F.col("file") != F.col("first"), F.col("first")))
        marked = cut(files.join(first, "sha256").join(known, "sha256", "left").select("file", "sha256", "bytes", origin.alias("duplicate_of")), "intake-files")
        # The files of one batch are bounded by the stream's per_batch.
        new = [r["file"] for r in marked.where("duplicate_of is null").select("file").collect()]
        if new:
            write(normalize_records(read_csv_rows(self.spark, new), self.record_type, self.source_name, keep=("file", "row_number")), "rows")
        write(marked, "files")
        write(marked.agg(F.count_if(F.col("duplicate_of").isNull()).alias("new_files"), F.count("duplicate_of").alias("duplicates")), "commits")

    def run(self, stream: DataFrame) -> None:
        """Take all files that are there; a later run goes on with what has come since."""
        query = stream.writeStream.foreachBatch(lambda files, batch: self.take(files, batch)).option("checkpointLocation", f"{self.table}/state").trigger(availableNow=True).start()
        query.awaitTermination()
