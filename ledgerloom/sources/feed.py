"""A paged feed as a stream whose offset is the feed's cursor.

A connector lands each page of changes as a folder `cursor=N` of JSON lines, N from 0 without gaps, renamed into place
when it is whole. The stream goes through the pages in order: its offset is the next cursor, kept in the query's
checkpoint, so that a restart goes on after the last committed page and a batch that failed is read again with the
same pages. A page is never passed over: where a cursor is missing the stream waits, whatever comes after it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Fixed value: the rows of the stream. `position` orders the changes of a page.
CHANGES = "cursor long, position long, change string"
_PAGE = re.compile(r"cursor=(0|[1-9][0-9]*)")


#: Bytes and files that one task reads, about; a larger file is one task's.
PIECE_BYTES, PIECE_FILES = 1 << 26, 200
#: Pages that one task writes, about.
PAGES = 500


class Piece(InputPartition):
    """Files of pages as (cursor, number, path); `number` is the place among the page's files by name."""

    def __init__(self, files: list[tuple[int, int, str]]):
        self.files = files


class PageReader(DataSourceStreamReader):
    """Lists pages on the driver, by name and size alone; tasks read the lines, a file or many small ones each."""

    def __init__(self, uri: str):
        self.uri = uri

    def _children(self, folder: str = "") -> list[fs.FileInfo]:
        store, root = fs.FileSystem.from_uri(self.uri)
        return store.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/{folder}".rstrip("/"), allow_not_found=True))

    def initialOffset(self) -> dict:
        return {"cursor": 0}

    def latestOffset(self) -> dict:
        """The first cursor that has no page yet."""
        names = [_PAGE.fullmatch(f.base_name) for f in self._children() if f.type == fs.FileType.Directory]
        there = {int(m[1]) for m in names if m}
        return {"cursor": next(k for k in range(len(there) + 1) if k not in there)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces, size = [], 0
        for cursor in range(start["cursor"], end["cursor"]):
            files = sorted((f.path, f.size or 0) for f in self._children(f"cursor={cursor}") if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
            for k, (path, n) in enumerate(files):
                if not pieces or len(pieces[-1].files) == PIECE_FILES or size + n > PIECE_BYTES:
                    pieces.append(Piece([]))
                    size = 0
                pieces[-1].files.append((cursor, k, path))
                size += n
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.uri)
        for cursor, number, path in partition.files:
            at, rest = number << 40, b""
            with store.open_input_stream(path, compression="detect") as stream:
                while block := stream.read(1 << 22):
                    *lines, rest = (rest + block).split(b"\n")
                    yield from self._batch(cursor, at, lines)
                    at += len(lines)
            yield from self._batch(cursor, at, [rest])

    @staticmethod
    def _batch(cursor: int, at: int, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
        kept = [(at + k, line.decode("utf-8", "replace")) for k, line in enumerate(lines) if line.strip()]
        if kept:
            places, texts = zip(*kept, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([cursor] * len(kept), pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=["cursor", "position", "change"])


class PageFeed(DataSource):
    """Format `page_feed`; option path: a URI that the driver and the tasks can open."""

    @classmethod
    def name(cls) -> str:
        return "page_feed"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> PageReader:
        if not self.options.get("path"):
            raise ValueError("a feed needs the path of its pages")
        return PageReader(self.options["path"])


def page_feed(spark: SparkSession, uri: str) -> DataFrame:
    """(cursor, position, change): the stream of the JSON lines of all pages; blank lines are none."""
    spark.dataSource.register(PageFeed)
    return spark.readStream.format("page_feed").option("path", uri).load()


def latest_changes(changes: DataFrame, schema: str) -> DataFrame:
    """The newest change of each `id`, by cursor, then position: the fields of `schema` (DDL, with id), and cursor.

    Lines that are no JSON object, and those without an id, belong to no record and are left out. The newest one of an
    id is picked before the shuffle, in each task.
    """
    fields = changes.withColumn("_r", F.from_json("change", schema)).where("_r.id is not null")
    return fields.groupBy(F.col("_r.id").alias("_id")).agg(F.max_by(F.struct("_r", "cursor"), F.struct("cursor", "position")).alias("_m")).select("_m._r.*", "_m.cursor")


def write_pages(changes: DataFrame, uri: str) -> None:
    """Rows (cursor, position, change) as pages, one file each; for tests, and for feeds that are tables already.

    Tasks are dealt by the number of pages, as a page costs more than its bytes, and write each file under a hidden name
    before it is renamed into place, so a task that is run again replaces its own files.
    """
    name = f"part-{uuid.uuid4().hex}.txt"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        pages = 0
        for cursor, group in groupby(((c, t) for b in batches for c, t in zip(b["cursor"].to_pylist(), b["change"].to_pylist(), strict=True)), key=itemgetter(0)):
            folder = f"{root.rstrip('/')}/cursor={cursor}"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/_{name}", compression=None, buffer_size=1 << 20) as stream:
                for _, text in group:
                    stream.write(((text or "") + "\n").encode())
            store.move(f"{folder}/_{name}", f"{folder}/{name}")
            pages += 1
        yield pa.RecordBatch.from_arrays([pa.array([pages], pa.int64())], names=["pages"])

    rows = changes.select("cursor", "position", "change").where("cursor is not null")
    tasks = 1 + rows.agg(F.approx_count_distinct("cursor")).first()[0] // PAGES
    ordered = rows.repartition(tasks, "cursor").sortWithinPartitions("cursor", "position")
    ordered.mapInArrow(write, "pages long").agg(F.sum("pages")).first()
