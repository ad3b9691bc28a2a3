"""Scans that keep the place of every row: CSV rows, strict JSON lines, pages of a feed, texts of scanned pages."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import MONEY
from ..plans.storage import cut

#: Fixed value: raw rows of a preview.
PREVIEW_ROWS = 25
#: Characters of a record of several lines, and different headers of the files that are read at once.
MAX_RECORD, MAX_HEADERS = 1 << 24, 200
#: Lines in a row, as a power of two, whose quotes are added up in one go, and lines that one task takes for it.
PIECE, LINES = 16, 200_000
#: Fixed value: a page below this confidence may take the recognised text.
OCR_BELOW = 0.80


def _numbered(read: DataFrame, first: int) -> DataFrame:
    """Rows of files with `file` and `row_number`, counted from `first` in each file.

    A split knows its rows' order; what the splits before it hold is summed over splits, not over rows, so a large
    file is numbered by many tasks.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")]
    rows = cut(read.select("*", *at), "numbered")
    splits = rows.groupBy("file", "_start").agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = rows.join(splits, ["file", "_start"])
    return numbered.withColumn("row_number", (F.col("_before") + F.col("_at") - F.col("_least") + first).cast("long")).select(*read.columns, "file", "row_number")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): lines from 1 in each file, however Spark splits it; a byte order mark is dropped."""
    lines = _numbered(spark.read.text(path), 1)
    return lines.select("file", F.col("row_number").alias("line"), F.when(F.col("row_number") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")).alias("value"))


def csv_records(spark: SparkSession, path: str | list[str], only_first_block: bool = False) -> DataFrame:
    """Records of CSV files, whole: (the columns of the folders, file, row_number, record, error), the header being row 1.

    Files are split anywhere, and a line knows whether it lies within quotes by the parity of all quotes before it in its file: running
    sums within a piece of a split, and one sum for each piece before it, so a task takes a bounded number of lines. Lines within quotes go on with the record before; only the
    lines of such records are brought together. Blank lines outside of quotes do not count. A record of more than
    MAX_RECORD characters over several lines, such as one whose quotes never close, is null with an `error`. Quotes inside of fields must be
    doubled; lines end in \\n or \\r\\n. With `only_first_block` the later splits of a file are left out.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    keys = [c for c in read.columns if c != "value"]
    block = F.col("_metadata.file_block_start")
    read = read.where(block == 0) if only_first_block else read
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("_quotes")
    lines = cut(read.select("value", *keys, F.col("_metadata.file_path").alias("file"), block.alias("_start"), F.monotonically_increasing_id().alias("_at"), quotes), "csv-lines")
    piece = ["file", "_start", "_piece"]
    lines = lines.withColumn("_piece", F.shiftright("_at", PIECE)).repartition(1 + lines.count() // LINES, *piece)
    split, run = Window.partitionBy(*piece).orderBy("_at"), (Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_quotes").over(split.rowsBetween(*run)), F.lit(0)) % 2
    filled = ~F.col("value").isin("", "\r", "\ufeff")
    local = lines.withColumn("_inside", inside).withColumn("_filled", filled)
    # A piece does not know whether it begins within quotes, so it counts the records that start in it for both cases.
    starts = {k: F.when(F.col("_filled") & (F.col("_inside") == k), 1).otherwise(0) for k in (0, 1)}
    local = local.withColumns({f"_run{k}": F.sum(c).over(split.rowsBetween(Window.unboundedPreceding, 0)) for k, c in starts.items()})
    splits = local.groupBy(*piece).agg(F.sum("_quotes").alias("_all"), *[F.sum(c).alias(f"_n{k}") for k, c in starts.items()])
    earlier = Window.partitionBy("file").orderBy("_start", "_piece").rowsBetween(*run)
    splits = splits.withColumn("_within", F.coalesce(F.sum("_all").over(earlier), F.lit(0)) % 2)
    own = F.when(F.col("_within") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    splits = splits.withColumn("_before", F.coalesce(F.sum(own).over(earlier), F.lit(0))).select(*piece, "_within", "_before")
    placed = local.join(splits, piece)
    outside = F.col("_inside") == F.col("_within")
    number = F.col("_before") + F.when(F.col("_within") == 0, F.col("_run0")).otherwise(F.col("_run1"))
    placed = placed.withColumns({"row_number": number.cast("long"), "_opens": outside, "_closes": (F.col("_inside") + F.col("_quotes")) % 2 == F.col("_within")}).where("not _opens or _filled")
    whole = placed.where("_opens and _closes").select(*keys, "file", "row_number", F.col("value").alias("record"), F.lit(None).cast("string").alias("error"))
    parts = placed.where("not (_opens and _closes)")
    sizes = parts.groupBy("file", "row_number").agg(F.sum(F.length("value") + 1).alias("_size"))
    parts = parts.join(sizes, ["file", "row_number"])
    short = F.when(F.col("_size") <= MAX_RECORD, F.struct("_start", "_at", "value"))  # the lines of a longer one are not gathered
    joined = parts.groupBy(*keys, "file", "row_number").agg(F.array_sort(F.collect_list(short)).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda x: x["value"]), "\n")
    joined = joined.select(*keys, "file", "row_number", F.when(F.size("_lines") > 0, text).alias("record"), F.when(F.size("_lines") == 0, "record is too long").alias("error"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def _fields(records: DataFrame, path: str | list[str]) -> DataFrame:
    """The fields of records, named by the header of their file; see `read_csv_rows`."""
    keys = [c for c in records.columns if c not in ("file", "row_number", "record", "error")]
    heads = records.where("row_number = 1 and record is not null").select("file", F.regexp_replace("record", "^\ufeff", "").alias("header"))
    headers = sorted(r["header"] for r in heads.select("header").distinct().limit(MAX_HEADERS + 1).collect())
    if not headers or len(headers) > MAX_HEADERS:
        raise ValueError(f"no header in {path}" if not headers else f"more than {MAX_HEADERS} different headers in {path}")
    body = records.where("row_number > 1").join(heads, "file")
    out = []
    for header in headers:
        names = next(csv.reader([header]))
        fields = F.from_csv("record", F.lit(", ".join(f"_{k} string" for k in range(len(names)))), {"escape": '"', "maxCharsPerColumn": "-1"})
        rows = body.where(F.col("header") == header).withColumn("_fields", fields)
        last = {n: k for k, n in enumerate(names)}  # of columns of one name the last counts
        out.append(rows.select(*[F.col(f"_fields._{k}").alias(n) for n, k in last.items()], *[k for k in keys if k not in last], "file", "row_number"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def read_csv_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns of CSV files as strings, with `file` and `row_number` (the header is row 1).

    Fields may hold line breaks within quotes, also where a split ends; see `csv_records`. A byte order mark is no part
    of the first name. Files of other headers give the union of the columns; if none has a header, it raises. A record
    that is too long has null fields.
    """
    return _fields(cut(csv_records(spark, path), "csv-records"), path)


def raise_first_error(rows: DataFrame) -> DataFrame:
    """The rows, if none has an `error`; else the first one by file and row number is raised."""
    bad = rows.where("error is not null").select("file", "row_number", "error").orderBy("file", "row_number").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}: row {bad[0]['row_number']}: {bad[0]['error']}")
    return rows


def file_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, sha256, bytes) of whole files; a file is one row, so it should be below two gigabytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def cap_rows(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of each file; the next one stays as an empty row with an `error`, the others go."""
    data = F.col("row_number") - 1
    values = [F.when(data <= most, F.col(f"`{c}`")).alias(c) for c in rows.columns if c not in ("file", "row_number")]
    return rows.where(data <= most + 1).select(*values, "file", "row_number", F.when(data > most, "row limit exceeded").alias("error"))


def read_preview(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The first raw rows of each file. Only the first splits are numbered, unless one of them may have fewer rows than a preview shows."""
    records = cut(csv_records(spark, path, only_first_block=True), "csv-records")
    seen = records.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("record") + 2).alias("bytes")).where(F.col("n") <= PREVIEW_ROWS + 1)
    lengths = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length")
    if seen.join(lengths, "file").where(F.col("length") > F.col("bytes")).limit(1).count():
        records = cut(csv_records(spark, path), "csv-records")
    return preview(_fields(records, path))


def preview(rows: DataFrame) -> DataFrame:
    """The first raw rows of each file."""
    return rows.where(F.col("row_number") - 1 <= PREVIEW_ROWS)


def read_predictions(spark: SparkSession, path: str, money: tuple[str, ...] = ("amount",), counts: tuple[str, ...] = ("tokens",)) -> DataFrame:
    """Strict JSON lines: case_id, the money and count fields, file, row_number and `error`, the first fault of the row.

    Faults: a blank line, no object, no case_id, money that is neither a string nor a 64-bit integer or does not parse,
    a count that is no integer of at least 0, a case_id that an earlier row (by file and row) has, an empty file.
    """
    read = spark.read.text(path)
    lines = _numbered(read, 1).withColumn("v", F.try_parse_json("value"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
    value = lambda name, to: F.try_variant_get("v", f"$.{name}", to)
    given = lambda name: kind(name).isNotNull() & (kind(name) != "VOID")
    amounts = {n: F.when(kind(n).isin("STRING", "BIGINT"), F.trim(value(n, "string")).try_cast(MONEY)) for n in money}
    numbers = {n: F.when(kind(n) == "BIGINT", value(n, "long")) for n in counts}
    faults = [
        F.when(F.trim("value") == "", "blank line"),
        F.when(~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "row must be an object"),
        F.when(F.coalesce(F.trim(value("case_id", "string")), F.lit("")) == "", "case_id is missing"),
        *[F.when(given(n) & ~kind(n).isin("STRING", "BIGINT"), f"{n} must be a string or an integer") for n in money],
        *[F.when(given(n) & c.isNull(), f"{n} is not a number") for n, c in amounts.items()],
        *[F.when(given(n) & ~F.coalesce(c >= 0, F.lit(False)), f"{n} must be an integer of at least 0") for n, c in numbers.items()],
    ]
    rows = lines.select(F.trim(value("case_id", "string")).alias("case_id"), *[c.alias(n) for n, c in (amounts | numbers).items()], "file", "row_number", F.coalesce(*faults).alias("error"))
    place = F.struct("file", "row_number")
    first = rows.where("case_id <> ''").groupBy("case_id").agg(F.min(place).alias("_first"))
    rows = rows.join(first, "case_id", "left")
    rows = rows.withColumn("error", F.coalesce("error", F.when(place != F.col("_first"), "duplicate case_id"))).drop("_first")
    # Scans skip empty files, so they are those of the listing, which the driver has anyway, that gave no row.
    listed = spark.createDataFrame([(f, "empty file") for f in read.inputFiles()], "file string, error string")
    # The listing writes local files with three slashes, the scan with one.
    listed = listed.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
    return rows.unionByName(listed.join(lines.select("file").distinct(), "file", "left_anti"), allowMissingColumns=True)


def merge_pages(pages: DataFrame, fields: list[str]) -> DataFrame:
    """Pages of a feed (cursor, added, modified: arrays of structs with `id`): each id as the last page has it.

    Within a page what is modified comes after what is added.
    """
    kinds = [pages.select("cursor", F.lit(k).alias("_kind"), F.explode(name).alias("r")) for k, name in enumerate(("added", "modified"))]
    every = reduce(DataFrame.unionByName, kinds)
    last = every.groupBy(F.col("r.id").alias("id")).agg(F.max(F.struct("cursor", "_kind", F.struct(*[F.col(f"r.{f}") for f in fields]).alias("r"))).alias("m"))
    return last.select("id", *[F.col(f"m.r.{f}").alias(f) for f in fields], F.col("m.cursor").alias("cursor"))


def choose_page_text(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pages (doc_id, page, confidence) with the confidence of their recognised tokens (token, conf of 0 to 100) and the choice.

    Tokens that are blank or have a negative confidence do not count. Recognised text wins on pages below OCR_BELOW,
    if there is any and its mean confidence is strictly higher.
    """
    counts = (F.col("conf") >= 0) & (F.trim("token") != "")
    ocr = tokens.where(counts).groupBy("doc_id", "page").agg(F.least(F.avg("conf") / 100, F.lit(1.0)).alias("ocr_confidence"))
    both = pages.join(ocr, ["doc_id", "page"], "left")
    wins = (F.col("confidence") < OCR_BELOW) & F.coalesce(F.col("ocr_confidence") > F.col("confidence"), F.lit(False))
    return both.withColumn("source", F.when(wins, "ocr").otherwise("text"))
