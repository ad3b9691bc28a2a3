"""Scans that keep the place of every row."""

import csv

import pytest

from ledgerloom.sources import files as R


@pytest.fixture
def folder(tmp_path):
    def put(name, text, encoding="utf-8"):
        (tmp_path / name).write_text(text, encoding=encoding)
        return f"file://{tmp_path}"

    return put


def test_rows_keep_their_numbers_over_many_splits(spark, folder):
    path = folder("a.csv", "k,v\n" + "".join(f"{i},x{i}\n" for i in range(5000)), "utf-8-sig")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = R.read_csv_rows(spark, path)
        got = rows.select("k", "row_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows.columns[:2] == ["k", "v"]
    assert sorted((int(r.k), r.row_number) for r in got) == [(i, i + 2) for i in range(5000)]


def test_each_file_is_numbered_by_itself_and_capped(spark, folder):
    folder("a.csv", "k\na1\na2\na3\na4\n")
    rows = R.read_csv_rows(spark, folder("b.csv", "k\nb1\n"))
    got = sorted((r.file[-5:], r.row_number, r.k, r.error) for r in R.cap_rows(rows, 2).collect())
    assert got == [("a.csv", 2, "a1", None), ("a.csv", 3, "a2", None), ("a.csv", 4, None, "row limit exceeded"), ("b.csv", 2, "b1", None)]
    assert R.preview(rows).count() == 5


def test_csv_without_header_raises_and_without_rows_is_empty(spark, folder):
    with pytest.raises(ValueError, match="no header"):
        R.read_csv_rows(spark, folder("a.csv", ""))
    assert R.read_csv_rows(spark, folder("a.csv", "k,v\n")).count() == 0


def test_prediction_faults(spark, folder):
    lines = ['{"case_id":"a","amount":"1.50","tokens":3}', "", "7", '{"amount":1}', '{"case_id":"b","amount":1.5}', '{"case_id":"a","amount":2}', '{"case_id":"c","amount":null,"tokens":-1}', '{"case_id":"d","amount":"x"}', '{"case_id":"e","tokens":"3"}', "{", '{"case_id":"f","amount":4,"more":1}']
    folder("a.jsonl", "\n".join(lines) + "\n")
    got = R.read_predictions(spark, folder("b.jsonl", "")).orderBy("file", "row_number").collect()
    assert [(r.row_number, r.case_id, r.error) for r in got] == [
        (1, "a", None), (2, None, "blank line"), (3, None, "row must be an object"), (4, None, "case_id is missing"), (5, "b", "amount must be a string or an integer"),
        (6, "a", "duplicate case_id"), (7, "c", "tokens must be an integer of at least 0"), (8, "d", "amount is not a number"), (9, "e", "tokens must be an integer of at least 0"), (10, None, "row must be an object"), (11, "f", None),
        (None, None, "empty file"),
    ]
    assert [str(r.amount) for r in got if r.error is None] == ["1.5000", "4.0000"]


def test_pages_and_recognised_text(spark):
    kind = "cursor int, added array<struct<id:int,v:int>>, modified array<struct<id:int,v:int>>"
    pages = spark.createDataFrame([(1, [(1, 10), (2, 20)], []), (2, [(3, 30)], [(1, 11), (3, 31)]), (3, None, [(2, 21)])], kind)
    assert sorted(map(tuple, R.merge_pages(pages, ["v"]).collect())) == [(1, 11, 2), (2, 21, 3), (3, 31, 2)]
    pages = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.8), (3, 1, 0.9), (4, 1, 0.0), (5, 1, 0.1)], "doc_id int, page int, confidence double")
    tokens = spark.createDataFrame([(1, 1, "a", 50), (2, 1, "a", 100), (4, 1, " ", 90), (4, 1, "b", -1), (5, 1, "b", 300), (5, 1, "c", -1)], "doc_id int, page int, token string, conf int")
    got = {r.doc_id: (r.ocr_confidence, r.source) for r in R.choose_page_text(pages, tokens).collect()}
    assert got == {1: (0.5, "text"), 2: (1.0, "text"), 3: (None, "text"), 4: (None, "text"), 5: (1.0, "ocr")}


def plain_rows(text):
    import csv
    import io

    rows = list(csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")))
    rows = [r for r in rows if r]
    return [(n, *[f or None for f in r]) for n, r in enumerate(rows[1:], 2)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_breaks_within_quotes_over_many_splits(spark, folder, end):
    import csv
    import io
    import random

    rng = random.Random(3)
    pieces = ["a", "b c", '"', ",", end, end + end, "é", "x" * 30]
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["k", "v,1", 'w"'])
    for i in range(900):
        if i % 50 == 7:
            out.write(end)
        long = rng.choice(pieces) * 600 if i % 300 == 5 else ""
        writer.writerow([str(i), "".join(rng.choice(pieces) for _ in range(rng.randrange(5))) + long, rng.choice(["", "q", '""'])])
    path = folder("a.csv", "")
    with open(path.removeprefix("file://") + "/a.csv", "w", newline="", encoding="utf-8-sig") as f:
        f.write(out.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = R.read_csv_rows(spark, path)
        got = [tuple(r) for r in rows.select("row_number", "k", "`v,1`", '`w"`').collect()]
        shown = sorted(r.row_number for r in R.read_preview(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows.columns == ["k", "v,1", 'w"', "file", "row_number"]
    # Within a field every line end is as it was written.
    assert sorted(got) == sorted(plain_rows(out.getvalue()))
    assert shown == list(range(2, 27))


def test_quotes_that_never_close_are_one_bad_record(spark, folder, monkeypatch):
    monkeypatch.setattr(R, "MAX_RECORD", 100)
    path = folder("a.csv", 'k,v\n1,a\n2,"open\n' + "x,y\n" * 100)
    records = {r.row_number: (r.record, r.error) for r in R.csv_records(spark, path).collect()}
    assert records == {1: ("k,v", None), 2: ("1,a", None), 3: (None, "record is too long")}


def test_files_of_other_headers_and_the_strict_form(spark, folder):
    folder("a.csv", "k,v\n1,2\n")
    path = folder("b.csv", "v,w,v\n3,4,5\n")
    rows = R.read_csv_rows(spark, path)
    assert sorted((r.file[-5:], r.k, r.v, r.w) for r in rows.collect()) == [("a.csv", "1", "2", None), ("b.csv", None, "5", "4")]
    from pyspark.sql import functions as F

    assert R.raise_first_error(rows.withColumn("error", F.lit(None).cast("string"))).count() == 2
    with pytest.raises(ValueError, match="a.csv: row 2: bad 1"):
        R.raise_first_error(rows.withColumn("error", F.concat(F.lit("bad "), "k"))).count()


def test_quotes_are_added_up_over_pieces_of_a_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 2)
    monkeypatch.setattr(R, "LINES", 5)
    rows = [(str(k), "a\n\n\"b\"\n,c\nd\ne" if k % 3 == 0 else "", "x" * (k % 4)) for k in range(40)]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "note", "rest"])
        out.writerows(rows)
    got = R.read_csv_rows(spark, str(tmp_path / "a.csv")).collect()
    assert sorted((r.row_number, r.id, r.note or "", r.rest or "") for r in got) == [(k + 2, *r) for k, r in enumerate(rows)]
