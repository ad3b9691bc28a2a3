"""Bounded streams: unmatched rows of a timing match, and intake that neither copies nor replays add to."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.streaming import jobs as S
from ledgerloom.streaming.intake import Intake, file_stream

KIND = "id long, currency string, amount long, ts timestamp"


def at(day, hour=0):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day, hours=hour)


def stream(spark, folder):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(folder))


def put(spark, folder, rows):
    spark.createDataFrame([(*r,) for r in rows], KIND).coalesce(1).write.mode("append").parquet(str(folder))


def test_rows_without_partner_come_out_when_the_watermark_has_passed(spark, tmp_path):
    left, right, out = tmp_path / "left", tmp_path / "right", f"file://{tmp_path}/out"
    put(spark, left, [(1, "EUR", 10, at(0)), (2, "EUR", 20, at(1)), (3, None, 30, at(1)), (4, "EUR", 40, at(30)), (5, "EUR", 50, None)])
    put(spark, right, [(11, "EUR", 10, at(3)), (12, "USD", 20, at(1)), (13, "EUR", 40, at(31)), (14, "EUR", 40, at(30, 5))])

    def run(how):
        matched = S.stream_timing_match(stream(spark, left), stream(spark, right), 3, "2 days", how)
        return sorted(map(tuple, S.run_to_table(matched, "match", f"{out}-{how}").collect()), key=str)

    assert run("inner") == [(1, 11), (4, 13), (4, 14)]
    assert run("left_outer") == sorted([(1, 11), (4, 13), (4, 14), (2, None), (3, None)], key=str)
    assert run("full_outer") == sorted([(1, 11), (4, 13), (4, 14), (2, None), (3, None), (None, 12)], key=str)
    # What comes later than the watermark is dropped; what comes in time goes on from the state.
    put(spark, left, [(6, "USD", 20, at(1)), (7, "EUR", 70, at(31)), (8, "EUR", 80, at(60))])
    put(spark, right, [(17, "EUR", 70, at(33)), (18, "EUR", 1, at(61))])
    assert run("left_outer") == sorted([(1, 11), (4, 13), (4, 14), (2, None), (3, None), (7, 17)], key=str)


def test_an_intake_takes_each_content_and_each_batch_once(spark, tmp_path):
    folder, table = tmp_path / "in", f"file://{tmp_path}/table"
    folder.mkdir()
    (folder / "a.csv").write_text('Invoice Number,Amount,Date,Description\nI1,"1,000.50",2026-01-02,"two\nlines, ""quoted"""\nI2,bad,2026-01-03,\n')
    (folder / "b.csv").write_text("Invoice Number,Total,Date\nI3,3,2026-01-04\n")
    (folder / "c.csv").write_text((folder / "b.csv").read_text())
    (folder / "d.csv").write_text("")
    intake = Intake(spark, table, "invoice", "uploads")
    assert intake.rows().count() == intake.files().count() == 0
    intake.run(file_stream(spark, f"file://{folder}"))
    seen = lambda: sorted((r.file[-5:], r.row_number, r.reference, r.amount and float(r.amount), r.description, r.error) for r in intake.rows().collect())
    want = [("a.csv", 2, "I1", 1000.5, 'two\nlines, "quoted"', None), ("a.csv", 3, "I2", None, None, "amount is missing or not a number"), ("b.csv", 2, "I3", 3.0, None, None)]
    assert seen() == want
    assert sorted((r.file[-5:], (r.duplicate_of or "")[-5:]) for r in intake.files().collect()) == [("a.csv", ""), ("b.csv", ""), ("c.csv", "b.csv")]
    (folder / "e.csv").write_text((folder / "a.csv").read_text())
    (folder / "f.csv").write_text("Invoice Number,Amount,Date\nI4,4,2026-01-04\n")
    intake.run(file_stream(spark, f"file://{folder}"))
    want = [*want, ("f.csv", 2, "I4", 4.0, None, None)]
    assert seen() == want
    done = sorted((r.new_files, r.duplicates) for r in intake.commits().collect())
    assert done == [(1, 1), (2, 1)]
    # A replayed batch adds nothing; one that stopped before its commit does not count, and is written anew.
    query = intake.commits().first()["query"]
    files = spark.createDataFrame([(f"file://{folder}/f.csv", "x", 9)], "file string, sha256 string, bytes long")
    intake.take(files, 0, query)
    assert seen() == want
    spark.createDataFrame([], intake.rows().drop("query", "batch").schema).unionByName(intake.rows().drop("query", "batch")).write.parquet(f"{table}/rows/query={query}/batch=7")
    assert seen() == want
    intake.take(files, 7, query)
    assert seen() == sorted([*want, want[-1]])
    intake.take(files, 7, query)
    assert seen() == sorted([*want, want[-1]])


def test_times_of_events_are_counted_by_day(spark):
    events = spark.createDataFrame([(at(0, 1), "a"), (at(0, 23), "a"), (at(1), "b")], "ts timestamp, event_type string")
    assert sorted((r.event_type, r.n) for r in S.windowed_counts(events).select("event_type", F.col("n")).collect()) == [("a", 2), ("b", 1)]


def test_a_table_that_is_a_folder_of_files_is_streamed_whole(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(f"file://{tmp_path}/parts.parquet")
    spark.range(4).coalesce(1).write.parquet(f"file://{tmp_path}/one")
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "file.parquet")
    for name, n in (("parts", 10), ("file", 4)):
        table = S.run_to_table(S.read_stream(spark, f"file://{tmp_path}", name), name, f"file://{tmp_path}/out-{name}")
        assert sorted(r.id for r in table.collect()) == list(range(n))


def test_pairs_meet_across_cells_once(spark, tmp_path):
    hours = [0, 1, 23, 24, 25, 47, 48, 49, 71, 96]
    put(spark, tmp_path / "left", [(k, "EUR", 10, at(0, h)) for k, h in enumerate(hours)])
    put(spark, tmp_path / "right", [(k, "EUR", 10, at(0, h)) for k, h in enumerate(hours)])
    matched = S.stream_timing_match(stream(spark, tmp_path / "left"), stream(spark, tmp_path / "right"), 1)
    assert "s_cell" in matched._jdf.queryExecution().analyzed().toString()
    got = sorted(map(tuple, S.run_to_table(matched, "match", f"file://{tmp_path}/out").collect()))
    assert got == sorted((i, j) for i, a in enumerate(hours) for j, b in enumerate(hours) if abs(a - b) <= 24)


def test_outer_pairs_meet_across_cells_and_rows_come_out_alone_once(spark, tmp_path):
    hours = [0, 1, 23, 24, 25, 47, 48, 49, 71, 96]
    alone, late = [(k, "EUR", 20 + k, at(k - 40)) for k in range(50, 54)], (90, "EUR", 1, at(30))
    put(spark, tmp_path / "left", [*[(k, "EUR", 10, at(0, h)) for k, h in enumerate(hours)], *alone, (60, "EUR", 10, at(9)), late])
    put(spark, tmp_path / "right", [*[(k, "EUR", 10, at(0, h)) for k, h in enumerate(hours)], (70, "EUR", 10, at(7)), (None, "EUR", 10, at(0)), (91, "EUR", 2, at(30))])
    pairs = [(i, j) for i, a in enumerate(hours) for j, b in enumerate(hours) if abs(a - b) <= 24] + [(i, None) for i, a in enumerate(hours) if a <= 24]
    left = [(k, None) for k in (50, 51, 52, 53, 60)]
    for how, want in (("left_outer", pairs + left), ("full_outer", [*pairs, *left, (None, 70)])):
        matched = S.stream_timing_match(stream(spark, tmp_path / "left"), stream(spark, tmp_path / "right"), 1, "2 days", how)
        assert "s_cell" in matched._jdf.queryExecution().analyzed().toString()
        assert sorted(map(tuple, S.run_to_table(matched, "match", f"file://{tmp_path}/{how}").collect()), key=str) == sorted(want, key=str)
