"""The paged feed goes on from its cursor, waits at gaps and keeps the newest change of each id."""

import json

from ledgerloom.sources import feed
from ledgerloom.streaming.jobs import run_to_table


def put(folder, cursor, *changes):
    page = folder / f"cursor={cursor}"
    page.mkdir(parents=True)
    (page / "part-0.json").write_text("\n".join(json.dumps(c) if isinstance(c, dict) else c for c in changes))


def test_a_feed_goes_on_after_the_last_committed_page(spark, tmp_path):
    pages, out = tmp_path / "pages", f"file://{tmp_path}/out"
    put(pages, 0, {"id": 1, "amount": 10}, "", {"id": 2, "amount": 20}, {"id": 1, "amount": 11})
    put(pages, 1, {"id": 3, "amount": 30}, "no json", {"amount": 5}, {"id": 2, "amount": None})
    put(pages, 3, {"id": 9, "amount": 90})
    (pages / "cursor=x").mkdir()
    run = lambda: run_to_table(feed.page_feed(spark, f"file://{pages}"), "feed", out)
    newest = lambda: sorted((r.id, r.amount, r.cursor) for r in feed.latest_changes(run(), "id long, amount long").collect())
    # Page 2 is not there, so page 3 waits.
    assert newest() == [(1, 11, 0), (2, None, 1), (3, 30, 1)]
    # What was committed is not read again: it may go.
    (pages / "cursor=0" / "part-0.json").write_text("")
    assert newest() == [(1, 11, 0), (2, None, 1), (3, 30, 1)]
    put(pages, 2, {"id": 3, "amount": 33}, {"id": 4, "amount": 40})
    assert newest() == [(1, 11, 0), (2, None, 1), (3, 33, 2), (4, 40, 2), (9, 90, 3)]
    assert run().count() == 10


def test_lines_of_many_blocks_and_an_empty_feed(spark, tmp_path):
    reader = feed.PageReader(f"file://{tmp_path}/none")
    assert reader.latestOffset() == reader.initialOffset() == {"cursor": 0}
    page = tmp_path / "p" / "cursor=0"
    page.mkdir(parents=True)
    lines = [json.dumps({"id": k, "note": "é" * (k % 2000)}, ensure_ascii=False) for k in range(6000)]
    (page / "b.json").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (page / "a.json").write_text('{"id": -1}')
    (page / "_SUCCESS").write_text("")
    reader = feed.PageReader(f"file://{tmp_path}/p")
    pieces = reader.partitions({"cursor": 0}, reader.latestOffset())
    got = [r for p in pieces for b in reader.read(p) for r in b.to_pylist()]
    assert [r["change"] for r in got] == ['{"id": -1}', *lines]
    assert [r["position"] for r in got] == sorted({r["position"] for r in got})


def test_written_pages_keep_their_order(spark, tmp_path):
    rows = [(c, k, f'{{"id": {k % 7}, "amount": {k}}}') for c in range(3) for k in range(500)]
    uri = f"file://{tmp_path}/pages"
    feed.write_pages(spark.createDataFrame(rows[::-1], feed.CHANGES).repartition(5), uri)
    got = run_to_table(feed.page_feed(spark, uri), "feed", f"file://{tmp_path}/out").orderBy("cursor", "position").collect()
    assert [(r.cursor, r.change) for r in got] == [(c, t) for c, _, t in rows]


def test_small_pages_share_a_task_and_large_files_do_not(spark, tmp_path, monkeypatch):
    for k in range(50):
        put(tmp_path / "p", k, {"id": k})
    monkeypatch.setattr(feed, "PIECE_FILES", 20)
    reader = feed.PageReader(f"file://{tmp_path}/p")
    read = lambda: [p.files for p in reader.partitions({"cursor": 0}, reader.latestOffset())]
    assert [len(p) for p in read()] == [20, 20, 10]
    assert [c for p in read() for c, _, _ in p] == list(range(50))
    monkeypatch.setattr(feed, "PIECE_BYTES", 5)
    assert len(read()) == 50


def test_pages_of_several_batches_are_one_file_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "PAGES", 2)
    rows = [(c, k, None if k == 3 else f'{{"id": {k}}}') for c in range(9) for k in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        feed.write_pages(spark.createDataFrame([*rows[::-1], (None, 0, "x")], feed.CHANGES), f"file://{tmp_path}/p")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(f.name for f in (tmp_path / "p").iterdir()) == [f"cursor={c}" for c in range(9)]
    for c in range(9):
        (page,) = (tmp_path / "p" / f"cursor={c}").iterdir()
        assert page.read_text().split("\n") == [*(t or "" for d, _, t in rows if d == c), ""]
