"""Filter audit, spelling variants and host rules against brute force, with the awkward cases."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import filter_audit, host_rules, queries, spelling

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, failures int, maybe string, host string, word string, n long"
LABELS = "doc_id long, quality int, toxic int, part string"


def docs(spark, rows):
    """Rows of (doc_id, text, source), with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r[:2], "en", r[2], 0, 1, "x", "h", "w", 1) for r in rows], DOCS)


def awkward():
    prose = " ".join(f"word{k % 700} and" for k in range(30000))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b", None), (4, prose, "a"), (5, prose, "b"), (6, prose + " END", "b"), (7, "a|b #x", ""), (8, "SHOUT LOUD", "b"), (8, "SHOUT LOUD", "b"), (8, "other text", "b"),
        (None, prose, "a"), (None, "", None), (9, "SHOUT LOUD", "c"), (10, "é" * 5000, "c"), (11, "x\r\ny\r\nx\r\nx", "c"), (0, "other text", "a"),
    ]


# --- op11


def brute_audit(rows, labels):
    first, good, toxic, failing = {}, set(), set(), []
    for i, q, t in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, source in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else "")
        fails += ("D" if re.search("[#$%&*|]", t) else "") + ("E" if i is not None and i > first[t] else "")
        failing.append((source or "", fails, i in good and i is not None, i in toxic and i is not None))
    out, by_filter = {}, Counter()
    for part in {f[0] for f in failing}:
        own = [f for f in failing if f[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                by_filter[part, f] += len(gone)
                failed = [x for x in own if f in x[1]]
                out[part, "".join(order), step] = (len(left), len(gone), len(failed) - len(gone), sum(x[1] == f for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone))
    return {k: (*v, by_filter[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("sketch", [1 << 20, 1])
def test_audit_is_that_of_every_order_in_turn(spark, sketch):
    rows, labels = awkward(), [(1, 1, 0), (5, 1, 1), (5, 0, None), (8, 1, 1), (9, None, 1), (None, 1, 1), (77, 1, 1)]
    rows += [(100 + k, f"text {k % 40} of many " * (k % 9), "hot") for k in range(300)]
    got = filter_audit.audit_filters(docs(spark, rows), spark.createDataFrame([(*x, "p") for x in labels], LABELS), sketch).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == brute_audit(rows, labels)


def test_audit_of_an_empty_table(spark):
    assert filter_audit.audit_filters(docs(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_the_sketch_clears_most_unique_texts_and_no_repeat(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.xxhash64((F.col("id") / F.lit(1) - F.col("id") % 6000 % 2 * (F.col("id") < 1000).cast("int")).cast("long")).alias("text_hash"))
    buckets = 1 + 6000 * filter_audit.CELLS_PER_ROW // filter_audit.BITMAP_BITS
    marked = filter_audit.add_maybe_repeat(rows, filter_audit.merged_sketch(rows, buckets), buckets).cache()
    repeated = marked.groupBy("text_hash").count().where("count > 1").count()
    assert repeated == 500 and marked.where("maybe").groupBy("text_hash").count().where("count > 1").count() == 500
    assert marked.where("maybe").count() < 1000 + 0.15 * 5000


# --- op12


def brute_spelling(rows, least_length=5, least_n=3, factor=2):
    total = Counter()
    for i, text, *_ in rows:
        for word, n in spelling.document_words(i, text):
            total[word] += n
    vocabulary = {w: n for w, n in total.items() if len(w) >= least_length and n >= least_n}
    alphabet, out = {c for w in vocabulary for c in w}, {}
    for w, n in vocabulary.items():
        edits = {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in alphabet} | {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in alphabet}
        near = [v for v in edits - {w} if v in vocabulary]
        form = min(near, key=lambda v: (-vocabulary[v], v), default=None)
        form = form if form and vocabulary[form] >= factor * n else None
        out[w] = (form, n, len(near), vocabulary.get(form))

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (form, root(w), n, near, form_n) for w, (form, n, near, form_n) in out.items()}


def spelled(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_runs_lose_the_letter_that_the_hash_names():
    import zlib

    text = "Straße ÀÉ× naïve-Æther 12abc"
    runs = ["straße", "ÀÉ×", "naïve", "Æther", "abc"]
    for i in range(400):
        want = Counter()
        for run in runs:
            h = zlib.crc32(f"{i}:{run}".encode())
            want[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
        assert Counter(dict(spelling.document_words(i, text))) == want or sum(want.values()) == 5
        got = Counter()
        for word, n in spelling.document_words(i, text):
            got[word] += n
        assert got == want


@pytest.mark.parametrize("tile,bin_size", [(2048, 8192), (3, 10)])
def test_near_words_are_those_one_edit_away(spark, tile, bin_size):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([4, 5, 5, 6, 6, 7, 8]))) for _ in range(400)] + ["spelling", "speling", "spellling", "spelliny", "xpelling", "pelling", "spellingx", "xspelling", "z" * 900, "z" * 901]
    rows = [(k, " ".join(rng.choice(words) for _ in range(300)), "s") for k in range(60)] + [(99, f"{'z' * 900} {'z' * 901} " * 5 + "spelling " * 50 + "speling pelling xspelling spellingx spelliny " * 4, "s")]
    got = spelled(spelling.group_spellings(docs(spark, rows), tile=tile, bin_size=bin_size))
    assert got == brute_spelling(rows)
    assert got["spelling"][3] >= 5 and got["z" * 900][3] == 1 and any(v[0] for v in got.values())


def test_spelling_awkward_rows(spark):
    rows = awkward()
    assert spelled(spelling.group_spellings(docs(spark, rows))) == brute_spelling(rows)
    assert spelled(spelling.group_spellings(docs(spark, []))) == {}


def test_spelling_query_is_that_of_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert spelled(queries.op12_spelling_variants(spark, FOLDER)) == brute_spelling(rows)


# --- op13


def brute_measures(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    times, covered, seen, dup = Counter(windows), set(), set(), 0
    for k, x in enumerate(windows):
        covered |= set(range(k, k + 8)) if times[x] > 1 else set()
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_measures_are_those_of_a_plain_loop(spark):
    eight = "one two three four five six seven eight"
    rows = [*awkward(), (20, f"{eight} {eight}", "s"), (21, f"{eight} nine {eight} nine", "s"), (22, f"x {eight} y {eight} z {eight}", "s"), (23, "a " * 30, "s"), (24, eight, "s"), (25, "l\nl \nl\n\n\nl", "s"), (26, "seven words are not a window here", "s")]
    got = host_rules.judge_documents(docs(spark, rows)).collect()
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=key) == sorted([(i, *brute_measures(t)) for i, t, _ in rows], key=key)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert host_rules.judge_documents(docs(spark, [])).count() == 0


def test_a_bad_host_takes_its_documents_and_few_documents_do_not(spark):
    good = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(k, good(k) if k % 10 else "junk", f"h{k % 7}") for k in range(700)]
    rows += [(1000 + k, "junk" if k % 10 else good(k), "bad") for k in range(300)] + [(2000, "junk", "new"), (2001, good(2001), "new"), (2002, good(1), None), (2003, "junk", None)]
    table = docs(spark, rows)
    got = {r.doc_id: r for r in host_rules.judge_documents(table).collect()}
    assert not any(got[1000 + k].kept for k in range(300)) and sum(not got[1000 + k].base_failed for k in range(300)) == 30
    assert all(r.kept == (not r.base_failed) for i, r in got.items() if not 1000 <= i < 1300)
    assert got[2001].kept and got[2002].kept and got[2002].host_rate is None and not got[2003].kept
    kept = host_rules.keep_good_hosts(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_host_rules", "host_reputation_tolerated"])
def test_queries_match_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    want = c.sql(queries.SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
