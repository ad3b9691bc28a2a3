"""The training-data operators against brute force, round trips and held-out accuracy, with the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, decontaminate, fingerprints, host_reputation, jaccard_join, kd_shards, language_id, mixing, pii, quality_mil, queries
from ledgerloom.llm.common import connected_components, running_sum, word_hashes

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, block int, node int"


def docs(spark, rows):
    """Rows of (doc_id, text[, source[, lang]]), with extra columns whose names clash with inner ones."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 1, 2) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def awkward(rng):
    long = words(rng, 20000)
    return [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, long + " end"), (6, "one two"), (7, "ONE two"), (8, "one two three"), (9, words(rng, 60)), (9, words(rng, 60)), (None, "null id here it is now"), (11, "same text for two rows here"), (11, "same text for two rows here")]


# --- op10


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(rows[a][0]), root(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True)}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_are_exact(spark, seed):
    rng = random.Random(seed)
    rows, passage = [], words(rng, 30)
    for k in range(25):
        base = words(rng, rng.choice([4, 8, 20, 60, 120])).split()
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            if rng.random() < 0.3:
                copy += passage.split()
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs(spark, rows), region_rows=4).collect()}
    assert got == brute_components(rows)


def test_jaccard_awkward_rows(spark):
    rows = awkward(random.Random(4))
    out = jaccard_join.link_documents(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3)
    assert by[5][1] == 4 and by[7] == (1, 6) and by[8] == (1, 8) and by[None][1] is None and by[11][1] == 11
    assert jaccard_join.link_documents(docs(spark, [])).count() == 0
    assert jaccard_join.keep_one_of_each(docs(spark, rows)).count() == len(rows) - 3


def test_jaccard_regions_are_cut_into_voronoi_cells(spark):
    """Many members about one centre, most of them not near it: regions are cut, and no link goes lost."""
    rng = random.Random(31)
    centre = words(rng, 200, 10**6).split()
    rows = []
    for _ in range(12):
        branch = list(centre)
        for k in rng.sample(range(200), 9):
            branch[k] = f"b{rng.random()}"
        for _ in range(12):
            leaf = list(branch)
            for k in rng.sample(range(200), rng.choice([3, 5, 8])):
                leaf[k] = f"l{rng.random()}"
            rows.append((len(rows), " ".join(leaf)))
    rng.shuffle(rows)
    for size in (4, 64):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs(spark, rows), region_rows=size, pivots=3).collect()}
        assert got == brute_components(rows)


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, b = "one text of six words here", "another text of six words there"
    rows = [(1, a), (5, a), (5, b), (None, a), (None, b), (None, "alone with no id at all"), (7, b), (7, b), (8, ""), (8, None)]
    clash = docs(spark, rows).withColumns({c: F.lit(c) for c in ("key", "row", "set_id", "root", "copies", "deal", "text_hash", "x", "p")})
    kept = jaccard_join.keep_one_of_each(clash)
    assert kept.columns == clash.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (5, b), (None, "alone with no id at all"), (8, ""), (8, None)], key=str)
    found = Counter((r.doc_id, r.component_id) for r in jaccard_join.link_documents(clash).collect())
    assert found == Counter([(1, 1), (5, 1), (5, 5), (None, 1), (None, 5), (None, None), (7, 5), (7, 5), (8, 8), (8, 8)])
    assert jaccard_join.keep_one_of_each(clash.limit(0)).count() == 0


def test_word_hashes_tell_words_apart():
    text = "A a b ab ba  Ab\tAB\né É " + "x" * 70000 + " " + "x" * 69999 + "y " + "x" * 70000
    got = word_hashes(text.encode()).tolist()
    want = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    assert len(got) == len(want) and {(g, w) for g, w in zip(got, want, strict=True)} == set(zip(got, want)) and len(set(got)) == len(set(want))


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges, "t").collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


# --- op7


def test_contaminated_documents_are_found_and_clean_ones_left(spark):
    rng = random.Random(5)
    items = [words(rng, n, 5000) for n in (14, 30, 60)]
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, "too short")], "item_id long, text string")

    def changed(t, every):
        return " ".join("zzz" if k % every == every - 1 else w for k, w in enumerate(t.split()))

    def around(t):
        return f"{words(rng, 40, 5000)} {t} {words(rng, 40, 5000)}"

    rows = [(0, around(items[0])), (1, around(items[1].upper())), (2, around(changed(items[2], 12))), (3, around(items[2].replace(" ", ", "))), (4, words(rng, 300, 5000)), (5, around(" ".join(items[1].split()[:8]))), (6, None), (7, "")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 2)}
    assert {r.doc_id for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()} == {4, 5, 6, 7}
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_benchmarks_are_taken_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    items = [words(rng, 40, 5000) for _ in range(12)]
    bench, rows = spark.createDataFrame([*enumerate(items), (50, "tiny item")], "item_id long, text string"), docs(spark, [(k, f"a b {t} c") for k, t in enumerate(items)] + [(70, words(rng, 50)), (71, "a tiny, ITEM")])
    want = sorted(decontaminate.contaminated(rows, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    assert sorted(decontaminate.contaminated(rows, bench).collect()) == want and len(want) == 13


def test_what_is_broadcast_does_not_grow_with_the_benchmark(spark, monkeypatch):
    rng = random.Random(26)
    items = [words(rng, 40, 5000) for _ in range(12)]
    bench, rows = spark.createDataFrame([*enumerate(items)], "item_id long, text string"), docs(spark, [(k, f"a b {t} c") for k, t in enumerate(items)])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    held = lambda b: decontaminate.contaminated(rows, b)._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")
    assert held(bench) == 0  # each block has been written
    one = bench.where("item_id = 3")
    copies = one.union(one.withColumn("item_id", F.explode(F.sequence(F.lit(100), F.lit(140)))))
    assert held(copies) == held(one) == 2  # of one block
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, copies).collect()} == {(3, k) for k in (3, *range(100, 141))}


def test_an_item_s_word_counts_once(spark):
    rng = random.Random(16)
    item = words(rng, 50, 5000).split()
    half, rest = " ".join(item[:20]), " ".join(item[20:45])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "five words are an item"), (3, "")], "item_id long, text string")
    long = words(rng, 30000, 5000)
    rows = [(0, f"{half} x {half}"), (1, f"{half} put in {rest}"), (2, f"{long} {' '.join(item)} {long}"), (3, "so five, WORDS are an item it is"), (4, "five words were an item"), (5, half), (5, " ".join(item)), (None, " ".join(item)), (None, half), (6, " ".join(item)), (6, " ".join(item))]
    clash = docs(spark, rows).withColumns({c: F.lit(c) for c in ("words", "pos", "h", "h1", "h2", "key", "row", "share", "item", "shift")})
    got = Counter((r.doc_id, r.item_id, r.matched) for r in decontaminate.contaminated(clash, bench).collect())
    assert got == Counter([(1, 1, 45), (2, 1, 50), (3, 2, 5), (5, 1, 50), (None, 1, 50), (6, 1, 50)])
    kept = decontaminate.decontaminate(clash, bench)
    assert kept.columns == clash.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(0, rows[0][1]), (4, rows[4][1]), (5, half), (None, half)], key=str)
    assert decontaminate.decontaminate(clash, bench.limit(0)).count() == len(rows)


def test_masks_hit_every_alignment_of_the_least_share():
    """The most equal words that an alignment of n words can have without a hit, by its last seven words."""
    hit = [int(m[::-1], 2) for m in decontaminate.MASKS]
    most = {0: 0}
    for n in range(1, 301):
        after = {}
        for last, ones in most.items():
            for bit in (0, 1):
                now = (last << 1 | bit) & 127
                if not any(now & (m << k) == m << k for m in hit for k in range(7)):
                    after[now] = max(after.get(now, 0), ones + bit)
        most = after
        assert max(most.values()) < max(8, 0.6 * n)


def test_copies_with_replaced_words_are_found(spark):
    rng = random.Random(9)
    items = [words(rng, n, 5000) for n in (8, 15, 16, 20, 30, 60)]
    bench, rows = spark.createDataFrame([*enumerate(items)], "item_id long, text string"), []
    for text in items:
        item = text.split()
        gone = [{k for k in range(len(item)) if k % every == at} for every in (3, 4) for at in range(every)] + [{k for k in range(len(item)) if k % 6 > 2}]
        gone += [set(rng.sample(range(len(item)), len(item) - -(-6 * len(item) // 10))) for _ in range(20)]
        for lost in gone:
            rows.append((len(rows), f"{words(rng, 20, 5000)} {' '.join('zzz' if k in lost else w for k, w in enumerate(item))} {words(rng, 20, 5000)}"))
    want = set()
    for i, text in rows:
        w = text.split()
        for k, item in enumerate(items):
            v = item.split()
            equal = max(sum(a == b for a, b in zip(w[s:], v)) for s in range(len(w)))
            if equal >= 8 and equal >= 0.6 * len(v):
                want.add((i, k))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == want and len(want) > 100


# --- op1


def brute_targets(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
        free -= over
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(7)
    rows = [(k, words(rng, rng.choice([1, 30, 400])), rng.choice(["a", "a", "b", "é", None, "c"])) for k in range(300)] + [(300, None, "a"), (301, "", None), (5, "dup row", "b"), (5, "dup row", "b"), (302, "x", "empty?")]
    out = mixing.mix_sources(docs(spark, rows), block_words=64).collect()
    assert len(out) == len(rows) and out != [] and all(r.taken <= 2 * r["size"] for r in out)
    sizes, taken = {}, {}
    for r in out:
        sizes[r.source], taken[r.source] = r.source_size, taken.get(r.source, 0) + r.taken
    want = brute_targets(sizes)
    for r in out:
        assert r.target == pytest.approx(want[r.source])
    for s, t in taken.items():
        assert abs(t - want[s]) <= 64 + 0.02 * want[s]
    again = mixing.mix_sources(docs(spark, rows), block_words=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    copies = {r.doc_id: r.n for r in mixing.mixed_documents(docs(spark, rows)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert max(copies.values()) <= 6 and 300 not in copies


def test_mixed_documents_keep_null_and_repeated_ids(spark):
    rng = random.Random(17)
    rows = [(None, words(rng, 50), "a") for _ in range(40)] + [(1, words(rng, 50), "a") for _ in range(40)] + [(None, "one text twice", "a")] * 2
    rows += [(100 + k, words(rng, 50), "b") for k in range(80)]
    rows = [(*r, "en") for r in rows]
    want = Counter()
    for r in mixing.mix_sources(docs(spark, rows), block_words=1).collect():
        want[r.doc_id, r.source] += r.taken
    got, texts = Counter(), Counter()
    for r in mixing.mixed_documents(docs(spark, rows), block_words=1).collect():
        got[r.doc_id, r.source] += len(r.text.split())
        texts[r.text] += 1
    assert sum(v for (i, s), v in got.items() if i is None) > 0
    for key in ((None, "a"), (1, "a")):
        assert abs(got[key] - want[key]) < 0.25 * want[key]
    given = Counter(t for _, t, *_ in rows)
    assert all(texts[t] <= 2 * n for t, n in given.items()) and set(texts) <= set(given)


def test_permutations_are_bijections(spark):
    rows = spark.range(40).select((F.col("id") + 1).alias("n")).withColumn("x", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    rows = rows.union(spark.range(1000).select(F.lit(1000), F.col("id").cast("int")))
    seen = {}
    for seed in (1, 2):
        for r in rows.select("n", "x", mixing.permuted(F.col("x").cast("long"), F.col("n"), [F.lit(seed)]).alias("y")).collect():
            seen.setdefault((seed, r.n), {})[r.x] = r.y
    assert all(sorted(m.values()) == list(range(n)) for (_, n), m in seen.items())
    assert seen[1, 1000] != seen[2, 1000] and sum(seen[1, 1000][x] == x for x in range(1000)) < 20


def test_shards_draw_their_source_counts(spark):
    sources = spark.createDataFrame([("a", 6400, 12800.0), (None, 640, 960.0), ("b", 3333, 2000.0), ("empty", 0, 0.0)], "source string, source_size long, target double")
    drawn = {}
    for seed, shards in ((1, 8), (2, 8), (1, 5)):
        out = mixing.draw_blocks(sources, seed, shards, 64).collect()
        times, per = Counter((r.source, r.block) for r in out), Counter(r.shard for r in out)
        slots = {}
        for r in out:
            slots.setdefault((r.source, r.shard), []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        own = Counter(r.source for r in out)
        assert set(per) == set(range(shards)) and max(per.values()) - min(per.values()) <= 4
        assert all(v <= 2 for v in times.values()) and abs(own["a"] - 200) <= shards and abs(own[None] - 15) <= shards and abs(own["b"] - 32) <= shards
        assert {b for s, b in times if s == "a"} == set(range(100)) or own["a"] < 100
        drawn[seed, shards] = sorted(map(str, out))
    assert len({str(v) for v in drawn.values()}) == 3


def test_shards_vary_as_multinomial_draws_do(spark):
    sources = spark.createDataFrame([("a", 640000, 640000.0), ("b", 320000, 320000.0), (None, 320000, 320000.0)], "source string, source_size long, target double")
    counts, shards, seeds = Counter(), 64, range(6)
    for seed in seeds:
        for r in mixing.shard_counts(sources, seed, shards, 64).collect():
            counts[seed, r.shard, r.source] = r["count"]
    assert all(sum(counts[seed, s, "a"] for s in range(shards)) == 10000 for seed in seeds)
    length, share = 20000 / 64, {"a": 0.5, "b": 0.25, None: 0.25}
    for source, p in share.items():
        got = [counts[seed, s, source] for seed in seeds for s in range(shards)]
        variance = sum((x - length * p) ** 2 for x in got) / len(got)
        # Of a multinomial, over shards that share out fixed totals.
        assert 0.75 < variance / (length * p * (1 - p) * (1 - 1 / shards)) < 1.3
    assert len({tuple(counts[seed, s, "a"] for s in range(shards)) for seed in seeds}) == len(seeds)


def test_mix_takes_very_long_and_repeated_texts_whole(spark):
    rng = random.Random(23)
    out = mixing.mix_sources(docs(spark, awkward(rng)), block_words=64).collect()
    assert len(out) == 13 and all(0 <= r.taken <= 2 * r["size"] for r in out) and {r["size"] for r in out if r.doc_id == 4} == {20000}
    assert abs(sum(r.taken for r in out) - out[0].target) <= 64


def test_mixed_blocks_are_the_taken_words(spark):
    rows = docs(spark, [(k, words(random.Random(k), 1 + k % 50), "aab"[k % 3]) for k in range(60)] + [(90, None, "a"), (91, "", None)])
    blocks = mixing.mixed_blocks(rows, block_words=8, shards=4).collect()
    taken = {r.doc_id: r for r in mixing.mix_sources(rows, block_words=8, shards=4).collect()}
    got, want = Counter(), Counter()
    for r in blocks:
        got[r.source] += len(r.words)
        assert len(r.words) <= 8
    for r in taken.values():
        want[r.source] += r.taken
    assert got == +want
    text = {r.doc_id: Counter((r.text or "").split()) for r in rows.collect()}
    have = sum((text[i] for i in text), Counter())
    assert all(n <= 2 * have[w] for w, n in sum((Counter(r.words) for r in blocks), Counter()).items())
    other = mixing.mix_sources(rows, block_words=8, shards=16).collect()
    assert {(r.doc_id, r.taken) for r in other} != {(r.doc_id, r.taken) for r in taken.values()}
    clash = rows.withColumns({c: F.lit(c) for c in ("copies", "_copy", "n", "rows", "own", "at", "h1", "row", "start")})
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns and mixed.count() > 0 and mixing.mixed_documents(clash.limit(0)).count() == 0


def test_running_sum_is_a_running_sum(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", None]), k, rng.randint(0, 9)) for k in range(500)]
    out = running_sum(spark.createDataFrame(rows, "p string, k long, v long"), ["p"], [F.col("k")], F.col("v"), "s").collect()
    for p in ("a", None):
        part = sorted((r.s, r.v) for r in out if r.p == p)
        ends = sorted(s + v for s, v in part)
        assert part[0][0] == 0 and ends[-1] == sum(v for _, v in part)


# --- op2


def test_shards_balance_and_slots_are_gapless(spark):
    rng = random.Random(9)
    rows = [(k, words(rng, rng.choice([5, 50, 300])), rng.choice(["hot", "hot", "b", None]), rng.choice(["en", "de"])) for k in range(1500)] + [(k, "hot copy " * 60) for k in range(2000, 2600)] + [(3000, None), (3001, ""), (3001, "")]
    out = kd_shards.shard_documents(docs(spark, rows), 16).collect()
    assert len(out) == len(rows)
    text = dict((i, t) for i, t, *_ in rows)
    load, slots = {}, {}
    for r in out:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data)) and r.grown_shard is None
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(load) == set(range(16)) and max(load.values()) < 1.1 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in out if r.doc_id in (3000, 3001)}) == 1
    assert kd_shards.shard_documents(docs(spark, [])).count() == 0


def plain_tree(points, shards, first=0):
    """The shard of each point (bytes, coordinates, tie, key): split at the weighted median of the widest dimension."""
    if shards == 1 or not points:
        return {p[-1]: first for p in points}
    spread = [max(p[1][d] for p in points) - min(p[1][d] for p in points) for d in range(4)]
    d, half = spread.index(max(spread)), shards // 2
    goal, weights = max(1, sum(p[0] for p in points) * half // shards), Counter()
    for p in points:
        weights[p[1][d], p[2]] += p[0]
    under = 0
    for cut in sorted(weights):
        over = under + weights[cut]
        if over >= goal:
            break
        under = over
    left = lambda p: (p[1][d], p[2]) <= cut if over - goal <= goal - under else (p[1][d], p[2]) < cut
    return plain_tree([p for p in points if left(p)], half, first) | plain_tree([p for p in points if not left(p)], shards - half, first + half)


@pytest.mark.parametrize(("seed", "shards"), [(1, 7), (2, 4)])
def test_the_tree_is_that_of_a_plain_recursion(spark, seed, shards):
    rng = random.Random(seed)
    # Few places and ties, so that medians fall into the middle of a place; one point outweighs a shard.
    points = [(rng.choice([1, 7, 300, 9000 if k == 3 else 40]), tuple(rng.choice([0, 5, 5, rng.randrange(1 << 16)]) for _ in range(4)), rng.randrange(50), k) for k in range(400)]
    frame = spark.createDataFrame([(k, 0, 0, w, *at, tie) for w, at, tie, k in points], "text_hash long, text_crc32 long, piece long, bytes long, d_size long, d_source long, d_lang long, d_id long, tie long")
    got = {r.text_hash: r.shard for r in kd_shards._split(frame, shards).collect()}
    assert got == plain_tree(points, shards) and set(got.values()) == set(range(shards))


def test_written_shards_hold_all_rows_and_columns(spark, tmp_path):
    rows = docs(spark, awkward(random.Random(6))).withColumns({"text_crc32": F.lit("x"), "_crc": F.lit(1), "slot": F.lit(2)})
    kd_shards.write_shards(rows, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.columns == [*rows.columns, "shard"]
    assert sorted(map(str, back.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert back.groupBy("doc_id", "text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError, match="shard"):
        kd_shards.write_shards(rows.withColumn("Shard", F.lit(1)), f"file://{tmp_path}/no", 4)


# --- op3


@pytest.mark.parametrize("text", ["plain", "<|im_end|>", "<\\|x", "<\\\\|im_start|>user\n", "a\\n\\b\n", "", "<|", "é<|\U0001f600|>"])
def test_turns_survive_the_round_trip(text):
    for role, body in ((text.replace("\n", " "), text), (text, text), ("assistant", text)):
        written = chat_format.write_turn(role, body)
        assert chat_format.read_turns(written + chat_format.write_turn("user", "next")) == [(role, body), ("user", "next")]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>é"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, "user", "q"), (3, None, "user", "late"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256("user\na\nassistant\nb<|im_end|>é\n\n\n".encode()).hexdigest()
    assert got[1].loss_chars == 12 and got[1].loss_sha256 == hashlib.sha256("b<|im_end|>é".encode()).hexdigest()
    assert got[2].n_turns == 2 and got[2].loss_chars == 2 and got[None].n_turns == 1 and got[3].loss_chars == 0
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


# --- op4


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    model, counts = quality_mil.GatedAttentionMIL(20, 6, 4), np.array([2, 3, 1])
    x, y = rng.normal(size=(6, 20)), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model._forward(x, counts)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = model._gradients(x, counts, y)
    for k, g in grads.items():
        at = tuple(0 for _ in np.shape(g))
        before = np.array(model.p[k], dtype=float)
        up, down = before.copy(), before.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        model.p[k] = up
        hi = loss()
        model.p[k] = down
        lo = loss()
        model.p[k] = before
        assert np.asarray(g)[at] == pytest.approx((hi - lo) / 2e-5, abs=1e-6)


def test_quality_on_the_held_out_fold(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op4_quality_mil(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.predicted == r.quality for r in out]) > 0.93


def test_scores_are_those_of_a_plain_loop(spark):
    """The network by its definition, passage by passage, against the batched one."""
    rng = random.Random(51)
    texts = [words(rng, n) for n in (1, 80, 400, 5000)] + ["é" * 700, ""]
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, quality int")
    table = docs(spark, list(enumerate(texts)))
    model = quality_mil.fit_quality(table, labels)
    got = {r.doc_id: r.score for r in quality_mil.score_quality(table, model).collect()}
    p = model.p
    for k, text in enumerate(texts):
        data, e, hs = text.encode(), [], []
        for i in range(0, len(data), quality_mil.PASSAGE):
            f, g, _ = quality_mil.passage_features([data[i : i + quality_mil.PASSAGE]])
            grams = Counter(((int(a) | int(b) << 8 | int(c) << 16) * 2654435761 % 2**32) >> 23 for a, b, c in zip(*[data[i : i + quality_mil.PASSAGE].lower()[o:] for o in range(3)]))
            assert [grams[q] for q in range(512)] == [int(v) for v in g[0]]
            h = np.tanh(((quality_mil.design(f, g)[0] - model.mean) / model.std) @ p["W"] + p["b"])
            e.append((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"])
            hs.append(h)
        if hs:
            a = np.exp(e) / np.exp(e).sum()
            assert got[k] == pytest.approx(1 / (1 + np.exp(-(np.array(hs).T @ a @ p["c"] + p["d"]))), abs=1e-5)
        else:
            assert got[k] == model.base


def test_a_long_text_is_scored_in_slices_of_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    model = quality_mil.GatedAttentionMIL()
    texts = [None, "".join(chr(97 + c) for c in rng.integers(0, 26, 5000)), "", "".join(chr(97 + c) for c in rng.integers(0, 26, 3 * quality_mil.SLICE + 700)), "x"]
    tracemalloc.start()
    got = model.score_texts(pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    for text, score in zip(texts, got, strict=True):
        if text:
            f, g, counts = quality_mil.passage_features([text.encode()])
            assert score == pytest.approx(model._forward((quality_mil.design(f, g) - model.mean) / model.std, counts)["y"][0], abs=1e-6)
        else:
            assert score == model.base


def test_quality_learns_rows_of_one_id_by_their_own_text(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality_mil.GatedAttentionMIL, "fit", lambda self, x, grams, counts, label: seen.update(counts=sorted(counts.tolist()), label=label.tolist()) or self)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    rows = [(1, "a" * 600), (1, "b" * 20), (1, "b" * 20), (2, "c" * 30000), (3, None), (6, "no label")]
    quality_mil.fit_quality(docs(spark, rows), labels)
    assert seen["counts"] == [0, 1, 2, 59] and sorted(seen["label"]) == [0, 1, 1, 1]
    quality_mil.fit_quality(docs(spark, rows), labels, max_fit_bytes=8000)
    assert seen["counts"] == [0, 1, 2]


def test_quality_awkward_rows(spark):
    rows = awkward(random.Random(10))
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 0), (9, 1, 0), (6, None, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_mil.fit_quality(docs(spark, rows), labels)
    out = quality_mil.score_quality(docs(spark, rows), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert quality_mil.keep_good(docs(spark, rows), labels).columns == docs(spark, rows).columns
    empty = quality_mil.fit_quality(docs(spark, []), labels.limit(0))
    assert 0 < quality_mil.score_quality(docs(spark, [(1, "a")]), empty).first().score < 1


# --- op5


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        total = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(11)
    parts = ["a@b.c", "x..y@d-e.f.g@h.i", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111111111111112", "+1 (437) 555-0689", "+12", "+1()2..3 4-", "é", " ", "\n", "9", "a@b", "%%%", "+", "-", "."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == plain_spans(text)


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(k, f"é call me at +1 (437) 555-{k:04} now or never") for k in range(10)] + [(50, "please call me at 437-555-0199 today"), (51, "version 1.2-3456 of it"), (52, None), (53, "")]
    out = {r.doc_id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    assert out[0].n_phone == 1 and out[0].spans == "phone:13:30" and out[50].n_phone == 0 and out[50].spans == "phone:18:30"
    assert out[51].spans == "" and out[52].spans == "" and out[52].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(docs(spark, [])).count() == 0
    assert pii.find_pii(docs(spark, awkward(random.Random(1)))).count() == 13


def test_dropped_matches_are_never_marked_and_masked_seeds_are_found(spark):
    rng = random.Random(41)
    rows = [(k, f"mail {words(rng, 3)} me.{k}@mail{k % 7}.example.com {words(rng, 2)}") for k in range(60)] + [(100 + k, f"pay with card 41111111111111{k:02} now") for k in range(60)]
    rows += [(300 + k, f"{words(rng, 4)} +1 ({200 + k}) 555-{1000 + k} {words(rng, 4)}") for k in range(60)] + [(400, "x" * 5000 + " write to jo@mail1.example.com")]
    out = {r.doc_id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    assert all(len(r.entities) == r.n_card for i, r in out.items() if 100 <= i < 200)
    got = {r.kind: r for r in pii.masked_recall(docs(spark, rows), 0.3).collect()}
    assert got["email"].masked > 5 and got["email"].found >= 0.9 * got["email"].masked and got["phone"].found >= 0.9 * got["phone"].masked
    assert all(r.wrong == 0 for r in got.values())


def test_pii_query_keeps_the_base(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.op5_pii(spark, FOLDER).collect():
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


# --- op6


def test_hosts_and_rules(spark):
    urls = ["HTTP://A.Example.NET/en/x?q#f", "http://example.net", "http://example.net/de/", "x", None, "a://b.example.com/de/1", "a://c.org/fr/", "a://notexample.net/en/", "a://h?x/y", "://q/p#z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, None), (None, 1)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge_pages(pages, labels, queries.URL_RULES).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1][:3] == ("example.net", "", None)
    assert got[2][2:] == ("net/", "block") and got[3][:2] == ("", "") and got[4][:2] == ("", "")
    assert got[5][2:] == ("example.com/de/", "block") and got[6][2:] == ("org/fr/", "allow") and got[7][2:] == ("net/", "block")
    assert got[8][:2] == ("h", "") and got[9][:2] == ("q", "/p")
    assert host_reputation.judge_pages(pages.limit(0), labels, queries.URL_RULES).count() == 0


def test_bad_hosts_are_blocked_and_few_labels_follow_the_domain(spark):
    rows = [(k, f"http://bad.com/{k}", 1) for k in range(60)] + [(100 + k, f"http://h{k % 20}.good.com/{k}", 0) for k in range(200)] + [(500, "http://once.good.com/", 1)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in host_reputation.judge_pages(pages, labels, {}).collect()}
    assert got[0] == "block" and got[100] == "allow" and got[500] == "allow"
    assert "block" not in {r.verdict for r in host_reputation.judge_pages(pages, labels.limit(0), {}).collect()}
    long = pages.union(spark.createDataFrame([(0, "http://bad.com/" + "x" * 100000), (0, "http://bad.com/0")], pages.schema)).withColumns({c: F.lit(c) for c in ("host", "rate", "low", "domain", "suffix", "bad")})
    assert host_reputation.judge_pages(long, labels, {}).where("page_id = 0").count() == 3


def test_two_label_suffixes_keep_sites_apart(spark):
    rows = [(k, f"http://a.bad.co.uk/{k}", 1) for k in range(60)] + [(100 + k, f"http://good{k % 9}.co.uk/{k}", 0) for k in range(200)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in host_reputation.judge_pages(pages, labels, {}).collect()}
    assert {v for i, v in got.items() if i < 60} == {"block"} and {v for i, v in got.items() if i >= 100} == {"allow"}


# --- op8


def test_fingerprints_estimate_jaccard():
    rng = random.Random(12)
    errors = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        a = words(rng, 800, 10**6).split()
        n = int(800 * share)
        b = a[:n] + words(rng, 800 - n, 10**6).split()
        x, y = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (a, b))
        got = fingerprints.likeness(fingerprints.fingerprint(" ".join(a)), fingerprints.fingerprint(" ".join(b)))
        errors.append(abs(got - len(x & y) / len(x | y)))
    assert max(errors) < 0.12
    assert fingerprints.likeness("", "") == 1.0 and fingerprints.likeness("", fingerprints.fingerprint("a")) == 0.0
    assert len(fingerprints.fingerprint("a b", 64, 4)) == 64


def test_next_document_by_descending_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 7)
    rng = random.Random(13)
    rows = [(k * 7 % 101, words(rng, rng.randint(0, 40))) for k in range(60)] + [(None, "last é text of all"), (500, None)]
    out = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(out) == len(rows)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        n = len(text) // 3
        new = text[: len(text) - n] + following[:n]
        mark = fingerprints.fingerprint(text)
        assert (out[i].n_chars, out[i].edited_sha256, out[i].fingerprint) == (len(text), hashlib.sha256(new.encode()).hexdigest(), mark)
        assert out[i].edited_fingerprint == fingerprints.fingerprint(new)
        assert out[i].near_next == fingerprints.likeness(mark, fingerprints.fingerprint(following))
    assert fingerprints.fingerprint_edits(docs(spark, [])).count() == 0
    assert fingerprints.fingerprint_edits(docs(spark, awkward(rng))).count() == 13


# --- op9


def brute_forward(word, pieces, logs, k):
    """By the definition: every segmentation's probability from its last piece back, whole words."""
    w, sums = "▁" + word, [0.0]
    for j in range(1, len(w) + 1):
        terms = []
        for i in range(j):
            if w[i:j] in pieces:
                terms.append(sums[i] + logs[pieces[w[i:j]], k])
            elif i == j - 1:
                terms.append(sums[i] + language_id.RARE)
        top = max(terms)
        sums.append(top + np.log(sum(np.exp(t - top) for t in terms)))
    return sums[-1]


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁ab", "b", "a", "▁", "abababababababab"]
    logs = np.log(np.array([[0.2, 0.1], [0.1, 0.3], [0.3, 0.2], [0.05, 0.1], [0.01, 0.2], [0.02, 0.01]]))
    lattice = language_id.Lattice(pieces)
    want = 0.1 + 0.2 * 0.3 + 0.01 * 0.05 * 0.3
    assert np.exp(language_id.forward(["ab"], lattice, logs)[0, 0]) == pytest.approx(want)
    counts = language_id.expected_counts(["ab", "zz"], np.array([1, 5]), lattice, logs[:, 0])
    assert counts[1] == pytest.approx(0.1 / want) and counts[2] == pytest.approx((0.06 + 0.00015) / want)
    words_ = ["ab", "b", "é", "ab" * 150, "abc" * 60, "x", "a" * 40]
    got = language_id.forward(words_, lattice, logs)
    for w, row in zip(words_, got, strict=True):
        for k in (0, 1):
            assert row[k] == pytest.approx(brute_forward(w, {p: i for i, p in enumerate(pieces)}, logs, k), rel=1e-9)


def test_pieces_and_words_are_whole():
    pieces = language_id.load_pieces()
    assert max(map(len, pieces)) > 12 and len(pieces) > 23700
    assert language_id.words_of("x" * 100 + " Äb 1c") == ["x" * 100, "äb", "c"]


def test_languages_on_the_held_out_fold(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_languages(d)
    out = language_id.identify_languages(d, model).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in out)
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    odd = language_id.identify_languages(docs(spark, awkward(random.Random(3)) + [(70, "123 !!")]), model)
    by = {r.doc_id: r.lang_pred for r in odd.collect()}
    assert by[1] == by[2] == by[3] == by[70] == "und" and by[6] in model.langs
    assert language_id.identify_languages(docs(spark, []), model).count() == 0
    nothing = language_id.fit_languages(docs(spark, []))
    assert language_id.identify_languages(docs(spark, [(1, "a")]), nothing).first().lang_pred == "und"


# --- pipeline


def test_languages_of_one_id_are_told_apart_by_row(spark):
    rows = [(k, f"the house is green and number {k}", "s", "en") for k in range(100)] + [(k, f"das haus ist grün und nummer {k}", "s", "de") for k in range(100)]
    table = docs(spark, rows)
    model = language_id.fit_languages(table)
    got = language_id.identify_languages(docs(spark, [(500, "the house is green"), (501, "das haus ist grün")]), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {500: "en", 501: "de"}
    # The bound holds for rows, also if they share an id.
    few = language_id.fit_languages(table.withColumn("doc_id", F.lit(3).cast("long")), max_fit_rows=5)
    assert set(few.langs) <= {"en", "de"} and few.langs


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [corpus_pipeline.quality(spark, d, FOLDER).cache()]
    assert kept[0].columns == d.columns
    kept.append(corpus_pipeline.near_duplicates(spark, kept[0], FOLDER).cache())
    want = {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in kept[0].collect()]).items() if i == c}
    assert {r.doc_id for r in kept[1].collect()} == want
    kept.append(corpus_pipeline.benchmark_passages(spark, kept[1], FOLDER).cache())
    items = [r.text.lower().split() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    gone = want - {r.doc_id for r in kept[2].collect()}
    texts = {r.doc_id: " ".join(r.text.lower().split()) for r in kept[1].collect()}
    assert {i for i, t in texts.items() if any(len(w) >= 11 and " ".join(w) in t for w in items)} <= gone
    kept.append(corpus_pipeline.mix(spark, kept[2], FOLDER).cache())
    assert {r.doc_id for r in kept[3].collect()} <= {r.doc_id for r in kept[2].collect()} and kept[3].columns == d.columns
    out = corpus_pipeline.shards(spark, kept[3], FOLDER).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in kept[3].collect())


def test_pipeline_runs_on_null_ids_and_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given = d.withColumn("doc_id", F.when(F.col("doc_id") < 140, F.col("doc_id"))).withColumns({"shard": F.lit("x"), "source_size": F.lit(1)})
    given = given.unionByName(given.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}))
    for name, rows in (("full", given), ("empty", given.limit(0))):
        rows.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{FOLDER}/{other}.parquet").write.parquet(f"file://{tmp_path}/{name}/{other}.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}/full").collect()
    sums = {(r.doc_id, zlib.crc32((r.text or "").encode())) for r in given.collect()}
    assert {(r.doc_id, r.text_crc32) for r in out} <= sums and {r["shard"] for r in out} == set(range(16))
    assert len({r.text_crc32 for r in out if r.doc_id is None}) > 20 and len({r.doc_id for r in out}) > 60
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    empty = corpus_pipeline.run(spark, f"file://{tmp_path}/empty")
    assert empty.count() == 0 and [f.name for f in empty.schema] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
