"""Selection without reuse is that of a scan, also along chains, in few rounds."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import greedy

KIND = "option_id string, rank long, tie long, resources array<string>"


def scan(rows):
    used, out = set(), set()
    for name, _, _, resources in sorted(rows, key=lambda r: (r[1], -r[2], r[0])):
        if resources and used.isdisjoint(resources):
            used |= set(resources)
            out.add(name)
    return out


def select(spark, rows, **options):
    got = greedy.greedy_select(spark.createDataFrame(rows, KIND), [F.col("rank"), F.col("tie").desc()], **options)
    assert got.columns == ["option_id", "rank", "tie", "resources"]
    return [r.option_id for r in got.collect()]


@pytest.mark.parametrize("seed,whole", [(1, 200_000), (2, 40), (3, 3)])
def test_random_options(spark, seed, whole):
    rng = random.Random(seed)
    rows = [(f"o{k}", rng.randrange(20), rng.randrange(3), [f"r{rng.randrange(150)}" for _ in range(rng.choice([1, 2, 2, 3, 4]))]) for k in range(200)]
    rows += [(f"hot{k}", 50 - k, 0, ["hot", f"x{k}"]) for k in range(40)] + [("none", 0, 0, [])]
    got = select(spark, rows, whole=whole)
    assert len(got) == len(set(got)) and set(got) == scan(rows)


@pytest.mark.parametrize("chains,whole", [(1, 200_000), (2, 25_000)])
def test_chains_of_ten_thousand_links_take_few_rounds(spark, monkeypatch, chains, whole):
    written = []
    cut = greedy.cut
    monkeypatch.setattr(greedy, "cut", lambda df, name: written.append(name) or cut(df, name))
    rows = [(f"o{c}-{k}", k, 0, [f"r{c}-{k}", f"r{c}-{k + 1}"]) for c in range(chains) for k in range(10_000)]
    got = select(spark, rows, whole=whole)
    assert set(got) == {f"o{c}-{k}" for c in range(chains) for k in range(0, 10_000, 2)}
    assert written.count("greedy-live") + written.count("component-labels") <= 20


def test_no_options(spark):
    assert select(spark, []) == []


def test_components_of_ids_and_keys(spark):
    rng = random.Random(9)
    rows = [(k, f"k{rng.randrange(300)}") for k in range(200) for _ in range(rng.choice([1, 1, 2]))]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, key in rows:
        parent[root(k)] = root(key)
    groups = {}
    for k, _ in rows:
        groups.setdefault(root(k), set()).add(k)
    got = {r.id: r.group for r in greedy.connected(spark.createDataFrame(rows, "id long, k string"), "id").collect()}
    assert got == {k: min(g) for g in groups.values() for k in g}


def test_only_options_that_share_a_resource_are_put_into_order(spark, monkeypatch):
    ordered, found = [], greedy.running_sums
    monkeypatch.setattr(greedy, "running_sums", lambda rows, *rest: (ordered.append(rows.count()), found(rows, *rest))[1])
    rows = [(f"o{k:02}", [f"a{k}", f"b{k}"]) for k in range(20)] + [("x", ["c", "a3"]), ("y", ["c", "c"]), ("z", ["d", "d"]), ("none", [])]
    options = spark.createDataFrame(rows, "option_id string, resources array<string>")
    got = {r.option_id for r in greedy.greedy_select(options, [F.col("option_id")]).collect()}
    assert got == {f"o{k:02}" for k in range(20)} | {"y", "z"} and ordered == [4]


def test_keys_of_one_id_and_ids_of_one_key_are_gone_before_the_rounds(spark, monkeypatch):
    written, cut = [], greedy.cut
    monkeypatch.setattr(greedy, "cut", lambda df, name: written.append((name, df.count())) or cut(df, name))
    rows = [(k, f"own{k}") for k in range(500)] + [(k, f"ten{k // 10}") for k in range(500)] + [(7, "x"), (13, "x"), (7, "x"), (490, "y"), (25, "y"), (12, "z"), (21, "z")]
    got = {r.id: r.group for r in greedy.connected(spark.createDataFrame(rows, "id long, k string"), "id").collect()}
    join = {1: 0, 2: 0, 49: 0}
    assert got == {k: join.get(k // 10, k // 10) * 10 for k in range(500)}
    assert sum(n for name, n in written if name == "component-ends") < 600
    assert sum(n for name, n in written if name == "component-labels") < 600
