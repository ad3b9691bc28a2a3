"""Running sums over ranges, what is built on them, and the refusals of a split."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import learning as L
from ledgerloom.operators import metrics as X
from ledgerloom.operators.ordered import running_sums


def test_running_sums_are_those_of_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(rng.random(), k, rng.randrange(9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "x double, k long, v long").repartition(7)
    got = running_sums(df, [F.col("x").desc(), F.col("k")], {"upto": F.col("v"), "place": F.lit(1)})
    want, total = {}, 0
    for place, (_, k, v) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
        total += v
        want[k] = (total, place)
    assert got.columns == ["x", "k", "v", "upto", "place"]
    assert {r.k: (r.upto, r.place) for r in got.collect()} == want
    below = running_sums(df, [F.col("x").desc(), F.col("k")], {"upto": F.col("v")}, before=True)
    assert {r.k: r.upto + r.v for r in below.collect()} == {k: t for k, (t, _) in want.items()}
    assert running_sums(df.limit(0), [F.col("x")], {"upto": F.col("v")}).count() == 0


def test_no_window_goes_over_all_rows(spark, capsys):
    df = spark.range(1000).select((F.col("id") / 1000).alias("probability"), (F.col("id") % 2).alias("label"), F.lit(1).alias("amount"))
    for out in (X.threshold_select(df, 0.5, 100), X.model_metrics(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        # The only window without a partition goes over the ranges.
        assert "Window" in plan and "probability" not in "".join(x for x in plan.splitlines() if "Exchange SinglePartition" in x)


def test_thresholds_and_area_of_a_plain_loop(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40) / 40, rng.randrange(2), rng.randrange(100)) for _ in range(500)]
    df = spark.createDataFrame(rows, "probability double, label int, amount int")
    ok = []
    for t in {p for p, _, _ in rows}:
        picked = [r for r in rows if r[0] >= t]
        if sum(1 - y for _, y, _ in picked) / len(picked) <= 0.45 and sum(a for _, y, a in picked if not y) <= 6000:
            ok.append(t)
    got = X.threshold_select(df, 0.45, 6000).first()
    assert (got.coverage_threshold, got.precision_threshold) == (min(ok, default=None), max(ok, default=None))
    wins = sum((p > q) + (p == q) / 2 for p, y, _ in rows if y for q, z, _ in rows if not z)
    assert X.model_metrics(df).first().auc == pytest.approx(wins / (sum(y for _, y, _ in rows) * sum(1 - y for _, y, _ in rows)), abs=1e-6)


def test_groups_fill_validation_then_test(spark):
    rows = [(k, g) for g in range(30) for k in range(g % 7 + 1)]
    got = L.grouped_split(spark.createDataFrame(rows, "example int, group int"), validation=0.3, test=0.1).collect()
    assert {r.group: r.n for r in got} == {g: g % 7 + 1 for g in range(30)}
    total = len(rows)
    for name, share in (("validation", 0.3), ("test", 0.1)):
        own = sum(r.n for r in got if r.split == name)
        assert share * total - 0.5 <= own < share * total + 7.5
    assert {r.split for r in got} == {"validation", "test", "train"}


def test_splits_that_cannot_be_are_refused(spark):
    df = lambda groups: spark.createDataFrame([(g,) for g in groups], "group int")
    with pytest.raises(ValueError, match="leave one for training"):
        L.grouped_split(df([1, 2, 3]), validation=0.6, test=0.4)
    with pytest.raises(Exception, match="needs three groups"):
        L.grouped_split(df([1, 2, 2])).collect()
    with pytest.raises(Exception, match="do not fill three splits"):
        L.grouped_split(df([1, 2, 3]), validation=0.5, test=0.4).collect()
    assert sorted(r.split for r in L.grouped_split(df([1, 2, 3])).collect()) == ["test", "train", "validation"]


def test_keys_in_two_splits_are_refused(spark):
    rows = spark.createDataFrame([("train", 1, "a"), ("test", 2, "a"), ("test", 3, None), ("validation", 4, None)], "split string, seed int, entity string")
    assert [tuple(r) for r in L.split_overlaps(rows, ["seed", "entity"]).collect()] == [("entity", "a", ["test", "train"])]
    with pytest.raises(ValueError, match="entity a is in the splits test, train"):
        L.refuse_overlaps(rows, ["seed", "entity"])
    assert L.refuse_overlaps(rows, ["seed"]) is rows
