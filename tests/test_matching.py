import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import normalize as N
from ledgerloom.operators import controls as C
from ledgerloom.operators import graph as G
from ledgerloom.operators import learning as L
from ledgerloom.operators import matching as M
from ledgerloom.operators.greedy import connected
from ledgerloom.plans import queries as core
from ledgerloom.plans.storage import cut

SCHEMA = "record_id string, record_type string, external_id string, amount decimal(20,4), currency string, record_date date, reference string, party string, fee_amount decimal(20,4)"


def record(i, amount, ref=None, kind="invoice", currency="USD", day=1, ext=None, party="p", fee=0):
    return (i, kind, ext, Decimal(str(amount)), currency, dt.date(2026, 1, day), ref, party, Decimal(str(fee)))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_greedy_equals_a_sequential_scan(spark):
    rng = random.Random(3)
    options = [(str(k), rng.randint(0, 5), sorted({f"r{rng.randint(0, 12)}" for _ in range(rng.randint(1, 3))})) for k in range(60)]
    used, want = set(), set()
    for k, _, res in sorted(options, key=lambda o: (o[1], o[0])):
        if not used & set(res):
            used |= set(res)
            want.add(k)
    df = spark.createDataFrame(options, "option_id string, priority int, resources array<string>")
    got = M.greedy_select(df, [F.col("priority"), F.col("option_id")])
    assert {r.option_id for r in got.collect()} == want


def test_rules_in_order_of_the_cascade(spark):
    s = frame(spark, record("a", 10, "R1"), record("b", 20), record("c", 30, day=1), record("d", 40, ext="E"), record("e", 50, "R5"), record("f", 60))
    t = frame(spark, record("A", 99, " r1 ", "payment"), record("B", 20, None, "payment"), record("C", 30, None, "payment", day=3), record("D", 41, None, "payment", ext="E"), record("E", 50, "r5", "payment", "JPY"), record("F", "57.5", None, "payment", fee="2.5"))
    got = {(r.source_id, r.target_id): (r.rule, r.status) for r in M.rule_pairs(s, t).collect()}
    assert got == {("a", "A"): ("reference", "MATCHED"), ("b", "B"): ("amount_date", "MATCHED"), ("c", "C"): ("timing", "MATCHED"), ("d", "D"): ("external_id", "MATCHED"), ("e", "E"): ("currency_mismatch", "EXCEPTION"), ("f", "F"): ("fee", "EXCEPTION")}


def test_reconcile_uses_each_record_once(spark):
    s = frame(spark, record("a", 10, "R"), record("b", 30), record("c", 5), record("d", 7), record("e", 99))
    t = frame(spark, record("A", 10, "R", "payment"), record("B", 11, None, "payment", day=9), record("C", 19, None, "payment", day=9), record("D", 12, None, "payment", day=9), record("Z", 1, None, "payment", "EUR"))
    rows = M.reconcile(s, t).collect()
    matched = {(tuple(r.source_ids), tuple(r.target_ids)) for r in rows if r.status == "MATCHED"}
    assert matched == {(("a",), ("A",)), (("b",), ("B", "C")), (("c", "d"), ("D",))}
    ids = [i for r in rows for i in [*r.source_ids, *r.target_ids]]
    assert len(ids) == len(set(ids)) == 10


def test_empty_sides(spark):
    none, one = frame(spark), frame(spark, record("a", 1))
    assert [r.status for r in M.reconcile(one, none).collect()] == ["UNMATCHED"]
    assert M.reconcile(none, none).count() == 0


def test_three_and_four_parts(spark):
    a = frame(spark, record("x", 60), record("y", 1111), record("z", 310))
    p = frame(spark, *[record(k, v, None, "payment") for k, v in (("a", 1), ("b", 10), ("c", 100), ("d", 1000), ("e", 15), ("g", 45), ("h", 70), ("i", 90), ("j", 150), ("n", -5))])
    got = {r.anchor_id: r.members for r in M.allocate(a, p).collect()}
    assert got == {"x": ["e", "g"], "y": ["a", "b", "c", "d"], "z": ["h", "i", "j"]}


def test_date_cells_find_what_a_plain_join_finds(spark):
    rng = random.Random(1)
    rows = [record(f"{k:02}", rng.choice([10, 500, 99999]), None, rng.choice(["invoice", "payment"]), rng.choice(["USD", "EUR"]), rng.randint(1, 28)) for k in range(50)]
    got = {(r.source_id, r.target_id) for r in G.candidate_edges(frame(spark, *rows), 3).collect()}
    want = set()
    for x in rows:
        for y in rows:
            first = ((x[1] != "invoice", x[0]) < (y[1] != "invoice", y[0]))
            if first and x[4] == y[4] and abs((x[5] - y[5]).days) <= 3 and abs(len(str(x[3])) - len(str(y[3]))) <= 2:
                want.add((x[0], y[0]))
    assert got == want


def test_money_and_dates(spark):
    text = ["($1,200.50)", "€5", "", "x", None, "1e3", "12345678901234567.5"]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    assert [r[0] for r in df.select(N.parse_amount(F.col("t"))).collect()] == [Decimal("-1200.5"), Decimal(5), None, None, None, Decimal(1000), None]
    fin = ["$1,234.56", "($500.00)", "1.5M", "500K", "1.2B", "1,000,000.00", "1.234,56", "($ 1,234.56)", "not a number", "", "12,34"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in fin], "t string").select(N.fin_value(F.col("t"))).collect()]
    assert got == [Decimal("1234.56"), Decimal(-500), Decimal(1500000), Decimal(500000), Decimal(1200000000), Decimal(1000000), Decimal("1234.56"), Decimal("-1234.56"), None, None, Decimal(1234)]
    days = spark.createDataFrame([(t,) for t in ["2026-1-5", "01/02/2026", "13/02/2026", "2026/03/04", "junk"]], "t string").select(N.parse_date(F.col("t")))
    assert [r[0] for r in days.collect()] == [dt.date(2026, 1, 5), dt.date(2026, 1, 2), dt.date(2026, 2, 13), dt.date(2026, 3, 4), None]


def test_no_leakage_between_splits(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(k, rng.randint(0, 40), rng.randint(0, 40)) for k in range(60)], "example_id long, a long, b long")
    groups = {r.example_id: r.group for r in L.leakage_groups(rows, ["a", "b"]).collect()}
    data = rows.collect()
    for x in data:
        for y in data:
            if x.a == y.a or x.b == y.b:
                assert groups[x.example_id] == groups[y.example_id]


def test_edges_of_one_party_are_those_of_all_edges(spark):
    records = core.both(spark, "/root/testdata/sf0.001")
    records = records[0].unionByName(records[1])
    party = {r.record_id: r.party for r in records.select("record_id", "party").collect()}
    want = sorted(tuple(r) for r in G.candidate_edges(records).collect() if party[r.source_id] == party[r.target_id])
    assert want and sorted(map(tuple, G.candidate_edges(records, one_party=True).collect())) == want


def test_examples_of_the_same_keys_go_through_the_rounds_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "connected", lambda ends, name: seen.append(ends.count()) or connected(ends, name))
    rows = [(k, f"p{k % 5}", None) for k in range(5, 500)] + [(1, "p1", "x"), (2, None, "x"), (3, None, None), (4, "p4", None), (4, None, "y"), (600, None, "y"), (None, "p0", "x")]
    got = {r.id: r.group for r in L.leakage_groups(spark.createDataFrame(rows, "id int, a string, b string"), ["a", "b"], "id").collect()}
    want = {k: {0: 5, 1: 1, 2: 7, 3: 8, 4: 4}[k % 5] for k in range(5, 500)} | {1: 1, 2: 1, 3: 3, 4: 4, 600: 4}
    assert got == want
    assert seen[0] <= 20


def test_rules_of_one_key_share_a_join(spark):
    rows = spark.createDataFrame([], "record_id string, external_id string, amount decimal(20,4), currency string, record_date date, reference string, fee_amount decimal(20,4)")
    rows = rows.union(rows)
    plan = M.rule_pairs(rows, rows)._jdf.queryExecution().analyzed().toString()
    # Reference, external id, amount, and the fee of either side.
    assert plan.count("Join Inner") + plan.count("Join UsingJoin") == 5


def test_rivals_counted_by_record_are_those_of_the_candidates(spark, monkeypatch):
    rng, written = random.Random(11), []
    monkeypatch.setattr(C, "cut", lambda df, name: (written.append(df.count()), cut(df, name))[1])

    def some(kind, n):
        return spark.createDataFrame([(f"{kind[0]}{k:02}", kind, None, Decimal(rng.choice([20, 25, 25, 40, 90])), rng.choice(["EUR", "EUR", "USD", None]), dt.date(2026, 1, rng.randrange(1, 9)), f"r{k % 3}", None, None) for k in range(n)], SCHEMA)

    sources, targets = some("invoice", 18), some("payment", 18)
    plain = G.candidate_batch(sources, targets)
    want = {r.candidate_id: r.rivals for r in C.rival_counts(plain).collect()}
    got = C.candidates_with_rivalry(sources, targets)
    assert {r.candidate_id: r.rivals for r in got.collect()} == want and len(want) > 50
    # Before the mask itself one row a record is written at most, not one a candidate.
    for margin in ("0.05", "0.15"):
        mine = {tuple(r) for r in C.batch_review_mask(sources, targets, margin=margin).collect()}
        assert max(written) <= 36
        assert mine == {tuple(r) for r in C.review_mask(plain, margin=margin).collect()} and any(r[-1] for r in mine)
        written.clear()
    assert {f.name for f in got.schema} >= {f.name for f in plain.schema}


def test_candidates_are_joined_back_once(spark):
    rng = random.Random(12)
    rows = [(f"s{a}:t{b}", f"s{a}", f"t{b}", rng.choice([0.3, 0.5, 0.55, 0.6, 0.9, None])) for a in range(9) for b in range(9) if rng.random() < 0.4]
    candidates = spark.createDataFrame(rows, "candidate_id string, source_id string, target_id string, score double")
    for margin in ("0.00", "0.05", "0.10"):
        want = {}
        for c, s, t, d in rows:
            rivals = [Decimal(str(x)) for k, a, b, x in rows if k != c and (a == s or b == t) and x is not None]
            want[c] = None if d is None else Decimal(str(d)) >= Decimal("0.5") and all(Decimal(str(d)) - x >= Decimal(margin) for x in rivals)
        assert {r.candidate_id: r.review for r in C.review_mask(candidates, margin=margin).collect()} == want and True in want.values()
    meta = {"review_threshold": "0.50", "review_gate_passed": True, "review_policy": "separated", "relationships": ["a->b"]}
    sides = {f"{side}_{c}": F.lit(v) for side, kind in (("source", "a"), ("target", "b")) for c, v in (("type", kind), ("currency", "EUR"), ("party", "p"))}
    ranked = C.rank_candidates(candidates.withColumns(sides), meta)
    assert {r.candidate_id for r in ranked.collect() if r.suggestion == "REVIEW"} == {r.candidate_id for r in C.review_mask(candidates).collect() if r.review}
    # The best of one side with those of the other, and the candidates with what is left of them.
    assert ranked._jdf.queryExecution().analyzed().toString().count("Join ") == 2


def test_close_edges_are_the_edges_of_near_amounts(spark):
    rng = random.Random(5)
    # Cents around the cells of ten, also below zero, and two types that come after all stages.
    rows = [record(f"{k:02}", rng.choice([-1, 1]) * rng.randrange(0, 5000) / 100, None, rng.choice(["invoice", "payment", "x", "y"]), "USD", rng.randint(1, 28)) for k in range(60)]
    records = frame(spark, *rows).withColumn("amount", F.round("amount", 2).cast("decimal(20,4)"))
    amount = {r.record_id: r.amount for r in records.collect()}
    every = G.candidate_edges(records, only_across=True).collect()
    assert sorted(map(tuple, every)) == sorted(tuple(r) for r in G.candidate_edges(records).collect() if r.source_type != r.target_type)
    want = sorted(tuple(r) for r in every if abs(amount[r.source_id] - amount[r.target_id]) <= 10)
    assert want and len(want) < len(every) and sorted(map(tuple, G.candidate_edges(records, only_across=True, close=True).collect())) == want


def test_long_paths_need_the_inner_edges_only(spark):
    kinds = ["invoice", "payment", "processor", "settlement", "bank_transaction"]
    edges = [(f"{a}{i}", f"{b}{i}", kinds[a], kinds[b], Decimal("0.95") if b == a + 1 else Decimal("0.50")) for a in range(5) for b in range(5) if a != b for i in "pq"]
    df = spark.createDataFrame(edges, "source_id string, target_id string, source_type string, target_type string, score decimal(4,2)")
    paths = lambda **inner: sorted(map(tuple, G.lineage_paths(df, **inner).collect()))
    got = paths(inner=df.where("score > 0.50"))
    assert got == paths() and ("0p>1p>2p>3p>4p", 5, round(0.95**4, 6)) in got and ("0p>4p", 2, 0.5) in got and len(got) == 2 * (4 + 6 + 3 + 2 + 1)
