"""Registered queries do the whole job: held against brute force over small tables."""

import itertools
import random
from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

import pytest

from ledgerloom.plans import queries as core

STAGES = {"invoice": 0, "payment": 1, "settlement": 3}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """60 orders of one currency on few days, each case of the derived tables six times."""
    rng, path = random.Random(3), str(tmp_path_factory.mktemp("orders"))
    rows = [(k, 4 * (k % 3), Decimal(rng.randrange(10000, 99999)) / 100, date(2024, 1, 1) + timedelta(rng.randrange(40))) for k in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice decimal(20,2), o_orderdate date").write.parquet(f"{path}/orders.parquet")
    return path


def brute_edges(records, window=3):
    out = {}
    for a, b in itertools.combinations(records, 2):
        a, b = sorted((a, b), key=lambda r: (STAGES[r.record_type], r.record_id))
        bucket = [max(1, len(str(int(r.amount))) * 100 - 100) for r in (a, b)]
        if a.currency == b.currency and abs((a.record_date - b.record_date).days) <= window and abs(bucket[0] - bucket[1]) <= 200:
            out[a.record_id, b.record_id] = (a, b)
    return out


def test_edges_reach_three_days(spark, folder):
    i, p = core.both(spark, folder)
    want = set(brute_edges(i.collect() + p.collect()))
    edges = core.QUERIES["candidate_edges"](spark, folder)
    assert {(r.source_id, r.target_id) for r in edges.collect()} == want
    across = {k for k in want if k[0][0] != k[1][0]}
    assert {(r.source_id, r.target_id) for r in core.QUERIES["candidate_batch"](spark, folder).collect()} == across
    ends = Counter(k[0] for k in across) + Counter(k[1] for k in across)
    assert {r.candidate_id: r.rivals for r in core.QUERIES["rival_counts"](spark, folder).collect()} == {f"{a}:{b}": ends[a] + ends[b] - 2 for a, b in across}
    # Pairs by id of the source: the best score, then the smallest target.
    score, used, pairs = {(r.source_id, r.target_id): r.score for r in edges.collect()}, set(), set()
    for a in sorted({k[0] for k in want}):
        free = [k for k in want if k[0] == a and not used & set(k)]
        if free:
            best = min(free, key=lambda k: (-score[k], k[1]))
            pairs.add(best)
            used |= set(best)
    assert {(r.source_id, r.target_id) for r in core.QUERIES["graph_pairs"](spark, folder).collect()} == pairs


def test_lineage_takes_a_second_hop(spark, folder):
    i, p = core.both(spark, folder)
    records = i.unionByName(p).unionByName(core.settlements(p))
    score = {(r.source_id, r.target_id): float(r.score) for r in core.G.candidate_edges(records).collect() if r.source_type != r.target_type}
    want = {">".join(k): (2, v) for k, v in score.items()}
    want |= {f"{a}>{b}>{c}": (3, round(v * w, 6)) for (a, b), v in score.items() for (x, c), w in score.items() if x == b and v * w >= 0.5 - 1e-12}
    got = {r.path: (r.n_nodes, r.confidence) for r in core.QUERIES["lineage_paths"](spark, folder).collect()}
    assert got == want and any(n == 3 for n, _ in got.values())


def test_graph_finds_split_and_late_orders(spark, folder):
    got = core.QUERIES["reconcile_graph"](spark, folder).collect()
    ids = Counter(k for r in got for k in r.ids)
    i, p = core.both(spark, folder)
    assert ids == Counter(r.record_id for r in i.unionByName(p).collect())
    party = {r.record_id: r.party for r in i.unionByName(p).collect()}
    found = {r.anchor_id: r.members for r in core.QUERIES["graph_allocations"](spark, folder).collect()}
    assert all(len({party[k] for k in (a, *m)}) == 1 for a, m in found.items())
    assert {f"I{k:09}": [f"P{k:09}-0", f"P{k:09}-1"] for k in range(5, 60, 10)}.items() <= found.items()


@pytest.mark.parametrize(("name", "whole", "parts"), [("alloc_one_to_many", 0, 1), ("alloc_many_to_one", 1, 0)])
def test_allocations_of_up_to_four(spark, tmp_path, name, whole, parts):
    rows = [(k, 4, Decimal(a), date(2024, 1, k + 1)) for k, a in enumerate((1, 20, 300, 4000, 4321, 70000, 80001))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice decimal(20,2), o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    sides = [df.collect() for df in core.both(spark, str(tmp_path))]
    used, want = set(), set()
    for a in sorted(sides[whole], key=lambda r: r.record_id):
        free = sorted((r for r in sides[parts] if (r.currency, r.party) == (a.currency, a.party) and r.record_id not in used), key=lambda r: r.record_id)
        group = next((g for n in (2, 3, 4) for g in itertools.combinations(free, n) if sum(r.amount for r in g) == a.amount), None)
        if group:
            used |= {r.record_id for r in group}
            want.add((a.record_id, ",".join(r.record_id for r in group)))
    if whole:  # the registered query has payments made of two invoices each; here they are the payments themselves
        i, p = core.both(spark, str(tmp_path))
        got = {(r.anchor_id, ",".join(r.members)) for r in core.M.allocate(p, i, ("currency", "party")).collect()}
    else:
        got = {(r.anchor_id, r.members) for r in core.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == want
    assert any(m.count(",") == 3 for _, m in want) or whole


FIELDS = "record_id string, record_type string, external_id string, amount decimal(20,4), currency string, record_date date, reference string, party string, fee_amount decimal(20,4)"


def test_edges_score_amount_and_date(spark):
    day = date(2024, 1, 1)
    row = lambda i, kind, amount, days: (i, kind, None, Decimal(amount), "EUR", day + timedelta(days), "r", None, Decimal(0))
    records = spark.createDataFrame([row("i", "invoice", 100, 0), row("p", "payment", 100, 0), row("q", "payment", 100, 2), row("r", "payment", 105, 0), row("s", "payment", 200, 0)], FIELDS)
    got = {(r.source_id, r.target_id): str(r.score) for r in core.G.candidate_edges(records, only_across=True).collect()}
    assert got == {("i", "p"): "0.95", ("i", "q"): "0.90", ("i", "r"): "0.80", ("i", "s"): "0.50"}
    batch = core.G.candidate_batch(records.where("record_type = 'invoice'"), records.where("record_type = 'payment'"))
    assert [r.target_id for r in core.C.review_mask(batch).where("review").collect()] == ["p"]


def brute_allocations(records, largest=4):
    """The scan of the reference: all out-edge groups, then all in-edge groups, exact or short of the fees."""
    edges, used, out = brute_edges(records), set(), set()
    for way in (0, 1):
        for a in sorted(records, key=lambda r: (STAGES[r.record_type], r.record_id)):
            if a.record_id in used:
                continue
            free = sorted((k[1 - way] for i, k in edges.items() if i[way] == a.record_id and i[1 - way] not in used), key=lambda r: r.record_id)
            for group in itertools.chain.from_iterable(itertools.combinations(free, n) for n in range(2, largest + 1)):
                total, fee = sum(r.amount for r in group), sum(abs(r.fee_amount) for r in (a, *group))
                short = total - a.amount if way else a.amount - total
                if len({r.record_type for r in group}) == 1 and (short == 0 or short == fee > 0):
                    out.add((a.record_id, *(r.record_id for r in group), "0.88" if short == 0 else "0.82"))
                    used |= {a.record_id, *(r.record_id for r in group)}
                    break
    return out


def test_allocations_with_fees_follow_the_scan(spark):
    rng, rows = random.Random(8), []
    for k in range(120):
        kind = rng.choice(["invoice", "payment", "settlement"])
        rows.append((f"{kind[0]}{k:03}", kind, None, Decimal(rng.randrange(1, 40)), rng.choice(["EUR", "USD"]), date(2024, 1, 1) + timedelta(rng.randrange(90)), None, None, Decimal(rng.choice([0, 0, 1, -2, 30]))))
    # An invoice without a fee paid by two payments with fees; two invoices with fees paid by one payment.
    far = date(2025, 1, 1)
    rows += [("i900", "invoice", None, Decimal(100), "EUR", far, None, None, Decimal(0)), *((f"p90{k}", "payment", None, Decimal(48), "EUR", far, None, None, Decimal(2)) for k in (1, 2))]
    far = date(2025, 6, 1)
    rows += [("p910", "payment", None, Decimal(96), "EUR", far, None, None, Decimal(0)), *((f"i91{k}", "invoice", None, Decimal(50), "EUR", far, None, None, Decimal(2)) for k in (1, 2))]
    records = spark.createDataFrame(rows, FIELDS)
    want = brute_allocations(records.collect())
    got = {(r.anchor_id, *r.members, str(r.confidence)) for r in core.G.graph_allocations(records, core.G.candidate_edges(records)).collect()}
    assert got == want and {("i900", "p901", "p902", "0.82"), ("p910", "i911", "i912", "0.82")} <= got


def test_review_suggestions_follow_the_scan(spark, folder):
    i, p = core.both(spark, folder)
    records = {r.record_id: r for r in i.unionByName(p).collect()}
    edges = {k: v for k, v in brute_edges(list(records.values())).items() if k[0][0] != k[1][0]}

    def score(a, b):
        return (0.95 if a.record_date == b.record_date else 0.9) if a.amount == b.amount else 0.8 if abs(a.amount - b.amount) <= 10 else 0.5

    flagged, want = set(), {}
    for way in (0, 1):
        for own in {k[way] for k in edges}:
            group = [k for k in edges if k[way] == own]
            for some in itertools.chain(itertools.combinations(group, 2), itertools.combinations(group, 3)):
                if sum(records[k[1 - way]].amount for k in some) == records[own].amount:
                    flagged |= set(some)
    for k, (a, b) in edges.items():
        rivals = [r for r in edges if r != k and (r[0] == k[0] or r[1] == k[1])]
        # Rivals of two known parties compete with nothing.
        best = max((score(*edges[r]) for r in rivals if edges[r][0].party == edges[r][1].party), default=0)
        if k in flagged:
            outcome = "UNSUPPORTED_ALLOCATION"
        elif a.amount != b.amount:
            outcome = "UNSUPPORTED_PARTIAL_PAYMENT"
        elif not rivals:
            outcome = "INSUFFICIENT_CANDIDATE_SET"
        elif a.party != b.party:
            outcome = "PARTY_CONFLICT"
        else:
            outcome = "PENDING_REVIEW" if score(a, b) - best >= 0.05 - 1e-9 else "AMBIGUOUS_RECORD_MATCH"
        want[":".join(k)] = (len(rivals), outcome)
    want |= {f"{r.record_type}:{k}": (0, "NO_CANDIDATES") for k, r in records.items() if not any(k in e for e in edges)}
    rows = core.QUERIES["review_suggestions"](spark, folder).collect()
    got = {r.candidate_id: (r.rivals, r.outcome) for r in rows}
    assert got == want and len(rows) == len(want)
    assert {"UNSUPPORTED_ALLOCATION", "UNSUPPORTED_PARTIAL_PAYMENT", "NO_CANDIDATES", "PENDING_REVIEW"} <= {o for _, o in got.values()}


def test_all_lines_are_used(spark, tmp_path):
    lines = [(1, n, 5.0 + n, 7, "R", Decimal(a)) for n, a in ((1, 10), (2, 4), (3, 5), (4, 11))]
    lines += [(9, 1, 1.0, 7, "A", Decimal(3)), (9, 2, 2.0, 50, "N", Decimal(3)), (2, 1, 1.0, 7, "A", Decimal(3)), (2, 2, 2.0, 7, "N", Decimal(3)), (2, 2, 3.0, 7, "N", Decimal(1))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_suppkey long, l_returnflag string, l_extendedprice decimal(20,2)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in (1, 2, 3, 9)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.journal_id: r.balanced for r in core.QUERIES["journal_balance"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: False, 3: False, 9: True, -2: False, -3: False, -4: False, -10: False}
    rows = Counter((r.doc_id, r.row_number, r.n_fields) for r in core.QUERIES["cells_to_rows"](spark, str(tmp_path)).collect())
    assert rows == Counter([(1, 2003, 2), (1, 2004, 2), (1, 2005, 2), (2, 3003, 2), (2, 3004, 2), (9, 1003, 2)])


def test_every_line_of_the_given_table_is_a_row(spark):
    folder = "/root/testdata/sf0.001"
    lines = core.tab(spark, folder, "lineitem")
    assert core.QUERIES["cells_to_rows"](spark, folder).count() == lines.count() - lines.select("l_orderkey").distinct().count()


def test_features_have_the_text_similarity(spark, folder):
    assert list(core.L.FEATURES) == core.TRAINED
    text = {r.record_id: (r.reference or "").lower().strip() for df in core.both(spark, folder) for r in df.collect()}
    rows = core.QUERIES["features"](spark, folder).collect()
    assert any(r.text_similarity == 1 for r in rows) and set(core.L.FEATURES) <= set(rows[0].asDict())
    for r in rows:
        a, b = text[r.s_record_id], text[r.t_record_id]
        assert (r.text_similarity == 1) == (a == b != "") and (r.text_similarity > 0) == (a != "" and b != "")
