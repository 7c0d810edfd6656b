"""Every general query against its DuckDB twin, and the driver contract."""

import random

import duckdb
import pytest

import __spark_entry__ as contract
from factloom import queries
from factloom.operators import packing, tables
from factloom.operators.graph import trace
from factloom.operators.packing import greedy_pack, union_pack
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple("∅" if v[k] is None else str(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def walked(edges, nodes, root, most):
    """The walk of one root, by recursion."""
    after, messages, seen, entered, cut = {}, [], set(), {root}, [False]
    for a, b, _ in sorted(set(edges), key=lambda e: (e[0], e[2], e[1])):
        after.setdefault(a, []).append(b)

    def go(a):
        for b in after.get(a, []):
            if len(messages) >= most:
                cut[0] = True
                return
            key = (nodes[a][0], nodes[b][0], nodes[b][1])
            if key not in seen:
                seen.add(key)
                messages.append((*key, False))
                if b not in entered:
                    entered.add(b)
                    go(b)
                if nodes[b][2]:
                    messages.append((nodes[b][0], nodes[a][0], nodes[b][2], True))

    go(root)
    return messages, cut[0]


def test_trace_is_depth_first(spark):
    random.seed(1)
    nodes = {k: (f"c{k % 4}", f"m{k % 5}", None if k % 3 == 0 else f"r{k}") for k in range(14)}
    edges = [(random.randrange(14), random.randrange(14), random.randrange(9)) for _ in range(34)]
    e, n, r = spark.createDataFrame(edges, "a long, b long, line long"), spark.createDataFrame([(k, *v) for k, v in nodes.items()], "id long, actor string, label string, answer string"), spark.createDataFrame([(k,) for k in nodes], "root long")
    for most in (40, 7):
        messages, ends = trace(e, n, r, most)
        got = {k: [] for k in nodes}
        for m in messages.orderBy("root", "step").collect():
            got[m.root].append((m["from"], m["to"], m.label, m.back))
        truncated = {x.root: x.truncated for x in ends.collect()}
        assert {k: (got[k], truncated[k]) for k in nodes} == {k: walked(edges, nodes, k, most) for k in nodes}
    assert trace(e, n, r.where("false"))[0].count() == 0


def test_packing_of_wide_owners(spark):
    random.seed(1)
    rows, want = [(None, 1, 3)], {(None, 1): 0}
    for o, n in enumerate([3, 200, 1, 60, 500]):
        total = chunk = 0
        for k in range(n):
            w = 0 if o == 3 else random.choice([0, None, 0, 1, 2, 5, 9, 10, 11, 30])
            if k and total > 0 and total + (w or 0) > 10:
                total, chunk = w or 0, chunk + 1
            else:
                total += w or 0
            rows.append((o, k, w))
            want[o, k] = chunk
    df = spark.createDataFrame(rows, "owner long, k long, w long")
    for ranges in (7, 1):
        assert {(r.owner, r.k): r.chunk for r in greedy_pack(df, "owner", ["k"], "w", 10, ranges=ranges).collect()} == want
    assert greedy_pack(df.where("false"), "owner", ["k"], "w", 10, ranges=7).count() == 0


def test_packing_of_unions(spark):
    groups = spark.createDataFrame([("a", k, 1) for k in range(6)] + [("b", 5, 50)], "owner string, place int, weight int")
    members = spark.createDataFrame([("a", 0, "x", 4), ("a", 1, "x", 4), ("a", 2, "y", 3), ("a", 3, "z", 40), ("a", 4, "z", 40), ("a", 5, "x", 4)], "owner string, place int, member string, weight int")
    got = {(r.owner, r.place): r.chunk for r in union_pack(groups, members, "owner", 10).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 0, ("a", 3): 1, ("a", 4): 2, ("a", 5): 3, ("b", 5): 0}


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert queries.QUERIES.keys() <= contract.queries().keys()


def test_packing_of_unions_over_ranges(spark):
    random.seed(2)
    groups, members, want = [], [], {}
    for o, (n, most) in enumerate([(1, 5), (60, 9), (90, 400), (40, 30)]):
        held, total, chunk = {}, 0, 0
        for k in range(n):
            own, mine = random.choice([0, None, 1]), {random.randrange(most): random.choice([0, 1, 9, 40]) for _ in range(random.choice([0, 1, 4]))}
            add = (own or 0) + sum(w for m, w in mine.items() if m not in held)
            if k and total + add > 25:
                held, total, chunk = mine, (own or 0) + sum(mine.values()), chunk + 1
            else:
                held, total = mine | held, total + add
            groups.append((o, f"p{k:03}", own))
            members += [(o, f"p{k:03}", m, w) for m, w in mine.items()]
            want[o, f"p{k:03}"] = chunk
    g, m = spark.createDataFrame(groups, "owner int, place string, weight int"), spark.createDataFrame(members, "owner int, place string, member int, weight int")
    for ranges in (1, 9, 60):  # of all groups, of a few chunks, shorter than a chunk
        assert {(r.owner, r.place): r.chunk for r in union_pack(g, m, "owner", 25, ranges=ranges).collect()} == want


def test_packing_takes_few_rounds(spark):
    """Chunks are not found one after the other."""
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("packing"))
    g = spark.range(400).selectExpr("0 as owner", "id as place", "1 as weight")
    spark.sparkContext.setJobGroup("packing", "packing")
    chunks = union_pack(g, g.selectExpr("owner", "place", "place as member", "5 as weight"), "owner", 12, ranges=4).agg({"chunk": "max"}).first()[0]
    spark.sparkContext.setJobGroup("", "")
    assert chunks == 199 and jobs() < 150


def test_packing_of_ranges_keeps_no_pointers_of_all_items(spark, monkeypatch):
    kept = {}

    def cut(df, name, whole=packing.cut):
        out = whole(df, name)
        kept[name] = kept.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(packing, "cut", cut)
    df = spark.range(4000).selectExpr("id % 2 as owner", "id as k", "3 as w")
    assert greedy_pack(df, "owner", ["k"], "w", 10, ranges=6).agg({"chunk": "max"}).first()[0] == 666
    assert sum(n for name, n in kept.items() if name != "dealt") < 1000


def test_ranges_of_packing_do_not_grow_with_the_table(spark, monkeypatch):
    largest = []

    def cut(df, name, whole=packing.cut):
        out = whole(df, name)
        if name == "dealt":
            largest.append(out.groupBy("range__").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(packing, "cut", cut)
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    df = spark.range(6000).selectExpr("id % 2 as owner", "id as k", "3 as w")
    for ranges in (3, None):
        got = greedy_pack(df, "owner", ["k"], "w", 10, ranges=ranges)
        assert got.where("chunk != floor(floor(k / 2) / 3)").count() == 0 and got.count() == 6000
    assert max(largest) < 900


def test_parts_of_one_brand_meet_in_bounded_tasks(spark, duck, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    got = queries.QUERIES["er_within_module"](spark, DATA)
    assert got._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 3
    want = duck.sql(queries.ORACLES["er_within_module"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
