"""Joins of references in tasks of bounded size: the same results when the limits are low."""

import random

import pytest
from pyspark.sql import functions as F

from roadframe.operators import integrity, topology
from roadframe.operators.integrity import Edge

EDGES = [Edge("line", "order", ("order",), True), Edge("line", "maker", ("maker", "dealer")), Edge("order", "buyer", ("buyer",), True)]


def tables(seed=3):
    rng = random.Random(seed)
    rows = {
        "buyer": [(i,) for i in range(12)],
        "maker": [(i,) for i in range(0, 12, 2)],
        "dealer": [(i,) for i in range(0, 12, 3)],
        "order": [(i, rng.choice([*range(14), None])) for i in range(60)],
        # ids repeat, with other references
        "line": [(f"{i % 170}", rng.choice(range(66)), rng.choice([*range(14), None])) for i in range(200)],
    }
    return rows


@pytest.fixture
def layers(spark):
    kinds = {"buyer": "id long", "maker": "id long", "dealer": "id long", "order": "id long, buyer long", "line": "id string, order long, maker long"}
    return {name: spark.createDataFrame(rows, kinds[name]) for name, rows in tables().items()}


@pytest.fixture(params=["sent", "dealt"])
def limits(request, monkeypatch):
    monkeypatch.setattr(integrity, "TASK_ROWS", 20)
    if request.param == "dealt":
        monkeypatch.setattr(integrity, "SENT_ROWS", 0)
    return request.param


def held(rows):
    return {name: {str(r[0]) for r in found} for name, found in rows.items()}


def test_unresolved_row_by_row(layers, limits):
    """A reference is lost by itself, also where another row of the same id has one that resolves."""
    rows, ids = tables(), held(tables())
    want = {("line", i, "order", True, str(o)) for i, o, _ in rows["line"] if str(o) not in ids["order"]}
    want |= {("line", i, "maker", False, str(m)) for i, _, m in rows["line"] if m is not None and str(m) not in ids["maker"] | ids["dealer"]}
    want |= {("order", str(i), "buyer", True, None if b is None else str(b)) for i, b in rows["order"] if b is None or str(b) not in ids["buyer"]}
    got = [tuple(r) for r in integrity.unresolved(layers, EDGES).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_tasks_of_references_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(integrity, "SENT_ROWS", 0, raising=False)
    monkeypatch.setattr(integrity, "TASK_ROWS", 50, raising=False)
    layers = {"a": spark.range(1_000).select("id"), "b": spark.range(2_000).select("id", (F.col("id") % 1_100).alias("a"))}
    lost = integrity.unresolved(layers, [Edge("b", "a", ("a",))])
    assert lost.count() == 100 and lost.rdd.getNumPartitions() >= 60


def plain_cascade(rows, gone):
    """Layer and id of all that goes, with its depth."""
    depth = 0
    while True:
        depth += 1
        new = {("order", str(i)) for i, b in rows["order"] if ("buyer", str(b)) in gone} | {("line", i) for i, o, _ in rows["line"] if ("order", str(o)) in gone and str(o) in held(rows)["order"]}
        new -= set(gone)
        if not new:
            return gone
        gone |= dict.fromkeys(new, depth)


def test_cascade_by_edges(spark, layers, limits):
    """One of the seeds is no row of its layer, so nothing that names it follows."""
    seeds = [("buyer", "3"), ("maker", "4"), ("order", "61"), ("dealer", "6"), ("maker", "6")]
    got = integrity.cascade(layers, EDGES, spark.createDataFrame(seeds, "layer string, id string"))
    assert got.count() == got.select("layer", "id").distinct().count()
    assert {(r["layer"], r["id"]): r["depth"] for r in got.collect()} == plain_cascade(tables(), dict.fromkeys(seeds, 0))


def test_cascade_keeps_references_it_does_not_need(spark):
    """A round joins only what may point at its rows: references to other layers are not written or dealt."""
    layers = {"a": spark.range(3).select("id"), "b": spark.range(9).select("id", (F.col("id") % 3).alias("a")), "c": spark.range(9).select("id", F.expr("raise_error('read')").cast("long").alias("d")), "d": spark.range(3).select("id")}
    edges = [Edge("b", "a", ("a",), True), Edge("c", "d", ("d",), True)]
    gone = integrity.cascade(layers, edges, spark.createDataFrame([("a", "1")], "layer string, id string"))
    assert {(r["layer"], r["id"]) for r in gone.collect()} == {("a", "1"), ("b", "1"), ("b", "4"), ("b", "7")}


def test_cleared_by_edges(spark, layers, limits):
    rows, ids = tables(), held(tables())
    seeds = [("buyer", "3"), ("maker", "4"), ("maker", "6"), ("dealer", "6"), ("dealer", "9"), ("maker", "13")]
    gone = plain_cascade(rows, dict.fromkeys(seeds, 0))
    names = {i: {str(m) for j, _, m in rows["line"] if i == j and m is not None} for i, _, _ in rows["line"]}
    want = set()
    for i, values in names.items():
        alive = any(v in ids[t] and (t, v) not in gone for v in values for t in ("maker", "dealer"))
        want |= {("line", i, "maker", v) for v in values if not alive and ("line", i) not in gone and any(v in ids[t] and (t, v) in gone for t in ("maker", "dealer"))}
    found = integrity.cleared(layers, EDGES, integrity.cascade(layers, EDGES, spark.createDataFrame(seeds, "layer string, id string")))
    got = [tuple(r) for r in found.collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    none = integrity.cleared(layers, EDGES, spark.createDataFrame([("buyer", "3")], "layer string, id string"))
    assert none.columns == found.columns and none.count() == 0


def test_cleared_deals_references_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(integrity, "SENT_ROWS", 0)
    monkeypatch.setattr(integrity, "TASK_ROWS", 50, raising=False)
    layers = {"a": spark.range(500).select("id"), "b": spark.range(1_000).select("id", (F.col("id") % 500).alias("a"))}
    gone = spark.range(400).select(F.lit("a").alias("layer"), F.col("id").cast("string").alias("id"))
    found = integrity.cleared(layers, [Edge("b", "a", ("a",))], gone)
    assert found.count() == 800 and found.rdd.getNumPartitions() >= 20


def test_unreferenced_nodes_meet_the_ends_once(spark):
    """The ends of links are dealt once, not once for each part of a union of nodes; repeated and null ids stay rows of their own."""
    nodes = spark.createDataFrame([(1,), (2,), (None,)], "id long").unionByName(spark.createDataFrame([(3,), (3,), (4,)], "id long")).unionByName(spark.createDataFrame([(5,)], "id long"))
    links = spark.createDataFrame([(10, 1, 9), (11, 4, None), (12, None, 4)], "id long, from_id long, to_id long")
    found = topology.unreferenced_nodes(nodes, links)
    assert sorted((r["id"] for r in found.collect()), key=str) == [2, 3, 3, 5, None]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("inline(") == 1 and "Anti" not in plan, plan


@pytest.mark.parametrize("turned", [False, True])
def test_a_repeated_target_has_its_empty_slot_filled(spark, turned):
    """Row order does not decide whether the first writer meets the empty or the filled row of a target whose id repeats."""
    rows = [(1, 1, 5, None), (5, 5, None, 7), (5, 5, None, None), (5, 5, None, 8)]
    links = spark.createDataFrame(rows[::-1] if turned else rows, "id long, ord long, r_id long, l_id long").coalesce(1)
    found = topology.reciprocal_state(links, "r_id", "l_id")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 5, "conflict"), (1, 5, "conflict"), (1, 5, "fill")]
