"""Cells of crossing segments, and components that need no rounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadframe.operators import components, segment, spatial
from roadframe.operators.components import connected_components, star_forest

from test_units import COORDS  # noqa: I001


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def touched(a, b, cell):
    """Cells that the boxes of a segment's steps touch."""
    n = min(max(math.ceil(max(abs(b[0] - a[0]), abs(b[1] - a[1])) / cell), 1), spatial.MAX_STEPS)
    at = lambda axis, i: a[axis] + (b[axis] - a[axis]) * (i / n)
    slack, found = cell * 1e-6, set()
    for i in range(n):
        ranges = [range(math.floor((min(at(k, i), at(k, i + 1)) - slack) / cell), math.floor((max(at(k, i), at(k, i + 1)) + slack) / cell) + 1) for k in (0, 1)]
        found |= {(x, y) for x in ranges[0] for y in ranges[1]}
    return found


def test_steps_give_each_cell_once_without_a_shuffle(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        reach = rng.choice([2.0, 30.0, 400.0])
        a = (rng.uniform(-100, 100), rng.uniform(-100, 100), 0.0)
        b = (a[0] + rng.uniform(-reach, reach), a[1] + rng.choice([0.0, rng.uniform(-reach, reach)]), 0.0)
        rows.append((i, [a, b]))
    rows += [(60, [(0.0, 0.0, 0.0), (100.0, 100.0, 0.0)]), (61, [(0.0, 10.0, 0.0), (30.0, 10.0, 0.0)])]
    steps = spatial._steps(spark.createDataFrame(rows, f"id long, coords {COORDS}"), "l", 10.0)
    got = [(r["l_id"], r["cx"], r["cy"]) for r in steps.collect()]
    assert len(got) == len(set(got)) > 500
    assert set(got) == {(i, x, y) for i, (a, b) in rows for x, y in touched(a, b, 10.0)}
    assert "Exchange" not in plan_of(steps)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_stars_need_no_rounds(spark, monkeypatch, kind):
    monkeypatch.setattr(components, "TASK_EDGES", 20)

    def no_round(*_):
        raise AssertionError("a round")

    monkeypatch.setattr(components, "_large_star", no_round)
    name = F.format_string("%03d", F.col("id")).cast(kind)
    pairs = spark.range(0, 400, numPartitions=5).select(name.alias("a"), F.format_string("%03d", F.col("id") % 7).cast(kind).alias("b"))
    found = {(int(r["node"]), int(r["component"])) for r in star_forest(pairs).collect()}
    assert found == {(i, i % 7) for i in range(7, 400)}


@pytest.mark.parametrize("most", [10, 1_000])
def test_names_contract_as_in_utf8_order(spark, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_EDGES", most)
    rng = random.Random(8)
    names = [f"{rng.choice(['a', 'Z', 'é', '\U0001f600', '￮', ''])}{i}" for i in range(120)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(80)]
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)), key=str.encode)
        root[y] = x
    found = {r["node"]: r["component"] for r in star_forest(spark.createDataFrame(pairs, "a string, b string").repartition(4)).collect()}
    assert found == {n: find(n) for n in names if find(n) != n}


def test_lateral_groups_take_references_as_they_stand(spark):
    rng = random.Random(6)
    rows = [(i, i, rng.choice([None, rng.randrange(90)]), rng.choice([None, rng.randrange(90)]), i % 9 != 0) for i in range(80)]
    links = spark.createDataFrame(rows, "id long, ord long, l_id long, r_id long, is_ordinary boolean")
    turned = spark.createDataFrame([(4,), (8,)], "link long")
    want = {tuple(r) for r in segment.lateral_groups(links, turned, segment.lateral_neighbours(links)).collect()}
    assert {tuple(r) for r in segment.lateral_groups(links, turned).collect()} == want and len({g for g, _, _ in want}) < len(want) - 5
    items = links.filter("is_ordinary").join(turned.withColumnRenamed("link", "id"), "id", "left_anti")
    assert {(r["component"], r["id"]) for r in connected_components(items, segment.side_pairs(links), "id", "ord", "id", "other").collect()} == {(g, i) for g, i, _ in want}
