"""Dense cells, large junctions and deep cascades: the same results when the limits are low."""

import random

import pytest
from pyspark.sql import functions as F

from roadframe.operators import integrity, segment, spatial
from roadframe.operators.integrity import Edge

from test_units import COORDS  # noqa: I001


def lines(rng, n, spread, length):
    out = []
    for _ in range(n):
        x, y = rng.uniform(-spread, spread), rng.uniform(-spread, spread)
        points = [(x, y, 0.0)]
        for _ in range(rng.randint(1, 3)):
            x, y = x + rng.uniform(-length, length), y + rng.uniform(-length, length)
            points.append((x, y, float(rng.choice([0, 0, 5]))))
        out.append(points)
    return out


def plain_crossings(a, b):
    """Pairs by exact orientation tests and heights at the meeting point, for segments in general position."""
    found = set()
    for i, p in a:
        for j, q in b:
            for (ax, ay, az), (bx, by, bz) in zip(p, p[1:], strict=False):
                for (cx, cy, cz), (dx, dy, dz) in zip(q, q[1:], strict=False):
                    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
                    if den == 0:
                        continue
                    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
                    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
                    if 0 <= t <= 1 and 0 <= u <= 1 and abs(az + (bz - az) * t - cz - (dz - cz) * u) <= 1:
                        found.add((i, j))
    return found


@pytest.mark.parametrize(("spread", "length"), [(200.0, 30.0), (12.0, 3.0), (5.0, 60.0)])
def test_dense_cells(spark, monkeypatch, spread, length):
    rng = random.Random(7)
    a = list(enumerate(lines(rng, 90, spread, length)))
    b = [(i + 1000, c) for i, c in enumerate(lines(rng, 70, spread, length))]
    left, right = (spark.createDataFrame(x, f"id long, coords {COORDS}") for x in (a, b))
    want = plain_crossings(a, b)
    assert len(want) > 10
    monkeypatch.setattr(spatial, "DENSE_PAIRS", 60)
    monkeypatch.setattr(spatial, "BLOCK_ROWS", 9)
    for splits in (0, 12):
        monkeypatch.setattr(spatial, "MAX_SPLITS", splits)
        got = [tuple(r) for r in spatial.crossing_pairs(left, right, 1.0).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    own = {tuple(r) for r in spatial.crossing_pairs(left, left, 1.0, once=True).collect()}
    assert own == {(i, j) for i, j in plain_crossings(a, a) if i < j}


def test_one_crowded_cell(spark):
    """30,000 short lines within 40 metres: cells are split until few pairs are left."""
    rng = random.Random(5)
    rows = []
    for i in range(30_000):
        x, y = rng.uniform(1, 41), rng.uniform(1, 41)
        rows.append((i, [(x, y, 0.0), (x + rng.uniform(-0.1, 0.1), y + rng.uniform(-0.1, 0.1), 0.0)]))
    df = spark.createDataFrame(rows, f"id long, coords {COORDS}").repartition(4).persist()
    left, right = spatial._dealt(df, df, 50.0)
    cells = left.groupBy("level", "cx", "cy", "bl", "br").count().withColumnRenamed("count", "l").join(right.groupBy("level", "cx", "cy", "bl", "br").count(), ["level", "cx", "cy", "bl", "br"])
    assert cells.agg(F.max(F.col("l") * F.col("count"))).first()[0] <= spatial.DENSE_PAIRS
    assert cells.agg(F.sum(F.col("l") * F.col("count"))).first()[0] < 30_000**2 / 30
    assert spatial.crossing_pairs(df, df, 1.0, once=True).count() > 100
    df.unpersist()


@pytest.mark.parametrize("limit", [0, 30, 50_000])
def test_greedy_pairs_of_large_junctions(spark, monkeypatch, limit):
    monkeypatch.setattr(segment, "TASK_CANDIDATES", limit)
    rng = random.Random(2)
    rows = [(j, t, 100 + f, rng.randint(0, 1), float(rng.randint(0, 9))) for j in range(4) for t in range(8) for f in range(8) if rng.random() < 0.2 + 0.2 * j]
    # a chain of falling distances, which takes a round for each link
    rows += [(9, i // 2, 100 + (i + 1) // 2, 0, 50.0 - i) for i in range(14)]
    want, used = set(), set()
    for j, t, f, p, d in sorted(rows, key=lambda r: (r[0], r[3], r[4], r[1], r[2])):
        if (j, "t", t) not in used and (j, "f", f) not in used:
            used |= {(j, "t", t), (j, "f", f)}
            want.add((j, t, f))
    df = spark.createDataFrame(rows, "junction long, to_grp long, from_grp long, priority int, distance double")
    got = segment.greedy_pairs(df)
    assert got.columns == df.columns and {(r["junction"], r["to_grp"], r["from_grp"]) for r in got.collect()} == want
    assert segment.greedy_pairs(df.limit(0)).count() == 0


def test_deep_cascade_without_sent_rows(spark, monkeypatch):
    """Chains of seven rows, with the newest rows of each round joined like any table."""
    monkeypatch.setattr(integrity, "SENT_ROWS", 0)
    rows = [(i, i - 1 if i % 7 else None) for i in range(1, 60)]
    layers = {"a": spark.createDataFrame(rows, "id long, up long")}
    edges = [Edge("a", "up", ("a",), True)]
    seeds = spark.createDataFrame([("a", "7"), ("a", "15")], "layer string, id string")
    gone = {int(r["id"]): r["depth"] for r in integrity.cascade(layers, edges, seeds).collect()}
    assert gone == {7 + d: d for d in range(7)} | {15 + d: d for d in range(6)}
