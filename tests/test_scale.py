"""Work that must not be done twice, or for rows that nobody asks for, and rounds that shrink."""

import random

from pyspark.sql import functions as F

from roadframe.operators import components, segment, spatial
from roadframe.plans import catalog, network

from test_units import COORDS  # noqa: I001

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_shrink(spark, monkeypatch):
    """A network in which paths with rising names hang together at random: each round leaves at most three quarters of the edges."""
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(3_000) if i % 50] + [(rng.randrange(3_000), rng.randrange(3_000)) for _ in range(600)]
    left, kept = [], components._small_star

    def counted(*given):
        edges = components.settled(kept(*given))
        left.append(edges.count())
        return edges

    monkeypatch.setattr(components, "TASK_EDGES", 40)
    monkeypatch.setattr(components, "_small_star", counted)
    root = list(range(3_001))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {r["node"]: r["component"] for r in components.star_forest(spark.createDataFrame(pairs, "a long, b long").repartition(6)).collect()}
    assert found == {n: find(n) for n in range(3_001) if find(n) != n}
    assert len(left) > 1 and all(b <= 0.75 * a for a, b in zip([len(pairs), *left], left, strict=False))


def test_markers_come_from_written_links(spark):
    n = network.network(spark, SF, once=True)
    assert not any("Window" in plan_of(df) for df in n.values())
    plain = network.network(spark, SF)
    for name, df in n.items():
        assert df.columns == plain[name].columns and not df.exceptAll(plain[name]).count() and df.count() == plain[name].count()


def test_repairs_are_segmented_up_to_connections(spark, monkeypatch):
    asked = []

    class Enough(Exception):
        pass

    def stop(links, nodes, markers, config=None, *_):
        asked.append(config)
        raise Enough

    monkeypatch.setattr(segment, "segment", stop)
    try:
        catalog.repair_then_segment(spark, SF)
    except Enough:
        pass
    assert asked[0] is not None and asked[0].stages[-1] == "connections"


def test_directions_of_standing_links_only(spark, monkeypatch):
    asked, whole = [], segment.end_geometry

    def seen(links, *more):
        asked.append(links.count())
        return whole(links, *more)

    monkeypatch.setattr(segment, "end_geometry", seen)
    n = catalog._classes(spark, SF)
    stages = segment.segment(n["links"], n["nodes"], n["markers"])
    standing = stages["group_references"].join(stages["connections"].select("grp"), "grp", "left_semi").count()
    assert asked == [standing] and 0 < standing < n["links"].filter(F.col("is_ordinary")).count()


def test_crossings_between_parts_only(spark, monkeypatch):
    """Links that meet at a node are one line to the search for crossings, and give the same junctions as before."""
    asked, whole = [], segment.crossing_pairs

    def seen(a, b, *more, **named):
        if named.get("once"):
            asked.append((a.count(), a.select("id").distinct().count()))
        return whole(a, b, *more, **named)

    monkeypatch.setattr(segment, "crossing_pairs", seen)
    flat = lambda *points: [(x, y, 0.0) for x, y in points]
    lines = {1: flat((0.0, 0.0), (50.0, 0.0)), 2: flat((0.0, 0.0), (0.0, 50.0)), 3: flat((20.0, -10.0), (20.0, 10.0)), 4: flat((300.0, 0.0), (350.0, 0.0))}
    nodes = {1: (10, 11), 2: (10, 12), 3: (13, 14), 4: (15, 16)}
    links = spark.createDataFrame([(i, i, *nodes[i], None, None, 1, True, False, False, False, c) for i, c in lines.items()], f"id long, ord long, from_id long, to_id long, r_id long, l_id long, lane_no long, is_junction boolean, is_ordinary boolean, is_pocket boolean, is_uturn boolean, coords {COORDS}")
    at = spark.createDataFrame([(n, n, 0.0, 0.0, 0.0, None) for n in range(10, 17)], "id long, ord long, x double, y double, z double, group_key string")
    link_ends, empty = segment.ends(links, at), links.limit(0)
    groups = segment.lateral_groups(empty, empty.select(F.col("id").alias("link")))
    found = segment.junctions(links, groups, segment.node_groups(groups, link_ends), link_ends, segment.lateral_neighbours(links))
    assert {(r["id"], r["junction"]) for r in found.collect()} == {(1, 0), (2, 0), (3, 0), (4, 1)}
    assert asked == [(4, 3)]


def test_cells_of_one_line_are_left_out(spark):
    rows = [(1, [(float(x), 10.0, 0.0), (x + 40.0, 12.0, 0.0)]) for x in range(0, 400, 10)] + [(2, [(1000.0, 0.0, 0.0), (1010.0, 0.0, 0.0)]), (3, [(1005.0, -5.0, 0.0), (1005.0, 5.0, 0.0)])]
    df = spark.createDataFrame(rows, f"id long, coords {COORDS}")
    left, _ = spatial._dealt(df, df, 50.0, once=True)
    assert {r["l_id"] for r in left.select("l_id").collect()} == {2, 3}
    assert [tuple(r) for r in spatial.crossing_pairs(df, df, 1.0, once=True).collect()] == [(2, 3)]


def test_lines_along_round_places_touch_few_cells(spark):
    """A grid of lines of 50 metres from node to node: two or three cells a line, not the eight or more on both sides of cell borders."""
    rows = [(100 * i + j, [(50.0 * i, 50.0 * j, 0.0), (50.0 * i + 25, 50.0 * j, 0.0), (50.0 * i + 50, 50.0 * j, 0.0)]) for i in range(9) for j in range(9)]
    df = spark.createDataFrame(rows, f"id long, coords {COORDS}")
    left, _ = spatial._dealt(df, df, 50.0)
    assert left.count() <= 3 * len(rows)
