"""Hand-made cases of single operators."""

import struct

import pytest
from pyspark.sql import functions as F

from roadframe.config import DEFAULT_MODES, WARN_ONLY, Config
from roadframe.functions import geometry as G
from roadframe.functions import text as X
from roadframe.operators import components, conform, integrity, merge, segment, spatial, topology
from roadframe.operators.components import connected_components, numbered
from roadframe.operators.integrity import Edge
from roadframe.schema import snake_case
from roadframe.sources import shapefile
from roadframe.specs import SCHEMAS, V2023

COORDS = "array<struct<x:double,y:double,z:double>>"


def line(*points):
    return [(float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 else 0.0) for p in points]


def one(df):
    return df.collect()[0]


def test_schemas_and_names():
    assert [len(s.layers) for s in SCHEMAS] == [14, 14]
    assert snake_case("FromNodeID") == "from_node_id" and snake_case("ID") == "id" and snake_case("R_LinkID") == "r_link_id"
    assert V2023.role("link").name == "A2_LINK"
    with pytest.raises(ValueError):
        V2023.role("none")


def test_config_rejects_bad_modes():
    assert len(DEFAULT_MODES) == 32 and len(WARN_ONLY) == 21
    for bad in ({"nope": "warn"}, {"layer_unknown": "repair"}, {"link_too_short": "maybe"}):
        with pytest.raises(ValueError):
            Config(modes=bad)


def test_field_rules(spark):
    layer = V2023.by_name["A2_LINK"]
    rows = spark.createDataFrame([("a", "A2009", "2.0", "x"), ("b", "A2003", "2.5", ""), ("c", "003", "", "1")], "id string, hist_type string, lane_no string, link_type string")
    got = {(r["feature_id"], r["code"], r["reason"]) for r in conform.check_fields(rows, layer).collect()}
    assert ("a", "manual-hist-type-invalid", "HistType") in got and ("c", "manual-hist-type-invalid", "HistType") in got
    assert ("b", "manual-hist-type-invalid", "HistType") not in got
    assert ("b", "manual-field-type-invalid", "LaneNo") in got and ("a", "manual-field-type-invalid", "LaneNo") not in got
    assert ("b", "manual-field-required-missing", "LinkType") in got and ("a", "manual-field-code-invalid", "LinkType") in got


def test_typed_defaults_and_column_plan(spark):
    layer = V2023.by_name["A2_LINK"]
    rows = spark.createDataFrame([(1, " L1 ", "2.0", "", "abc"), (2, "L2", "2.5", "N1", "1.5")], "ord long, id string, laneno string, ToNodeId string, Length string")
    out = {r["id"]: r for r in conform.typed(rows, layer).collect()}
    assert out["L1"]["lane_no"] == 2 and out["L2"]["lane_no"] == -1
    assert out["L1"]["to_node_id"] is None and out["L2"]["to_node_id"] == "N1"
    assert out["L1"]["length"] != out["L1"]["length"] and out["L2"]["length"] == 1.5
    plan, found = conform.column_plan(["id", "ID", "laneno"], layer)
    assert ("dbf-column-case-duplicate", "ID,id") in found and plan["LaneNo"] == "laneno"


def test_mojibake(spark):
    broken = "서울".encode("cp949").decode("latin-1")
    rows = spark.createDataFrame([(broken,), ("café",), ("plain",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.repaired(F.col("t"))).collect()] == ["서울", "café", "plain", None]


def test_duplicates_modes(spark):
    rows = spark.createDataFrame([("A", 1, "x"), ("A", 2, "x"), ("A", 3, "y"), ("", 4, "z")], "id string, ord long, v string")
    kept, found = merge.merge_layer(rows, "L")
    assert [(r["id"], r["ord"]) for r in kept.collect()] == [("A", 1)]
    assert sorted(r["code"] for r in found.collect()) == ["feature-id-duplicate-conflicting-dropped", "feature-id-duplicate-identical", "feature-id-missing"]
    kept, found = merge.merge_layer(rows, "L", config=Config(modes={"feature_id_duplicate_conflicting": "off"}))
    assert kept.count() == 1 and "feature-id-duplicate-conflicting-dropped" not in {r["code"] for r in found.collect()}


def test_cascade_and_clear(spark):
    layers = {
        "node": spark.createDataFrame([("N1",), ("N2",)], "id string"),
        "link": spark.createDataFrame([("A", "N1"), ("B", "N2")], "id string, node string"),
        "sign": spark.createDataFrame([("S", "A")], "id string, link string"),
        "post": spark.createDataFrame([("P",)], "id string"),
        "light": spark.createDataFrame([("T", "P", "B")], "id string, post string, link string"),
    }
    edges = [Edge("link", "node", ("node",), True), Edge("sign", "link", ("link",), True), Edge("light", "link", ("link",), True), Edge("light", "post", ("post",))]
    seeds = spark.createDataFrame([("node", "N1"), ("post", "P")], "layer string, id string")
    out, found = integrity.remove_cascade(layers, edges, seeds, "gone")
    assert [r["id"] for r in out["link"].collect()] == ["B"] and out["sign"].count() == 0
    assert one(out["light"])["post"] is None and out["light"].count() == 1
    assert {r["code"] for r in found.collect()} == {"gone", "required-reference-dependent-removed", "optional-dependent-reference-cleared"}


def test_multi_target_survivor(spark):
    layers = {"a": spark.createDataFrame([("X",)], "id string"), "b": spark.createDataFrame([("X",)], "id string"), "c": spark.createDataFrame([("C", "X")], "id string, ref string")}
    edges = [Edge("c", "ref", ("a", "b"), True)]
    assert {r["target"] for r in integrity.resolved(layers, edges, "any").collect()} == {"a", "b"}
    assert integrity.resolved(layers, edges, "one").count() == 0
    assert one(integrity.resolved(layers, edges, "first"))["target"] == "a"
    found = integrity.resolved(layers, edges, "any")
    assert one(integrity.dependants_of(found, "b", "X"))["ids"] == ["C"]
    gone = integrity.cascade(layers, edges, spark.createDataFrame([("a", "X")], "layer string, id string"))
    assert {r["layer"] for r in gone.collect()} == {"a"}
    gone = integrity.cascade(layers, edges, spark.createDataFrame([("a", "X"), ("b", "X")], "layer string, id string"))
    assert {r["layer"] for r in gone.collect()} == {"a", "b", "c"}


def test_tangent_and_area(spark):
    rows = spark.createDataFrame([(line((0, 0), (0.4, 0), (0.4, 10)),), (line((0, 0), (0, 0)),), (line((0, 0), (2, 0), (2, 2), (0, 2)),)], f"coords {COORDS}")
    got = rows.select(G.tangent(F.col("coords"), "from", 1.0).alias("t"), G.area(F.col("coords")).alias("a")).collect()
    norm = (0.4**2 + 0.6**2) ** 0.5
    assert got[0]["t"]["x"] == pytest.approx(0.4 / norm) and got[0]["t"]["y"] == pytest.approx(0.6 / norm)
    assert got[1]["t"] is None and got[2]["a"] == 4.0


@pytest.mark.parametrize("dz,hit", [(6.0, False), (0.9, True), (1.0, True)])
def test_crossing_height(spark, dz, hit):
    a = spark.createDataFrame([(1, line((0, 0), (10, 0)))], f"id long, coords {COORDS}")
    b = spark.createDataFrame([(2, line((5, -5, dz), (5, 5, dz)))], f"id long, coords {COORDS}")
    assert (spatial.crossing_pairs(a, b, 1.0).count() == 1) is hit
    touching = spark.createDataFrame([(3, line((10, 0), (20, 7))), (4, line((5, 0), (30, 0)))], f"id long, coords {COORDS}")
    assert spatial.crossing_pairs(a, touching, 1.0).count() == 2


def test_components_and_numbers(spark):
    items = spark.createDataFrame([(5, 0), (1, 1), (9, 2), (7, 3)], "i long, o long")
    pairs = spark.createDataFrame([(1, 7), (7, 42), (9, 9)], "a long, b long")
    assert {r["i"]: r["component"] for r in connected_components(items, pairs, "i", "o").collect()} == {5: 0, 1: 1, 7: 1, 9: 2}
    assert sorted(r["n"] for r in numbered(spark.range(57), "id", "n").collect()) == list(range(57))
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(spark.range(301).withColumn("o", F.col("id")), chain, "id", "o").select("component").distinct().count() == 1


@pytest.mark.parametrize("task_edges", [1, 40, 500_000])
def test_forest_in_few_and_many_tasks(spark, monkeypatch, task_edges):
    import random

    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    pairs += [(5, 5), *pairs[:5]]
    least = {}
    for x in sorted({v for p in pairs for v in p}):
        least.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    want = {k: v for k, v in least.items() if k != v}
    if task_edges == 1:
        pairs = pairs[:12] + pairs[30:36]
        want = {k: 0 for k in range(1, 13)} | {k: 100 for k in range(101, 107)}
    got = components.star_forest(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    named = components.star_forest(spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in pairs], "a string, b string")).collect()
    assert {r["node"]: r["component"] for r in named} == {f"n{k:03}": f"n{v:03}" for k, v in want.items()}


def test_orientation_tie_is_skipped(spark):
    c = line((0, 0), (1, 0))
    links = spark.createDataFrame([(1, 1, 10, 11, 2, None, c), (2, 2, 12, 13, None, 1, c), (3, 3, 11, 14, None, None, c), (4, 4, 15, 12, None, None, c)], f"id long, ord long, from_id long, to_id long, r_id long, l_id long, coords {COORDS}")
    nodes = spark.createDataFrame([(i, 0.0, 0.0, None) for i in range(10, 16)], "id long, x double, y double, group_key string")
    got = {r["id"]: r["verdict"] for r in topology.orientation(links, nodes, topology.orientation_groups(links, nodes)).collect()}
    assert got[1] == got[2] == "skipped"


def test_greedy_pairs(spark):
    rows = [(0, 1, 9, 1, 2.0), (0, 2, 9, 0, 5.0), (0, 1, 8, 1, 7.0), (1, 5, 6, 1, 1.0)]
    got = segment.greedy_pairs(spark.createDataFrame(rows, "junction long, to_grp long, from_grp long, priority int, distance double")).collect()
    assert {(r["to_grp"], r["from_grp"]) for r in got} == {(2, 9), (1, 8), (5, 6)}


def _shp(records):
    body = b""
    for i, (code, content) in enumerate(records):
        raw = struct.pack("<i", code) + content
        body += struct.pack(">2i", i + 1, len(raw) // 2) + raw
    return b"\0" * 100 + body


def _poly(code, parts):
    points = [p for part in parts for p in part]
    starts, n = [], 0
    for part in parts:
        starts.append(n)
        n += len(part)
    return code, struct.pack("<4d2i", 0, 0, 0, 0, len(parts), n) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def _dbf(names, rows, width=20):
    head = 32 + 32 * len(names) + 1
    out = struct.pack("<4BIHH20x", 3, 0, 0, 0, len(rows), head, 1 + width * len(names))
    for n in names:
        out += n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14
    return out + b"\r" + b"".join(b" " + b"".join(v.ljust(width) for v in row) for row in rows)


def test_shapefile_ingest(spark, tmp_path):
    folder = tmp_path / "SEC01" / "COORD_A"
    folder.mkdir(parents=True)
    (folder / "A1_NODE.shp").write_bytes(_shp([(1, struct.pack("<2d", 1, 2)), (1, struct.pack("<2d", 3, 4)), (0, b"")]))
    (folder / "A1_NODE.dbf").write_bytes(_dbf(["ID", "NodeType", "Extra"], [[b"N1", b"1", b"x"], [b"N2", "서울".encode("cp949"), b"y"], [b"N3", b"1", b"z"]]))
    (folder / "A2_LINK.shp").write_bytes(_shp([_poly(3, [[(1, 2), (2, 3)], [(2, 3.05), (3, 4)]]), _poly(3, [[(0, 0), (1, 1)], [(5, 5), (6, 6)]])]))
    (folder / "A2_LINK.dbf").write_bytes(_dbf(["ID", "FromNodeID", "ToNodeId", "LaneNo"], [[b"L1", b"N1", b"N2", b"1"], [b"L2", b"N1", b"N2", b"2"]]))
    (folder / "ZZ.shp").write_bytes(_shp([]))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    schema, layers, found = shapefile.load_layers(spark, str(tmp_path), "COORD_A")
    assert schema.version == "2023.07"
    nodes = {r["id"]: r for r in layers["A1_NODE"].collect()}
    assert set(nodes) == {"N1", "N2"} and nodes["N2"]["node_type"] == "서울" and nodes["N1"]["section"] == "SEC01"
    links = layers["A2_LINK"].collect()
    assert [r["id"] for r in links] == ["L1"] and len(links[0]["coords"]) == 3 and links[0]["to_node_id"] == "N2"
    codes = {r["code"] for r in found.collect()}
    assert {"unknown-layer", "missing-shp-sidecar", "missing-required-layer", "unknown-manual-column", "missing-manual-columns", "missing-geometry", "geometry-invalid"} <= codes


def test_load_map_repairs(spark, tmp_path):
    from roadframe.dataset import load_map, repair

    folder = tmp_path / "HD"
    folder.mkdir(parents=True)
    (folder / "A1_NODE.shp").write_bytes(_shp([(1, struct.pack("<2d", 0, 0)), (1, struct.pack("<2d", 10, 0)), (1, struct.pack("<2d", 20, 0)), (1, struct.pack("<2d", 99, 99))]))
    (folder / "A1_NODE.dbf").write_bytes(_dbf(["ID"], [[b"N1"], [b"N2"], [b"N3"], [b"N4"]]))
    (folder / "A2_LINK.shp").write_bytes(_shp([_poly(3, [[(0, 0), (10, 0)]]), _poly(3, [[(10, 0), (20, 0)]]), _poly(3, [[(0, 0), (0.1, 0)]]), _poly(3, [[(10, 0), (0, 0)]])]))
    (folder / "A2_LINK.dbf").write_bytes(_dbf(["ID", "FromNodeID", "ToNodeID", "L_LinkID"], [[b"L1", b"N1", b"N2", b"L2"], [b"L2", b"", b"N3", b""], [b"L3", b"N1", b"N2", b""], [b"L4", b"N2", b"N1", b""]]))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    ds, found = load_map(spark, str(tmp_path), "HD")
    links = {r["id"]: r for r in ds.layers["A2_LINK"].collect()}
    assert set(links) == {"L1", "L2", "L4"} and {links["L2"]["from_node_id"], links["L2"]["to_node_id"]} == {"N2", "N3"} and links["L1"]["l_link_id"] is None
    assert {r["id"] for r in ds.layers["A1_NODE"].collect()} == {"N1", "N2", "N3"}
    assert {r["layer"] for r in found.filter("code LIKE 'link-%'").collect()} == {"A2_LINK"}
    codes = {r["code"] for r in found.filter("kind = 'action'").collect()}
    assert {"link-too-short-removed", "link-endpoint-unresolved-assigned", "link-side-reference-longitudinal-cleared", "node-unreferenced-removed"} <= codes
    assert repair(ds)[1].filter("kind = 'action'").count() == 0


def test_raw_numbers_of_a_load(spark, tmp_path):
    folder = tmp_path / "HD"
    folder.mkdir(parents=True)
    (folder / "C2_KILOPOST.shp").write_bytes(_shp([(1, struct.pack("<2d", i, 0)) for i in range(3)]))
    (folder / "C2_KILOPOST.dbf").write_bytes(_dbf(["ID", "Distance", "Ref_Lane"], [[b"K1", b"1.5", b"2"], [b"K2", b"far", b"x1"], [b"K3", b"2", b""]]))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    bad = {("manual-field-type-invalid", "K2", "Distance row 1", "far"), ("manual-field-type-invalid", "K2", "Ref_Lane row 1", "x1")}
    for config, more in ((Config(), set()), (Config(report_required_numbers=True), {("manual-field-required-missing", "K3", "Ref_Lane row 2", "")})):
        layers, found = shapefile.load_layers(spark, str(tmp_path), "HD", config)[1:]
        got = found.filter("code IN ('manual-field-type-invalid', 'manual-field-required-missing')").collect()
        assert {(r["code"], r["feature_id"], r["reason"], next(v for k, v in r["before"].items())) for r in got} == bad | more
        assert all(r["source_path"].endswith("C2_KILOPOST.shp") for r in got) and layers["C2_KILOPOST"].count() == 3


def _odd_delivery(folder):
    """A file for an unknown layer, sidecars missing, columns unknown and missing, bad geometries, cells that are no UTF-8."""
    folder.mkdir(parents=True)
    (folder / "A1_NODE.shp").write_bytes(_shp([(1, struct.pack("<2d", 1, 2)), (1, struct.pack("<2d", 3, 4)), (0, b"")]))
    cells = [b"a\xff", b"b\xfe", "서울 서울 서울".encode()]
    (folder / "A1_NODE.dbf").write_bytes(_dbf(["ID", "id", "NodeType", "Extra"], [[b"N1", b"N1", cells[0], cells[1]], [b"N2", b"N2", cells[2], cells[2]], [b"N3", b"N3", cells[2], b"z"]]))
    (folder / "A1_NODE.cpg").write_bytes(b"UTF-8")
    (folder / "A2_LINK.shp").write_bytes(_shp([_poly(3, [[(0, 0), (1, 1)], [(5, 5), (6, 6)]]), _poly(3, [[(1, 2), (3, 4)]])]))
    (folder / "A2_LINK.dbf").write_bytes(_dbf(["ID", "FromNodeID", "ToNodeID"], [[b"L1", b"N1", b"N2"]]))
    (folder / "A3_DRIVEWAYSECTION.shp").write_bytes(_shp([_poly(5, [[(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(2, 2), (3, 2), (2, 2)]])]))
    (folder / "A3_DRIVEWAYSECTION.dbf").write_bytes(_dbf(["ID"], [[b"D1"]]))
    (folder / "ZZ.shp").write_bytes(_shp([]))


def test_modes_govern_the_ingest(spark, tmp_path):
    _odd_delivery(tmp_path / "HD")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    checks = shapefile.DISCOVERY | shapefile.RECORDS
    found = shapefile.load_layers(spark, str(tmp_path), "HD")[2].collect()
    # every bad cell of a row is told
    assert sorted(r["reason"].split()[1] for r in found if r["code"] == "text-utf8-decode-replacement") == ["Extra", "NodeType"]
    seen = {r["code"] for r in found} & set(checks)
    assert seen == set(checks)
    some = sorted(seen)[::2]
    left = shapefile.load_layers(spark, str(tmp_path), "HD", Config(modes={checks[c]: "off" for c in some}))[2]
    # codes of one check go together
    off = {checks[c] for c in some}
    assert {r["code"] for r in left.collect()} & set(checks) == {c for c in seen if checks[c] not in off}


def test_unknown_columns_are_kept_on_request(spark, tmp_path):
    _odd_delivery(tmp_path / "HD")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    layers = shapefile.load_layers(spark, str(tmp_path), "HD", keep_unknown=True)[1]
    assert {r["id"]: r["undocumented"].get("Extra") for r in layers["A1_NODE"].collect()}["N2"] == "서울 서울 서울"
    assert "undocumented" in layers["A5_PARKINGLOT"].columns and layers["A5_PARKINGLOT"].isEmpty()


def test_references_left_after_repairs_are_told(spark):
    from roadframe.dataset import MapDataset, remaining

    layers = {x.name: shapefile.empty_layer(spark, x) for x in V2023.layers}
    link = V2023.role("link").name
    layers[link] = spark.createDataFrame([{"id": "L1", "from_node_id": "gone", "to_node_id": None}], layers[link].schema)
    ds = MapDataset(V2023, layers)
    assert {(r["code"], r["feature_id"], r["reason"]) for r in remaining(ds).collect()} == {("reference-unresolved", "L1", "from_node_id"), ("reference-unresolved", "L1", "to_node_id")}
    assert remaining(ds, Config(modes={"reference_unresolved": "warn"})).isEmpty()


def test_field_checks_on_a_stream(spark, tmp_path):
    from roadframe.streaming import stream_findings

    layer, rows = V2023.by_name["A2_LINK"], [("a", "A2009", "x"), ("b", "A2003", "")]
    table = spark.createDataFrame(rows, "id string, hist_type string, link_type string")
    table.write.parquet(str(tmp_path / "in"))
    stream = stream_findings(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), layer)
    query = stream.writeStream.format("memory").queryName("stream_test").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = conform.check_fields(table, layer).select("code", "feature_id", "reason").collect()
    assert sorted(spark.table("stream_test").select("code", "feature_id", "reason").collect()) == sorted(want) and want


def test_tangent_mentions_its_line_few_times(spark):
    rows = spark.createDataFrame([(line((0, 0), (1, 0)),)], f"coords {COORDS}")
    plan = rows.select(G.tangent(F.col("coords"), "to", 1.0).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("coords#") < 20, plan.count("coords#")


def test_repeated_ids_come_once(spark):
    items = spark.createDataFrame([(1, 10), (2, 20), (2, 5), (3, 30)], "id long, ord long")
    pairs = spark.createDataFrame([(2, 3)], "a long, b long")
    assert sorted(map(tuple, connected_components(items, pairs, "id", "ord").collect())) == [(1, 1), (2, 0), (3, 0)]
    rows = [(1, None, None, 7, 8), (1, None, None, 8, 9), (2, 1, None, 9, 7)]
    links = spark.createDataFrame(rows, "id long, r_id long, l_id long, from_id long, to_id long")
    nodes = spark.createDataFrame([(7, None), (8, None), (9, None)], "id long, group_key string")
    assert sorted(map(tuple, topology.orientation_groups(links, nodes).collect())) == [(1, 1), (2, 1)]
    rings = spark.createDataFrame([(1, line((0, 0), (3, 0), (0, 3))), (1, line((10, 0), (13, 0), (10, 3)))], f"id long, ring {COORDS}")
    got = sorted((r["x"], r["y"]) for r in G.ring_point(rings, ["id", "ring"], "ring").collect())
    assert got == [pytest.approx((1.0, 1.0)), pytest.approx((11.0, 1.0))]


def test_tasks_contract_edges_in_bounded_steps(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_EDGES", 50)
    edges = spark.range(4000).selectExpr("id % 200 + 1000 AS a", "id % 200 % 7 AS b").coalesce(1)
    # 200 edges are repeated 20 times; a forest over half of the limit is sent, so that no task holds all
    forest = components._contract(edges)
    assert forest.count() < 4200 and forest.distinct().count() >= 200
    got = {r["node"]: r["component"] for r in components.star_forest(edges).collect()}
    assert got == {i + 1000: i % 7 for i in range(200)}
