"""Reading layer files: ranges of records, rings, lines of several parts, sections."""

import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadframe.functions import geometry as G
from roadframe.sources import lines, ranges, records, shapefile, writer
from roadframe.specs import V2023

from test_units import COORDS, _dbf, _poly, _shp, line  # noqa: I001

PARTS = f"array<{COORDS}>"


def ring(x, y, w, h=None, clockwise=True):
    h = w if h is None else h
    points = [(x, y), (x, y + h), (x + w, y + h), (x + w, y), (x, y)]
    return points if clockwise else points[::-1]


def index(shp):
    """The index of a main file."""
    offsets, lengths = records.walked(shp)
    return b"\0" * 100 + b"".join(struct.pack(">2i", o // 2, n // 2) for o, n in zip(offsets.tolist(), lengths.tolist(), strict=True))


# --- rings


CASES = {
    "one": ([ring(0, 0, 9)], 1, 0, 0),
    "hole": ([ring(0, 0, 9), ring(2, 2, 3, clockwise=False)], 1, 1, 0),
    "hole first": ([ring(2, 2, 3), ring(0, 0, 9)], 1, 1, 0),
    "same direction": ([ring(0, 0, 9), ring(2, 2, 3)], 1, 1, 0),
    "two holes": ([ring(0, 0, 9), ring(1, 1, 2), ring(5, 5, 2)], 1, 2, 0),
    "apart": ([ring(0, 0, 9), ring(20, 0, 3)], 2, 0, 0),
    "island": ([ring(0, 0, 9), ring(1, 1, 6), ring(2, 2, 3)], 2, 1, 0),
    "bad hole": ([ring(0, 0, 9), [(2, 2), (3, 2), (2, 2)]], 1, 0, 1),
    "touching hole": ([ring(0, 0, 9), [(0, 4), (3, 5), (3, 3), (0, 4)]], 1, 1, 0),
}


def test_rings(spark):
    rows = spark.createDataFrame([(k, [line(*r) for r in v[0]]) for k, v in CASES.items()] + [("none", None), ("empty", [])], f"id string, parts {PARTS}")
    got = {r["id"]: r["p"] for r in rows.select("id", G.polygon(F.col("parts")).alias("p")).collect()}
    for k, (parts, n_outer, n_holes, n_bad) in CASES.items():
        p = got[k]
        assert (p["n_outer"], len(p["holes"]), p["n_bad"]) == (n_outer, n_holes, n_bad), k
        assert [(q["x"], q["y"]) for q in p["outer"]] == max(parts, key=lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))))
    assert got["none"] is None and got["empty"]["n_outer"] == 0


def test_polygons_of_a_delivery(spark, tmp_path):
    folder = tmp_path / "HD"
    folder.mkdir()
    (folder / "A3_DRIVEWAYSECTION.shp").write_bytes(_shp([_poly(5, v[0]) for v in CASES.values()]))
    (folder / "A3_DRIVEWAYSECTION.dbf").write_bytes(_dbf(["ID", "Kind", "RoadType"], [[k.encode(), b"1", b"1"] for k in CASES]))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    layers, found = shapefile.load_layers(spark, str(tmp_path), "HD")[1:]
    rows = {r["id"]: r for r in layers["A3_DRIVEWAYSECTION"].collect()}
    assert set(rows) == {k for k, v in CASES.items() if v[1] == 1}
    assert {k: len(r["holes"]) for k, r in rows.items()} == {k: CASES[k][2] for k in rows} and rows["hole first"]["coords"][1]["y"] == 9
    told = [(r["code"], r["reason"]) for r in found.filter("code LIKE 'geometry-%'").collect()]
    order = list(CASES)
    assert sorted(told) == sorted([("geometry-invalid", f"several polygons row {order.index(k)}") for k in ("apart", "island")] + [("geometry-hole-invalid", f"row {order.index('bad hole')}")])
    assert "holes" not in layers["A2_LINK"].columns and dict(layers["A5_PARKINGLOT"].dtypes)["holes"] == dict(layers["A3_DRIVEWAYSECTION"].dtypes)["holes"]


# --- lines of several parts


def plain_line(parts, tolerance):
    """Walk from end to end, trying equal ends before near ones."""
    parts = [p for p in parts if p]
    if len(parts) < 2:
        return parts[0] if parts else None
    for t in (0.0, tolerance):
        ends = [(p, s) for p in range(len(parts)) for s in (0, -1)]
        near = {e: [f for f in ends if f != e and math.dist(parts[e[0]][e[1]][:2], parts[f[0]][f[1]][:2]) <= t] for e in ends}
        if any(len(v) > 1 for v in near.values()):
            continue
        free = [e for e in ends if not near[e]]
        if len(free) not in (0, 2):
            continue
        at, out, used = (free or ends)[0], [], set()
        while at is not None and at[0] not in used:
            used.add(at[0])
            own = parts[at[0]] if at[1] == 0 else parts[at[0]][::-1]
            out += own[bool(out) :]
            leave = (at[0], -1 - at[1])
            at = near[leave][0] if near[leave] else None
        if len(used) == len(parts):
            return out
    return None


def test_joined_lines(spark):
    rng = random.Random(3)
    cases = [None, [], [[]], [line((0, 0), (1, 1))], [line((0, 0), (1, 1)), []]]
    for _ in range(400):
        n = rng.randint(2, 12)
        if rng.random() < 0.1:
            n = 300
        path = [(float(rng.randint(0, 9)) if n < 20 else float(i), float(i % 7), float(i)) for i in range(n * 2 + 1)]
        if rng.random() < 0.3:
            path[-1] = path[0]
        parts = [path[2 * i : 2 * i + 3] for i in range(n)]
        if rng.random() < 0.5:
            parts = [[(x + rng.uniform(-0.06, 0.06), y, z) for x, y, z in p] for p in parts]
        if rng.random() < 0.2:
            parts.insert(rng.randint(0, n), line((50, 50), (51, 51)))
        if rng.random() < 0.1:
            parts.append(line((70, 70), (71, 71), (70, 70)))
        if rng.random() < 0.1:
            parts.append(line(path[2], (99, 99)))
        rng.shuffle(parts)
        cases.append([p if rng.random() < 0.5 else p[::-1] for p in parts])
    column = pa.array([None if c is None else [[dict(zip("xyz", q, strict=True)) for q in p] for p in c] for c in cases], records.PARTS)
    want = [None if c is None else plain_line(c, 0.1) for c in cases]
    assert sum(w is not None for w in want) > 100 and sum(w is None for w in want) > 50
    for a, b in ((0, len(cases)), (3, 77)):
        got = lines.joined(column.slice(a, b - a), 0.1).to_pylist()
        assert [None if g is None else [tuple(q[c] for c in "xyz") for q in g] for g in got] == want[a:b]
    many = [line((i, 0), (i + 1, 0)) for i in range(20_000)]
    rng.shuffle(many)
    got = lines.joined(pa.array([[[dict(zip("xyz", q, strict=True)) for q in p] for p in many]], records.PARTS), 0.1).to_pylist()
    assert sorted({got[0][0]["x"], got[0][-1]["x"]}) == [0, 20_000] and len(got[0]) == 20_001


# --- ranges


def delivery(folder, n=900, sidecars=("shx", "dbf")):
    """Points, lines with and without heights, and shapes that are missing or damaged, in one layer of points and one of lines."""
    rng = random.Random(9)
    shapes = []
    for i in range(n):
        kind = rng.choice(["line", "line", "parts", "z", "none", "damaged"])
        points = [(i + rng.random(), rng.random()) for _ in range(rng.randint(2, 9))]
        if kind == "line":
            shapes.append(_poly(3, [points]))
        elif kind == "parts":
            shapes.append(_poly(3, [points, [points[-1], (0.5, 0.5)]]))
        elif kind == "z":
            code, content = _poly(3, [points])
            shapes.append((13, content + struct.pack("<2d", 0, 0) + struct.pack(f"<{len(points)}d", *range(len(points)))))
        elif kind == "none":
            shapes.append((0, b""))
        else:
            shapes.append((3, _poly(3, [points])[1][:38] + struct.pack("<i", 10**6)))
    shp = _shp(shapes)
    folder.mkdir(parents=True)
    (folder / "A2_LINK.shp").write_bytes(shp)
    if "shx" in sidecars:
        (folder / "A2_LINK.SHX").write_bytes(index(shp))
    if "dbf" in sidecars:
        dbf = bytearray(_dbf(["ID", "LaneNo"], [[f"L{i}".encode(), "서울".encode("cp949") if i == n - 1 else str(i % 5).encode()] for i in range(n)]))
        for i in range(0, n, 10):
            dbf[97 + i * 41] = ord("*")
        (folder / "A2_LINK.dbf").write_bytes(bytes(dbf))
    return shapes


def read(spark, folder, range_bytes=ranges.RANGE_BYTES):
    files = shapefile.coordinate_files(shapefile.listing(spark, str(folder)), "HD")
    raw = shapefile.read_raw(spark, shapefile.discover(files, V2023)[0], range_bytes=range_bytes)
    return raw.rdd.getNumPartitions(), sorted(raw.collect(), key=lambda r: r["ord"])


def test_ranges_of_records(spark, tmp_path, monkeypatch):
    shapes = delivery(tmp_path / "a" / "HD")
    n, rows = read(spark, tmp_path / "a", 4096)
    assert n > 8
    assert [r["source_row"] for r in rows] == [i for i in range(900) if i % 10]
    for r in rows:
        code, content = shapes[r["source_row"]]
        good = code and len(content) != 42
        assert r["geom_kind"] == ("line" if good else None)
        if good:
            n_parts, n_points = struct.unpack_from("<2i", content, 32)
            points = np.frombuffer(content, "<f8", 2 * n_points, 40 + 4 * n_parts).reshape(-1, 2)
            assert [(p["x"], p["y"]) for part in r["parts"] for p in part] == [tuple(p) for p in points.tolist()] and len(r["parts"]) == n_parts
            assert [p["z"] for part in r["parts"] for p in part] == ([float(k) for k in range(n_points)] if code == 13 else [0.0] * n_points)
        assert r["attributes"]["ID"] == f"L{r['source_row']}"
    # one cell far off decides the encoding of all ranges
    assert rows[-1]["attributes"]["LaneNo"] == "서울"
    assert read(spark, tmp_path / "a")[1] == rows
    delivery(tmp_path / "b" / "HD", sidecars=("dbf",))
    bare = [r.asDict(True) | {"source_path": ""} for r in read(spark, tmp_path / "b", 4096)[1]]
    assert bare == [r.asDict(True) | {"source_path": ""} for r in rows]
    delivery(tmp_path / "c" / "HD", sidecars=("shx",))
    assert [(r["geom_kind"], r["attributes"]) for r in read(spark, tmp_path / "c", 4096)[1]][1:3] == [("line" if s[0] and len(s[1]) != 42 else None, {}) for s in shapes[1:3]]
    # a store that Python does not reach
    monkeypatch.setattr(ranges, "in_reach", lambda path: False)
    assert read(spark, tmp_path / "a")[1] == rows


@pytest.mark.parametrize(("found", "declared", "want"), [((True, False, 3, 0), None, "utf-8"), ((True, True, 3, 0), "UTF-8", "cp949"), ((False, False, 4, 2), "utf-8", "utf-8-replace"), ((False, False, 4, 3), "65001", "cp949"), ((False, False, 4, 1), None, "cp949"), ((False, False, 0, 0), "UTF8", "cp949")])
def test_encodings(found, declared, want):
    assert records.encoding_of(*found, declared, 0.5) == want


def test_layers_that_a_section_lacks(spark):
    names = [x.name for x in V2023.layers]
    required = {x.name for x in V2023.layers if x.required}
    found = spark.createDataFrame([("S1", n) for n in names if n != "A1_NODE"] + [(None, "A2_LINK"), (None, "A2_LINK")], "section string, layer string")
    rows = shapefile.placeholders(found, V2023).collect()
    assert sorted((r["section"] or "", r["layer"], r["level"]) for r in rows) == sorted([("S1", "A1_NODE", "error"), *(("", n, "error" if n in required else "info") for n in names if n != "A2_LINK")])
    assert {r["id"] for r in rows} == {"-"} and "Missing required layer file: A1_NODE.shp" in {r["reason"] for r in rows}
    assert shapefile.placeholders(found.limit(0), V2023).count() == 0


def test_layer_written_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """A task holds the rows of one file, not all of its own."""
    monkeypatch.setattr(writer, "FILE_ROWS", 20)
    monkeypatch.setattr(ranges, "BATCH_ROWS", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        point = F.array(F.array(G.point(F.col("id") * 1.0, F.lit(0.0))))
        rows = spark.range(0, 90, 1, 1).select(F.concat(F.lit("서"), "id").alias("ID"), F.lit("7").alias("NodeType"), point.alias("parts"))
        assert writer.write_layer(rows, "A1_NODE", "point", str(tmp_path), "HD") == 90
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [len(records.walked(f.read_bytes())[0]) for f in sorted(tmp_path.glob("*/HD/A1_NODE.shp"))] == [20, 20, 20, 20, 10]
    layers = shapefile.load_layers(spark, str(tmp_path), "HD")[1]
    got = layers["A1_NODE"].select("id", F.col("coords")[0]["x"].alias("x")).collect()
    assert sorted((r["id"], r["x"]) for r in got) == sorted((f"서{i}", float(i)) for i in range(90))
