"""Sections as part of keys, labels of codes, searches by index."""

import struct

import pytest
from pyspark.sql import functions as F

from roadframe.dataset import delivered, load_map, segmented
from roadframe.functions import text as X
from roadframe.operators import labels, sections
from roadframe.specs import V2023

from test_units import _dbf, _poly, _shp  # noqa: I001


def section(root, name, x, missing=False):
    """Two links in a row and one beside; the second section repeats all ids elsewhere."""
    folder = root / name / "HD"
    folder.mkdir(parents=True)
    (folder / "A1_NODE.shp").write_bytes(_shp([(1, struct.pack("<2d", x + 10 * i, 0)) for i in range(4)]))
    (folder / "A1_NODE.dbf").write_bytes(_dbf(["ID"], [[f"N{i}".encode()] for i in range(4)]))
    last = b"N9" if missing else b"N3"
    (folder / "A2_LINK.shp").write_bytes(_shp([_poly(3, [[(x + 10 * i, 0), (x + 10 * i + 10, 0)]]) for i in range(3)]))
    (folder / "A2_LINK.dbf").write_bytes(_dbf(["ID", "FromNodeID", "ToNodeID", "R_LinkID", "LinkType"], [[b"L0", b"N0", b"N1", b"", b"6"], [b"L1", b"N1", b"N2", b"", b"6"], [b"L2", b"N2", last, b"", b"6"]]))
    (folder / "C1_TRAFFICLIGHT.shp").write_bytes(_shp([(1, struct.pack("<2d", x, 5))]))
    (folder / "C1_TRAFFICLIGHT.dbf").write_bytes(_dbf(["ID", "LinkID"], [[b"T", b"L8" if missing else b"L2"]]))


def test_sections_with_equal_ids(spark, tmp_path):
    section(tmp_path, "SEC01", 0.0)
    section(tmp_path, "SEC02", 5000.0, missing=True)
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    ds, found = load_map(spark, str(tmp_path), "HD", by_section=True)
    links = {(sections.section_of, r["section"], r["id"])[1:]: r for r in delivered(ds)["A2_LINK"].collect()}
    assert set(links) == {(s, f"L{i}") for s in ("SEC01", "SEC02") for i in range(3)}
    # the lost end of one section is found among its own nodes
    assert {k: {r["from_node_id"], r["to_node_id"]} for k, r in links.items()} == {(s, f"L{i}"): {f"N{i}", f"N{i + 1}"} for s in ("SEC01", "SEC02") for i in range(3)}
    assert links["SEC02", "L0"]["coords"][0]["x"] == 5000 and links["SEC01", "L0"]["r_link_id"] is None
    # a reference into nothing removes a row of its own section only
    assert [(r["section"], r["id"], r["link_id"]) for r in delivered(ds)["C1_TRAFFICLIGHT"].collect()] == [("SEC01", "T", "L2")]
    told = {r["feature_id"] for r in found.filter("code IN ('reference-required-unresolved-removed', 'feature-id-duplicate-conflicting-dropped')").collect()}
    assert told == {f"SEC02{sections.BETWEEN}T"}
    groups = segmented(ds)["lateral_groups"].collect()
    assert len({r["grp"] for r in groups}) == 6 and {sections.BETWEEN in r["id"] for r in groups} == {True}


def test_qualified_ids(spark):
    rows = spark.createDataFrame([("S", "a"), (None, "a"), ("S", ""), ("S", None)], "section string, id string")
    full = sections.qualified(rows, ["id", "absent"])
    assert [r["id"] for r in full.collect()] == [f"S{sections.BETWEEN}a", f"{sections.BETWEEN}a", "", None]
    assert sections.local(full, ["id"]).collect() == rows.collect()
    assert [r[0] for r in full.select(sections.section_of(F.col("id"))).collect()] == ["S", None, None, None]


def test_labels(spark):
    layer = V2023.by_name["A2_LINK"]
    book = spark.createDataFrame(
        [("v", None, "RoadRank", "1", "all"), ("v", "A2_LINK", "RoadRank", "1", "own"), ("v", "A1_NODE", "RoadRank", "2", "other"), ("w", None, "RoadRank", "3", "old"), ("v", None, "LinkType", "6", "b"), ("v", None, "LinkType", "6", "a")],
        "version string, layer string, field string, code string, label string",
    )
    rows = spark.createDataFrame([("L1", "1", " 6 "), ("L2", "2", None), ("L3", "3", "")], "id string, road_rank string, link_type string")
    got = {(r["id"], r["field"]): r["text"] for r in labels.decoded(rows, layer, book, "v").collect()}
    assert got == {("L1", "RoadRank"): "1 (own)", ("L1", "LinkType"): "6 (a)", ("L2", "RoadRank"): "2", ("L2", "LinkType"): "-", ("L3", "RoadRank"): "3", ("L3", "LinkType"): "-"}
    assert labels.decoded(rows.select("id"), layer, book, "v").count() == 0 and labels.decoded(rows, layer, book.limit(0), "v").count() == 6


@pytest.mark.parametrize("query", ["abc", "AB", "", "bca b", "zzz", "ÄÖÜ", "aaaa", "c d e f g h", "é e"])
def test_indexed_search(spark, tmp_path, query):
    import random

    rng = random.Random(1)
    rows = spark.createDataFrame([(i, "".join(rng.choice("abcÄé \n") for _ in range(rng.randint(0, 60))), rng.choice(["abc", None, "äöü", "x"])) for i in range(400)] + [(900, None, None), (901, "", "ab")], "k long, t string, u string")
    X.save_index(X.search_index(rows, "k", "t", "u"), str(tmp_path / "ix"))
    index = spark.read.parquet(str(tmp_path / "ix"))
    want = sorted(r["k"] for r in X.search(rows, query, "t", "u").collect())
    assert sorted(r["k"] for r in X.indexed_search(rows, index, "k", query, "t", "u").collect()) == want
