"""Queries over deliveries made from the driver tables: layers are written as files and loaded again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.components import ensure_checkpoint_dir
from ..sources import shapefile, writer
from .catalog import query, read


def _points(*xy: tuple[Column, Column]) -> Column:
    return F.array(*(G.point(x, y) for x, y in xy))


def _square(x: Column, y: Column, size: Column) -> Column:
    """A closed ring that goes up from its lower left corner."""
    return _points((x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y))


#: Rings of each part: a square of 10; one somewhere at or in it; for every fifth size one within that; for every seventh one of two points, beneath these or away.
_RINGS = """r AS (SELECT p_partkey AS id, p_partkey % 13 + 0.0e0 AS x, p_size % 11 + 0.5e0 AS y, p_partkey % 3 + 1.0e0 AS s, p_size % 5 = 0 AS third, p_size % 7 = 0 AS flat FROM part),
d AS (SELECT *, CAST(x < 10 AND y + s / 2 < 10 AS INT) AS in_first, CAST(x + 0.25 < 10 AND y + 0.5 < 10 AS INT) + 1 AS in_both, CAST(id % 2 = 1 AS INT) AS flat_in FROM r),
n AS (SELECT *, 1 + CAST(in_first = 0 AS INT) + CASE WHEN third THEN CAST(in_both % 2 = 0 AS INT) ELSE 0 END + CASE WHEN flat THEN 1 - flat_in ELSE 0 END AS n_outer,
   in_first + CASE WHEN third THEN in_both % 2 ELSE 0 END AS n_holes, CASE WHEN flat THEN flat_in ELSE 0 END AS n_bad FROM d)"""


def _rings(part: DataFrame) -> DataFrame:
    """id and parts, the largest ring last in every other part."""
    x, y, s = F.col("p_partkey") % 13 + F.lit(0.0), F.col("p_size") % 11 + F.lit(0.5), F.col("p_partkey") % 3 + F.lit(1.0)
    outer, none = _square(F.lit(0.0), F.lit(0.0), F.lit(10.0)), F.expr("CAST(array() AS array<array<struct<x:double,y:double,z:double>>>)")
    inner = F.array(_square(x, y, s))
    third = F.when(F.col("p_size") % 5 == 0, F.array(_square(x + 0.25, y + 0.25, F.lit(0.5)))).otherwise(none)
    away = F.when(F.col("p_partkey") % 2 == 1, 9.0).otherwise(19.0)
    flat = F.when(F.col("p_size") % 7 == 0, F.array(_points((away, F.lit(0.1)), (away, F.lit(0.3)), (away, F.lit(0.1))))).otherwise(none)
    parts = F.concat(F.array(outer), inner, third, flat)
    return part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.reverse(parts)).otherwise(parts).alias("parts"))


@query(f"WITH {_RINGS} SELECT id, n_outer, n_holes, n_bad, CASE WHEN n_outer = 1 THEN 5 END AS outer_points FROM n")
def polygon_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rings of a shape are outer ones and which are holes, by nesting."""
    rows = _rings(read(spark, sf_dir, "part")).withColumn("p", G.polygon(F.col("parts")))
    return rows.select("id", "p.n_outer", F.size("p.holes").alias("n_holes"), "p.n_bad", F.when(F.col("p.n_outer") == 1, F.size("p.outer")).alias("outer_points"))


def _delivery(spark: SparkSession, sf_dir: str) -> str:
    """Suppliers as nodes, orders as lines in up to three parts, parts as polygons; some attributes are no numbers."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/delivery-{uuid.uuid4().hex}"
    supplier, orders, part = (read(spark, sf_dir, t) for t in ("supplier", "orders", "part"))
    nodes = supplier.select(F.concat(F.lit("N"), "s_suppkey").alias("ID"), F.lit("7").alias("NodeType"), F.when(F.col("s_suppkey") % 9 != 0, F.array(_points((F.col("s_suppkey") + 0.5, F.col("s_nationkey") * 1.0)))).alias("parts"))
    k = F.col("o_orderkey") * 1.0
    gap = F.when(F.col("o_orderkey") % 4 == 1, 0.05).when(F.col("o_orderkey") % 4 == 2, 0.5).otherwise(0.0)
    first, second, third = _points((k, F.lit(0.0)), (k + 1, F.lit(1.0))), _points((k + 2, F.lit(2.0)), (k + 1, 1 + gap)), _points((k + 2, F.lit(2.0)), (k + 3, F.lit(5.0)))
    lines = orders.select(
        F.concat(F.lit("L"), "o_orderkey").alias("ID"),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("x"), "o_custkey")).otherwise((F.col("o_orderkey") % 5).cast("string")).alias("LaneNo"),
        F.concat(F.lit("N"), "o_custkey").alias("FromNodeID"),
        F.when(F.col("o_orderkey") % 4 == 3, F.array(first)).otherwise(F.array(second, third, first)).alias("parts"),
    )
    areas = _rings(part).select(F.concat(F.lit("P"), "id").alias("ID"), F.lit("1").alias("Kind"), "parts")
    for rows, layer, kind in ((nodes, "A1_NODE", "point"), (lines, "A2_LINK", "line"), (areas, "A3_DRIVEWAYSECTION", "polygon")):
        writer.write_layer(rows, layer, kind, root, "HD")
    return root


@query(f"""WITH {_RINGS}
SELECT 'A1_NODE' AS layer, 'N' || s_suppkey AS id, 1 AS n_points, 0 AS n_holes, s_suppkey + 0.5e0 AS x, '7' AS value FROM supplier WHERE s_suppkey % 9 <> 0
UNION ALL SELECT 'A2_LINK', 'L' || o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 2 ELSE 4 END, 0, CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey + 1 ELSE o_orderkey + 3 END + 0.0e0, CASE WHEN o_orderkey % 7 = 0 THEN '-1' ELSE CAST(o_orderkey % 5 AS VARCHAR) END FROM orders WHERE o_orderkey % 4 <> 2
UNION ALL SELECT 'A3_DRIVEWAYSECTION', 'P' || id, 5, n_holes, 10.0e0, '1' FROM n WHERE n_outer = 1""")
def delivery_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a delivery after a round trip through its files: geometries that are accepted, their holes, typed attributes."""
    _, layers, _ = shapefile.load_layers(spark, _delivery(spark, sf_dir), "HD")
    value = {"A1_NODE": "node_type", "A2_LINK": "lane_no", "A3_DRIVEWAYSECTION": "kind"}
    parts = []
    for name, column in value.items():
        holes = F.size("holes") if "holes" in layers[name].columns else F.lit(0)
        x = F.array_max(F.transform("coords", lambda p: p["x"]))
        parts.append(layers[name].select(F.lit(name).alias("layer"), "id", F.size("coords").alias("n_points"), holes.alias("n_holes"), x.alias("x"), F.col(column).cast("string").alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {_RINGS},
f AS (SELECT 'missing-geometry' AS code, 'A1_NODE' AS layer FROM supplier WHERE s_suppkey % 9 = 0
  UNION ALL SELECT 'geometry-invalid', 'A2_LINK' FROM orders WHERE o_orderkey % 4 = 2
  UNION ALL SELECT 'manual-field-type-invalid', 'A2_LINK' FROM orders WHERE o_orderkey % 4 <> 2 AND o_orderkey % 7 = 0
  UNION ALL SELECT 'geometry-invalid', 'A3_DRIVEWAYSECTION' FROM n WHERE n_outer > 1
  UNION ALL SELECT 'geometry-hole-invalid', 'A3_DRIVEWAYSECTION' FROM n WHERE n_outer = 1 AND n_bad > 0
  UNION ALL SELECT 'missing-required-layer', layer FROM (VALUES ('B2_SURFACELINEMARK'), ('C3_VEHICLEPROTECTIONSAFETY')) v(layer))
SELECT code, layer, count(*) AS n FROM f GROUP BY code, layer""")
def delivery_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load says about single records and about the whole delivery."""
    found = shapefile.load_layers(spark, _delivery(spark, sf_dir), "HD")[2]
    # column findings come once for each file, and a task writes a file
    return found.filter("code NOT IN ('missing-manual-columns', 'unknown-manual-column')").groupBy("code", "layer").agg(F.count("*").alias("n"))
