"""A road network derived from part and orders, with faults injected by key, for tests at any scale.

The same SQL runs in Spark and in DuckDB; numbers are cast so that types agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import settled

NODE = """
SELECT p_partkey AS node_id, (p_partkey % 40) * 50.0 AS x, floor(p_partkey / 40) * 50.0 AS y,
       CASE WHEN p_size % 10 = 0 THEN 6.0 ELSE 0.0 END AS z,
       p_brand AS group_key, CASE WHEN p_type = 'PROMO' THEN '1' ELSE '7' END AS node_type
FROM {part}
UNION ALL
SELECT 1000000 + p_partkey, (p_partkey % 40) * 50.0 + 0.3, floor(p_partkey / 40) * 50.0,
       0.0, p_brand, '7' FROM {part} WHERE p_partkey % 50 = 7
UNION ALL
SELECT 2000000 + o_orderkey, o_orderkey * 10.0, -500.0, 0.0, NULL, '7' FROM {orders} WHERE o_orderkey % 499 = 0
UNION ALL
SELECT 3000000 + o_orderkey, o_orderkey * 10.0, -450.0, 0.0, NULL, '7' FROM {orders} WHERE o_orderkey % 499 = 0
"""

LINK = """
SELECT k AS link_id,
       CASE WHEN k % 97 = 0 THEN NULL WHEN k % 101 = 0 THEN -k WHEN k % 43 = 0 THEN t ELSE f END AS from_id,
       CASE WHEN k % 103 = 0 THEN -k WHEN k % 43 = 0 THEN f ELSE t END AS to_id,
       CASE WHEN k % 13 = 0 THEN NULL ELSE nx END AS r_id,
       CASE WHEN k % 37 = 0 THEN sk WHEN k % 29 = 0 THEN k + 1 WHEN k % 11 = 0 THEN NULL ELSE pv END AS l_id,
       lane_no, link_type,
       CASE WHEN k % 31 = 0 THEN bx ELSE ax END + sh AS x0, CASE WHEN k % 31 = 0 THEN by_ ELSE ay END AS y0, 0.0 AS z0,
       CASE WHEN k % 199 = 0 THEN ax + 0.05 ELSE (ax + bx) / 2 + ux * 3.0 * lane_no END AS xm,
       CASE WHEN k % 199 = 0 THEN ay ELSE (ay + by_) / 2 - (1.0 - ux) * 3.0 * lane_no END AS ym,
       CASE WHEN k % 5 = 0 THEN 6.0 ELSE 0.0 END AS zm,
       CASE WHEN k % 199 = 0 THEN ax + 0.1 WHEN k % 31 = 0 THEN ax ELSE bx END AS x1,
       CASE WHEN k % 199 = 0 THEN ay WHEN k % 31 = 0 THEN ay ELSE by_ END AS y1, 0.0 AS z1
FROM (
  SELECT c.*, CASE WHEN k % 67 = 0 THEN 2.0 WHEN k % 61 = 0 THEN 0.25 ELSE 0.0 END AS sh FROM (
    SELECT w.*, s.sk, (f % 40) * 50.0 AS ax, floor(f / 40) * 50.0 AS ay, (t % 40) * 50.0 AS bx, floor(t / 40) * 50.0 AS by_
    FROM (
      SELECT e.*, lead(k) OVER (PARTITION BY f, t, link_type ORDER BY k) AS nx, lag(k) OVER (PARTITION BY f, t, link_type ORDER BY k) AS pv,
             row_number() OVER (PARTITION BY f, t, link_type ORDER BY k) AS lane_no
      FROM ({edges}) e) w
    LEFT JOIN (SELECT f AS sf, min(k) AS sk FROM ({edges}) q GROUP BY f) s ON s.sf = w.t) c) g
UNION ALL
SELECT 1000000 + o_orderkey, 2000000 + o_orderkey, 3000000 + o_orderkey, NULL, NULL, 1, '6',
       o_orderkey * 10.0, -500.0, 0.0, o_orderkey * 10.0, -475.0, 0.0, o_orderkey * 10.0, -450.0, 0.0
FROM {orders} WHERE o_orderkey % 499 = 0
"""

EDGES = """
SELECT k, f, f + CASE WHEN pr IN ('1','3') THEN 1 WHEN pr IN ('2','4') THEN 40 WHEN k % 2 = 0 THEN 41 ELSE 39 END AS t,
       CASE WHEN pr IN ('1','3') THEN 0.0 ELSE 1.0 END AS ux,
       CASE WHEN st = 'P' AND pr IN ('1','5') AND k % 2 = 0 THEN '1' ELSE '6' END AS link_type
FROM (SELECT o_orderkey AS k, (o_orderkey * 7) % n AS f, substr(o_orderpriority, 1, 1) AS pr, o_orderstatus AS st
      FROM {orders} CROSS JOIN (SELECT count(*) AS n FROM {part}) size) b
WHERE f % 40 BETWEEN 1 AND 38 AND f % 211 <> 0
"""

MARKER = """
SELECT 4000000 + link_id AS marker_id, CASE WHEN link_id % 3 = 0 THEN '502' ELSE '503' END AS kind,
       xm - 2.0 AS x0, ym - 2.0 AS y0, CASE WHEN link_id % 2 = 0 THEN 0.0 ELSE 20.0 END AS z0,
       xm + 2.0 AS x1, ym + 2.0 AS y1, CASE WHEN link_id % 2 = 0 THEN 0.0 ELSE 20.0 END AS z1
FROM {link} WHERE link_id % 17 = 0 AND link_id < 1000000
"""

_NODE_COLS = "node_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, group_key, node_type"
_LINK_COLS = "link_id, from_id, to_id, r_id, l_id, CAST(lane_no AS BIGINT) AS lane_no, link_type, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("x0", "y0", "z0", "xm", "ym", "zm", "x1", "y1", "z1"))
_MARKER_COLS = "marker_id, kind, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("x0", "y0", "z0", "x1", "y1", "z1"))


def _sql(part: str, orders: str, link: str) -> dict[str, str]:
    edges = EDGES.format(part=part, orders=orders)
    return {"net_node": f"SELECT {_NODE_COLS} FROM ({NODE.format(part=part, orders=orders)}) n", "net_link": f"SELECT {_LINK_COLS} FROM ({LINK.format(part=part, orders=orders, edges=edges)}) l", "net_marker": f"SELECT {_MARKER_COLS} FROM ({MARKER.format(link=link)}) m"}


def ctes() -> str:
    """net_node, net_link and net_marker as common table expressions, without WITH."""
    return ",\n".join(f"{name} AS ({sql})" for name, sql in _sql("part", "orders", "net_link").items())


def network(spark: SparkSession, sf_dir: str, once: bool = False) -> dict[str, DataFrame]:
    """nodes (id, ord, x, y, z, group_key, node_type), links (id, ord, ends, sides, lane_no, link_type, coords), markers (id, kind, coords).

    once writes links and nodes, for those who read them several times.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_brand", "p_type")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    sql = _sql("{part}", "{orders}", "{link}")
    nodes = spark.sql(sql["net_node"], part=part, orders=orders)
    links = spark.sql(sql["net_link"], part=part, orders=orders)
    if once:
        nodes, links = settled(nodes), settled(links)
    markers = spark.sql(sql["net_marker"], link=links)

    def line(*ends: str):
        return F.array(*(F.struct(*(F.col(f"{c}{e}").alias(c) for c in "xyz")) for e in ends)).alias("coords")

    return {
        "nodes": nodes.select(F.col("node_id").alias("id"), F.col("node_id").alias("ord"), "x", "y", "z", "group_key", "node_type"),
        "links": links.select(F.col("link_id").alias("id"), F.col("link_id").alias("ord"), "from_id", "to_id", "r_id", "l_id", "lane_no", "link_type", line("0", "m", "1")),
        "markers": markers.select(F.col("marker_id").alias("id"), "kind", line("0", "1")),
    }
