"""Geometry as column expressions over ARRAY<STRUCT<x, y, z>>. Everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    z = F.lit(0.0) if z is None else F.coalesce(z.cast("double"), F.lit(0.0))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.alias("z"))


def with_z(coords: Column) -> Column:
    """Missing heights become 0."""
    return F.transform(coords, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), F.coalesce(c["z"], F.lit(0.0)).alias("z")))


def first_point(coords: Column) -> Column:
    return F.try_element_at(coords, F.lit(1))


def last_point(coords: Column) -> Column:
    return F.try_element_at(coords, F.lit(-1))


def norm(dx: Column, dy: Column) -> Column:
    """Planar length of a difference, by the root that every engine rounds alike."""
    return F.sqrt(dx * dx + dy * dy)


def distance(a: Column, b: Column) -> Column:
    """Planar distance of two points."""
    return norm(a["x"] - b["x"], a["y"] - b["y"])


def _pairs(coords: Column) -> Column:
    """Consecutive points as structs (a, b); empty for fewer than two points."""
    n = F.size(coords)
    both = F.arrays_zip(F.slice(coords, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(coords, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    return F.when(n >= 2, both)


def polyline_length(coords: Column) -> Column:
    """Planar length; 0 for fewer than two points."""
    return F.coalesce(F.aggregate(_pairs(coords), F.lit(0.0), lambda s, p: s + distance(p["a"], p["b"])), F.lit(0.0))


def area(ring: Column) -> Column:
    """Planar area of a ring, closed or not."""
    n = F.size(ring)
    closed = F.concat(ring, F.slice(ring, 1, 1))
    cross = F.aggregate(_pairs(closed), F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])
    return F.when(n >= 3, F.abs(cross) / 2).otherwise(F.lit(0.0))


def open_ring(ring: Column, tolerance: float = 1e-8) -> Column:
    """The ring without a last point that equals its first."""
    a, b = first_point(ring), last_point(ring)
    same = (F.size(ring) > 1) & (distance(a, b) <= tolerance) & (F.abs(a["z"] - b["z"]) <= tolerance)
    return F.when(same, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(1)))).otherwise(ring)


#: A closed ring has at least so many points.
RING_POINTS = 4


def valid_holes(holes: Column) -> Column:
    return F.filter(holes, lambda h: F.size(h) >= RING_POINTS)


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring, closed or not, surrounds a place: an odd number of its edges lies to the right of it."""
    closed = F.concat(ring, F.slice(ring, 1, 1))

    def crossed(acc: Column, p: Column) -> Column:
        a, b = p["a"], p["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        right = x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(spans & right, ~acc).otherwise(acc)

    return F.coalesce(F.aggregate(_pairs(closed), F.lit(False), crossed), F.lit(False))


def nested(parts: Column) -> Column:
    """array<struct<ring, depth>>: each ring with the number of larger rings around it, in the given order.

    Rings of one shape do not cross, so the middle of a ring's first edge stands for the whole ring.
    """

    def measured(r: Column) -> Column:
        a, b = first_point(r), F.coalesce(F.try_element_at(r, F.lit(2)), first_point(r))
        return F.struct(r.alias("ring"), area(r).alias("area"), ((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))

    def depths(rings: Column) -> Column:
        return F.transform(rings, lambda r: F.struct(r["ring"].alias("ring"), F.size(F.filter(rings, lambda o: (o["area"] > r["area"]) & inside(o["ring"], r["x"], r["y"]))).alias("depth")))

    # a list of one list, so that every ring is measured once
    return F.element_at(F.transform(F.array(F.transform(parts, measured)), depths), 1)


def polygon(parts: Column) -> Column:
    """struct(outer: the first outer ring, n_outer, holes, n_bad: holes of too few points, which are left out).

    Rings at even depths are outer rings, the others holes; which way a ring runs does not matter. One ring is an outer ring.
    """

    def split(rings: Column) -> Column:
        outer = F.filter(rings, lambda r: r["depth"] % 2 == 0)
        holes = F.transform(F.filter(rings, lambda r: r["depth"] % 2 == 1), lambda r: r["ring"])
        good = valid_holes(holes)
        return F.struct(F.try_element_at(outer, F.lit(1))["ring"].alias("outer"), F.size(outer).alias("n_outer"), good.alias("holes"), (F.size(holes) - F.size(good)).alias("n_bad"))

    several = F.element_at(F.transform(F.array(nested(parts)), split), 1)
    one = F.struct(F.try_element_at(parts, F.lit(1)).alias("outer"), F.size(parts).alias("n_outer"), F.slice(parts, 1, 0).alias("holes"), F.lit(0).alias("n_bad"))
    return F.when(F.size(parts) > 1, several).when(parts.isNotNull(), one)


def accepts(geom_kind: Column, parts: Column, kinds: tuple[str, ...], rings: Column) -> Column:
    """Why a geometry is rejected, or null: kind not accepted, several polygons, too few points. rings is what polygon() makes of a polygon's parts."""
    first = F.try_element_at(parts, F.lit(1))
    return (
        F.when(geom_kind.isNull() | (F.coalesce(F.size(parts), F.lit(0)) <= 0), F.lit("missing"))
        .when(~geom_kind.isin(*kinds), F.concat(F.lit("kind "), geom_kind))
        .when((geom_kind == "polygon") & (rings["n_outer"] > 1), F.lit("several polygons"))
        .when((geom_kind == "line") & (F.size(parts) == 1) & (F.size(first) < 2), F.lit("fewer than 2 points"))
        .when((geom_kind == "polygon") & (F.size(rings["outer"]) < RING_POINTS), F.lit("fewer than 4 points"))
    )


def extent(coords: Column) -> Column:
    """struct(min_x, max_x, ..., span): the box and its larger planar side."""
    ends = {f"{f.__name__.removeprefix('array_')}_{c}": f(F.transform(coords, _axis(c))) for c in "xyz" for f in (F.array_min, F.array_max)}
    span = F.greatest(ends["max_x"] - ends["min_x"], ends["max_y"] - ends["min_y"])
    return F.struct(*(v.alias(k) for k, v in ends.items()), span.alias("span"))


def focus(coords: Column, padding: float = 20.0, least: float = 20.0, most: float = 500.0) -> Column:
    """struct(cx, cy, cz, scale): the middle of the box, and three quarters of its span with padding, kept between least and most."""
    box = extent(coords)
    middle = [((box[f"min_{c}"] + box[f"max_{c}"]) / 2).alias(f"c{c}") for c in "xyz"]
    scale = F.least(F.greatest(box["span"] * 0.75 + padding, F.lit(least)), F.lit(most))
    return F.struct(*middle, scale.alias("scale"))


def summary(coords: Column) -> Column:
    """struct(vertices, length_m, area): what a reader wants to know of one geometry."""
    return F.struct(F.size(coords).alias("vertices"), polyline_length(coords).alias("length_m"), area(coords).alias("area"))


def _axis(c: str):
    return lambda p: p[c]


def bounds(rows: DataFrame, coords: str = "coords") -> DataFrame:
    """One row: the box of all geometries. Only finite numbers count."""
    box = rows.select(extent(F.col(coords)).alias("e"))
    return box.agg(*(F.min(f"e.min_{c}").alias(f"min_{c}") for c in "xyz"), *(F.max(f"e.max_{c}").alias(f"max_{c}") for c in "xyz"))


def to_local_origin(rows: DataFrame, coords: str = "coords") -> DataFrame:
    """Coordinates relative to the centre of the whole table's box."""
    box = bounds(rows, coords).select(*(((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"o{c}") for c in "xyz"))
    moved = F.transform(F.col(coords), lambda p: F.struct(*((p[c] - F.col(f"o{c}")).alias(c) for c in "xyz")))
    # one row, whatever the size of the table
    return rows.crossJoin(F.broadcast(box)).withColumn(coords, moved).drop("ox", "oy", "oz")


def ring_point(rows: DataFrame, key: str | list[str], coords: str = "coords") -> DataFrame:
    """key, x, y, z, one row per key: mean of a ring's distinct finite points in the plane, median of their heights."""
    keys = [key] if isinstance(key, str) else key
    points = rows.select(*keys, F.inline(open_ring(F.col(coords))))
    finite = F.lit(True)
    for c in "xyz":
        finite &= ~F.isnan(c) & F.col(c).isNotNull() & (F.abs(c) != float("inf"))
    distinct = points.filter(finite).groupBy(*keys, "x", "y").agg(F.min("z").alias("z"))
    return distinct.groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.percentile("z", F.lit(0.5)).alias("z"))


def tangent(coords: Column, side: str, lookback: float) -> Column:
    """struct(x, y): unit direction of travel at one end of a polyline, or null.

    It joins the end to the point `lookback` along the line from it, or to the far end of a shorter
    line; segments of length 0 are skipped.
    """
    line = coords if side == "from" else F.reverse(coords)
    sign = 1.0 if side == "from" else -1.0
    measured = F.filter(F.transform(_pairs(line), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), distance(p["a"], p["b"]).alias("length"))), lambda p: p["length"] > 0)
    zero = F.struct(F.lit(lookback).alias("left"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(False).alias("done"))

    def step(acc: Column, p: Column) -> Column:
        reaches = acc["left"] <= p["length"]
        ratio = acc["left"] / p["length"]
        x, y = (F.when(acc["done"], acc[c]).when(reaches, p["a"][c] + (p["b"][c] - p["a"][c]) * ratio).otherwise(p["b"][c]) for c in "xy")
        left = F.when(acc["done"] | reaches, acc["left"]).otherwise(acc["left"] - p["length"])
        return F.struct(left.alias("left"), x.alias("x"), y.alias("y"), (acc["done"] | reaches).alias("done"))

    # columns used in lambdas would be computed anew at each mention, so each step hands its value on in a list of one
    end = F.array(F.struct(first_point(line).alias("start"), F.aggregate(measured, zero, step).alias("end")))
    way = F.transform(end, lambda e: F.struct((sign * (e["end"]["x"] - e["start"]["x"])).alias("dx"), (sign * (e["end"]["y"] - e["start"]["y"])).alias("dy")))
    sized = F.transform(way, lambda w: F.struct(w["dx"].alias("dx"), w["dy"].alias("dy"), norm(w["dx"], w["dy"]).alias("length")))
    return F.element_at(F.transform(sized, lambda w: F.when(w["length"] > 0, F.struct((w["dx"] / w["length"]).alias("x"), (w["dy"] / w["length"]).alias("y")))), 1)


def segments(rows: DataFrame, keep: list[str], coords: str = "coords") -> DataFrame:
    """One row per segment of positive length: the kept columns, seg (from 0), ax, ay, az, bx, by, bz."""
    out = rows.select(*keep, F.posexplode(_pairs(F.col(coords))).alias("seg", "p"))
    flat = out.select(*keep, "seg", *(F.col(f"p.{e}.{c}").alias(f"{e}{c}") for e in "ab" for c in "xyz"))
    return flat.filter((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))


def same_geometry(a: Column, b: Column) -> Column:
    """Exact equality of all coordinates; NaN equals NaN."""
    return a.eqNullSafe(b)
