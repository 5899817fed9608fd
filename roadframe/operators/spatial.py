"""Joins by place: points within a distance, and segments that cross, by equi joins on grid cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import norm, segments
from .components import settled


def distance_join(left: DataFrame, right: DataFrame, tolerance: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows within `tolerance` in the plane; both sides have x, y and the columns `by`, which must agree; other columns must differ.

    Cells are as wide as the tolerance. Only the left side is copied, to its own and the eight
    neighbouring cells, so hand in the smaller side as left. Null and NaN places never match.
    """
    size = tolerance if tolerance > 0 else 1.0

    def cell(c: Column) -> Column:
        return F.floor(c / size).cast("long")

    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = left.filter("NOT isnan(x) AND NOT isnan(y)").withColumnsRenamed({"x": "lx", "y": "ly"}).withColumn("d", F.explode(around)).withColumns({"cx": cell(F.col("lx")) + F.col("d.i"), "cy": cell(F.col("ly")) + F.col("d.j")}).drop("d")
    b = right.filter("NOT isnan(x) AND NOT isnan(y)").withColumnsRenamed({"x": "rx", "y": "ry"}).withColumns({"cx": cell(F.col("rx")), "cy": cell(F.col("ry"))})
    away = norm(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))
    return a.join(b, [*by, "cx", "cy"]).withColumn("distance", away).filter(F.col("distance") <= tolerance).drop("cx", "cy", "lx", "ly", "rx", "ry")


#: A segment is cut into at most as many steps before it is dealt to cells.
MAX_STEPS = 1_000
#: Pairs of segments above which a cell is split into four, and splits of a cell at most.
DENSE_PAIRS, MAX_SPLITS = 4_000_000, 12
#: A split is kept where the four hold at most this share of the cell's pairs.
GAIN = 0.75
#: Segments of a side that meet in one block where no split helps.
BLOCK_ROWS = 2_000
#: Dense cells up to this number are sent to all tasks.
SENT_CELLS = 100_000
#: Where cells of crossing segments begin, as a part of a cell: lines often run along round coordinates, which would touch cells on both sides.
BEGIN = 0.02


def _steps(rows: DataFrame, side: str, cell: float, begin: float = 0.0) -> DataFrame:
    """Segments of a side with one row per cell that a step's box touches; the first cell begins at begin on both axes."""
    s = segments(rows.select(F.col("id").alias(f"{side}_id"), "coords"), [f"{side}_id"])
    s = s.select(f"{side}_id", F.col("seg").alias(f"{side}_seg"), *(F.col(f"{e}{c}").alias(f"{side}{e}{c}") for e in "ab" for c in "xyz"))
    dx, dy = F.col(f"{side}bx") - F.col(f"{side}ax"), F.col(f"{side}by") - F.col(f"{side}ay")
    # a long diagonal segment goes step by step, so that it touches cells along it and not its whole box
    steps = F.least(F.greatest(F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / cell), F.lit(1)), F.lit(MAX_STEPS)).cast("int")
    s = s.withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def at(axis: str, i: Column) -> Column:
        return F.col(f"{side}a{axis}") + (F.col(f"{side}b{axis}") - F.col(f"{side}a{axis}")) * (i / F.col("n"))

    def bounds(axis: str, i: Column) -> tuple[Column, Column]:
        a, b = at(axis, i), at(axis, i + 1)
        # a step's ends are rounded: widen by far less than a cell, so that no touching cell is missed
        slack = cell * 1e-6
        return F.floor((F.least(a, b) - begin - slack) / cell).cast("long"), F.floor((F.greatest(a, b) - begin + slack) / cell).cast("long")

    for axis in "xy":
        s = s.withColumn(f"c{axis}", F.explode(F.sequence(*bounds(axis, F.col("i")))))
    # steps go one way along each axis, so those that touch a cell follow each other: the first of them keeps it
    before = [F.col(f"c{axis}").between(*bounds(axis, F.col("i") - 1)) for axis in "xy"]
    return s.filter((F.col("i") == 0) | ~(before[0] & before[1])).drop("n", "i")


def _quarters(rows: DataFrame, side: str, cell: float, begin: float = 0.0) -> DataFrame:
    """Rows of cells of a size dealt to the quarters that their part in the cell touches; px, py name the cell."""
    half, slack = cell / 2, cell * 1e-6
    rows = rows.withColumnsRenamed({"cx": "px", "cy": "py"})
    low, high = F.lit(0.0), F.lit(1.0)
    for axis in "xy":
        a, d = F.col(f"{side}a{axis}"), F.col(f"{side}b{axis}") - F.col(f"{side}a{axis}")
        first, second = ((F.col(f"p{axis}") + i) * cell + begin + s - a for i, s in ((0, -slack), (1, slack)))
        low = F.greatest(low, F.when(d != 0, F.least(first / d, second / d)).otherwise(F.lit(0.0)))
        high = F.least(high, F.when(d != 0, F.greatest(first / d, second / d)).otherwise(F.lit(1.0)))
    rows = rows.withColumns({"t0": low, "t1": high}).filter("t0 <= t1")
    for axis in "xy":
        a, d = F.col(f"{side}a{axis}"), F.col(f"{side}b{axis}") - F.col(f"{side}a{axis}")
        u, v = a + d * F.col("t0"), a + d * F.col("t1")
        base = F.col(f"p{axis}") * 2
        start = F.greatest(F.least(F.floor((F.least(u, v) - begin - slack) / half).cast("long"), base + 1), base)
        end = F.least(F.greatest(F.floor((F.greatest(u, v) - begin + slack) / half).cast("long"), base), base + 1)
        rows = rows.withColumn(f"c{axis}", F.explode(F.sequence(start, end)))
    return rows.drop("t0", "t1")


def _counted(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """keys, nl, nr: rows of both sides in each cell."""
    one = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return one.groupBy(*keys).agg(F.sum("l").alias("nl"), F.sum("r").alias("nr"))


def _sent(cells: DataFrame, n: int) -> DataFrame:
    return F.broadcast(cells) if n <= SENT_CELLS else cells


def _dealt(a: DataFrame, b: DataFrame, cell: float, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides by level, cx, cy, bl, br: cells, quartered where they hold many pairs, and blocks of cells that stay dense.

    A split that leaves most pairs as they are (long segments that meet all over the cell) is not kept: there, blocks of
    the left side meet blocks of the right one. once is for a table with itself: cells of one id are left out.
    """
    begin = BEGIN * cell
    sides = {"l": _steps(a, "l", cell, begin), "r": _steps(b, "r", cell, begin)}
    if once:
        several = settled(sides["l"].groupBy("cx", "cy").agg((F.min("l_id") != F.max("l_id")).alias("several")).filter("several").select("cx", "cy"))
        few = _sent(several, several.count())
        sides = {s: rows.join(few, ["cx", "cy"], "left_semi") for s, rows in sides.items()}
    done: dict[str, list[DataFrame]] = {"l": [], "r": []}

    def settle(side: str, rows: DataFrame, level: int, blocks: bool = False) -> None:
        rows = rows.withColumns({"level": F.lit(level), "bl": F.lit(0), "br": F.lit(0)})
        if blocks:
            n = {s: F.ceil(F.col(f"n{s}") / BLOCK_ROWS).cast("int") for s in "lr"}
            mine = F.pmod(F.xxhash64(f"{side}_id", f"{side}_seg", f"{side}ax", f"{side}ay"), n[side]).cast("int")
            rows = rows.withColumn(f"b{side}", mine).withColumn("br" if side == "l" else "bl", F.explode(F.sequence(F.lit(0), n["r" if side == "l" else "l"] - 1)))
        done[side].append(rows.drop("nl", "nr", "px", "py"))

    for level in range(MAX_SPLITS + 1):
        dense = settled(_counted(sides["l"], sides["r"], "cx", "cy").filter(F.col("nl") * F.col("nr") > DENSE_PAIRS))
        n = dense.count()
        if not n:
            for s, rows in sides.items():
                settle(s, rows, level)
            break
        cells = _sent(dense, n)
        for s, rows in sides.items():
            settle(s, rows.join(cells.select("cx", "cy"), ["cx", "cy"], "left_anti"), level)
        hard = {s: rows.join(cells, ["cx", "cy"]) for s, rows in sides.items()}
        if level == MAX_SPLITS:
            for s, rows in hard.items():
                settle(s, rows, level, blocks=True)
            break
        quarters = {s: _quarters(rows.drop("nl", "nr"), s, cell / 2**level, begin) for s, rows in hard.items()}
        pairs = _counted(quarters["l"], quarters["r"], "px", "py", "cx", "cy").groupBy(F.col("px").alias("cx"), F.col("py").alias("cy")).agg(F.sum(F.col("nl") * F.col("nr")).alias("pairs"))
        split = settled(dense.join(pairs, ["cx", "cy"]).filter(F.col("pairs") <= GAIN * F.col("nl") * F.col("nr")).select("cx", "cy"))
        kept = _sent(split, n)
        for s in "lr":
            settle(s, hard[s].join(kept, ["cx", "cy"], "left_anti"), level, blocks=True)
        sides = {s: settled(quarters[s].join(kept.select(F.col("cx").alias("px"), F.col("cy").alias("py")), ["px", "py"], "left_semi").drop("px", "py")) for s in "lr"}
    out = {s: parts[0] for s, parts in done.items()}
    for s, parts in done.items():
        for more in parts[1:]:
            out[s] = out[s].unionByName(more)
    return out["l"], out["r"]


def crossing_pairs(a: DataFrame, b: DataFrame, z_tolerance: float, cell: float = 50.0, once: bool = False) -> DataFrame:
    """(a_id, b_id): polylines that meet in the plane at a place where their heights differ by at most z_tolerance.

    Both tables have id and coords; lines may share an id, which then stands for all of them. Segments are closed, so touching counts; collinear segments meet
    over their overlap and are judged at its middle. once keeps pairs with a_id < b_id, for a table with itself.
    """
    left, right = _dealt(a, b, cell, once)
    pairs = left.join(right, ["level", "cx", "cy", "bl", "br"])
    if once:
        pairs = pairs.filter("l_id < r_id")
    # most segments of a cell pass each other by: their boxes tell before anything is divided
    for axis in "xy":
        (la, lb), (ra, rb) = ((F.col(f"{s}a{axis}"), F.col(f"{s}b{axis}")) for s in "lr")
        pairs = pairs.filter((F.least(ra, rb) <= F.greatest(la, lb)) & (F.greatest(ra, rb) >= F.least(la, lb)))
    ux, uy = F.col("lbx") - F.col("lax"), F.col("lby") - F.col("lay")
    vx, vy = F.col("rbx") - F.col("rax"), F.col("rby") - F.col("ray")
    wx, wy = F.col("rax") - F.col("lax"), F.col("ray") - F.col("lay")
    cross = ux * vy - uy * vx
    parallel = cross == 0
    t = F.when(~parallel, (wx * vy - wy * vx) / cross)
    u = F.when(~parallel, (wx * uy - wy * ux) / cross)
    # collinear: the overlap along the left segment
    square = ux * ux + uy * uy
    t0 = (wx * ux + wy * uy) / square
    t1 = t0 + (vx * ux + vy * uy) / square
    low, high = F.greatest(F.least(t0, t1), F.lit(0.0)), F.least(F.greatest(t0, t1), F.lit(1.0))
    overlap = parallel & (wx * uy - wy * ux == 0) & (low <= high)
    middle = (low + high) / 2
    tt = F.when(overlap, middle).otherwise(t)
    uu = F.when(overlap, (middle - t0) / (t1 - t0)).otherwise(u)
    meets = overlap | (t.between(0.0, 1.0) & u.between(0.0, 1.0))
    lz = F.col("laz") + (F.col("lbz") - F.col("laz")) * tt
    rz = F.col("raz") + (F.col("rbz") - F.col("raz")) * uu
    return pairs.filter(F.coalesce(meets & (F.abs(lz - rz) <= z_tolerance), F.lit(False))).select(F.col("l_id").alias("a_id"), F.col("r_id").alias("b_id")).distinct()


def height_at(rows: DataFrame, points: DataFrame) -> DataFrame:
    """(key, z): the height of each keyed line at the place nearest to a point. rows: id, coords; points: id, key, x, y."""
    s = segments(rows, ["id"]).join(points, "id")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.greatest(F.least(((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy), F.lit(1.0)), F.lit(0.0))
    away = norm(F.col("ax") + dx * t - F.col("x"), F.col("ay") + dy * t - F.col("y"))
    z = F.col("az") + (F.col("bz") - F.col("az")) * t
    return s.groupBy("key").agg(F.min_by(z, F.struct(away, F.col("seg"))).alias("z"))
