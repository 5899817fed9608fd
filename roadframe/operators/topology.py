"""Checks and repairs of links and nodes.

links: id, ord, from_id, to_id, r_id, l_id, coords and any other columns. nodes: id, x, y and any other
columns, group_key where nodes form groups. Every function reads one snapshot.
Repairs take the name of the layer that their findings are about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance, first_point, last_point, polyline_length
from .components import settled, star_forest
from .conform import findings
from .sections import section_of
from .spatial import distance_join


def lengths(links: DataFrame) -> DataFrame:
    return links.select("id", polyline_length(F.col("coords")).alias("length_m"))


def too_short(links: DataFrame, least: float = 0.2) -> DataFrame:
    """id, length_m of links shorter than `least` in the plane."""
    return lengths(links).filter(F.col("length_m") < least)


def link_ends(links: DataFrame) -> DataFrame:
    """id, side, node: one row per end that names a node."""
    ends = F.inline(F.array(F.struct(F.lit("from").alias("side"), F.col("from_id").alias("node")), F.struct(F.lit("to").alias("side"), F.col("to_id").alias("node"))))
    return links.select("id", ends).filter("node IS NOT NULL")


def node_degree(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, degree: distinct links at every node, 0 included."""
    degree = link_ends(links).groupBy(F.col("node").alias("id")).agg(F.count_distinct("id").alias("degree"))
    return nodes.select("id").join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def unreferenced_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id of every node row at which no link ends.

    One sum by id in place of an anti-join: Spark would push that below each part of a union of nodes, and sort all ends there.
    """
    ends = link_ends(links).select(F.col("node").alias("id"), F.lit(True).alias("used"))
    seen = nodes.select("id", F.lit(False).alias("used")).unionByName(ends).groupBy("id").agg(F.count_if(~F.col("used")).cast("int").alias("n"), F.bool_or("used").alias("used"))
    return seen.filter("NOT used").select(F.explode(F.array_repeat("id", F.col("n"))).alias("id"))


def _end_degrees(links: DataFrame) -> DataFrame:
    """id, many_from, many_to: whether several links end at each end's node, null where the end names none."""
    degree = link_ends(links).groupBy("node").agg((F.min("id") != F.max("id")).alias("many"))
    a = degree.select(F.col("node").alias("from_id"), F.col("many").alias("many_from"))
    b = degree.select(F.col("node").alias("to_id"), F.col("many").alias("many_to"))
    return links.select("id", "from_id", "to_id").join(a, "from_id", "left").join(b, "to_id", "left").select("id", "many_from", "many_to")


def isolated_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """id of links whose two nodes exist and that no other link touches."""
    known = nodes.select("id")
    both = links.join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("id")
    return _end_degrees(links).filter("NOT many_from AND NOT many_to").select("id").join(both, "id", "left_semi")


def endpoint_candidates(links: DataFrame, nodes: DataFrame, tolerance: float = 0.5, by_section: bool = False) -> DataFrame:
    """id, side, current, n_near, node: ends without an existing node, and the nodes near the polyline's end.

    node is set where exactly one is near. Links with fewer than two points are left out. by_section looks at nodes of a
    link's own section only, with ids that carry it.
    """
    ends = F.inline(
        F.array(
            F.struct(F.lit("from").alias("side"), F.col("from_id").alias("current"), first_point(F.col("coords")).alias("p")),
            F.struct(F.lit("to").alias("side"), F.col("to_id").alias("current"), last_point(F.col("coords")).alias("p")),
        )
    )
    every = links.filter(F.size("coords") >= 2).select("id", ends)
    open_ends = every.join(nodes.select(F.col("id").alias("current")), "current", "left_anti").select("id", "side", "current", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    place, at = open_ends.select("id", "side", "x", "y"), nodes.select(F.col("id").alias("node"), "x", "y")
    if by_section:
        place, at = (df.withColumn("__section", F.coalesce(section_of(F.col(c)), F.lit(""))) for df, c in ((place, "id"), (at, "node")))
    near = distance_join(place, at, tolerance, ["__section"] if by_section else [])
    counts = near.groupBy("id", "side").agg(F.count("*").alias("n_near"), F.min("node").alias("node"))
    out = open_ends.select("id", "side", "current").join(counts, ["id", "side"], "left")
    return out.select("id", "side", "current", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("n_near") == 1, F.col("node")).alias("node"))


def assign_endpoints(links: DataFrame, nodes: DataFrame, tolerance: float = 0.5, layer: str = "link", by_section: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links with the one near node assigned and other dangling ends cleared, findings)."""
    found = settled(endpoint_candidates(links, nodes, tolerance, by_section))
    wide = found.groupBy("id").agg(*(F.max(F.when(F.col("side") == s, F.struct(F.lit(True).alias("open"), "node"))).alias(f"__{s}") for s in ("from", "to")))
    out = links.join(wide, "id", "left")
    for s in ("from", "to"):
        out = out.withColumn(f"{s}_id", F.when(F.col(f"__{s}").isNotNull(), F.col(f"__{s}.node")).otherwise(F.col(f"{s}_id")))
    code = F.when(F.col("n_near") == 1, "link-endpoint-unresolved-assigned").when(F.col("current").isNotNull(), "link-endpoint-unresolved-cleared").when(F.col("n_near") == 0, "link-endpoint-unresolved")
    before, after = F.create_map("side", F.col("current").cast("string")), F.create_map("side", F.col("node").cast("string"))
    acted = findings(found.filter("n_near = 1 OR current IS NOT NULL"), "action", code, layer, F.col("id"), F.col("side"), before, after)
    warned = findings(found.filter("n_near = 0 AND current IS NULL"), "warning", code, layer, F.col("id"), F.col("side"))
    ambiguous = findings(found.filter("n_near > 1"), "warning", "link-endpoint-unresolved-ambiguous", layer, F.col("id"), F.concat(F.col("side"), F.lit(" "), F.col("n_near").cast("string")))
    return out.select(*links.columns), acted.unionByName(warned).unionByName(ambiguous)


_INVERSE = {"l_id": "r_id", "r_id": "l_id"}


def side_references(links: DataFrame) -> DataFrame:
    """id, side (l_id or r_id), target, back: each side reference to an existing link, and what that link's inverse side says."""
    sides = F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("target")) for s in _INVERSE)))
    refs = links.select("id", "ord", "from_id", "to_id", sides).filter("target IS NOT NULL")
    other = links.select(F.col("id").alias("target"), F.col("from_id").alias("t_from"), F.col("to_id").alias("t_to"), F.col("r_id").alias("t_r"), F.col("l_id").alias("t_l"))
    return refs.join(other, "target").withColumn("back", F.when(F.col("side") == "l_id", F.col("t_r")).otherwise(F.col("t_l")))


def longitudinal(links: DataFrame) -> DataFrame:
    """id, side, target, node: side references to a link that goes on from this one or leads to it."""
    node = F.when(F.col("to_id") == F.col("t_from"), F.col("to_id")).when(F.col("from_id") == F.col("t_to"), F.col("from_id"))
    return side_references(links).withColumn("node", node).filter("node IS NOT NULL").select("id", "side", "target", "node")


def clear_longitudinal(links: DataFrame, layer: str = "link") -> tuple[DataFrame, DataFrame]:
    """(links without such references, findings). The relation is mutual, so a reference back goes by itself."""
    found = settled(longitudinal(links))
    hit = found.groupBy("id").agg(*(F.max(F.col("side") == s).alias(f"__{s}") for s in _INVERSE))
    out = links.join(hit, "id", "left")
    for s in _INVERSE:
        out = out.withColumn(s, F.when(F.coalesce(F.col(f"__{s}"), F.lit(False)), None).otherwise(F.col(s)))
    acted = findings(found, "action", "link-side-reference-longitudinal-cleared", layer, F.col("id"), F.concat(F.col("side"), F.lit(" "), F.col("node").cast("string")), F.create_map("side", F.col("target").cast("string")))
    return out.select(*links.columns), acted


def nonreciprocal(links: DataFrame) -> DataFrame:
    """id, side, target, n_candidates, redirect: side references whose target does not point back.

    Candidates are the links whose inverse side points here; redirect is the only one, else null.
    """
    lost = side_references(links).filter("NOT (back <=> id)")
    inverse = links.select("id", F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(_INVERSE[s]).alias("points_at")) for s in _INVERSE)))).filter("points_at IS NOT NULL")
    counts = inverse.groupBy(F.col("points_at").alias("id"), "side").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    out = lost.select("id", "side", "target").join(counts, ["id", "side"], "left")
    return out.select("id", "side", "target", F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"), F.when(F.col("n") == 1, F.col("only")).alias("redirect"))


def redirect_nonreciprocal(links: DataFrame, layer: str = "link") -> tuple[DataFrame, DataFrame]:
    """(redirected links, findings). All decisions come from one snapshot, so link order does not matter."""
    found = settled(nonreciprocal(links))
    hit = found.filter("redirect IS NOT NULL").groupBy("id").agg(*(F.max(F.when(F.col("side") == s, F.col("redirect"))).alias(f"__{s}") for s in _INVERSE))
    out = links.join(hit, "id", "left")
    for s in _INVERSE:
        out = out.withColumn(s, F.coalesce(f"__{s}", s))
    before, after = F.create_map("side", F.col("target").cast("string")), F.create_map("side", F.col("redirect").cast("string"))
    acted = findings(found.filter("redirect IS NOT NULL"), "action", "link-side-reference-nonreciprocal-redirected", layer, F.col("id"), F.col("side"), before, after)
    warned = findings(found.filter("redirect IS NULL"), "warning", "link-side-reference-nonreciprocal-ambiguous", layer, F.col("id"), F.concat(F.col("side"), F.lit(" "), F.col("n_candidates").cast("string")), before)
    return out.select(*links.columns), acted.unionByName(warned)


def reciprocal_state(rows: DataFrame, column: str, inverse: str) -> DataFrame:
    """id, target, state: fill (the target's empty slot, first writer by ord), conflict (the slot holds another), for rule column -> inverse.

    Where several rows share the target's id, the first writer meets the empty slot before filled ones, whatever order rows come in.
    """
    from pyspark.sql import Window

    refs = rows.filter(F.col(column).isNotNull()).select("id", "ord", F.col(column).alias("target"))
    slots = rows.select(F.col("id").alias("target"), F.col(inverse).alias("slot"))
    found = refs.join(slots, "target").filter("NOT (slot <=> id)")
    writer = F.row_number().over(Window.partitionBy("target").orderBy("ord", "id", F.col("slot").isNotNull(), "slot"))
    ranked = found.withColumn("n", F.when(F.col("slot").isNull(), writer))
    return ranked.select("id", "target", F.when(F.col("n") == 1, "fill").otherwise("conflict").alias("state"))


def fill_reciprocal(rows: DataFrame, rules: list[tuple[str, str]], layer: str = "link") -> tuple[DataFrame, DataFrame]:
    """(rows with empty inverse references filled, findings), one rule after another."""
    parts, columns = [], rows.columns
    for column, inverse in rules:
        state = settled(reciprocal_state(rows, column, inverse))
        fills = state.filter("state = 'fill'").select(F.col("target").alias("id"), F.col("id").alias("__new"))
        rows = rows.join(fills, "id", "left").withColumn(inverse, F.coalesce(inverse, "__new")).select(*columns)
        text = F.col("id").cast("string")
        parts.append(findings(state.filter("state = 'fill'"), "action", "reciprocal-reference-missing-filled", layer, F.col("target"), F.concat(F.lit(f"{inverse} "), text), after=F.create_map(F.lit(inverse), text)))
        parts.append(findings(state.filter("state = 'conflict'"), "warning", "reciprocal-reference-conflict", layer, F.col("target"), F.concat(F.lit(f"{inverse} "), text)))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return rows, found


def votes(links: DataFrame) -> DataFrame:
    """id, swap: links with exactly one end that another link touches; swap says it is the from end."""
    return _end_degrees(links).filter("many_from <> many_to").select("id", F.col("many_from").alias("swap"))


def orientation_groups(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, grp: every link id once, joined by side references or by node groups; grp is the smallest id.

    A node group joins its links through its first link, so pairs grow with the links.
    """
    known = links.select(F.col("id").alias("b"))
    sides = links.select(F.col("id").alias("a"), F.explode(F.array("r_id", "l_id")).alias("b")).filter("b IS NOT NULL").join(known, "b", "left_semi")
    at = settled(link_ends(links).join(nodes.filter("group_key IS NOT NULL AND group_key <> ''").select(F.col("id").alias("node"), "group_key"), "node").select("id", "group_key"))
    first = settled(at.groupBy("group_key").agg(F.min("id").alias("b")))
    forest = star_forest(sides.select("a", "b").unionByName(at.join(first, "group_key").select(F.col("id").alias("a"), "b")))
    return links.select("id").distinct().join(forest.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("grp"))


def orientation(links: DataFrame, nodes: DataFrame, groups: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """id, grp, swap, verdict, flip for every link.

    verdict: skipped (its group has no strict majority), invalid (too few points), unresolved, fits, both
    (fits either way), misaligned. swap is the link's own vote or its group's; flip reverses the polyline.
    """
    own = votes(links)
    voted = settled(groups.join(own, "id", "left"))
    # groups with a strict majority only: one group may hold most links
    major = settled(voted.filter("swap IS NOT NULL").groupBy("grp").agg(F.sum(F.when(F.col("swap"), 1).otherwise(-1)).alias("lead")).filter("lead <> 0"))
    judged = voted.join(major, "grp", "left").select("id", "grp", F.coalesce("swap", F.col("lead") > 0).alias("swap"), F.col("lead").isNotNull().alias("decided"))
    ends = F.struct(F.size("coords").alias("n"), first_point(F.col("coords")).alias("start"), last_point(F.col("coords")).alias("end"))
    rows = links.select("id", "from_id", "to_id", ends.alias("line")).join(judged, "id")
    want_from, want_to = F.when(F.col("swap"), F.col("to_id")).otherwise(F.col("from_id")), F.when(F.col("swap"), F.col("from_id")).otherwise(F.col("to_id"))
    rows = rows.withColumns({"__f": want_from, "__t": want_to})
    for side in "ft":
        rows = rows.join(nodes.select(F.col("id").alias(f"__{side}"), F.struct("x", "y").alias(f"__p{side}")), f"__{side}", "left")
    start, end = F.col("line.start"), F.col("line.end")

    def near(p: Column, node: str) -> Column:
        return distance(p, F.col(node)) <= tolerance

    same, turned = near(start, "__pf") & near(end, "__pt"), near(start, "__pt") & near(end, "__pf")
    verdict = (
        F.when(~F.col("decided"), "skipped")
        .when(F.col("line.n") < 2, "invalid")
        .when(F.col("__pf").isNull() | F.col("__pt").isNull(), "unresolved")
        .when(same & turned, "both")
        .when(same | turned, "fits")
        .otherwise("misaligned")
    )
    return rows.select("id", "grp", "swap", verdict.alias("verdict"), ((verdict == "fits") & turned).alias("flip"))


def orient(links: DataFrame, decisions: DataFrame, layer: str = "link") -> tuple[DataFrame, DataFrame]:
    """(links with ids swapped and polylines reversed where the verdict fits, findings)."""
    decisions = settled(decisions)
    hit = decisions.filter("verdict = 'fits'").select("id", F.col("swap").alias("__swap"), F.col("flip").alias("__flip"))
    rows = links.join(hit, "id", "left")
    swap, flip = F.coalesce("__swap", F.lit(False)), F.coalesce("__flip", F.lit(False))
    out = rows.withColumns({"from_id": F.when(swap, F.col("to_id")).otherwise(F.col("from_id")), "to_id": F.when(swap, F.col("from_id")).otherwise(F.col("to_id")), "coords": F.when(flip, F.reverse("coords")).otherwise(F.col("coords"))}).select(*links.columns)
    what = F.concat_ws(" and ", F.when(F.col("swap"), "swap FromNodeID/ToNodeID"), F.when(F.col("flip"), "reverse polyline"))
    acted = findings(decisions.filter("verdict = 'fits' AND (swap OR flip)"), "action", "link-orientation-reversed-repaired", layer, F.col("id"), what)
    codes = {"invalid": "link-orientation-geometry-invalid", "unresolved": "link-orientation-endpoint-unresolved", "misaligned": "link-endpoint-misaligned"}
    code = F.element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), F.col("verdict"))
    warned = findings(decisions.filter(F.col("verdict").isin(*codes)), "warning", code, layer, F.col("id"), "")
    skipped = findings(decisions.filter("verdict = 'skipped'").select("grp").distinct(), "warning", "link-orientation-reversed-ambiguous", layer, F.col("grp"), "no strict majority of votes")
    return out, acted.unionByName(warned).unionByName(skipped)
