"""Road structure from links and nodes: U-turns, lateral groups, junctions and what joins them.

links carry id, ord, from_id, to_id, r_id, l_id, lane_no, coords and the flags of classified(); nodes
id, ord, x, y, z and group_key. Results are long tables (one row per member), which later stages join;
entities are numbered from 0 by first appearance. Hubs are star-shaped sets of pairs, so their number
grows with the links.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.geometry import first_point, last_point, norm, segments, tangent
from ..functions.text import stripped
from ..schema import RoleFilter, Schema
from .components import numbered, placed_components, settled, star_forest
from .sections import section_of
from .spatial import crossing_pairs, distance_join


def matches(rule: RoleFilter) -> Column:
    """The predicate of a role filter."""
    found = F.lit(False)
    for c in rule.columns:
        value = stripped(F.col(c))
        found |= F.coalesce(value.try_cast("double") >= rule.least, F.lit(False)) if rule.least is not None else value.isin(*rule.values)
    return found


FLAGS = {"is_junction": "junction_link", "is_ordinary": "ordinary_link", "is_pocket": "pocket_link", "is_uturn": "uturn_link"}


def classified(links: DataFrame, schema: Schema) -> DataFrame:
    """links with one flag per role filter; a filter that the version lacks is false."""
    rules = {r.name: r for r in schema.filters}
    return links.withColumns({flag: matches(rules[name]) if name in rules else F.lit(False) for flag, name in FLAGS.items()})


def role_keys(nodes: DataFrame, column: str = "group_key", name: str = "node_group") -> DataFrame:
    """id, key: `name:value` of nodes whose column is not empty."""
    return nodes.filter(stripped(F.col(column)) != "").select("id", F.concat(F.lit(f"{name}:"), stripped(F.col(column))).alias("key"))


def lateral_neighbours(links: DataFrame) -> DataFrame:
    """id, side (left or right), other: by the link's own side reference or by the other's inverse one."""
    return neighbours(links).distinct()


def neighbours(links: DataFrame) -> DataFrame:
    """The rows of lateral_neighbours, of which a mutual pair comes twice."""
    sides = F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.lit(back).alias("back"), F.col(c).alias("other")) for s, back, c in (("left", "right", "l_id"), ("right", "left", "r_id")))))
    refs = links.filter("id IS NOT NULL").select("id", sides).filter("other IS NOT NULL").join(links.select(F.col("id").alias("other")), "other", "left_semi")
    return refs.select(F.inline(F.array(F.struct("id", "side", "other"), F.struct(F.col("other").alias("id"), F.col("back").alias("side"), F.col("id").alias("other")))))


def side_pairs(links: DataFrame) -> DataFrame:
    """id, other: every side reference as it stands, for components, which need neither its direction nor each pair once."""
    return links.select("id", F.explode(F.array("l_id", "r_id")).alias("other")).filter("other IS NOT NULL")


def ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, ord, side, node: ends at existing nodes."""
    cells = F.inline(F.array(F.struct(F.lit("from").alias("side"), F.col("from_id").alias("node")), F.struct(F.lit("to").alias("side"), F.col("to_id").alias("node"))))
    return links.select("id", "ord", cells).join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select("id", "ord", "side", "node")


def _own_section(pairs: DataFrame, by_section: bool) -> DataFrame:
    """Crossing pairs, within sections only where ids carry them."""
    return pairs.filter(section_of(F.col("a_id")).eqNullSafe(section_of(F.col("b_id")))) if by_section else pairs


def uturns(links: DataFrame, markers: DataFrame, z_tolerance: float = 1.0, by_section: bool = False, declared: bool | None = None) -> DataFrame:
    """id, link, markers: declared U-turn links if there are any, else ordinary links that cross a U-turn marking.

    declared says whether there are any where links are a part of a map.
    """
    direct = links.filter("is_uturn").select(F.col("id").alias("link"), "ord", F.expr(f"CAST(array() AS array<{markers.schema['id'].dataType.simpleString()}>)").alias("markers"))
    if declared is False or declared is None and direct.isEmpty():
        hit = _own_section(crossing_pairs(links.filter("is_ordinary").select("id", "coords"), markers.select("id", "coords"), z_tolerance), by_section)
        found = hit.groupBy(F.col("a_id").alias("link")).agg(F.array_sort(F.collect_set("b_id")).alias("markers"))
        # numbering looks at its rows twice, and crossings are dear
        direct = settled(found.join(links.select(F.col("id").alias("link"), "ord"), "link"))
    return numbered(direct, "ord", "id").select("id", "link", "markers")


def lateral_groups(links: DataFrame, uturn_links: DataFrame, lateral: DataFrame | None = None) -> DataFrame:
    """grp, id, ord: ordinary links without U-turns, grouped with their lateral neighbours: pairs (id, other), by default the links' own."""
    lateral = side_pairs(links) if lateral is None else lateral
    items = links.filter("is_ordinary").join(uturn_links.select(F.col("link").alias("id")), "id", "left_anti").groupBy("id").agg(F.min("ord").alias("ord"))
    return placed_components(settled(items), lateral, "id", "ord", "id", "other").select(F.col("component").alias("grp"), "id", "ord")


def reference_links(groups: DataFrame, links: DataFrame, lateral: DataFrame) -> DataFrame:
    """grp, first_link, reference, source, warning: each group's link that the others count from.

    The only one with lane number 1 among links that are no pockets; else the only one without such a
    left neighbour in the group; else none, with the reason.
    """
    member = groups.join(links.select("id", "lane_no", "is_pocket"), "id")
    plain = member.filter("NOT is_pocket").select("grp", "id", "lane_no")
    left = lateral.filter("side = 'left'").select("id", "other").join(plain.select(F.col("id").alias("other"), "grp"), "other").select("id", "grp").distinct().withColumn("has_left", F.lit(True))
    edge = plain.join(left, ["id", "grp"], "left").withColumns({"lane1": F.coalesce(F.col("lane_no") == 1, F.lit(False)), "edge": F.col("has_left").isNull()})
    counts = edge.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("lane1").alias("n_lane1"), F.min(F.when(F.col("lane1"), F.col("id"))).alias("by_lane"), F.count_if("edge").alias("n_edge"), F.min(F.when(F.col("edge"), F.col("id"))).alias("by_edge"))
    every = groups.groupBy("grp").agg(F.min_by("id", "ord").alias("first_link"))
    rows = every.join(counts, "grp", "left")
    one, by_edge = F.col("n_lane1") == 1, F.col("n_edge") == 1
    none = F.col("n").isNull()
    many = F.when(F.col("n_lane1") > 1, "multiple lane_no_1 candidates; ").otherwise("")
    text = F.when(by_edge, F.when(F.col("n_lane1") > 1, F.concat(many, F.lit("topology selected"))).otherwise("")).when(F.col("n_edge") == 0, F.concat(many, F.lit("no non-pocket left edge"))).otherwise(F.concat(many, F.lit("multiple non-pocket left edges")))
    return rows.select("grp", "first_link", F.when(one, F.col("by_lane")).when(by_edge, F.col("by_edge")).alias("reference"), F.when(none | one, "lane_no").otherwise("lateral_topology").alias("source"), F.when(none, "no non-pocket links").when(one, "").otherwise(text).alias("warning"))


def node_groups(groups: DataFrame, link_ends: DataFrame) -> DataFrame:
    """node_grp, grp, side, node: the nodes at each side of each lateral group."""
    rows = groups.select("grp", "id").join(link_ends.select("id", "side", "node"), "id").select("grp", "side", "node").distinct()
    rows = settled(rows)
    order = F.col("grp") * 2 + F.when(F.col("side") == "to", 1).otherwise(0)
    ids = numbered(rows.select("grp", "side", order.alias("o")).distinct(), "o", "node_grp").select("grp", "side", "node_grp")
    return rows.join(ids, ["grp", "side"]).select("node_grp", "grp", "side", "node")


def node_group_keys(node_grp: DataFrame, keys: DataFrame) -> DataFrame:
    """node_grp, keys: the distinct role keys (id, key) of each node group's nodes, sorted."""
    held = node_grp.select("node_grp", F.col("node").alias("id")).join(keys, "id")
    return held.groupBy("node_grp").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def least_distance(a: DataFrame, b: DataFrame, by: str, reach: float) -> DataFrame:
    """by, distance: the least planar distance between points of a and of b with the same key, where it is at most reach. Both have by, x, y."""
    return distance_join(a, b, reach, [by]).groupBy(by).agg(F.min("distance").alias("distance"))


def _star(rows: DataFrame, hub: list[str], item: str = "id") -> DataFrame:
    """(a, b): every item of a hub with the hub's smallest."""
    least = rows.groupBy(*hub).agg(F.min(item).alias("a"))
    return rows.join(least, hub).select("a", F.col(item).alias("b"))


def junctions(links: DataFrame, groups: DataFrame, node_grp: DataFrame, link_ends: DataFrame, lateral: DataFrame, z_tolerance: float = 1.0, by_section: bool = False) -> DataFrame:
    """junction, id, kind (seed, promoted or owner): junction links, what they pull in, and bridges between them."""
    seeds = settled(links.filter("is_junction").select("id", "ord", "coords"))
    seed = seeds.select("id")
    is_seed = seed.withColumn("seed", F.lit(True))
    next_to = lateral.select("id", "other").join(seed, "id", "left_semi").join(is_seed.withColumnRenamed("id", "other"), "other", "left")
    seed_ends = link_ends.join(seed, "id", "left_semi").select("id", "side", "node")
    shared = _star(seed_ends.select("node", "id").distinct(), ["node"])
    beside = next_to.filter("seed").select(F.col("id").alias("a"), F.col("other").alias("b"))
    # a link that leaves where a seed leaves, or arrives where it arrives, comes with its whole group
    # one seed stands for all at a node, as they are together anyway
    touched = link_ends.select(F.col("id").alias("b"), "side", "node").join(seed_ends.groupBy("side", "node").agg(F.min("id").alias("a")), ["side", "node"]).select("a", "b").join(seed.withColumnRenamed("id", "b"), "b", "left_anti")
    in_group = groups.select(F.col("id").alias("b"), "grp")
    sideways = next_to.filter("seed IS NULL").select(F.col("id").alias("a"), F.col("other").alias("b")).join(in_group, "b", "left_semi")
    pulled = settled(touched.unionByName(sideways).distinct())
    pulled_groups = pulled.join(in_group, "b").select("grp").distinct()
    members = settled(groups.join(pulled_groups, "grp", "left_semi").join(seed, "id", "left_anti").select("grp", "id"))
    promoted = pulled.select(F.col("b").alias("id")).unionByName(members.select("id")).distinct()
    tied = _star(members, ["grp"])
    kind = settled(seed.withColumn("kind", F.lit("seed")).unionByName(promoted.withColumn("kind", F.lit("promoted"))))
    # bridges: links of these kinds that touch one node group at the same end
    # the links at a node are the same for all its node groups, so they meet in a star at the node, and a node group joins its nodes' stars
    grouped = node_grp.select("node_grp", "node")
    at_node = settled(link_ends.select("id", F.col("side").alias("end"), "node").join(kind, "id"))
    of_kind = [F.max(F.col("kind") == k).alias(c) for k, c in (("seed", "s"), ("promoted", "p"))]
    stars = settled(at_node.groupBy("node", "end").agg(F.min("id").alias("m"), *of_kind).join(grouped, "node", "left_semi"))
    touching = at_node.join(stars.select("node", "end", F.col("m").alias("a")), ["node", "end"]).select("a", F.col("id").alias("b"))
    reach = settled(grouped.join(stars, "node").select("node_grp", "end", "m", "s", "p"))
    hubs = settled(reach.groupBy("node_grp", "end").agg(F.min("m").alias("a"), F.max("s").alias("s"), F.max("p").alias("p")))
    bridge = touching.unionByName(reach.select("node_grp", "end", F.col("m").alias("b")).join(hubs.select("node_grp", "end", "a"), ["node_grp", "end"]).select("a", "b"))
    mixed = hubs.filter("s AND p").select("node_grp", "end", "a").join(node_grp.select("node_grp", "grp", "node"), "node_grp")
    # by group and node together: a group may be as large as the network
    own_ends = link_ends.select("id", F.col("side").alias("end"), "node").join(groups.select("grp", "id"), "id")
    owners = settled(mixed.join(own_ends, ["grp", "node", "end"]).select("a", F.col("id").alias("b")).distinct())
    items = kind.unionByName(owners.select(F.col("b").alias("id")).distinct().join(kind, "id", "left_anti").withColumn("kind", F.lit("owner")))
    pairs = beside
    for more in (shared, pulled.select("a", "b"), tied, bridge, owners):
        pairs = pairs.unionByName(more.select("a", "b"))
    part = star_forest(pairs).select(F.col("node").alias("id"), F.col("component").alias("part"))
    # crossings are looked for between parts only: links at one node cross all over, and are together anyway
    apart = settled(seeds.select("id", "coords").join(part, "id", "left").select(F.coalesce("part", "id").alias("id"), "coords"))
    crossing = _own_section(crossing_pairs(apart, apart, z_tolerance, once=True), by_section)
    whole = star_forest(crossing, "a_id", "b_id").select(F.col("node").alias("part"), F.col("component").alias("root"))
    rooted = items.join(part, "id", "left").select("id", "kind", F.coalesce("part", "id").alias("part"))
    rooted = settled(rooted.join(whole, "part", "left").select("id", "kind", F.coalesce("root", "part").alias("root")))
    first = rooted.join(seeds.select("id", "ord"), "id").groupBy("root").agg(F.min("ord").alias("o"))
    return rooted.join(numbered(first, "o", "junction"), "root").select("junction", "id", "kind")


def junction_nodes(junction: DataFrame, link_ends: DataFrame) -> DataFrame:
    """junction, node: end nodes of a junction's links. Nodes of several junctions appear in each."""
    return junction.join(link_ends.select("id", "node"), "id").select("junction", "node").distinct()


def junction_matches(groups: DataFrame, node_grp: DataFrame, junction: DataFrame, nodes_of: DataFrame, link_ends: DataFrame) -> DataFrame:
    """node_grp, grp, side, junction, method: node groups of outer link groups with their best junction."""
    inner = groups.join(junction.select("id").distinct(), "id", "left_semi").select("grp").distinct()
    outer = settled(node_grp.join(inner, "grp", "left_anti"))
    shared = outer.join(nodes_of, "node").select("node_grp", "grp", "side", "junction", F.lit(0).alias("priority"))
    beside = outer.join(link_ends.select("id", "node"), "node").join(junction.select("junction", "id"), "id").select("node_grp", "grp", "side", "junction", F.lit(1).alias("priority"))
    best = shared.unionByName(beside).groupBy("node_grp", "grp", "side").agg(F.min(F.struct("priority", "junction")).alias("m"))
    return best.select("node_grp", "grp", "side", F.col("m.junction").alias("junction"), F.when(F.col("m.priority") == 0, "shared_node").otherwise("graph_adjacency").alias("method"))


def end_geometry(links: DataFrame, lookback: float = 1.0) -> DataFrame:
    """id, side, anchor, tangent: both ends of every link whose direction is defined."""
    cells = F.inline(F.array(*(F.struct(F.lit(s).alias("side"), p(F.col("coords")).alias("anchor"), tangent(F.col("coords"), s, lookback).alias("tangent")) for s, p in (("from", first_point), ("to", last_point)))))
    return links.filter("size(coords) >= 2").select("id", cells).filter("tangent IS NOT NULL")


def pair_candidates(match: DataFrame, node_grp: DataFrame, nodes: DataFrame, refs: DataFrame, geometry: DataFrame, config: Config | None = None) -> DataFrame:
    """junction, to_grp, from_grp, priority, distance: an arriving and a leaving node group that may be one connection."""
    config = config or Config()
    at = settled(match.join(node_grp.select("node_grp", "node"), "node_grp").join(nodes.select(F.col("id").alias("node"), "x", "y", "group_key"), "node"))
    sides = {s: at.filter(F.col("side") == s).select(F.col("junction").alias(f"{s}_junction"), F.col("node_grp").alias(f"{s}_grp"), F.col("group_key").alias(f"{s}_key"), "x", "y") for s in ("to", "from")}
    near = distance_join(sides["to"].withColumnRenamed("to_junction", "at"), sides["from"].withColumnRenamed("from_junction", "at"), config.merge_distance_m, ["at"]).withColumnRenamed("at", "to_junction").groupBy(F.col("to_junction").alias("junction"), "to_grp", "from_grp").agg(F.min("distance").alias("distance"))
    keys = {s: sides[s].filter(f"{s}_key <> ''").select(f"{s}_grp", F.col(f"{s}_key").alias("key")).distinct() for s in sides}
    same = near.select("to_grp", "from_grp").join(keys["to"], "to_grp").join(keys["from"], ["from_grp", "key"]).select("to_grp", "from_grp").distinct().withColumn("shared", F.lit(True))
    link = match.join(refs.select("grp", F.coalesce("reference", "first_link").alias("id")), "grp").join(geometry.select("id", "side", "tangent"), ["id", "side"]).select("node_grp", "tangent")
    way = {s: link.select(F.col("node_grp").alias(f"{s}_grp"), F.col("tangent").alias(f"{s}_way")) for s in ("to", "from")}
    rows = near.join(way["to"], "to_grp").join(way["from"], "from_grp").join(same, ["to_grp", "from_grp"], "left")
    dot = F.col("to_way.x") * F.col("from_way.x") + F.col("to_way.y") * F.col("from_way.y")
    return rows.filter(dot <= -config.opposite_dot_min).select("junction", "to_grp", "from_grp", F.when(F.col("shared"), 0).otherwise(1).alias("priority"), "distance")


_ORDER = ["priority", "distance", "to_grp", "from_grp"]
#: Candidates of a junction up to which one task chooses.
TASK_CANDIDATES = 50_000


def _chosen(rows: pa.Table) -> pa.Table:
    """The choice for one junction: the candidates in order, each unless one of its ends is taken."""
    rows = rows.sort_by([(c, "ascending") for c in _ORDER])
    used: dict[str, set] = {"to": set(), "from": set()}
    keep = []
    for to, frm in zip(rows.column("to_grp").to_pylist(), rows.column("from_grp").to_pylist(), strict=True):
        free = to not in used["to"] and frm not in used["from"]
        keep.append(free)
        if free:
            used["to"].add(to)
            used["from"].add(frm)
    return rows.filter(pa.array(keep, pa.bool_()))


def greedy_pairs(candidates: DataFrame) -> DataFrame:
    """The candidates that a greedy one-to-one choice in order (priority, distance, to_grp, from_grp) takes.

    Junctions are independent, so a task chooses for each whole junction. For one of more than TASK_CANDIDATES, which
    need not fit a task, every pair that is best for both its ends is taken round by round: the order is total, so the
    choice is the same.
    """
    counted = settled(candidates.withColumn("__n", F.count("*").over(Window.partitionBy("junction"))))
    taken = counted.filter(F.col("__n") <= TASK_CANDIDATES).drop("__n").groupBy("junction").applyInArrow(_chosen, candidates.schema)
    left = counted.filter(F.col("__n") > TASK_CANDIDATES).drop("__n")
    while not left.isEmpty():
        ranks = {f"__{s}": F.row_number().over(Window.partitionBy("junction", f"{s}_grp").orderBy(*_ORDER)) for s in ("to", "from")}
        best = settled(left.withColumns(ranks).filter("__to = 1 AND __from = 1").select(*candidates.columns))
        taken = taken.unionByName(best)
        left = settled(left.join(best.select("junction", "to_grp"), ["junction", "to_grp"], "left_anti").join(best.select("junction", "from_grp"), ["junction", "from_grp"], "left_anti"))
    return taken


def connections(match: DataFrame, pairs: DataFrame) -> DataFrame:
    """connection, junction, node_grp, grp, side, method: pairs first, then what stays one-sided, by junction."""
    both = pairs.select("junction", "priority", "distance", "to_grp", "from_grp", F.explode(F.array("to_grp", "from_grp")).alias("node_grp"))
    rows = match.join(both.drop("junction"), "node_grp", "left")
    single = F.col("to_grp").isNull()
    order = F.struct("junction", single.alias("single"), F.coalesce("priority", F.lit(0)).alias("p"), F.coalesce("distance", F.lit(0.0)).alias("d"), F.coalesce("to_grp", "node_grp").alias("t"), F.coalesce("from_grp", "node_grp").alias("f"))
    rows = settled(rows.select("junction", "node_grp", "grp", "side", F.when(single, "one_sided").when(F.col("priority") == 0, "node_group_key,opposite_direction").otherwise("opposite_direction").alias("method"), order.alias("o")))
    ids = numbered(rows.select("o").distinct(), "o", "connection")
    return rows.join(ids, "o").select("connection", "junction", "node_grp", "grp", "side", "method")


def junction_references(connection: DataFrame, node_grp: DataFrame, nodes_of: DataFrame, refs: DataFrame, links: DataFrame, geometry: DataFrame) -> DataFrame:
    """connection, junction, link, side, source, anchor, tangent, reversed_from_source: one link per connection.

    A reference link counts by its arriving end at the connection; by its leaving end only where the
    connection is outbound only. The smallest (lane number, group, id) wins.
    """
    at = connection.join(node_grp.select("node_grp", "node"), "node_grp").select("connection", "junction", "node").distinct()
    outbound = connection.groupBy("connection").agg(F.bool_and(F.col("side") == "from").alias("outbound"))
    ref = connection.select("connection", "junction", "grp").distinct().join(refs.filter("reference IS NOT NULL").select("grp", F.col("reference").alias("id"), "source"), "grp").join(links.select("id", "from_id", "to_id", "lane_no"), "id")
    hit = ref.join(at.select("connection", F.col("node").alias("to_id"), F.lit(True).alias("__to")), ["connection", "to_id"], "left").join(at.select("connection", F.col("node").alias("from_id"), F.lit(True).alias("__from")), ["connection", "from_id"], "left").join(outbound, "connection")
    side = F.when(F.col("__to"), "to").when(F.col("__from") & F.col("outbound"), "from")
    key = F.struct(F.coalesce("lane_no", F.lit(1_000_000)).alias("lane"), F.col("grp").alias("g"), F.col("id").alias("i"), side.alias("side"), F.concat(F.col("source"), F.when(side == "to", ":toward_junction").otherwise(":out_of_junction")).alias("source"))
    best = hit.filter(side.isNotNull()).groupBy("connection", "junction").agg(F.min(key).alias("k"))
    out = best.select("connection", "junction", F.col("k.i").alias("id"), F.col("k.side").alias("side"), F.col("k.source").alias("source"))
    return out.join(geometry, ["id", "side"]).select("connection", "junction", F.col("id").alias("link"), "side", "source", "anchor", "tangent", F.lit(False).alias("reversed_from_source"))


def centroids(junction: DataFrame, nodes_of: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """junction, cx, cy: length-weighted middle of the links' segments; without length the mean of the end nodes."""
    s = segments(junction.join(links.select("id", "coords"), "id"), ["junction"])
    w = norm(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    by_line = s.groupBy("junction").agg((F.sum((F.col("ax") + F.col("bx")) / 2 * w) / F.sum(w)).alias("lx"), (F.sum((F.col("ay") + F.col("by")) / 2 * w) / F.sum(w)).alias("ly"))
    by_node = nodes_of.join(nodes.select(F.col("id").alias("node"), "x", "y"), "node").groupBy("junction").agg(F.avg("x").alias("nx"), F.avg("y").alias("ny"))
    every = junction.select("junction").distinct()
    return every.join(by_line, "junction", "left").join(by_node, "junction", "left").select("junction", F.coalesce("lx", "nx").alias("cx"), F.coalesce("ly", "ny").alias("cy")).filter("cx IS NOT NULL")


def junction_edges(references: DataFrame, connection: DataFrame, node_grp: DataFrame, groups: DataFrame, centre: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """connection, junction, link, node, px, py, start, end, n_crossings: the cross-section where a connection leaves its junction.

    It stands at the node farthest outward and spans the outermost crossings of the connection's links
    with the line across; without two distinct ones it spans the nodes' projections.
    """
    r = references.join(centre, "junction")
    # rounded far below any real distance: the centre is a sum whose last digits depend on its order
    out = F.round(F.col("tangent.x") * (F.col("anchor.x") - F.col("cx")) + F.col("tangent.y") * (F.col("anchor.y") - F.col("cy")), 6) >= 0
    sign = F.when(out, 1.0).otherwise(-1.0)
    r = r.select("connection", "junction", "link", "anchor", (F.col("tangent.x") * sign).alias("fx"), (F.col("tangent.y") * sign).alias("fy"))
    at = connection.select("connection", "node_grp").join(node_grp.select("node_grp", "node"), "node_grp").select("connection", "node").distinct().join(nodes.select(F.col("id").alias("node"), "x", "y", "z"), "node")
    ahead = (F.col("x") - F.col("anchor.x")) * F.col("fx") + (F.col("y") - F.col("anchor.y")) * F.col("fy")
    far = r.join(at, "connection").groupBy("connection").agg(F.min(F.struct((-ahead).alias("s"), "node", F.struct("x", "y", "z").alias("p"))).alias("k"))
    r = settled(r.join(far, "connection").select("connection", "junction", "link", "fx", "fy", (-F.col("fy")).alias("px"), F.col("fx").alias("py"), F.col("k.node").alias("node"), F.col("k.p").alias("o")))
    own = connection.select("connection", "grp").distinct().join(groups.select("grp", "id"), "grp").select("connection", "id").distinct()
    s = F.posexplode(F.arrays_zip(F.slice("coords", 1, F.size("coords") - 1).alias("a"), F.slice("coords", 2, F.size("coords") - 1).alias("b"))).alias("seg", "e")
    seg = r.join(own, "connection").join(links.filter("size(coords) >= 2").select("id", "coords"), "id").select("connection", "id", "fx", "fy", "px", "py", "o", s)

    def station(p: str) -> Column:
        return (F.col(f"e.{p}.x") - F.col("o.x")) * F.col("fx") + (F.col(f"e.{p}.y") - F.col("o.y")) * F.col("fy")

    seg = seg.withColumns({"sa": station("a"), "sb": station("b")})
    ratio = -F.col("sa") / (F.col("sb") - F.col("sa"))
    mid = F.struct(*((F.col(f"e.a.{c}") + (F.col(f"e.b.{c}") - F.col(f"e.a.{c}")) * ratio).alias(c) for c in "xyz"))
    hits = F.when((F.col("sa") == 0) & (F.col("sb") == 0), F.array("e.a", "e.b")).when(F.col("sa") == 0, F.array("e.a")).when(F.col("sb") == 0, F.array("e.b")).when(F.col("sa") * F.col("sb") < 0, F.array(mid))
    points = seg.select("connection", "px", "py", "o", F.explode(hits).alias("p"))

    def spanned(rows: DataFrame) -> DataFrame:
        lateral = (F.col("p.x") - F.col("o.x")) * F.col("px") + (F.col("p.y") - F.col("o.y")) * F.col("py")
        both = rows.withColumn("t", lateral).groupBy("connection").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min(F.struct("t", "p")).alias("lo"), F.max(F.struct("t", "p")).alias("hi"))
        return both.filter("n >= 2 AND t0 < t1").select("connection", "n", F.col("lo.p").alias("start"), F.col("hi.p").alias("end"))

    lateral = (F.col("x") - F.col("o.x")) * F.col("px") + (F.col("y") - F.col("o.y")) * F.col("py")
    moved = F.struct((F.col("o.x") + F.col("px") * lateral).alias("x"), (F.col("o.y") + F.col("py") * lateral).alias("y"), F.col("z").alias("z"))
    crossed, projected = spanned(points), spanned(r.join(at.drop("node"), "connection").select("connection", "px", "py", "o", moved.alias("p")))
    rest = projected.join(crossed.select("connection"), "connection", "left_anti").withColumn("n", F.lit(0).cast("long"))
    return r.join(crossed.unionByName(rest), "connection").select("connection", "junction", "link", "node", "px", "py", "start", "end", F.col("n").alias("n_crossings"))


def segment(links: DataFrame, nodes: DataFrame, markers: DataFrame, config: Config | None = None, by_section: bool = False, declared: bool | None = None) -> dict[str, DataFrame]:
    """All stages in order, by name. A stage that is switched off, or whose inputs are, is left out; one without result stays as an empty table.

    by_section keeps links of different sections apart where they cross, with ids that carry their section; declared is
    for links that are a part of a map (see uturns).
    """
    config = config or Config()
    out: dict[str, DataFrame] = {}
    lateral, link_ends = settled(neighbours(links)), settled(ends(links, nodes))

    def ready(name: str, *needs: str) -> bool:
        return name in config.stages and all(n in out for n in needs)

    if ready("uturns"):
        out["uturns"] = settled(uturns(links, markers, config.z_intersection_tol_m, by_section, declared))
    if ready("lateral_groups", "uturns"):
        out["lateral_groups"] = settled(lateral_groups(links, out["uturns"]))
        out["group_references"] = settled(reference_links(out["lateral_groups"], links, lateral))
    if ready("node_groups", "lateral_groups"):
        out["node_groups"] = settled(node_groups(out["lateral_groups"], link_ends))
    if ready("junctions", "lateral_groups", "node_groups"):
        out["junctions"] = settled(junctions(links, out["lateral_groups"], out["node_groups"], link_ends, lateral, config.z_intersection_tol_m, by_section))
        out["junction_nodes"] = settled(junction_nodes(out["junctions"], link_ends))
    if ready("connections", "junctions"):
        match = settled(junction_matches(out["lateral_groups"], out["node_groups"], out["junctions"], out["junction_nodes"], link_ends))
        # directions are dear, and only the links that stand for a matched group are asked for theirs
        standing = out["group_references"].join(match.select("grp"), "grp", "left_semi").select(F.coalesce("reference", "first_link").alias("id"))
        geometry = settled(end_geometry(links.join(standing, "id", "left_semi"), config.tangent_lookback_m))
        pairs = greedy_pairs(pair_candidates(match, out["node_groups"], nodes, out["group_references"], geometry, config))
        out["connections"] = settled(connections(match, pairs))
    if ready("references", "connections"):
        out["references"] = settled(junction_references(out["connections"], out["node_groups"], out["junction_nodes"], out["group_references"], links, geometry))
    if ready("edges", "references"):
        centre = centroids(out["junctions"], out["junction_nodes"], links, nodes)
        out["edges"] = settled(junction_edges(out["references"], out["connections"], out["node_groups"], out["lateral_groups"], centre, links, nodes))
    return out


def membership(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, layer, feature_id, entity_id: which entities each link and node belongs to."""
    parts = []

    def add(stage: str, layer: str, rows: DataFrame, feature: str, entity: str) -> None:
        parts.append(rows.select(F.lit(stage).alias("stage"), F.lit(layer).alias("layer"), F.col(feature).cast("string").alias("feature_id"), F.col(entity).cast("long").alias("entity_id")).distinct())

    for stage, layer, name, feature, entity in (("uturns", "link", "uturns", "link", "id"), ("lateral_groups", "link", "lateral_groups", "id", "grp"), ("node_groups", "node", "node_groups", "node", "node_grp"), ("junctions", "link", "junctions", "id", "junction"), ("junctions", "node", "junction_nodes", "node", "junction"), ("references", "link", "references", "link", "connection"), ("edges", "link", "edges", "link", "connection")):
        if name in stages:
            add(stage, layer, stages[name], feature, entity)
    if "connections" in stages:
        add("connections", "link", stages["connections"].join(stages["lateral_groups"], "grp"), "id", "connection")
        add("connections", "node", stages["connections"].select("connection", "node_grp").join(stages["node_groups"], "node_grp"), "node", "connection")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_report(rows: DataFrame, layer: str | None = None, feature_id: str | None = None) -> DataFrame:
    """layer, feature_id, stage, entities: of one feature, or of all."""
    if layer is not None:
        rows = rows.filter(F.col("layer") == layer)
    if feature_id is not None:
        rows = rows.filter(F.col("feature_id") == feature_id)
    return rows.groupBy("layer", "feature_id", "stage").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))
