"""SQL over the derived network for the queries that take several stages: orientation, segmentation, repairs.

Each function gives common table expressions whose names start with a prefix, over given link and node tables,
so that a chain can run them on repaired links as well.
"""

from __future__ import annotations


def components(name: str, items: str, pairs: str) -> str:
    """name (id, root): the smallest id that each item reaches over the pairs (a, b)."""
    return f"""{name}_sym AS (SELECT a, b FROM ({pairs}) p1 UNION SELECT b, a FROM ({pairs}) p2),
{name} (id, root) USING KEY (id) AS (SELECT id, id FROM ({items}) i UNION
  SELECT s.b, min(c.root) FROM {name} c JOIN {name}_sym s ON s.a = c.id JOIN recurring.{name} r ON r.id = s.b WHERE c.root < r.root GROUP BY s.b)"""


def distance(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"


def orientation(p: str, link: str) -> str:
    """{p}judged: id, grp, swap, verdict, flip."""
    start_from, end_to = distance("l.x0", "l.y0", "f.x", "f.y"), distance("l.x1", "l.y1", "t.x", "t.y")
    start_to, end_from = distance("l.x0", "l.y0", "t.x", "t.y"), distance("l.x1", "l.y1", "f.x", "f.y")
    return f"""{p}ends AS (SELECT link_id, from_id AS node FROM {link} WHERE from_id IS NOT NULL UNION ALL SELECT link_id, to_id FROM {link} WHERE to_id IS NOT NULL),
{p}deg AS (SELECT node, count(DISTINCT link_id) AS n FROM {p}ends GROUP BY node),
{p}vote AS (SELECT link_id AS id, a.n > 1 AS swap FROM {link} JOIN {p}deg a ON a.node = from_id JOIN {p}deg b ON b.node = to_id WHERE (a.n > 1) <> (b.n > 1)),
{p}keyed AS (SELECT DISTINCT link_id AS id, group_key FROM {p}ends JOIN net_node ON node_id = node WHERE group_key <> ''),
{p}firsts AS (SELECT group_key, min(id) AS b FROM {p}keyed GROUP BY group_key),
{p}pairs AS (SELECT link_id AS a, r_id AS b FROM {link} WHERE r_id IN (SELECT link_id FROM {link}) UNION SELECT link_id, l_id FROM {link} WHERE l_id IN (SELECT link_id FROM {link})
  UNION SELECT id, b FROM {p}keyed JOIN {p}firsts USING (group_key) WHERE id <> b),
{components(f"{p}group", f"SELECT link_id AS id FROM {link}", f"SELECT * FROM {p}pairs")},
{p}major AS (SELECT root, count(*) FILTER (WHERE swap) AS yes, count(*) FILTER (WHERE NOT swap) AS no FROM {p}group LEFT JOIN {p}vote USING (id) GROUP BY root),
{p}side AS (SELECT g.id, g.root AS grp, coalesce(v.swap, CASE WHEN yes > no THEN true WHEN yes < no THEN false END) AS swap, yes <> no AS decided
  FROM {p}group g JOIN {p}major m ON m.root = g.root LEFT JOIN {p}vote v ON v.id = g.id),
{p}near AS (SELECT s.*, f.node_id IS NULL OR t.node_id IS NULL AS open, {start_from} <= 0.5 AND {end_to} <= 0.5 AS same, {start_to} <= 0.5 AND {end_from} <= 0.5 AS turned
  FROM {p}side s JOIN {link} l ON l.link_id = s.id
  LEFT JOIN net_node f ON f.node_id = CASE WHEN s.swap THEN l.to_id ELSE l.from_id END LEFT JOIN net_node t ON t.node_id = CASE WHEN s.swap THEN l.from_id ELSE l.to_id END),
{p}said AS (SELECT *, CASE WHEN NOT decided THEN 'skipped' WHEN open THEN 'unresolved' WHEN same AND turned THEN 'both' WHEN same OR turned THEN 'fits' ELSE 'misaligned' END AS verdict FROM {p}near),
{p}judged AS (SELECT id, grp, swap, verdict, verdict = 'fits' AND turned AS flip FROM {p}said)"""


def _crossing(p: str, rows: str, other: str, condition: str) -> str:
    """Pairs (a, b) of segment tables (id, ax, ay, az, bx, by_, bz) that meet within 1 m of height."""
    return f"""SELECT DISTINCT a, b FROM (
  SELECT a, b, laz + (lbz - laz) * CASE WHEN lap THEN mid ELSE t END AS lz, raz + (rbz - raz) * CASE WHEN lap THEN (mid - t0) / (t1 - t0) ELSE u END AS rz, lap OR (t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1) AS meets FROM (
    SELECT *, d = 0 AND wx * uy - wy * ux = 0 AND greatest(least(t0, t1), 0.0) <= least(greatest(t0, t1), 1.0) AS lap, (greatest(least(t0, t1), 0.0) + least(greatest(t0, t1), 1.0)) / 2 AS mid,
           CASE WHEN d <> 0 THEN (wx * vy - wy * vx) / d END AS t, CASE WHEN d <> 0 THEN (wx * uy - wy * ux) / d END AS u FROM (
      SELECT *, (wx * ux + wy * uy) / (ux * ux + uy * uy) AS t0, (wx * ux + wy * uy) / (ux * ux + uy * uy) + (vx * ux + vy * uy) / (ux * ux + uy * uy) AS t1, ux * vy - uy * vx AS d FROM (
        SELECT l.id AS a, r.id AS b, l.az AS laz, l.bz AS lbz, r.az AS raz, r.bz AS rbz, l.bx - l.ax AS ux, l.by_ - l.ay AS uy, r.bx - r.ax AS vx, r.by_ - r.ay AS vy, r.ax - l.ax AS wx, r.ay - l.ay AS wy
        FROM {rows} l JOIN {other} r ON {condition} AND least(r.ax, r.bx) <= greatest(l.ax, l.bx) AND greatest(r.ax, r.bx) >= least(l.ax, l.bx) AND least(r.ay, r.by_) <= greatest(l.ay, l.by_) AND greatest(r.ay, r.by_) >= least(l.ay, l.by_)) q1) q2) q3) q4
WHERE meets AND abs(lz - rz) <= 1.0"""


def _tangent(p: str, link: str, side: str) -> str:
    """Unit direction of travel at one end of the three-point lines, looked at from 1 m along."""
    (ax, ay), (bx, by), (cx, cy) = [(f"x{e}", f"y{e}") for e in (("0", "m", "1") if side == "from" else ("1", "m", "0"))]
    sign = "" if side == "from" else "-"
    place = {}
    for axis, a, b, c in (("x", ax, bx, cx), ("y", ay, by, cy)):
        place[axis] = f"""CASE WHEN d1 > 0 AND 1 <= d1 THEN {a} + ({b} - {a}) * (1.0 / d1) WHEN d1 > 0 AND d2 > 0 AND 1.0 - d1 <= d2 THEN {b} + ({c} - {b}) * ((1.0 - d1) / d2) WHEN d1 > 0 AND d2 > 0 THEN {c}
      WHEN d1 > 0 THEN {b} WHEN d2 > 0 AND 1 <= d2 THEN {b} + ({c} - {b}) * (1.0 / d2) WHEN d2 > 0 THEN {c} END"""
    return f"""SELECT id, '{side}' AS side, px, py, dx / sqrt(dx * dx + dy * dy) AS tx, dy / sqrt(dx * dx + dy * dy) AS ty FROM (
  SELECT id, px, py, {sign}(ex - px) AS dx, {sign}(ey - py) AS dy FROM (
    SELECT link_id AS id, {ax} AS px, {ay} AS py, {place["x"]} AS ex, {place["y"]} AS ey FROM (
      SELECT *, {distance(ax, ay, bx, by)} AS d1, {distance(bx, by, cx, cy)} AS d2 FROM {link}) m1) m2) m3 WHERE dx * dx + dy * dy > 0"""


def groups(p: str, link: str) -> str:
    """{p}turned, {p}grp (id, grp), {p}e (link ends at nodes), {p}ng (node groups), {p}lat (lateral neighbours)."""
    return f"""{p}seg AS (SELECT link_id AS id, link_type, x0 AS ax, y0 AS ay, z0 AS az, xm AS bx, ym AS by_, zm AS bz FROM {link} WHERE x0 <> xm OR y0 <> ym
  UNION ALL SELECT link_id, link_type, xm, ym, zm, x1, y1, z1 FROM {link} WHERE xm <> x1 OR ym <> y1),
{p}plain AS (SELECT * FROM {p}seg WHERE link_type = '6'),
{p}mark AS (SELECT marker_id AS id, x0 AS ax, y0 AS ay, z0 AS az, x1 AS bx, y1 AS by_, z1 AS bz FROM net_marker WHERE kind = '502'),
{p}turned AS (SELECT DISTINCT a AS link_id FROM ({_crossing(p, f"{p}plain", f"{p}mark", "true")}) c),
{p}item AS (SELECT link_id AS id FROM {link} WHERE link_type = '6' AND link_id NOT IN (SELECT link_id FROM {p}turned)),
{p}lat AS (SELECT DISTINCT id, side, other FROM (SELECT link_id AS id, 'left' AS side, l_id AS other FROM {link} UNION ALL SELECT link_id, 'right', r_id FROM {link}
    UNION ALL SELECT r_id, 'left', link_id FROM {link} UNION ALL SELECT l_id, 'right', link_id FROM {link}) n
  WHERE id IN (SELECT link_id FROM {link}) AND other IN (SELECT link_id FROM {link})),
{components(f"{p}beside", f"SELECT id FROM {p}item", f"SELECT id AS a, other AS b FROM {p}lat WHERE id IN (SELECT id FROM {p}item) AND other IN (SELECT id FROM {p}item)")},
{p}grp AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS grp FROM {p}beside),
{p}e AS (SELECT link_id AS id, s AS side, node FROM (SELECT link_id, 'from' AS s, from_id AS node FROM {link} UNION ALL SELECT link_id, 'to', to_id FROM {link}) o WHERE node IN (SELECT node_id FROM net_node)),
{p}ng AS (SELECT dense_rank() OVER (ORDER BY grp, side) - 1 AS node_grp, grp, side, node FROM (SELECT DISTINCT grp, side, node FROM {p}grp JOIN {p}e USING (id)) d)"""


def junctions(p: str, link: str) -> str:
    """{p}junction (junction, id, kind), after groups()."""
    return f"""{p}seed AS (SELECT link_id AS id FROM {link} WHERE link_type = '1'),
{p}seedseg AS (SELECT * FROM {p}seg WHERE link_type = '1'),
{p}cross AS ({_crossing(p, f"{p}seedseg", f"{p}seedseg", "l.id < r.id")}),
{p}seedend AS (SELECT * FROM {p}e WHERE id IN (SELECT id FROM {p}seed)),
{p}pulled AS (SELECT s.id AS a, o.id AS b FROM {p}seedend s JOIN {p}e o ON o.side = s.side AND o.node = s.node WHERE o.id NOT IN (SELECT id FROM {p}seed)
  UNION SELECT id, other FROM {p}lat WHERE id IN (SELECT id FROM {p}seed) AND other NOT IN (SELECT id FROM {p}seed) AND other IN (SELECT id FROM {p}grp)),
{p}member AS (SELECT grp, id FROM {p}grp WHERE grp IN (SELECT grp FROM {p}grp WHERE id IN (SELECT b FROM {p}pulled)) AND id NOT IN (SELECT id FROM {p}seed)),
{p}kind AS (SELECT id, 'seed' AS kind FROM {p}seed UNION SELECT b, 'promoted' FROM {p}pulled UNION SELECT id, 'promoted' FROM {p}member),
{p}touch AS (SELECT DISTINCT node_grp, e.side, k.id, k.kind FROM {p}ng n JOIN {p}e e ON e.node = n.node JOIN {p}kind k ON k.id = e.id),
{p}mixed AS (SELECT node_grp, side, min(id) AS a FROM {p}touch GROUP BY node_grp, side HAVING count(DISTINCT kind) = 2),
{p}owner AS (SELECT DISTINCT m.a, g.id AS b FROM {p}mixed m JOIN {p}ng n ON n.node_grp = m.node_grp JOIN {p}grp g ON g.grp = n.grp JOIN {p}e e ON e.id = g.id AND e.side = m.side AND e.node = n.node),
{p}joined AS (SELECT a, b FROM {p}cross UNION SELECT id, other FROM {p}lat WHERE id IN (SELECT id FROM {p}seed) AND other IN (SELECT id FROM {p}seed)
  UNION SELECT min(id) OVER (PARTITION BY node), id FROM {p}seedend UNION SELECT a, b FROM {p}pulled UNION SELECT min(id) OVER (PARTITION BY grp), id FROM {p}member
  UNION SELECT min(id) OVER (PARTITION BY node_grp, side), id FROM {p}touch UNION SELECT a, b FROM {p}owner),
{p}part AS (SELECT id, kind FROM {p}kind UNION SELECT DISTINCT b, 'owner' FROM {p}owner WHERE b NOT IN (SELECT id FROM {p}kind)),
{components(f"{p}whole", f"SELECT id FROM {p}part", f"SELECT a, b FROM {p}joined WHERE a <> b")},
{p}number AS (SELECT root, dense_rank() OVER (ORDER BY min(id)) - 1 AS junction FROM {p}whole WHERE id IN (SELECT id FROM {p}seed) GROUP BY root),
{p}junction AS (SELECT junction, id, kind FROM {p}whole JOIN {p}number USING (root) JOIN {p}part USING (id))"""


def connections(p: str, link: str) -> str:
    """{p}connection (connection, junction, node_grp, grp, side, method), after junctions().

    The greedy choice runs one candidate of each junction after another, with lists of what is taken.
    """
    return f"""{p}jn AS (SELECT DISTINCT junction, node FROM {p}junction JOIN {p}e USING (id)),
{p}outer AS (SELECT * FROM {p}ng WHERE grp NOT IN (SELECT grp FROM {p}grp WHERE id IN (SELECT id FROM {p}junction))),
{p}match AS (SELECT node_grp, grp, side, min((priority, junction))[2] AS junction, CASE WHEN min(priority) = 0 THEN 'shared_node' ELSE 'graph_adjacency' END AS method FROM (
    SELECT node_grp, grp, side, junction, 0 AS priority FROM {p}outer JOIN {p}jn USING (node)
    UNION ALL SELECT node_grp, grp, o.side, junction, 1 FROM {p}outer o JOIN {p}e e ON e.node = o.node JOIN {p}junction j ON j.id = e.id) c GROUP BY node_grp, grp, side),
{p}nopocket AS (SELECT grp, id, lane_no FROM {p}grp JOIN {link} ON link_id = id WHERE lane_no < 3),
{p}edged AS (SELECT *, id NOT IN (SELECT l.id FROM {p}lat l JOIN {p}nopocket a ON a.id = l.id JOIN {p}nopocket b ON b.id = l.other AND b.grp = a.grp WHERE l.side = 'left') AS is_edge FROM {p}nopocket),
{p}counted AS (SELECT grp, count(*) AS n, count(*) FILTER (WHERE lane_no = 1) AS n1, min(id) FILTER (WHERE lane_no = 1) AS by1, count(*) FILTER (WHERE is_edge) AS ne, min(id) FILTER (WHERE is_edge) AS bye FROM {p}edged GROUP BY grp),
{p}ref AS (SELECT g.grp, first_link, CASE WHEN n1 = 1 THEN by1 WHEN ne = 1 THEN bye END AS reference, CASE WHEN n IS NULL OR n1 = 1 THEN 'lane_no' ELSE 'lateral_topology' END AS source
  FROM (SELECT grp, min(id) AS first_link FROM {p}grp GROUP BY grp) g LEFT JOIN {p}counted c ON c.grp = g.grp),
{p}way AS ({_tangent(p, link, "from")} UNION ALL {_tangent(p, link, "to")}),
{p}at AS (SELECT m.junction, m.node_grp, m.side, x, y, group_key FROM {p}match m JOIN {p}ng n ON n.node_grp = m.node_grp JOIN net_node ON node_id = n.node),
{p}heading AS (SELECT node_grp, tx, ty FROM {p}match m JOIN {p}ref r ON r.grp = m.grp JOIN {p}way w ON w.id = coalesce(r.reference, r.first_link) AND w.side = m.side),
{p}close AS (SELECT a.junction, a.node_grp AS t, b.node_grp AS f, min({distance("a.x", "a.y", "b.x", "b.y")}) AS d FROM {p}at a JOIN {p}at b ON b.junction = a.junction AND b.side = 'from'
    AND b.x BETWEEN a.x - 15 AND a.x + 15 AND b.y BETWEEN a.y - 15 AND a.y + 15 WHERE a.side = 'to' AND {distance("a.x", "a.y", "b.x", "b.y")} <= 15 GROUP BY a.junction, a.node_grp, b.node_grp),
{p}cand AS (SELECT c.junction, t, f, CASE WHEN EXISTS (SELECT 1 FROM {p}at a JOIN {p}at b ON b.group_key = a.group_key WHERE a.node_grp = c.t AND b.node_grp = c.f AND a.group_key <> '') THEN 0 ELSE 1 END AS priority, d
  FROM {p}close c JOIN {p}heading u ON u.node_grp = t JOIN {p}heading v ON v.node_grp = f WHERE u.tx * v.tx + u.ty * v.ty <= -0.85),
{p}ordered AS (SELECT *, row_number() OVER (PARTITION BY junction ORDER BY priority, d, t, f) AS i FROM {p}cand),
{p}greedy AS (SELECT junction, i, t, f, true AS taken, [t, f] AS used FROM {p}ordered WHERE i = 1
  UNION ALL SELECT o.junction, o.i, o.t, o.f, NOT list_has_any(g.used, [o.t, o.f]), CASE WHEN list_has_any(g.used, [o.t, o.f]) THEN g.used ELSE list_concat(g.used, [o.t, o.f]) END
  FROM {p}greedy g JOIN {p}ordered o ON o.junction = g.junction AND o.i = g.i + 1),
{p}pair AS (SELECT o.* FROM {p}ordered o JOIN {p}greedy g ON g.junction = o.junction AND g.i = o.i WHERE g.taken),
{p}connection AS (SELECT dense_rank() OVER (ORDER BY m.junction, q.t IS NULL, coalesce(priority, 0), coalesce(d, 0), coalesce(q.t, m.node_grp), coalesce(q.f, m.node_grp)) - 1 AS connection, m.junction, m.node_grp, m.grp, m.side,
    CASE WHEN q.t IS NULL THEN 'one_sided' WHEN priority = 0 THEN 'node_group_key,opposite_direction' ELSE 'opposite_direction' END AS method
  FROM {p}match m LEFT JOIN {p}pair q ON m.node_grp IN (q.t, q.f))"""


def references(p: str, link: str) -> str:
    """{p}reference (connection, junction, id, side, source, px, py, tx, ty), after connections()."""
    return f"""{p}cnode AS (SELECT DISTINCT connection, n.node FROM {p}connection c JOIN {p}ng n ON n.node_grp = c.node_grp),
{p}out AS (SELECT connection, bool_and(side = 'from') AS outbound FROM {p}connection GROUP BY connection),
{p}hit AS (SELECT DISTINCT c.connection, c.junction, c.grp, l.link_id AS id, coalesce(l.lane_no, 1000000) AS lane, r.source,
    CASE WHEN (c.connection, l.to_id) IN (SELECT (connection, node) FROM {p}cnode) THEN 'to' WHEN outbound AND (c.connection, l.from_id) IN (SELECT (connection, node) FROM {p}cnode) THEN 'from' END AS side
  FROM {p}connection c JOIN {p}out o ON o.connection = c.connection JOIN {p}ref r ON r.grp = c.grp JOIN {link} l ON l.link_id = r.reference),
{p}best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY connection ORDER BY lane, grp, id) AS n FROM {p}hit WHERE side IS NOT NULL) h WHERE n = 1),
{p}reference AS (SELECT b.connection, b.junction, b.id, b.side, b.source || CASE WHEN b.side = 'to' THEN ':toward_junction' ELSE ':out_of_junction' END AS source, px, py, tx, ty FROM {p}best b JOIN {p}way w ON w.id = b.id AND w.side = b.side)"""


def edges(p: str, link: str) -> str:
    """{p}edge (connection, junction, link, node, the line across and its span), after references()."""
    return f"""{p}bysegment AS (SELECT junction, sum((ax + bx) / 2 * w) / sum(w) AS cx, sum((ay + by_) / 2 * w) / sum(w) AS cy FROM (SELECT j.junction, s.*, {distance("ax", "ay", "bx", "by_")} AS w FROM {p}junction j JOIN {p}seg s ON s.id = j.id) q GROUP BY junction),
{p}facing AS (SELECT r.*, CASE WHEN round(tx * (px - cx) + ty * (py - cy), 6) >= 0 THEN 1.0 ELSE -1.0 END AS sign FROM {p}reference r JOIN {p}bysegment b ON b.junction = r.junction),
{p}far AS (SELECT f.connection, f.junction, f.id, tx * sign AS fx, ty * sign AS fy, n.node, k.x, k.y, k.z,
    row_number() OVER (PARTITION BY f.connection ORDER BY -((k.x - px) * (tx * sign) + (k.y - py) * (ty * sign)), n.node) AS i FROM {p}facing f JOIN {p}cnode n ON n.connection = f.connection JOIN net_node k ON k.node_id = n.node),
{p}stand AS (SELECT *, -fy AS ux, fx AS uy FROM {p}far WHERE i = 1),
{p}own AS (SELECT DISTINCT c.connection, g.id FROM {p}connection c JOIN {p}grp g ON g.grp = c.grp),
{p}line AS (SELECT link_id AS id, x0 AS ax, y0 AS ay, z0 AS az, xm AS bx, ym AS by_, zm AS bz FROM {link} UNION ALL SELECT link_id, xm, ym, zm, x1, y1, z1 FROM {link}),
{p}station AS (SELECT s.*, q.ax, q.ay, q.az, q.bx, q.by_, q.bz, (q.ax - s.x) * fx + (q.ay - s.y) * fy AS sa, (q.bx - s.x) * fx + (q.by_ - s.y) * fy AS sb FROM {p}stand s JOIN {p}own o ON o.connection = s.connection JOIN {p}line q ON q.id = o.id),
{p}point AS (SELECT connection, x, y, ux, uy, ax AS qx, ay AS qy, az AS qz FROM {p}station WHERE sa = 0 UNION ALL SELECT connection, x, y, ux, uy, bx, by_, bz FROM {p}station WHERE sb = 0
  UNION ALL SELECT connection, x, y, ux, uy, ax + (bx - ax) * r, ay + (by_ - ay) * r, az + (bz - az) * r FROM (SELECT *, -sa / (sb - sa) AS r FROM {p}station WHERE sa * sb < 0) c),
{p}spot AS (SELECT *, (qx - x) * ux + (qy - y) * uy AS t FROM {p}point),
{p}proj AS (SELECT s.connection, s.x, s.y, s.ux, s.uy, s.x + s.ux * ((k.x - s.x) * s.ux + (k.y - s.y) * s.uy) AS qx, s.y + s.uy * ((k.x - s.x) * s.ux + (k.y - s.y) * s.uy) AS qy, k.z AS qz FROM {p}stand s JOIN {p}cnode n ON n.connection = s.connection JOIN net_node k ON k.node_id = n.node),
{p}shade AS (SELECT *, (qx - x) * ux + (qy - y) * uy AS t FROM {p}proj),
{p}span AS (SELECT connection, count(*) AS n, min((t, qx, qy, qz)) AS lo, max((t, qx, qy, qz)) AS hi FROM {p}spot GROUP BY connection HAVING count(*) >= 2 AND min(t) < max(t)),
{p}spare AS (SELECT connection, 0 AS n, min((t, qx, qy, qz)) AS lo, max((t, qx, qy, qz)) AS hi FROM {p}shade WHERE connection NOT IN (SELECT connection FROM {p}span) GROUP BY connection HAVING count(*) >= 2 AND min(t) < max(t)),
{p}edge AS (SELECT s.connection, s.junction, s.id AS link, s.node, ux, uy, lo, hi, n FROM {p}stand s JOIN (SELECT * FROM {p}span UNION ALL SELECT * FROM {p}spare) w ON w.connection = s.connection)"""


def stages(p: str, link: str, last: str) -> str:
    """All common table expressions up to one of groups, junctions, connections, references, edges."""
    made = []
    for step in (groups, junctions, connections, references, edges):
        made.append(step(p, link))
        if step.__name__ == last:
            return ",\n".join(made)
    raise ValueError(last)


_FIELDS = "lane_no, link_type, x0, y0, z0, xm, ym, zm, x1, y1, z1"


def _fill(p: str, name: str, rows: str, column: str, inverse: str) -> str:
    """{p}{name}_state (id, target, state) of one reciprocal rule, and {p}{name}: the rows with empty slots filled."""
    other = "r_id, new AS l_id" if inverse == "l_id" else "new AS r_id, l_id"
    filled = other.replace("new", f"coalesce({inverse}, s.id)")
    return f"""{p}{name}_state AS (SELECT id, target, CASE WHEN slot IS NULL AND row_number() OVER (PARTITION BY target ORDER BY id) = 1 THEN 'fill' ELSE 'conflict' END AS state
  FROM (SELECT a.link_id AS id, a.{column} AS target, t.{inverse} AS slot FROM {rows} a JOIN {rows} t ON t.link_id = a.{column} WHERE t.{inverse} IS NULL OR t.{inverse} <> a.link_id) f),
{p}{name} AS (SELECT link_id, from_id, to_id, {filled}, {_FIELDS} FROM {rows} LEFT JOIN (SELECT * FROM {p}{name}_state WHERE state = 'fill') s ON s.target = link_id)"""


def repaired(p: str, link: str) -> str:
    """{p}links after all link repairs, and {p}found (kind, code, n)."""
    refs = """SELECT q.*, t.from_id AS t_from, t.to_id AS t_to, CASE WHEN q.side = 'l_id' THEN t.r_id ELSE t.l_id END AS back
  FROM (SELECT link_id AS id, 'l_id' AS side, l_id AS target, from_id, to_id FROM {0} UNION ALL SELECT link_id, 'r_id', r_id, from_id, to_id FROM {0}) q JOIN {0} t ON t.link_id = q.target"""
    return f"""{p}open AS (SELECT o.* FROM (SELECT link_id, 'from' AS side, from_id AS current, x0 AS x, y0 AS y FROM {link} UNION ALL SELECT link_id, 'to', to_id, x1, y1 FROM {link}) o LEFT JOIN net_node ON node_id = current WHERE node_id IS NULL),
{p}near AS (SELECT link_id, side, count(*) AS n_near, min(node_id) AS node FROM {p}open b JOIN net_node n ON n.x BETWEEN b.x - 0.5 AND b.x + 0.5 AND n.y BETWEEN b.y - 0.5 AND b.y + 0.5
  WHERE {distance("n.x", "n.y", "b.x", "b.y")} <= 0.5 GROUP BY link_id, side),
{p}fix AS (SELECT b.link_id, b.side, b.current, coalesce(n_near, 0) AS n_near, CASE WHEN n_near = 1 THEN node END AS node FROM {p}open b LEFT JOIN {p}near n ON n.link_id = b.link_id AND n.side = b.side),
{p}l1 AS (SELECT l.link_id, CASE WHEN f.link_id IS NULL THEN from_id ELSE f.node END AS from_id, CASE WHEN t.link_id IS NULL THEN to_id ELSE t.node END AS to_id, r_id, l_id, {_FIELDS}
  FROM {link} l LEFT JOIN {p}fix f ON f.link_id = l.link_id AND f.side = 'from' LEFT JOIN {p}fix t ON t.link_id = l.link_id AND t.side = 'to'),
{p}long AS (SELECT DISTINCT id, side FROM ({refs.format(p + "l1")}) s WHERE to_id = t_from OR from_id = t_to),
{p}l2 AS (SELECT link_id, from_id, to_id, CASE WHEN (link_id, 'r_id') IN (SELECT (id, side) FROM {p}long) THEN NULL ELSE r_id END AS r_id, CASE WHEN (link_id, 'l_id') IN (SELECT (id, side) FROM {p}long) THEN NULL ELSE l_id END AS l_id, {_FIELDS} FROM {p}l1),
{p}inverse AS (SELECT id, side, count(*) AS n, min(link_id) AS only_one FROM (SELECT r_id AS id, 'l_id' AS side, link_id FROM {p}l2 WHERE r_id IS NOT NULL UNION ALL SELECT l_id, 'r_id', link_id FROM {p}l2 WHERE l_id IS NOT NULL) i GROUP BY id, side),
{p}lost AS (SELECT s.id, s.side, CASE WHEN n = 1 THEN only_one END AS redirect FROM ({refs.format(p + "l2")}) s LEFT JOIN {p}inverse i ON i.id = s.id AND i.side = s.side WHERE back IS NULL OR back <> s.id),
{p}l3 AS (SELECT link_id, from_id, to_id, coalesce(r.redirect, r_id) AS r_id, coalesce(l.redirect, l_id) AS l_id, {_FIELDS}
  FROM {p}l2 LEFT JOIN {p}lost r ON r.id = link_id AND r.side = 'r_id' LEFT JOIN {p}lost l ON l.id = link_id AND l.side = 'l_id'),
{orientation(p + "t_", p + "l3")},
{p}turn AS (SELECT id, swap AND verdict = 'fits' AS swap, flip FROM {p}t_judged),
{p}l4 AS (SELECT link_id, CASE WHEN swap THEN to_id ELSE from_id END AS from_id, CASE WHEN swap THEN from_id ELSE to_id END AS to_id, r_id, l_id, lane_no, link_type,
    {", ".join(f"CASE WHEN flip THEN {c}{b} ELSE {c}{a} END AS {c}{a}" for a, b in (("0", "1"), ("m", "m"), ("1", "0")) for c in "xyz")} FROM {p}l3 JOIN {p}turn ON id = link_id),
{_fill(p, "l5", p + "l4", "r_id", "l_id")},
{_fill(p, "links", p + "l5", "l_id", "r_id")},
{p}told AS (SELECT CASE WHEN n_near = 1 OR (n_near = 0 AND current IS NOT NULL) THEN 'action' ELSE 'warning' END AS kind, CASE WHEN n_near = 1 THEN 'link-endpoint-unresolved-assigned' WHEN current IS NOT NULL THEN 'link-endpoint-unresolved-cleared' ELSE 'link-endpoint-unresolved' END AS code FROM {p}fix WHERE n_near <= 1
  UNION ALL SELECT 'action', 'link-endpoint-unresolved-cleared' FROM {p}fix WHERE n_near > 1 AND current IS NOT NULL
  UNION ALL SELECT 'warning', 'link-endpoint-unresolved-ambiguous' FROM {p}fix WHERE n_near > 1
  UNION ALL SELECT 'action', 'link-side-reference-longitudinal-cleared' FROM {p}long
  UNION ALL SELECT CASE WHEN redirect IS NULL THEN 'warning' ELSE 'action' END, CASE WHEN redirect IS NULL THEN 'link-side-reference-nonreciprocal-ambiguous' ELSE 'link-side-reference-nonreciprocal-redirected' END FROM {p}lost
  UNION ALL SELECT 'action', 'link-orientation-reversed-repaired' FROM {p}t_judged WHERE verdict = 'fits' AND (swap OR flip)
  UNION ALL SELECT 'warning', CASE verdict WHEN 'unresolved' THEN 'link-orientation-endpoint-unresolved' ELSE 'link-endpoint-misaligned' END FROM {p}t_judged WHERE verdict IN ('unresolved', 'misaligned')
  UNION ALL SELECT 'warning', 'link-orientation-reversed-ambiguous' FROM (SELECT DISTINCT grp FROM {p}t_judged WHERE verdict = 'skipped') k
  UNION ALL SELECT CASE state WHEN 'fill' THEN 'action' ELSE 'warning' END, CASE state WHEN 'fill' THEN 'reciprocal-reference-missing-filled' ELSE 'reciprocal-reference-conflict' END
    FROM (SELECT state FROM {p}l5_state UNION ALL SELECT state FROM {p}links_state) z),
{p}found AS (SELECT kind, code, count(*) AS n FROM {p}told GROUP BY kind, code)"""
