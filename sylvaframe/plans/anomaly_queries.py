"""Queries of flags on organs and of repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaframe.operators import anomalies as A
from sylvaframe.operators import graph as G
from sylvaframe.operators import regions as R
from sylvaframe.plans import fixtures as X
from sylvaframe.plans import region_queries as Q

BOOK = X.Book()
add = BOOK.add
TYPICAL = 8.0


def times(s, d):
    return R.component_times(Q.comps(s, d), Q.hours(s))


def frame(s, d):
    return X.remember(s, d, "frame", lambda: A.estimated_radius(A.organ_frame(Q.forest(s, d), Q.organs(s, d), times(s, d))))


def links(s, d):
    return Q.links(s, d).join(Q.costed(s, d).select("box", "src", "dst", "cost"), ["box", "src", "dst"])


def flags(s, d):
    return X.remember(s, d, "flags", lambda: A.all_flags(frame(s, d), links(s, d), Q.edges(s, d), TYPICAL))


def _r(df, *names):
    return df.withColumns({n: F.round(n, 4) for n in names})


# The organ nodes with what stands before and after them, and their radius.
FRAME = """frame AS MATERIALIZED (SELECT *, CASE WHEN line > 0 THEN n_px / line ELSE sqrt(n_px / pi()) END AS radius FROM (
  SELECT *, CASE WHEN idx > 0 AND nxt IS NOT NULL THEN sqrt((fx - nfx) ** 2 + (fy - nfy) ** 2) WHEN nxt IS NOT NULL THEN 2 * sqrt((cx - nfx) ** 2 + (cy - nfy) ** 2) WHEN idx > 0 THEN 2 * sqrt((cx - fx) ** 2 + (cy - fy) ** 2) ELSE sqrt(n_px) END AS line FROM (
    SELECT f.box, f.cc_id, f.parent, f.n_px, f.day, f.cx, f.cy, f.fx, f.fy, o.organ_id, o.idx, count(*) OVER (PARTITION BY f.box, o.organ_id) AS size,
      lead(f.fx) OVER w AS nfx, lead(f.fy) OVER w AS nfy, lead(f.cc_id) OVER w AS nxt, lag(f.cc_id) OVER w AS prv, lag(f.cx) OVER w AS pcx, lag(f.cy) OVER w AS pcy, (f.day - 1) * 8e0 AS h_tip, CASE WHEN f.day >= 2 THEN f.day - 2 ELSE f.day - 1 END * 8e0 AS h_start
    FROM forest f JOIN organs o ON o.box = f.box AND o.cc_id = f.cc_id WINDOW w AS (PARTITION BY f.box, o.organ_id ORDER BY o.idx)))),
best_out AS MATERIALIZED (SELECT f.box, f.parent AS cc_id, min((round(c.cost, 6), f.cc_id))[2] AS nx FROM forest f JOIN costed c ON c.box = f.box AND c.src = f.parent AND c.dst = f.cc_id GROUP BY 1, 2)"""
USES = ("forest", "organs", "costed", "edges")


def _mad(rows, keys, value):
    """SQL of rows with the median, lower and upper median of a value by keys, and its deviations v."""
    return f"""(SELECT *, abs({value} - median) / (1.4826 * (CASE WHEN {value} < median THEN median - low ELSE high - median END) + 1e-6) AS v FROM {rows} JOIN (
      SELECT {keys}, any_value(m) AS median, median({value}) FILTER ({value} <= m) AS low, median({value}) FILTER ({value} >= m) AS high FROM {rows} JOIN (SELECT {keys}, median({value}) AS m FROM {rows} GROUP BY {keys}) USING ({keys}) GROUP BY {keys}) USING ({keys}))"""


def _flag(rows, node=None, edges=()):
    """SQL of flags of rows with v: a node's reason, and edges (src, dst, reason)."""
    parts = [f"SELECT box, 'node' AS kind, cc_id AS a, CAST(NULL AS BIGINT) AS b, '{node}' AS reason, v AS value FROM {rows}"] if node else []
    parts += [f"SELECT box, 'edge' AS kind, {a} AS a, {b} AS b, '{reason}' AS reason, v AS value FROM {rows} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b, reason in edges]
    return " UNION ALL ".join(parts)


def _cos(ax, ay, bx, by):
    return f"(({ax}) * ({bx}) + ({ay}) * ({by})) / nullif(sqrt(({ax}) ** 2 + ({ay}) ** 2) * sqrt(({bx}) ** 2 + ({by}) ** 2), 0)"


def _sharp(where, cosine):
    return f"(SELECT *, degrees(acos(greatest(-1, least(1, k)))) AS v FROM (SELECT *, {cosine} AS k FROM frame WHERE {where}) WHERE k < 0.5)"


OUTLIERS = f"(SELECT m.*, b.nx FROM {_mad('frame', 'box, organ_id', 'radius')} m LEFT JOIN best_out b ON b.box = m.box AND b.cc_id = m.cc_id WHERE size >= 3 AND v > CASE WHEN size > 7 THEN 6 WHEN size > 5 THEN 8 ELSE 100 END)"
CHANGES = """(SELECT z.*, abs(m1 - m0) / nullif((s0 + s1) / 0.6745, 0) AS v, b.nx FROM (SELECT *, avg(radius) OVER p AS m0, stddev_samp(radius) OVER p AS s0, avg(radius) OVER n AS m1, stddev_samp(radius) OVER n AS s1 FROM frame
  WINDOW p AS (PARTITION BY box, organ_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), n AS (PARTITION BY box, organ_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) z
  JOIN best_out b ON b.box = z.box AND b.cc_id = z.cc_id JOIN (SELECT box, dst AS cc_id, count(*) AS n_in FROM edges GROUP BY 1, 2) i ON i.box = z.box AND i.cc_id = z.cc_id
  WHERE size > 5 AND idx >= 2 AND idx < size - 1 AND n_in >= 2 AND abs(m1 - m0) > (s0 + s1) / 0.6745)"""
ENDS = "(SELECT box, cc_id, h_tip AS e FROM (SELECT *, count(*) OVER (PARTITION BY box) AS organs_of_box FROM frame WHERE nxt IS NULL) WHERE organs_of_box > 3)"
LATE = f"(SELECT * FROM {_mad(ENDS, 'box', 'e')} WHERE v > 3)"
RATE = "ln(n_px / CASE WHEN h_tip = h_start THEN 8 ELSE h_tip - h_start + 1e-6 END + 1e-6)"
PAIRS = f"""pairs AS MATERIALIZED (SELECT * FROM (SELECT c.box, c.cc_id, c.parent, c.rate, p.rate AS p_rate, row_number() OVER (PARTITION BY c.box ORDER BY round(p.rate, 9), c.cc_id) AS rk, count(*) OVER (PARTITION BY c.box) AS n
  FROM (SELECT *, {RATE} AS rate FROM frame WHERE idx = 0 AND parent IS NOT NULL) c JOIN (SELECT box, cc_id, {RATE} AS rate FROM frame) p ON p.box = c.box AND p.cc_id = c.parent) WHERE n >= 10),
around AS MATERIALIZED (SELECT a.box, a.cc_id, o.rate FROM pairs a JOIN pairs o ON o.box = a.box AND o.rk <> a.rk AND o.rk BETWEEN greatest(1, least(a.rk - 12, a.n - 24)) AND greatest(1, least(a.rk - 12, a.n - 24)) + 24),
middle AS MATERIALIZED (SELECT box, cc_id, median(rate) AS median FROM around GROUP BY 1, 2),
spread AS MATERIALIZED (SELECT a.box, a.cc_id, m.median, median(rate) FILTER (rate <= m.median) AS low, median(rate) FILTER (rate >= m.median) AS high FROM around a JOIN middle m ON m.box = a.box AND m.cc_id = a.cc_id GROUP BY 1, 2, 3)"""
WEIRD = "(SELECT * FROM (SELECT p.*, abs(rate - median) / (1.4826 * (CASE WHEN rate < median THEN median - low ELSE high - median END) + 1e-6) AS v FROM pairs p JOIN spread s ON s.box = p.box AND s.cc_id = p.cc_id) WHERE v > 2)"
PARTS = {
    "radius_outlier": (lambda s, d: A.radius_outlier(frame(s, d), links(s, d)), _flag(OUTLIERS, "RADIUS_OUTLIER", (("parent", "cc_id", "RADIUS_OUTLIER_IN_TARGET"), ("cc_id", "nx", "RADIUS_OUTLIER_IN_SOURCE")))),
    "radius_sudden_change": (lambda s, d: A.radius_sudden_change(frame(s, d), links(s, d), Q.edges(s, d)), _flag(CHANGES, "RADIUS_SUDDEN_CHANGE", (("parent", "cc_id", "RADIUS_SUDDEN_CHANGE_AT_TARGET"), ("cc_id", "nx", "RADIUS_SUDDEN_CHANGE_AT_SOURCE")))),
    "final_time_outlier": (lambda s, d: A.final_time_outlier(frame(s, d)), _flag(LATE, "FINAL_TIME_OUTLIER")),
    "sharp_angle": (lambda s, d: A.sharp_angle(frame(s, d)), _flag(_sharp("idx > 0 AND nxt IS NOT NULL", _cos("cx - fx", "cy - fy", "nfx - cx", "nfy - cy")), None, (("prv", "cc_id", "SHARP_ANGLE_AT_TARGET"), ("cc_id", "nxt", "SHARP_ANGLE_AT_SOURCE")))),
    "sharp_angle_terminal": (lambda s, d: A.sharp_angle_terminal(frame(s, d)), _flag(_sharp("idx > 0 AND nxt IS NULL", _cos("cx - pcx", "cy - pcy", "cx - fx", "cy - fy")), "SHARP_ANGLE_TERMINAL", (("prv", "cc_id", "SHARP_ANGLE_AT_TERMINAL_TARGET"),))),
    "sharp_edge_angle": (lambda s, d: A.sharp_edge_angle(frame(s, d)), _flag(_sharp("idx > 0", _cos("fx - pcx", "fy - pcy", "cx - fx", "cy - fy")), None, (("prv", "cc_id", "SHARP_EDGE_ANGLE"),))),
    "weird_child_surface": (lambda s, d: A.weird_child_surface(frame(s, d), TYPICAL), _flag(WEIRD, None, (("parent", "cc_id", "WEIRD_CHILD_ORGAN_SURFACE"),))),
}
add("estimated_radius", lambda s, d: _r(frame(s, d).select("box", "cc_id", "radius"), "radius"), f"WITH {FRAME} SELECT box, cc_id, round(radius, 4) AS radius FROM frame", USES)
for name, (query, sql) in PARTS.items():
    add(name, lambda s, d, query=query: _r(query(s, d), "value"), f"WITH {FRAME}, {PAIRS} SELECT box, kind, a, b, reason, round(value, 4) AS value FROM ({sql})", USES)
FLAGS = f"{FRAME}, {PAIRS}, flags AS MATERIALIZED ({' UNION ALL '.join(sql for _, sql in PARTS.values())})"
add("anomaly_counts", lambda s, d: A.anomaly_counts(flags(s, d)), f"WITH {FLAGS} SELECT box, count(DISTINCT CASE WHEN kind = 'node' THEN a END) AS nodes, count(DISTINCT CASE WHEN kind = 'edge' THEN (a, b) END) AS edges, count(*) AS level FROM flags GROUP BY 1", USES)
add(
    "anomaly_inventory",
    lambda s, d: A.anomaly_inventory(flags(s, d)).withColumn("reasons", F.array_join(F.transform("reasons", lambda r: r["reason"]), ",")),
    f"WITH {FLAGS} SELECT box, kind, a, b, count(*) AS level, string_agg(reason, ',' ORDER BY reason, value) AS reasons FROM flags GROUP BY 1, 2, 3, 4",
    USES,
)
add(
    "neighbourhood_anomaly",
    lambda s, d: A.neighbourhood_anomaly(Q.comps(s, d), Q.edges(s, d), Q.links(s, d), flags(s, d)),
    f"""WITH {FLAGS}, own AS MATERIALIZED (SELECT box, a AS cc_id, count(*) AS level FROM flags WHERE kind = 'node' GROUP BY 1, 2), ed AS (SELECT box, a, b FROM flags WHERE kind = 'edge' AND (box, a, b) IN (SELECT (box, parent, cc_id) FROM forest)),
    parts AS (SELECT box, cc_id, level FROM own UNION ALL SELECT box, a, 1 FROM ed UNION ALL SELECT box, b, 1 FROM ed UNION ALL SELECT e.box, e.dst, o.level FROM edges e JOIN own o ON o.box = e.box AND o.cc_id = e.src UNION ALL SELECT e.box, e.src, o.level FROM edges e JOIN own o ON o.box = e.box AND o.cc_id = e.dst)
    SELECT f.box, f.cc_id, CAST(coalesce(sum(level), 0) AS BIGINT) AS level FROM forest f LEFT JOIN parts p ON p.box = f.box AND p.cc_id = f.cc_id GROUP BY 1, 2""",
    USES,
)
LEVELS = "lv AS MATERIALIZED (SELECT e.box, e.src, e.dst, (f.cc_id IS NOT NULL) AS active, count(g.a) AS level FROM edges e LEFT JOIN forest f ON f.box = e.box AND f.cc_id = e.dst AND f.parent = e.src LEFT JOIN flags g ON g.kind = 'edge' AND g.box = e.box AND g.a = e.src AND g.b = e.dst GROUP BY ALL)"
add(
    "alternative_incoming",
    lambda s, d: A.alternative_incoming(Q.edges(s, d), Q.links(s, d), flags(s, d)),
    f"""WITH {FLAGS}, {LEVELS} SELECT n.box, n.dst AS cc_id, n.src, o.src AS other, n.level, o.level AS other_level FROM lv n JOIN lv o ON o.box = n.box AND o.dst = n.dst AND n.active AND NOT o.active AND o.level < n.level
    WHERE (n.box, n.dst) IN (SELECT (box, a) FROM flags WHERE reason = 'RADIUS_OUTLIER')""",
    USES,
)
PROPOSALS = """proposals AS MATERIALIZED (SELECT DISTINCT g.box, g.a AS src, g.b AS dst, o.cc_id AS other FROM flags g JOIN frame t ON t.box = g.box AND t.cc_id = g.b JOIN (SELECT box, src, dst AS other FROM edges UNION SELECT box, dst, src FROM edges) n ON n.box = g.box AND n.src = g.a AND n.other <> g.b
  JOIN frame o ON o.box = g.box AND o.cc_id = n.other WHERE g.reason = 'WEIRD_CHILD_ORGAN_SURFACE' AND o.day <= t.day AND sqrt((t.cx - o.cx) ** 2 + (t.cy - o.cy) ** 2) <= 6 * sqrt((t.cx - t.fx) ** 2 + (t.cy - t.fy) ** 2)
  AND (t.cx - t.fx) * (o.cx - t.fx) + (t.cy - t.fy) * (o.cy - t.fy) <= 0 AND ((t.cx - t.fx) * (t.cx - o.cx) + (t.cy - t.fy) * (t.cy - o.cy)) / (sqrt((t.cx - t.fx) ** 2 + (t.cy - t.fy) ** 2) * sqrt((t.cx - o.cx) ** 2 + (t.cy - o.cy) ** 2) + 1e-6) >= sqrt(0.5)
  AND ((o.box, o.cc_id) IN (SELECT (box, a) FROM flags) OR (o.box, o.cc_id) IN (SELECT (box, b) FROM flags WHERE b IS NOT NULL)))"""


def proposals(s, d):
    return X.remember(s, d, "proposals", lambda: A.rewire_candidates(frame(s, d), Q.edges(s, d), flags(s, d)))


add("rewire_candidates", proposals, f"WITH {FLAGS}, {PROPOSALS} SELECT * FROM proposals", USES)
add(
    "repair_heuristic",
    lambda s, d: A.repair_heuristic(proposals(s, d), flags(s, d), G.subtree_totals(Q.forest(s, d))),
    f"""WITH {FLAGS}, {PROPOSALS} SELECT p.*, ((SELECT count(*) FROM flags g WHERE g.box = p.box AND g.kind = 'edge' AND g.a = p.src AND g.b = p.dst) + (SELECT count(*) FROM flags g WHERE g.box = p.box AND g.kind = 'node' AND g.a = p.dst)) / 2e0 AS gain, t.n_nodes, t.px
    FROM proposals p LEFT JOIN totals t ON t.box = p.box AND t.cc_id = p.dst""",
    (*USES, "totals"),
)
TOUCHED = """touched AS MATERIALIZED (SELECT box, src, dst, other, unnest([src, dst, other]) AS cc_id FROM proposals UNION SELECT p.box, p.src, p.dst, p.other, e.dst FROM (SELECT *, unnest([src, dst, other]) AS at FROM proposals) p JOIN edges e ON e.box = p.box AND e.src = p.at
  UNION SELECT p.box, p.src, p.dst, p.other, e.src FROM proposals p JOIN edges e ON e.box = p.box AND e.dst = p.dst)"""
add("affected_neighbourhood", lambda s, d: A.affected_neighbourhood(proposals(s, d), Q.edges(s, d)), f"WITH {FLAGS}, {PROPOSALS}, {TOUCHED} SELECT * FROM touched", USES)
add("affected_edges", lambda s, d: A.affected_edges(proposals(s, d), Q.edges(s, d)), f"WITH {FLAGS}, {PROPOSALS}, {TOUCHED} SELECT DISTINCT t.box, t.src, t.dst, t.other, e.src AS a, e.dst AS b FROM touched t JOIN edges e ON e.box = t.box AND (e.src = t.cc_id OR e.dst = t.cc_id)", USES)
add("what_if_gain", lambda s, d: A.what_if_gain(Q.forest(s, d), times(s, d), Q.costed(s, d), proposals(s, d), TYPICAL))
add("greedy_repair", lambda s, d: A.greedy_repair(Q.forest(s, d), times(s, d), Q.costed(s, d), TYPICAL)[1])
