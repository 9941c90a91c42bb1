"""Queries of regions, their adjacency, edge costs and forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaframe.operators import graph as G
from sylvaframe.operators import regions as R
from sylvaframe.plans import fixtures as X

BOOK = X.Book()
add = BOOK.add


def labelled(s, d):
    return X.remember(s, d, "labelled", lambda: R.connected_components(X.cells(s, d)))


def comps(s, d):
    return R.component_attributes(labelled(s, d))


def edges(s, d):
    return X.remember(s, d, "edges", lambda: R.adjacency_edges(R.facets(labelled(s, d)), comps(s, d)))


def costed(s, d):
    return R.edge_cost_static(edges(s, d)).withColumn("cost", F.round("cost", 6))


def hours(s):
    return s.range(X.FRAMES).select(F.col("id").alias("i"), (F.col("id") * 8.0).alias("h"))


def timed(s, d):
    """Edges with their cost and the hours of both ends."""
    return R.timed_edges(costed(s, d), R.component_times(comps(s, d), hours(s)))


def forest(s, d):
    """Components with their cheapest predecessor and the connection to it."""

    def build():
        links = edges(s, d).select("box", F.col("dst").alias("cc_id"), F.col("src").alias("parent"), "fx", "fy")
        best = R.best_incoming(costed(s, d)).select("box", F.col("dst").alias("cc_id"), F.col("src").alias("parent"))
        rows = comps(s, d).join(best, ["box", "cc_id"], "left").join(links, ["box", "cc_id", "parent"], "left")
        return rows.select("box", "cc_id", "parent", "n_px", "day", "cx", "cy", F.col("cx").alias("x"), "fx", "fy")

    return X.remember(s, d, "forest", build)


def organs(s, d):
    return X.remember(s, d, "organs", lambda: G.organs(forest(s, d)))


def _r(df, *names):
    return df.withColumns({n: F.round(n, 4) for n in names})


def on_comps(fn):
    return lambda s, d: fn(comps(s, d))


def on_edges(fn):
    return lambda s, d: fn(edges(s, d))


add("connected_components", labelled, "SELECT box, x, y, day, cc_id FROM labelled", ("labelled",))
add("component_size_filter", lambda s, d: R.component_size_filter(labelled(s, d), 3), "SELECT * FROM labelled WHERE (box, cc_id) IN (SELECT (box, cc_id) FROM comps WHERE n_px >= 3)", ("labelled", "comps"))
add("component_attributes", comps, "SELECT * FROM comps", ("comps",))
add(
    "component_central_pixel",
    lambda s, d: _r(R.component_central_pixel(labelled(s, d), comps(s, d)), "x", "y"),
    """SELECT box, cc_id, round(CASE WHEN whole THEN mx ELSE p[2] END, 4) AS x, round(CASE WHEN whole THEN my ELSE p[3] END, 4) AS y FROM (
      SELECT *, (SELECT count(*) FROM labelled l WHERE l.box = m.box AND l.cc_id = m.cc_id AND l.x IN (floor(mx), ceil(mx)) AND l.y IN (floor(my), ceil(my))) = len(list_distinct([floor(mx), ceil(mx)])) * len(list_distinct([floor(my), ceil(my)])) AS whole
      FROM (SELECT l.box, l.cc_id, min((CAST((x - cx) * (x - cx) + (y - cy) * (y - cy) AS DOUBLE), x, y)) AS p, avg(x) AS mx, avg(y) AS my FROM labelled l JOIN comps c ON l.box = c.box AND l.cc_id = c.cc_id GROUP BY 1, 2) m)""",
    ("labelled", "comps"),
)
add(
    "component_times",
    lambda s, d: R.component_times(comps(s, d), hours(s)),
    "SELECT box, cc_id, CASE WHEN day >= 2 THEN (day - 2) * 8e0 ELSE (day - 1) * 8e0 END AS h_start, (CASE WHEN day >= 2 THEN (day - 2) * 8e0 ELSE (day - 1) * 8e0 END + (day - 1) * 8e0) / 2 AS h_mid, (day - 1) * 8e0 AS h_tip FROM comps",
    ("comps",),
)
add(
    "enclosed_components",
    lambda s, d: R.enclosed_components(X.cells(s, d), labelled(s, d), 40, 40),
    """SELECT l.box, l.cc_id FROM labelled l JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) m(dx, dy) ON true LEFT JOIN cells c ON c.box = l.box AND c.x = l.x + dx AND c.y = l.y + dy
    WHERE coalesce(c.day, 0) <> l.day GROUP BY 1, 2 HAVING min(coalesce(c.day, 0)) > 0 AND count(DISTINCT coalesce(c.day, 0)) = 1""",
    ("labelled",),
)
add(
    "pixel_membership",
    lambda s, d: R.pixel_membership(X.table(s, d, "part").select(F.lit("A_0").alias("box"), (F.col("p_partkey") % 40).cast("int").alias("x"), (F.col("p_size") % 40).cast("int").alias("y"), "p_partkey"), labelled(s, d)),
    "SELECT 'A_0' AS box, CAST(p_partkey % 40 AS INTEGER) AS x, CAST(p_size % 40 AS INTEGER) AS y, p_partkey FROM part WHERE ('A_0', p_partkey % 40, p_size % 40) IN (SELECT (box, x, y) FROM labelled)",
    ("labelled",),
)
add(
    "fuse_components",
    on_comps(lambda c: R.fuse_components(c, F.col("cc_id") % 10)),
    "SELECT box, cc_id % 10 AS grp, CAST(sum(n_px) AS BIGINT) AS n_px, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax, count(*) AS n FROM comps GROUP BY 1, 2",
    ("comps",),
)
add(
    "surface_growth_rate",
    on_comps(lambda c: c.select("box", "cc_id", F.round(R.surface_growth_rate(F.col("n_px"), F.greatest(F.col("day") - 2, F.lit(0)) * 8.0, (F.col("day") - 1) * 8.0, 8.0), 4).alias("rate"))),
    "SELECT box, cc_id, round(n_px / 8.0, 4) AS rate FROM comps",
    ("comps",),
)
add(
    "nearest_component",
    lambda s, d: R.nearest_component(X.table(s, d, "supplier").select(F.lit("A_0").alias("box"), (F.col("s_suppkey") % 40).alias("px"), (F.col("s_nationkey") * 1.5).cast("double").alias("py"), "s_suppkey"), comps(s, d), "s_suppkey"),
    """SELECT 'A_0' AS box, s_suppkey, m[2] AS cc_id, m[1] AS d2 FROM (SELECT s_suppkey, min((CAST(pow(s_suppkey % 40 - cx, 2) + pow(s_nationkey * 1.5 - cy, 2) AS DOUBLE), cc_id)) AS m FROM supplier JOIN comps ON box = 'A_0' GROUP BY 1)""",
    ("comps",),
)
add("max_label_per_date", on_comps(R.max_label_per_date), "SELECT box, day, max(cc_id) AS max_label FROM comps GROUP BY 1, 2", ("comps",))
add("component_order_x", on_comps(R.component_order_x), "SELECT box, cc_id, row_number() OVER (PARTITION BY box ORDER BY cx, cc_id) AS place FROM comps", ("comps",))
add(
    "bbox_candidates",
    on_comps(R.bbox_candidates),
    """SELECT a.box, a.cc_id AS a, b.cc_id AS b FROM comps a JOIN comps b ON a.box = b.box AND a.cc_id < b.cc_id AND a.xmin <= b.xmax + 1 AND b.xmin <= a.xmax + 1 AND a.ymin <= b.ymax + 1 AND b.ymin <= a.ymax + 1""",
    ("comps",),
)
add("facets", lambda s, d: _r(R.facets(labelled(s, d)), "fx", "fy"), "SELECT box, src, dst, n_facets, round(fx, 4) AS fx, round(fy, 4) AS fy FROM facets", ("facets",))
add("adjacency_edges", on_edges(lambda e: _r(e, "fx", "fy")), "SELECT * REPLACE (round(fx, 4) AS fx, round(fy, 4) AS fy) FROM edges", ("edges",))
DEG = "(SELECT box, cc_id, (SELECT count(*) FROM edges e WHERE e.box = c.box AND e.src = c.cc_id) AS n_out, (SELECT count(*) FROM edges e WHERE e.box = c.box AND e.dst = c.cc_id) AS n_in FROM comps c)"
add("degrees", lambda s, d: R.degrees(comps(s, d), edges(s, d)), f"SELECT * FROM {DEG}", ("comps", "edges"))
add(
    "drop_late_isolated_starts",
    lambda s, d: R.drop_late_isolated_starts(comps(s, d), edges(s, d)),
    f"""SELECT * FROM (SELECT box, cc_id, CASE WHEN gap IS NULL THEN 'no successor' WHEN gap > 1 THEN 'late successor' END AS reason FROM (SELECT c.*, (SELECT min(day_t - day_s) FROM edges e WHERE e.box = c.box AND e.src = c.cc_id) AS gap FROM {DEG} c WHERE n_in = 0)) WHERE reason IS NOT NULL""",
    ("comps", "edges"),
)
RATE_S, RATE_T = "floor(n_s / CASE WHEN s_tip = s_start THEN 1e-6 ELSE s_tip - s_start END + 0.5)", "floor(n_t / CASE WHEN t_tip = t_start THEN 1e-6 ELSE t_tip - t_start END + 0.5)"
add(
    "exclude_fuzzy_dead_ends",
    lambda s, d: R.exclude_fuzzy_dead_ends(comps(s, d), timed(s, d)),
    f"""SELECT e.box, e.dst AS cc_id, 'DEAD_END_FUZZY_SURFACE' AS reason FROM timed e JOIN {DEG} t ON t.box = e.box AND t.cc_id = e.dst AND t.n_out = 0 AND t.n_in = 1 JOIN {DEG} f ON f.box = e.box AND f.cc_id = e.src AND f.n_out > 1
    WHERE {RATE_S} > 10 * {RATE_T}""",
    ("comps", "timed"),
)
add(
    "exclude_tiny_starts",
    lambda s, d: R.exclude_tiny_starts(comps(s, d), timed(s, d)),
    f"SELECT e.box, e.src AS cc_id, 'START_VERY_SMALL_RELATIVE_TO_SUCCESSOR' AS reason FROM timed e JOIN {DEG} t ON t.box = e.box AND t.cc_id = e.src AND t.n_in = 0 AND t.n_out = 1 WHERE {RATE_T} > 10 * {RATE_S}",
    ("comps", "timed"),
)
add("extremity_flag", lambda s, d: R.extremity_flag(comps(s, d), edges(s, d).where("n_facets > 1")), "SELECT c.box, c.cc_id, NOT EXISTS (SELECT 1 FROM edges e WHERE n_facets > 1 AND e.box = c.box AND e.src = c.cc_id) OR NOT EXISTS (SELECT 1 FROM edges e WHERE n_facets > 1 AND e.box = c.box AND e.dst = c.cc_id) AS is_extremity FROM comps c", ("comps", "edges"))
add("set_out", lambda s, d: R.set_out(edges(s, d), comps(s, d).where("cc_id % 5 = 0")).select("box", "src", "dst"), "SELECT box, src, dst FROM edges WHERE src % 5 <> 0 AND dst % 5 <> 0", ("edges",))
UNIQUE = "SELECT *, count(*) OVER (PARTITION BY box, src) AS n_out, count(*) OVER (PARTITION BY box, dst) AS n_in FROM {}"
add("activate_unique_links", on_edges(lambda e: R.activate_unique_links(e).select("box", "src", "dst")), f"SELECT box, src, dst FROM ({UNIQUE.format('edges')}) WHERE n_out = 1 AND n_in = 1", ("edges",))
DAILY = UNIQUE.format("(SELECT * FROM timed WHERE day_t = day_s + 1)")
add(
    "activate_daily_unique_links",
    lambda s, d: R.activate_daily_unique_links(timed(s, d)).select("box", "src", "dst"),
    f"""SELECT box, src, dst FROM (SELECT *, n_s / (s_tip - s_start + 1e-6) AS v0, n_t / (t_tip - t_start + 1e-6) AS v1 FROM ({DAILY})) WHERE n_out = 1 AND n_in = 1 AND v1 <= 3 * v0 AND v0 <= 3 * v1""",
    ("timed",),
)
LEN = "sqrt((tx - fx) * (tx - fx) + (ty - fy) * (ty - fy))"
add("hint_vectors", on_edges(lambda e: _r(R.hint_vectors(e), "length", "ux", "uy")), f"SELECT box, src, dst, round({LEN}, 4) AS length, round((tx - fx) / nullif({LEN}, 0), 4) AS ux, round((ty - fy) / nullif({LEN}, 0), 4) AS uy FROM edges", ("edges",))
add("edge_cost_static", on_edges(lambda e: _r(R.edge_cost_static(e).select("box", "src", "dst", "cost"), "cost")), "SELECT box, src, dst, round(cost, 4) AS cost FROM costed", ("costed",))
SPEED = f"{LEN} / CASE WHEN t_mid = t_start THEN 4 ELSE t_mid - t_start + 1e-6 END"
add("edge_velocity", lambda s, d: _r(R.edge_velocity(timed(s, d), 8.0).select("box", "src", "dst", "speed"), "speed"), f"SELECT box, src, dst, round({SPEED}, 4) AS speed FROM timed", ("timed",))
add("surface_cost", on_edges(lambda e: e.select("box", "src", "dst", F.round(R.surface_cost(F.col("n_s"), F.col("n_t")), 4).alias("cost"))), "SELECT box, src, dst, round(abs(n_s - n_t) / CAST(n_s + n_t AS DOUBLE), 4) AS cost FROM edges", ("edges",))
add("best_incoming", lambda s, d: R.best_incoming(costed(s, d)), "SELECT box, dst, m[2] AS src, m[1] AS cost FROM (SELECT box, dst, min((round(cost, 6), src)) AS m FROM costed GROUP BY 1, 2)", ("costed",))
add("best_outgoing", lambda s, d: R.best_outgoing(costed(s, d)), "SELECT box, src, m[2] AS dst, m[1] AS cost FROM (SELECT box, src, min((round(cost, 6), dst)) AS m FROM costed GROUP BY 1, 2)", ("costed",))
add("best_outgoing_by_weight", lambda s, d: R.best_outgoing_by_weight(costed(s, d), "n_t"), "SELECT box, src, m[3] AS dst, -m[1] AS n_t FROM (SELECT box, src, min((-n_t, round(cost, 6), dst)) AS m FROM costed GROUP BY 1, 2)", ("costed",))
add(
    "parent_or_start",
    lambda s, d: R.parent_or_start(comps(s, d), costed(s, d), 1.2),
    "SELECT c.box, c.cc_id, CASE WHEN m[1] < 1.2 THEN m[2] END AS parent, CASE WHEN m[1] < 1.2 THEN m[1] ELSE 1.2 END AS cost FROM comps c LEFT JOIN (SELECT box, dst, min((round(cost, 6), src)) AS m FROM costed GROUP BY 1, 2) b ON b.box = c.box AND b.dst = c.cc_id",
    ("costed", "comps"),
)
add("selection_candidates", on_edges(lambda e: R.selection_candidates(e, F.col("n_facets") > 2).select("box", "src", "dst", "active")), "SELECT box, src, dst, n_facets > 2 AS active FROM (SELECT *, max(CAST(n_facets > 2 AS INTEGER)) OVER (PARTITION BY box, dst) AS has FROM edges) WHERE n_facets > 2 OR has = 0", ("edges",))


TYPICAL = 8.0


def samples(s, d):
    return X.remember(s, d, "samples", lambda: _r(R.speed_samples(timed(s, d), F.expr("n_facets > 1"), TYPICAL), "rate", "ratio", "speed"))


def _rates(half):
    """SQL of the logarithms of the source's rate and of its ratio to the target's."""
    rate = lambda p: f"n_{p} / CASE WHEN {p}_tip = {p}_start THEN {half} ELSE {p}_tip - {p}_start + 1e-6 END"
    return f"ln({rate('s')} + 1e-6)", f"ln(({rate('s')}) / ({rate('t')} + 1e-6) + 1e-6)"


SAMPLES = f"""samples AS MATERIALIZED (SELECT box, dst AS id, m[3] AS src, round(m[4], 4) AS rate, round(m[5], 4) AS ratio, round(m[6], 4) AS speed FROM (
  SELECT box, dst, min((CASE WHEN n_facets > 1 THEN 0 ELSE 1 END, rcost, src, {_rates(4)[0]}, {_rates(4)[1]}, ln(greatest({SPEED}, 1e-6)))) AS m FROM timed GROUP BY 1, 2))"""
# The 20 nearest samples of each distinct query of a box, and their medians.
KNN = """near AS MATERIALIZED (SELECT q.box, q.qa, q.qb, n.speed FROM (SELECT DISTINCT box, qa, qb FROM asked) q JOIN samples n ON n.box = q.box
  QUALIFY row_number() OVER (PARTITION BY q.box, q.qa, q.qb ORDER BY round((q.qa - n.rate) * (q.qa - n.rate) + (q.qb - n.ratio) * (q.qb - n.ratio), 9), n.id) <= 20),
mid AS MATERIALIZED (SELECT box, qa, qb, median(speed) AS median FROM near GROUP BY ALL),
stats AS MATERIALIZED (SELECT n.box, n.qa, n.qb, m.median, median(speed) FILTER (speed <= m.median) AS low, median(speed) FILTER (speed >= m.median) AS high FROM near n JOIN mid m ON m.box = n.box AND m.qa = n.qa AND m.qb = n.qb GROUP BY ALL)"""
ASKED = f"asked AS MATERIALIZED (SELECT *, round({_rates(8)[0]}, 9) AS qa, round({_rates(8)[1]}, 9) AS qb, ln({SPEED} + 1e-6) AS log_speed FROM timed)"
add("speed_samples", samples, f"WITH {SAMPLES} SELECT * FROM samples", ("timed",))


def _queries(s, d):
    rows = samples(s, d).select("box", F.struct("rate", "ratio").alias("query")).distinct()
    return rows.select("box", "query", "query.rate", "query.ratio")


add(
    "knn_speed_stats",
    lambda s, d: R.knn_speed_stats(_queries(s, d), samples(s, d), 20).select("box", "query.rate", "query.ratio", *(F.round(c, 6).alias(c) for c in ("median", "low", "high"))),
    f"WITH {SAMPLES}, asked AS (SELECT box, rate AS qa, ratio AS qb FROM samples), {KNN} SELECT box, qa AS rate, qb AS ratio, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high FROM stats",
    ("timed",),
)
MAD = "1 - exp(-abs(log_speed - median) / (1.4826 * (CASE WHEN log_speed < median THEN median - low ELSE high - median END + 1e-6)) / 2)"
DISTANCE = f"priced AS MATERIALIZED (SELECT a.*, {MAD} AS dc FROM asked a JOIN stats k ON k.box = a.box AND k.qa = a.qa AND k.qb = a.qb)"
add(
    "distance_cost",
    lambda s, d: _r(R.distance_cost(timed(s, d), samples(s, d), TYPICAL), "distance_cost"),
    f"WITH {SAMPLES}, {ASKED}, {KNN}, {DISTANCE} SELECT box, src, dst, round(dc, 4) AS distance_cost FROM priced",
    ("timed",),
)
add(
    "edge_cost_velocity",
    lambda s, d: _r(R.edge_cost_velocity(timed(s, d), samples(s, d), TYPICAL).select("box", "src", "dst", "cost"), "cost"),
    f"WITH {SAMPLES}, {ASKED}, {KNN}, {DISTANCE} SELECT box, src, dst, round(least(100, tc + 3 * dc + 2 * coalesce(oc, 100) + sc), 4) AS cost FROM priced",
    ("timed",),
)


def hidden(s, d):
    return X.remember(s, d, "hidden", lambda: R.hidden_edge_candidates(comps(s, d), edges(s, d), 2))


BUSY = "(SELECT c.box, c.cc_id, c.day FROM comps c JOIN (SELECT box, n, count(*) FILTER (o) AS n_out, count(*) FILTER (NOT o) AS n_in FROM (SELECT box, src AS n, true AS o FROM edges UNION ALL SELECT box, dst, false FROM edges) GROUP BY 1, 2) g ON g.box = c.box AND g.n = c.cc_id AND (n_out > 1 OR n_in > 1))"
HIDDEN = f"""sides AS MATERIALIZED (SELECT b.*, c.day AS to_day FROM (SELECT box, src AS a, dst AS b FROM edges UNION ALL SELECT box, dst, src FROM edges) b JOIN comps c ON c.box = b.box AND c.cc_id = b.b),
one AS MATERIALIZED (SELECT s.box, s.cc_id AS src, s.day, b AS dst, to_day, [s.cc_id, b] AS path FROM {BUSY} s JOIN sides ON sides.box = s.box AND a = s.cc_id),
two AS MATERIALIZED (SELECT o.box, o.src, o.day, b.b AS dst, b.to_day, min([o.src, o.dst, b.b]) AS path FROM one o JOIN sides b ON b.box = o.box AND b.a = o.dst AND o.to_day <= o.day AND b.b <> o.src
  WHERE (o.box, o.src, b.b) NOT IN (SELECT (box, src, dst) FROM one) GROUP BY ALL),
ways AS MATERIALIZED (SELECT box, src, dst, path FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE to_day >= day)"""
PATHS = "array_to_string(path, ',')"
add("hidden_edge_candidates", lambda s, d: hidden(s, d).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ",")), f"WITH {HIDDEN} SELECT box, src, dst, {PATHS} AS path FROM ways", ("edges", "comps"))
add(
    "component_path_length",
    lambda s, d: _r(R.component_path_length(hidden(s, d), edges(s, d), comps(s, d)), "path_length"),
    f"""WITH {HIDDEN}, side AS MATERIALIZED (SELECT box, src AS a, dst AS b, fx, fy FROM edges UNION ALL SELECT box, dst, src, fx, fy FROM edges),
    legs AS (SELECT w.box, w.src, w.dst, s.cx AS x0, s.cy AS y0, t.cx AS x1, t.cy AS y1, f.fx AS ax, f.fy AS ay, g.fx AS bx, g.fy AS ey FROM ways w JOIN comps s ON s.box = w.box AND s.cc_id = w.src JOIN comps t ON t.box = w.box AND t.cc_id = w.dst
      JOIN side f ON f.box = w.box AND f.a = w.path[1] AND f.b = w.path[2] LEFT JOIN side g ON g.box = w.box AND g.a = w.path[2] AND g.b = w.path[3])
    SELECT box, src, dst, round(sqrt((x0 - ax) ** 2 + (y0 - ay) ** 2) + coalesce(sqrt((ax - bx) ** 2 + (ay - ey) ** 2), 0) + sqrt((coalesce(bx, ax) - x1) ** 2 + (coalesce(ey, ay) - y1) ** 2), 4) AS path_length FROM legs""",
    ("edges", "comps"),
)
add(
    "organ_neighbours",
    lambda s, d: R.organ_neighbours(forest(s, d).where("parent is not null").select("box", F.col("parent").alias("src"), F.col("cc_id").alias("dst")), organs(s, d)),
    """SELECT o.box, o.cc_id, CASE WHEN p.ord = o.ord THEN p.cc_id END AS before, (SELECT min(k.cc_id) FROM forest g JOIN organs k ON k.box = g.box AND k.cc_id = g.cc_id WHERE g.box = o.box AND g.parent = o.cc_id AND k.ord = o.ord) AS after
    FROM organs o JOIN forest f ON f.box = o.box AND f.cc_id = o.cc_id LEFT JOIN organs p ON p.box = f.box AND p.cc_id = f.parent""",
    ("organs",),
)


def _pointed(s, d):
    o = X.table(s, d, "supplier")
    return o.select(
        F.concat(F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("s_suppkey") % 3 + 1).cast("int")), F.lit("_0")).alias("box"), F.col("s_suppkey").alias("query"), (F.col("s_suppkey") % 5).alias("q_day_s"), (F.col("s_suppkey") % 7).alias("q_day_t"),
        (F.col("s_suppkey") % 40).alias("q_sx"), (F.col("s_nationkey") % 40).alias("q_sy"), (F.col("s_suppkey") % 37).alias("q_tx"), (F.col("s_nationkey") % 31).alias("q_ty"),
    )


add(
    "nearest_edge",
    lambda s, d: R.nearest_edge(_pointed(s, d), edges(s, d)),
    """SELECT box, query, m[2] AS src, m[3] AS dst, m[1] AS d2 FROM (SELECT e.box, s_suppkey AS query, min((CAST((day_s - s_suppkey % 5) ** 2 + (day_t - s_suppkey % 7) ** 2 + (sx - s_suppkey % 40) ** 2 + (sy - s_nationkey % 40) ** 2 + (tx - s_suppkey % 37) ** 2 + (ty - s_nationkey % 31) ** 2 AS DOUBLE), src, dst)) AS m
    FROM supplier JOIN edges e ON e.box = ['A', 'N', 'R'][s_suppkey % 3 + 1] || '_0' GROUP BY 1, 2)""",
    ("edges",),
)


def on_forest(fn):
    return lambda s, d: fn(forest(s, d))


def on_organs(fn):
    return lambda s, d: fn(organs(s, d))


def links(s, d):
    """Active edges: those of the forest."""
    return forest(s, d).where("parent is not null").select("box", F.col("parent").alias("src"), F.col("cc_id").alias("dst"))


LEAF = "(SELECT * FROM forest f WHERE NOT EXISTS (SELECT 1 FROM forest k WHERE k.box = f.box AND k.parent = f.cc_id))"
add("path_to_root", on_forest(G.closure), "SELECT box, node, anc, depth FROM closure", ("closure",))
add("node_depth", on_forest(G.node_depth), "SELECT box, node AS cc_id, CAST(max(depth) AS BIGINT) AS depth FROM closure GROUP BY 1, 2", ("closure",))
add("node_height", on_forest(G.node_height), "SELECT box, anc AS cc_id, CAST(max(depth) AS BIGINT) AS height FROM closure GROUP BY 1, 2", ("closure",))
add("descendants", on_forest(G.descendants), "SELECT box, anc AS cc_id, node AS descendant FROM closure WHERE depth > 0", ("closure",))
add("leaves", on_forest(G.leaves_below), f"SELECT c.box, c.anc AS cc_id, c.node AS leaf FROM closure c JOIN {LEAF} l ON l.box = c.box AND l.cc_id = c.node", ("closure",))
add("subtree_totals", on_forest(G.subtree_totals), "SELECT * FROM totals", ("totals",))
add(
    "downstream_accumulation",
    on_forest(G.downstream_accumulation),
    f"""SELECT box, anc AS cc_id, CAST(sum(px) AS BIGINT) AS px, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c.box, c.anc, sum(f.n_px) OVER w AS px, count(*) OVER w AS n FROM closure c JOIN {LEAF} l ON l.box = c.box AND l.cc_id = c.node
    JOIN forest f ON f.box = c.box AND f.cc_id = c.anc WINDOW w AS (PARTITION BY c.box, c.node ORDER BY c.depth ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2""",
    ("closure",),
)
add("forest_roots", on_forest(lambda f: G.forest_roots(f).select("box", "cc_id")), "SELECT box, cc_id FROM forest WHERE parent IS NULL", ("forest",))
add(
    "prune_small_trees",
    on_forest(lambda f: G.prune_small_trees(f, 3, 5)),
    "SELECT c.box, c.node AS cc_id, c.anc AS root FROM closure c JOIN forest f ON f.box = c.box AND f.cc_id = c.anc AND f.parent IS NULL JOIN totals t ON t.box = c.box AND t.cc_id = c.anc WHERE n_nodes >= 3 AND px > 5",
    ("totals",),
)
add("main_path", on_organs(G.main_path), "SELECT box, cc_id, organ_id, idx FROM organs WHERE ord = 1", ("organs",))
add("lateral_orders", on_organs(lambda o: o.select("box", "cc_id", "ord", "organ_id", "idx")), "SELECT box, cc_id, CAST(ord AS BIGINT) AS ord, organ_id, idx FROM organs", ("organs",))
add("plant_index", on_forest(G.plant_index), "SELECT * FROM plants", ("plants",))
add(
    "organ_path",
    on_organs(lambda o: G.organ_path(o).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))),
    "SELECT box, organ_id, string_agg(CAST(cc_id AS VARCHAR), ',' ORDER BY idx) AS path FROM organs GROUP BY 1, 2",
    ("organs",),
)
add("children", on_forest(G.children), "SELECT f.box, f.cc_id, count(k.cc_id) AS n, count(k.cc_id) = 0 AS is_leaf FROM forest f LEFT JOIN forest k ON k.box = f.box AND k.parent = f.cc_id GROUP BY 1, 2", ("forest",))
add("lateral_starts", on_organs(G.lateral_starts), "SELECT o.box, o.cc_id, f.parent, CAST(o.ord AS BIGINT) AS ord FROM organs o JOIN forest f ON f.box = o.box AND f.cc_id = o.cc_id WHERE ord > 1 AND organ_id = o.cc_id", ("organs",))
add("all_lateral_organs", lambda s, d: G.all_lateral_organs(forest(s, d), organs(s, d)), "SELECT c.box, c.anc AS cc_id, c.node AS organ FROM closure c JOIN organs s ON s.box = c.box AND s.cc_id = c.node AND s.organ_id = s.cc_id JOIN organs o ON o.box = c.box AND o.cc_id = c.anc WHERE depth > 0 AND s.ord > o.ord", ("organs",))
add("direct_lateral_organs", on_organs(G.direct_lateral_organs), "SELECT f.box, p.organ_id AS on_organ, f.cc_id AS organ FROM forest f JOIN organs o ON o.box = f.box AND o.cc_id = f.cc_id AND o.organ_id = o.cc_id JOIN organs p ON p.box = f.box AND p.cc_id = f.parent", ("organs",))
add("attachment_points", on_organs(G.attachment_points), "SELECT o.box, o.organ_id, f.parent, p.organ_id AS parent_organ, p.idx AS at FROM organs o JOIN forest f ON f.box = o.box AND f.cc_id = o.cc_id AND o.organ_id = o.cc_id JOIN organs p ON p.box = f.box AND p.cc_id = f.parent", ("organs",))
add("main_trunk_path", lambda s, d: G.main_trunk_path(organs(s, d), G.plant_index(forest(s, d))), "SELECT o.box, plant, idx, o.cc_id FROM organs o JOIN plants p ON p.box = o.box AND p.cc_id = o.cc_id WHERE ord = 1", ("organs", "plants"))


def _dropped(s, d):
    """What is left of nodes and edges without the laterals of one in four organ numbers."""
    some = organs(s, d).where("organ_id % 4 = 1").select("box", "organ_id").distinct()
    nodes, kept = G.drop_lateral_chain(forest(s, d), links(s, d), organs(s, d), some)
    return nodes.select("box", F.lit("node").alias("kind"), F.col("cc_id").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(kept.select("box", F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


GONE = "(SELECT (box, cc_id) FROM organs WHERE organ_id % 4 = 1 AND ord > 1)"
add(
    "drop_lateral_chain",
    _dropped,
    f"""SELECT box, 'node' AS kind, cc_id AS a, NULL AS b FROM forest WHERE (box, cc_id) NOT IN {GONE}
    UNION ALL SELECT box, 'edge', parent, cc_id FROM forest WHERE parent IS NOT NULL AND (box, cc_id) NOT IN {GONE} AND (box, parent) NOT IN {GONE}""",
    ("organs",),
)
add(
    "chain_ends",
    lambda s, d: G.chain_ends(comps(s, d), costed(s, d)),
    """WITH RECURSIVE nxt AS MATERIALIZED (SELECT box, src, min((round(cost, 6), dst))[2] AS dst FROM costed GROUP BY 1, 2),
    chain AS (SELECT box, cc_id, cc_id AS last, 0 AS steps FROM comps UNION ALL SELECT c.box, c.cc_id, n.dst, c.steps + 1 FROM chain c JOIN nxt n ON n.box = c.box AND n.src = c.last)
    SELECT box, cc_id, arg_max(last, steps) AS last, CAST(max(steps) AS BIGINT) AS steps FROM chain GROUP BY 1, 2""",
    ("costed", "comps"),
)
add(
    "forest_statistics",
    on_forest(G.forest_statistics),
    f"""SELECT p.box, plant, count(*) AS n_nodes, CAST(max(d.depth) AS BIGINT) AS height, CAST(sum(f.n_px) AS BIGINT) AS px, count(l.cc_id) AS n_leaves, count(*) FILTER (o.organ_id = o.cc_id AND ord > 1) AS n_laterals FROM plants p JOIN forest f ON f.box = p.box AND f.cc_id = p.cc_id
    JOIN organs o ON o.box = p.box AND o.cc_id = p.cc_id JOIN (SELECT box, node, max(depth) AS depth FROM closure GROUP BY 1, 2) d ON d.box = p.box AND d.node = p.cc_id LEFT JOIN {LEAF} l ON l.box = p.box AND l.cc_id = p.cc_id GROUP BY 1, 2""",
    ("organs", "plants"),
)
add(
    "tree_consistency",
    # Successors by facets, not by the forest, so that some components have none of their order.
    lambda s, d: G.tree_consistency(organs(s, d), edges(s, d).where("n_facets > 1").select("box", "src", "dst")),
    """SELECT o.box, o.cc_id, CAST(o.ord AS BIGINT) AS ord FROM organs o WHERE EXISTS (SELECT 1 FROM edges e WHERE n_facets > 1 AND e.box = o.box AND e.src = o.cc_id)
    AND NOT EXISTS (SELECT 1 FROM edges e JOIN organs k ON k.box = e.box AND k.cc_id = e.dst WHERE n_facets > 1 AND e.box = o.box AND e.src = o.cc_id AND k.ord = o.ord)""",
    ("organs",),
)
add(
    "drop_unselected_edges",
    lambda s, d: G.drop_unselected_edges(costed(s, d), F.expr("n_facets > 1 or cost < 1")).select("box", "src", "dst", "is_out", "reason"),
    "SELECT box, src, dst, NOT (n_facets > 1 OR round(cost, 6) < 1) AS is_out, CASE WHEN NOT (n_facets > 1 OR round(cost, 6) < 1) THEN 'NON_ACTIVATED_STEP5' END AS reason FROM costed",
    ("costed",),
)
add(
    "exclusion_summary",
    lambda s, d: G.exclusion_summary(
        R.exclude_fuzzy_dead_ends(comps(s, d), timed(s, d)).unionByName(R.exclude_tiny_starts(comps(s, d), timed(s, d))), G.drop_unselected_edges(costed(s, d), F.expr("n_facets > 1 or cost < 1"))
    ),
    f"""SELECT kind, reason, count(*) AS n FROM (SELECT 'node' AS kind, 'DEAD_END_FUZZY_SURFACE' AS reason FROM timed e JOIN {DEG} t ON t.box = e.box AND t.cc_id = e.dst AND t.n_out = 0 AND t.n_in = 1 JOIN {DEG} f ON f.box = e.box AND f.cc_id = e.src AND f.n_out > 1 WHERE {RATE_S} > 10 * {RATE_T}
    UNION ALL SELECT 'node', 'START_VERY_SMALL_RELATIVE_TO_SUCCESSOR' FROM timed e JOIN {DEG} t ON t.box = e.box AND t.cc_id = e.src AND t.n_in = 0 AND t.n_out = 1 WHERE {RATE_T} > 10 * {RATE_S}
    UNION ALL SELECT 'edge', 'NON_ACTIVATED_STEP5' FROM costed WHERE NOT (n_facets > 1 OR round(cost, 6) < 1)) GROUP BY 1, 2""",
    ("timed", "comps", "costed"),
)
