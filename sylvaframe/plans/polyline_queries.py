"""Queries of changed and compared polylines, nearest nodes and segments, and contacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaframe.operators import polylines as L
from sylvaframe.operators import reports as P
from sylvaframe.plans import fixtures as X

BOOK = X.Book()
add = BOOK.add
KEY = "model, root"
W = "WINDOW w AS (PARTITION BY model, root ORDER BY seq)"


def _r(df, *names, digits=3):
    return df.withColumns({n: F.round(n, digits) for n in names})


def on(fn, *names):
    return lambda s, d: _r(fn(X.nodes(s, d)), *names)


def both(fn, *names):
    return lambda s, d: _r(fn(X.nodes(s, d), X.roots(s, d)), *names)


EXACT = "abs(t - round_even(t, 0)) < 1e-6"
add(
    "retime_nodes",
    both(lambda n, r: L.retime_nodes(n, r).select("model", "root", "seq", "t", "th"), "t", "th"),
    f"""WITH z AS (SELECT n.*, r.parent IS NULL AND sum(CASE WHEN nxt = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY n.model, n.root ORDER BY seq) = 0 AS starts FROM (SELECT *, lead(t) OVER w AS nxt FROM segs {W}) n JOIN roots r ON r.model = n.model AND r.root = n.root),
    u AS (SELECT model, root, seq, c, CASE WHEN starts THEN 0 ELSE t END AS t, CASE WHEN starts THEN 0 ELSE th END AS th FROM z),
    e AS (SELECT *, {EXACT} AND NOT coalesce(abs(nt - round_even(nt, 0)) < 1e-6 AND round_even(nt, 0) = round_even(t, 0), false) AS exact FROM (SELECT *, lead(t) OVER w AS nt FROM u {W})),
    m AS (SELECT *, last_value(CASE WHEN exact THEN (c, t, th) END IGNORE NULLS) OVER (PARTITION BY model, root ORDER BY seq ROWS UNBOUNDED PRECEDING) AS a, first_value(CASE WHEN exact THEN (c, t, th) END IGNORE NULLS) OVER (PARTITION BY model, root ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e),
    k AS (SELECT *, NOT exact AND a IS NOT NULL AND b IS NOT NULL AS moves, CASE WHEN b[1] - a[1] < 1e-6 THEN 0.5 ELSE (c - a[1]) / (b[1] - a[1]) END AS share FROM m)
    SELECT {KEY}, seq, round(CASE WHEN moves THEN a[2] + share * (b[2] - a[2]) ELSE t END, 3) AS t, round(CASE WHEN moves THEN a[3] + share * (b[3] - a[3]) ELSE th END, 3) AS th FROM k""",
    ("segs", "roots"),
)


def _distances(n):
    return n.where("seq % 3 = 0").select("model", "root", F.col("seq").alias("q"), (F.col("seq") * 7.25 - 30).alias("d"))


def _at(queries):
    """SQL of places at distances of queries (model, root, q, d)."""
    return f"""SELECT q.model, q.root, q.q, q.d, {', '.join(f"CASE WHEN a.c IS NULL THEN b.{v} WHEN b.c IS NULL THEN a.{v} ELSE b.{v} * (q.d - a.c) / (b.c - a.c) + (1 - (q.d - a.c) / (b.c - a.c)) * a.{v} END AS {v}" for v in ('x', 'y', 't', 'th'))}
    FROM ({queries}) q ASOF LEFT JOIN segs a ON a.model = q.model AND a.root = q.root AND a.c < q.d ASOF LEFT JOIN segs b ON b.model = q.model AND b.root = q.root AND b.c >= q.d"""


add("position_at_distance", on(lambda n: L.position_at_distance(n, _distances(n)), "x", "y", "t", "th"), f"SELECT {KEY}, q, d, round(x, 3) AS x, round(y, 3) AS y, round(t, 3) AS t, round(th, 3) AS th FROM ({_at('SELECT model, root, seq AS q, seq * 7.25e0 - 30 AS d FROM nodes WHERE seq % 3 = 0')})", ("segs", "nodes"))
add(
    "speed_vectors",
    on(lambda n: L.speed_vectors(n, 5.0, 5.0), "vx", "vy"),
    f"""WITH a AS ({_at('SELECT model, root, seq AS q, c - 5 AS d FROM segs')}), b AS ({_at('SELECT model, root, seq AS q, c + 5 AS d FROM segs')})
    SELECT n.model, n.root, n.seq, round(CASE WHEN n.t < 1 THEN 0 ELSE (b.x - CASE WHEN a.t < 1 THEN n.x ELSE a.x END) / nullif(b.th - CASE WHEN a.t < 1 THEN n.th ELSE a.th END, 0) END, 3) AS vx,
    round(CASE WHEN n.t < 1 THEN 0 ELSE (b.y - CASE WHEN a.t < 1 THEN n.y ELSE a.y END) / nullif(b.th - CASE WHEN a.t < 1 THEN n.th ELSE a.th END, 0) END, 3) AS vy
    FROM nodes n JOIN a ON a.model = n.model AND a.root = n.root AND a.q = n.seq JOIN b ON b.model = n.model AND b.root = n.root AND b.q = n.seq""",
    ("segs", "nodes"),
)
add(
    "snap_laterals",
    both(L.snap_laterals),
    f"""SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY seq) AS seq, x, y, diameter, th, t FROM (SELECT {KEY}, seq, x, y, diameter, th, t FROM nodes UNION ALL SELECT f.model, f.root, 0, m[3], m[4], f.diameter, f.th, f.t FROM nodes f
    JOIN (SELECT f.model, f.root, min(((o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y), o.seq, o.x, o.y)) AS m FROM nodes f JOIN roots r ON r.model = f.model AND r.root = f.root JOIN nodes o ON o.model = r.model AND o.root = r.parent AND o.seq > 1 WHERE f.seq = 1 GROUP BY 1, 2) p
    ON p.model = f.model AND p.root = f.root WHERE f.seq = 1)""",
    ("nodes", "roots"),
)
add("translate_nodes", both(lambda n, r: L.translate_nodes(n, r.where("root % 2 = 0").select("model", "root", (F.col("root") % 7).alias("dx"), F.lit(-3).alias("dy"))).select("model", "root", "seq", "x", "y")), "SELECT model, root, seq, x + CASE WHEN root % 2 = 0 THEN root % 7 ELSE 0 END AS x, y - CASE WHEN root % 2 = 0 THEN 3 ELSE 0 END AS y FROM nodes", ("nodes",))
add("node_equality", lambda s, d: L.node_equality(X.nodes(s, d), X.nodes(s, d, "error")), "SELECT n.model, n.root, n.seq, coalesce(p.x = n.x AND p.y = n.y AND p.t = n.t AND p.diameter = n.diameter, false) AS equal FROM nodes n LEFT JOIN nodes_pred p ON p.model = n.model AND p.root = n.root AND p.seq = n.seq", ("nodes", "nodes_pred"))
add("node_precedes", on(lambda n: L.node_precedes(n.select("model", F.col("root").alias("root_a"), F.col("seq").alias("seq_a"), (F.col("root") + F.when(F.col("seq") % 5 == 0, 1).otherwise(0)).alias("root_b"), (F.col("x") % 50).alias("seq_b")))),
    "SELECT *, root_a = root_b AND seq_a <= seq_b AS precedes FROM (SELECT model, root AS root_a, seq AS seq_a, root + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS root_b, x % 50 AS seq_b FROM nodes)", ("nodes",))
add("model_validity", both(lambda n, r: L.model_validity(n.where("root % 5 > 0").withColumn("x", F.when(F.expr("root % 7 = 0 and seq = 2"), None).otherwise(F.col("x"))), r)), "SELECT r.model, r.root, root % 5 > 0 AND NOT (root % 7 = 0 AND EXISTS (SELECT 1 FROM nodes n WHERE n.model = r.model AND n.root = r.root AND n.seq = 2)) AS valid FROM roots r", ("nodes", "roots"))
add(
    "attach_child",
    lambda s, d: L.attach_child(X.roots(s, d), X.roots(s, d).where("root % 4 = 1").join(X.roots(s, d).groupBy("model").agg(F.min("root").alias("least"), F.max("root").alias("most")), "model").select("model", "root", F.when(F.col("root") % 8 == 1, F.col("most")).otherwise(F.col("least")).alias("new_parent"))),
    """WITH RECURSIVE up AS (SELECT model, root, root AS anc FROM roots UNION ALL SELECT u.model, u.root, r.parent FROM up u JOIN roots r ON r.model = u.model AND r.root = u.anc WHERE r.parent IS NOT NULL),
    c AS (SELECT r.model, r.root, CASE WHEN r.root % 8 = 1 THEN most ELSE least END AS np FROM roots r JOIN (SELECT model, min(root) AS least, max(root) AS most FROM roots GROUP BY 1) m ON m.model = r.model WHERE r.root % 4 = 1)
    SELECT r.model, r.root, CASE WHEN c.np IS NOT NULL AND NOT EXISTS (SELECT 1 FROM up WHERE up.model = r.model AND up.root = c.np AND up.anc = r.root) THEN c.np ELSE r.parent END AS parent FROM roots r LEFT JOIN c ON c.model = r.model AND c.root = r.root""",
    ("roots",),
)
MARKS = "SELECT user_id // 30 AS model, user_id AS root, event_id AS line, ['MDL', 'ANCHOR', 'LENGTH'][event_id % 3 + 1] AS type, event_type AS value, CAST(value AS DOUBLE) AS position FROM events"
add(
    "root_annotations",
    lambda s, d: _r(L.root_annotations(X.table(s, d, "events").select(F.expr(f"user_id div {X.ROOTS}").alias("model"), F.col("user_id").alias("root"), F.col("event_id").alias("line"), F.element_at(F.array(F.lit("MDL"), F.lit("ANCHOR"), F.lit("LENGTH")), (F.col("event_id") % 3 + 1).cast("int")).alias("type"), F.col("event_type").alias("mark_value"), F.col("value").alias("position")).withColumnRenamed("mark_value", "value")), "place"),
    f"""SELECT model, root, line, type, value, position, round(CASE WHEN type = 'ANCHOR' THEN position ELSE position - coalesce(origin, 0) END, 3) AS place FROM (SELECT m.*, row_number() OVER (PARTITION BY model, root, type ORDER BY line DESC) AS n, o.origin FROM ({MARKS}) m
    LEFT JOIN (SELECT model, root, arg_max(position, line) AS origin FROM ({MARKS}) WHERE type = 'ANCHOR' GROUP BY 1, 2) o USING (model, root)) WHERE type <> 'MDL' OR n = 1""",
)
D2 = "round((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y), 6)"
add(
    "nearest_node_by_order",
    lambda s, d: L.nearest_node_by_order(X.points(s, d).withColumn("want", F.col("pid") % 2 + 1), X.nodes(s, d), P.root_orders(X.roots(s, d))),
    f"SELECT model, pid, m[2] AS root, m[3] AS seq, m[1] AS d2 FROM (SELECT p.model, pid, min(({D2}, n.root, n.seq)) AS m FROM points p JOIN nodes n ON p.model = n.model AND n.t <= p.z JOIN ranks k ON k.model = n.model AND k.root = n.root AND k.ord = pid % 2 + 1 GROUP BY 1, 2)",
    ("points", "nodes", "ranks"),
)
for name, same, sign in (("nearest_node_by_root", True, "="), ("nearest_node_in_other_root", False, "<>")):
    add(
        name,
        lambda s, d, same=same: L.nearest_node_by_root(X.points(s, d).withColumn("own", F.col("model") * X.ROOTS + F.col("pid") % 10), X.nodes(s, d), same),
        f"SELECT model, pid, m[2] AS root, m[3] AS seq, m[1] AS d2 FROM (SELECT p.model, pid, min(({D2}, n.root, n.seq)) AS m FROM points p JOIN nodes n ON p.model = n.model AND n.t <= p.z AND n.root {sign} p.model * 30 + pid % 10 GROUP BY 1, 2)",
        ("points", "nodes"),
    )
add(
    "nearest_segment",
    lambda s, d: L.nearest_segment(X.points(s, d), X.nodes(s, d), 25.0),
    """SELECT model, pid, m[2] AS root, m[3] AS seq, m[1] AS d2 FROM (SELECT p.model, pid, min((round(((x1 - s.x) * (p.y - s.y) - (y1 - s.y) * (p.x - s.x)) ** 2 / nullif(len * len, 0), 6), s.root, s.seq)) AS m FROM points p JOIN segs s ON s.model = p.model AND x1 IS NOT NULL AND least(s.t, t1) <= p.z
      AND (x1 - s.x) * (p.x - s.x) + (y1 - s.y) * (p.y - s.y) BETWEEN 0 AND (x1 - s.x) * (x1 - s.x) + (y1 - s.y) * (y1 - s.y) WHERE round(((x1 - s.x) * (p.y - s.y) - (y1 - s.y) * (p.x - s.x)) ** 2 / nullif(len * len, 0), 6) < 625 GROUP BY 1, 2)""",
    ("points", "segs"),
)
STEPS = "(SELECT model, root, seq, c, t, lag(x) OVER w AS x0, lag(y) OVER w AS y0, x, y FROM segs WINDOW w AS (PARTITION BY model, root ORDER BY seq))"


def _foot(p, s):
    """SQL of the squared distance of a point to a segment (point prefix and suffix; segment prefix)."""
    x, y = f"{p[0]}.x{p[1]}", f"{p[0]}.y{p[1]}"
    k = f"greatest(0, least(1, coalesce((({x} - {s}.x0) * ({s}.x - {s}.x0) + ({y} - {s}.y0) * ({s}.y - {s}.y0)) / nullif(CAST(({s}.x - {s}.x0) ** 2 + ({s}.y - {s}.y0) ** 2 AS DOUBLE), 0), 0)))"
    return f"sqrt(({x} - {s}.x0 - {k} * ({s}.x - {s}.x0)) ** 2 + ({y} - {s}.y0 - {k} * ({s}.y - {s}.y0)) ** 2)"


CROSS = "((a.x - a.x0) * (b.y - b.y0) - (a.y - a.y0) * (b.x - b.x0))"
MEETS = f"coalesce(((b.x0 - a.x0) * (b.y - b.y0) - (b.y0 - a.y0) * (b.x - b.x0)) / nullif(CAST({CROSS} AS DOUBLE), 0) BETWEEN 0 AND 1 AND ((b.x0 - a.x0) * (a.y - a.y0) - (b.y0 - a.y0) * (a.x - a.x0)) / nullif(CAST({CROSS} AS DOUBLE), 0) BETWEEN 0 AND 1, false)"
APART = f"CASE WHEN {MEETS} THEN 0e0 ELSE least({_foot(('a', '0'), 'b')}, {_foot(('a', ''), 'b')}, {_foot(('b', '0'), 'a')}, {_foot(('b', ''), 'a')}) END"
add(
    "segment_distance",
    on(lambda n: L.segments(n).where("x1 is not null").join(L.segments(n).where("x1 is not null").select("model", (F.col("root") - 1).alias("root"), "seq", *(F.col(c).alias(f"o{c}") for c in ("x", "y", "x1", "y1"))), ["model", "root", "seq"])
        .select("model", "root", "seq", L.segment_distance(*((F.col(x).cast("double"), F.col(y).cast("double")) for x, y in (("x", "y"), ("x1", "y1"), ("ox", "oy"), ("ox1", "oy1"))))["d"].alias("distance")), "distance"),
    f"SELECT a.model, a.root, a.seq - 1 AS seq, round({APART}, 3) AS distance FROM {STEPS} a JOIN {STEPS} b ON b.model = a.model AND b.root = a.root + 1 AND b.seq = a.seq WHERE a.x0 IS NOT NULL",
    ("segs",),
)
add("bbox_overlap", both(lambda n, r: L.segments(n).groupBy("model", "root").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("near", L.bbox_overlap(F.col("lo"), F.col("hi"), F.lag("lo").over(L.Window.partitionBy("model").orderBy("root")), F.lag("hi").over(L.Window.partitionBy("model").orderBy("root")), 3.0))),
    "SELECT *, lo - 3 <= lag(hi) OVER (PARTITION BY model ORDER BY root) AND lag(lo) OVER (PARTITION BY model ORDER BY root) - 3 <= hi AS near FROM (SELECT model, root, min(x) AS lo, max(x) AS hi FROM nodes GROUP BY 1, 2)", ("nodes",))
CONTACTS = f"""(SELECT a.model, a.root AS root_a, a.seq AS seq_a, b.root AS root_b, b.seq AS seq_b, {APART} AS d FROM {STEPS} a JOIN {STEPS} b ON b.model = a.model AND a.root < b.root AND a.x0 IS NOT NULL AND b.x0 IS NOT NULL AND a.c >= 8 AND b.c >= 8 AND a.t <= 25 AND b.t <= 25
  AND greatest(a.x0, a.x) + 4 >= least(b.x0, b.x) AND greatest(b.x0, b.x) + 4 >= least(a.x0, a.x) AND greatest(a.y0, a.y) + 4 >= least(b.y0, b.y) AND greatest(b.y0, b.y) + 4 >= least(a.y0, a.y) WHERE round({APART}, 9) <= 4)"""
add("contact_points", on(lambda n: L.contact_points(n, 4.0, 25.0).drop("x", "y"), "d"), f"SELECT model, root_a, seq_a, root_b, seq_b, round(d, 3) AS d FROM {CONTACTS}", ("segs",))
add("complexity_count", on(lambda n: L.complexity_count(L.contact_points(n, 4.0, 25.0))), f"SELECT model, count(DISTINCT (root_a, root_b)) AS pairs, count(*) AS places FROM {CONTACTS} GROUP BY 1", ("segs",))
