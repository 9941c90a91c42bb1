"""Queries of polylines, traits and nearest nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaframe.operators import traits as T
from sylvaframe.plans import fixtures as X

BOOK = X.Book()
add = BOOK.add
W = "WINDOW w AS (PARTITION BY model, root ORDER BY seq)"
KEY = "model, root"


def _r(df, *names):
    # dates have four places already
    return df.withColumns({n: F.round(n, 4 if n in ("t", "th") else 3) for n in names})


def on(fn, *names):
    return lambda s, d: _r(fn(X.nodes(s, d)), *names)


def both(fn, *names):
    return lambda s, d: _r(fn(X.nodes(s, d), X.roots(s, d)), *names)


THETA = "CASE WHEN len > 0 THEN CASE WHEN y1 <= y THEN acos(greatest(-1, least(1, (x1 - x) / len))) ELSE 2 * pi() - acos(greatest(-1, least(1, (x1 - x) / len))) END END"
EXACT = "abs(t - round(t)) < 1e-6"
add("arc_length", on(lambda n: T.segments(n).select("model", "root", "seq", "c"), "c"), "SELECT model, root, seq, round(c, 3) AS c FROM segs", ("segs",))
add("node_geometry", on(T.node_geometry, "len", "theta"), f"SELECT model, root, seq, round(len, 3) AS len, round({THETA}, 3) AS theta, greatest(diameter, 1) AS diameter FROM segs", ("segs",))
add("clamp_times", on(lambda n: T.clamp_times(n).select("model", "root", "seq", "th", "t"), "th", "t"), "SELECT model, root, seq, round(greatest(th, 0), 4) AS th, round(CASE WHEN t < 1 THEN 0 ELSE t END, 4) AS t FROM nodes", ("nodes",))
add("exact_time_flag", on(lambda n: n.select("model", "root", "seq", T.is_exact(F.col("t")).alias("is_exact"))), f"SELECT model, root, seq, {EXACT} AS is_exact FROM nodes", ("nodes",))
add("drop_interpolated_nodes", on(lambda n: T.drop_interpolated_nodes(n).select("model", "root", "seq", "x", "y")), f"SELECT model, root, row_number() OVER (PARTITION BY model, root ORDER BY seq) AS seq, x, y FROM nodes WHERE {EXACT}", ("nodes",))
add("rebase_time", on(lambda n: T.rebase_time(n, 7.0).select("model", "root", "seq", "t"), "t"), "SELECT model, root, seq, round(th / 7, 4) AS t FROM nodes", ("nodes",))
add("hours_axis", on(lambda n: T.hours_axis(n, 7.0, 30)), "SELECT model, CAST(k AS INTEGER) AS date, 7e0 * k AS hours FROM (SELECT DISTINCT model FROM nodes), range(30) r(k)", ("nodes",))
add(
    "insert_missing_dates",
    on(lambda n: T.insert_missing_dates(n).select("model", "root", "seq", "x", "y", "t", "inserted"), "x", "y", "t"),
    """SELECT model, root, row_number() OVER (PARTITION BY model, root ORDER BY place) AS seq, round(x, 3) AS x, round(y, 3) AS y, round(t, 4) AS t, inserted FROM (
      SELECT model, root, CAST(seq AS DOUBLE) AS place, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, t, false AS inserted FROM nodes
      UNION ALL SELECT model, root, seq + (k - t) / (t1 - t) / 2, x + (k - t) / (t1 - t) * (x1 - x), y + (k - t) / (t1 - t) * (y1 - y), k, true
      FROM (SELECT *, CAST(unnest(range(CAST(floor(t) + 1 AS BIGINT), CAST(ceil(t1) AS BIGINT))) AS DOUBLE) AS k FROM segs WHERE ceil(t1) - 1 >= floor(t) + 1))""",
    ("segs",),
)
add(
    "densify_polyline",
    on(lambda n: T.densify_polyline(n, 2.5), "x", "y"),
    """SELECT model, root, seq, CAST(i AS INTEGER) AS i, round(CASE WHEN i = 0 THEN x ELSE x + i / CAST(n AS DOUBLE) * (x1 - x) END, 3) AS x, round(CASE WHEN i = 0 THEN y ELSE y + i / CAST(n AS DOUBLE) * (y1 - y) END, 3) AS y FROM (
      SELECT *, unnest(range(n)) AS i FROM (SELECT *, CAST(CASE WHEN len > 2.5 THEN pow(2, greatest(0, ceil(log2(len / 2.5)))) ELSE 1 END AS BIGINT) AS n FROM segs))""",
    ("segs",),
)
add("root_length", on(T.root_length, "length"), "SELECT model, root, round(coalesce(sum(len), 0), 3) AS length FROM segs GROUP BY 1, 2", ("segs",))
add(
    "root_length_at",
    on(lambda n: T.root_length(n, 12.3), "length"),
    "SELECT model, root, round(coalesce(sum(CASE WHEN t1 <= 12.3e0 THEN len WHEN t <= 12.3e0 THEN len * (12.3e0 - t) / (t1 - t) ELSE 0 END), 0), 3) AS length FROM segs GROUP BY 1, 2",
    ("segs",),
)
add(
    "root_surface_volume",
    on(T.root_surface_volume, "surface", "volume"),
    """SELECT model, root, round(sum(pi() * (a + b) * sqrt((a - b) * (a - b) + len * len)), 3) AS surface, round(sum(pi() * len * (a * a + a * b + b * b) / 3), 3) AS volume
    FROM (SELECT *, diameter / 2 AS a, d1 / 2 AS b FROM segs WHERE len IS NOT NULL) GROUP BY 1, 2""",
    ("segs",),
)
add("root_diameter", on(lambda n: T.root_diameter(n, 10, 60), "mean", "median"), "SELECT model, root, round(avg(diameter), 3) AS mean, round(median(diameter) FILTER (c BETWEEN 10 AND 60), 3) AS median FROM segs GROUP BY 1, 2", ("segs",))
add(
    "root_shape",
    on(T.root_shape, "tortuosity", "orientation", "span"),
    f"""SELECT model, root, round(avg(abs(theta - before)), 3) AS tortuosity, round(avg(theta), 3) AS orientation, round(sqrt((arg_max(x, seq) - arg_min(x, seq)) ** 2 + (arg_max(y, seq) - arg_min(y, seq)) ** 2), 3) AS span
    FROM (SELECT *, lag(theta) OVER w AS before FROM (SELECT *, {THETA} AS theta FROM segs) {W}) GROUP BY 1, 2""",
    ("segs",),
)
BBOX = "SELECT model, root, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, max(t) AS last_date FROM segs WHERE x1 IS NOT NULL GROUP BY 1, 2"
add("root_bbox", on(T.root_bbox, "last_date"), f"SELECT * REPLACE (round(last_date, 3) AS last_date) FROM ({BBOX})", ("segs",))
add(
    "model_extent",
    on(T.model_extent),
    f"""SELECT model, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) - min(xmin) AS width, max(ymax) - min(ymin) AS height, max(xmax) + min(xmin) AS width_sum, max(ymax) + min(ymin) AS height_sum,
    min(xmin) + (max(xmax) - min(xmin)) / 2 AS cx, min(ymin) + (max(ymax) - min(ymin)) / 2 AS cy FROM ({BBOX}) GROUP BY 1""",
    ("segs",),
)
add(
    "insertion_node",
    both(T.insertion_node),
    """SELECT model, root, parent, m[2] AS at_seq, m[1] AS d2 FROM (SELECT f.model, f.root, r.parent, min(((f.x - o.x) * (f.x - o.x) + (f.y - o.y) * (f.y - o.y), o.seq)) AS m
    FROM nodes f JOIN roots r ON f.model = r.model AND f.root = r.root AND f.seq = 1 JOIN nodes o ON o.model = r.model AND o.root = r.parent GROUP BY 1, 2, 3)""",
    ("nodes", "roots"),
)
add(
    "root_counts",
    both(lambda n, r: T.root_counts(n, r, 3.0)),
    """SELECT model, count(*) FILTER (parent IS NULL) AS primaries, count(*) FILTER (parent IS NOT NULL) AS laterals, count(*) FILTER (parent IS NULL AND born <= 3) AS primaries_at, count(*) FILTER (parent IS NOT NULL AND born <= 3) AS laterals_at
    FROM roots JOIN (SELECT model, root, min(t) AS born FROM nodes GROUP BY 1, 2) USING (model, root) GROUP BY 1""",
    ("nodes", "roots"),
)
add(
    "length_summary",
    both(T.length_summary, "mean_primary", "mean_lateral", "mean_all", "total"),
    """SELECT model, round(avg(n) FILTER (parent IS NULL), 3) AS mean_primary, round(avg(n) FILTER (parent IS NOT NULL), 3) AS mean_lateral, round(avg(n), 3) AS mean_all, round(sum(n), 3) AS total,
    CAST(coalesce(sum(floor(n)) FILTER (parent IS NULL), 0) AS BIGINT) AS total_primary, CAST(coalesce(sum(floor(n)) FILTER (parent IS NOT NULL), 0) AS BIGINT) AS total_lateral
    FROM roots JOIN (SELECT model, root, coalesce(sum(len), 0) AS n FROM segs GROUP BY 1, 2) USING (model, root) GROUP BY 1""",
    ("segs", "roots"),
)
add(
    "nearest_node",
    lambda s, d: T.nearest_node(X.points(s, d), X.nodes(s, d)),
    """SELECT model, pid, m[2] AS root, m[3] AS seq, m[1] AS d2 FROM (SELECT p.model, pid, min((round((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y), 6), n.root, n.seq)) AS m
    FROM points p JOIN nodes n ON p.model = n.model AND n.t <= p.z GROUP BY 1, 2)""",
    ("points", "nodes"),
)
add(
    "primary_length_series",
    on(T.length_series, "length", "growth"),
    f"""SELECT model, root, day, round(length, 3) AS length, round(length - coalesce(lag(length) OVER (PARTITION BY model, root ORDER BY day), 0), 3) AS growth FROM (
      SELECT model, root, day, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY model, root ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS length
      FROM (SELECT model, root, CAST(unnest(range(1, last + 1)) AS INTEGER) AS day FROM (SELECT DISTINCT model, root FROM nodes) JOIN (SELECT model, CAST(ceil(max(t)) AS BIGINT) AS last FROM nodes GROUP BY 1) USING (model))
      LEFT JOIN (SELECT model, root, CAST(t AS INTEGER) AS day, max(c) AS c FROM segs WHERE {EXACT} GROUP BY 1, 2, 3) USING (model, root, day))""",
    ("segs",),
)
