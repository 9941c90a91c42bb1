"""Queries of insertions, series, reports and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaframe.operators import reports as P
from sylvaframe.plans import fixtures as X

BOOK = X.Book()
add = BOOK.add
KEY = "model, root"


def _r(df, *names, digits=3):
    return df.withColumns({n: F.round(n, digits) for n in names})


def inserted(s, d):
    return X.remember(s, d, "inserted", lambda: P.insertions(X.nodes(s, d), X.roots(s, d)))


def on(fn, *names):
    return lambda s, d: _r(fn(X.nodes(s, d)), *names)


def both(fn, *names):
    return lambda s, d: _r(fn(X.nodes(s, d), X.roots(s, d)), *names)


def on_inserted(fn, *names):
    return lambda s, d: _r(fn(inserted(s, d)), *names)


INS = ("inserted",)
add("insertion_position", on_inserted(lambda i: i.select("model", "root", "parent", "base", "apex"), "base", "apex"), f"SELECT {KEY}, parent, round(base, 3) AS base, round(apex, 3) AS apex FROM inserted", INS)
add("insertion_angle", on_inserted(lambda i: i.select("model", "root", "angle"), "angle"), f"SELECT {KEY}, round(angle, 3) AS angle FROM inserted", INS)
add("side_of_parent", lambda s, d: P.side_of_parent(X.roots(s, d), inserted(s, d)), f"SELECT r.model, r.root, coalesce(side, 0) AS side FROM roots r LEFT JOIN inserted i ON i.model = r.model AND i.root = r.root", ("inserted", "roots"))
add(
    "node_after_attachment",
    both(P.node_after_attachment),
    """SELECT f.model, f.root, r.parent, coalesce(arg_max(o.nxt, o.seq) FILTER (o.nxt IS NOT NULL AND o.y < f.y), min(o.seq)) AS node FROM nodes f JOIN roots r ON r.model = f.model AND r.root = f.root AND f.seq = 1
    JOIN (SELECT *, lead(seq) OVER (PARTITION BY model, root ORDER BY seq) AS nxt FROM nodes) o ON o.model = r.model AND o.root = r.parent GROUP BY 1, 2, 3""",
    ("nodes", "roots"),
)
ENDS = "(SELECT model, parent AS root, count(*) AS n_child, max((apex, -root, base)) AS a, min((apex, root, base)) AS b FROM inserted GROUP BY 1, 2)"
add("first_last_child", on_inserted(P.first_last_child, "first_base", "last_base"), f"SELECT {KEY}, n_child, -a[2] AS first_child, round(a[3], 3) AS first_base, b[2] AS last_child, round(b[3], 3) AS last_base FROM {ENDS}", INS)
DENSITY = f"(SELECT {KEY}, coalesce(n_child / nullif(b[3] - a[3], 0), 0) AS density FROM {ENDS})"
add("child_density", on_inserted(P.child_density, "density"), f"SELECT {KEY}, round(density, 3) AS density FROM {DENSITY}", INS)
add("inter_branch", on_inserted(P.inter_branch, "inter_branch"), "SELECT i.model, i.root, i.parent, round(coalesce(min(o.apex - i.apex) FILTER (o.apex > i.apex), 0), 3) AS inter_branch FROM inserted i LEFT JOIN inserted o ON o.model = i.model AND o.parent = i.parent GROUP BY 1, 2, 3, i.apex", INS)
LENGTH = f"(SELECT {KEY}, coalesce(sum(len), 0) AS length FROM segs GROUP BY 1, 2)"
add(
    "children_summary",
    lambda s, d: _r(P.children_summary(X.nodes(s, d), X.roots(s, d), inserted(s, d)).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ",")), "length", "angle"),
    f"""SELECT i.model, i.parent AS root, count(*) AS n, round(sum(l.length), 3) AS length, round(avg(angle), 3) AS angle, string_agg(CAST(i.root AS VARCHAR), ',' ORDER BY f.y, i.root) AS children
    FROM inserted i JOIN {LENGTH} l ON l.model = i.model AND l.root = i.root JOIN nodes f ON f.model = i.model AND f.root = i.root AND f.seq = 1 GROUP BY 1, 2""",
    ("inserted", "segs"),
)
add("node_at_length", on(lambda n: P.node_at_length(n, 50.0)), f"SELECT {KEY}, arg_min(seq, (round(abs(c - 50), 9), seq)) AS seq FROM segs GROUP BY 1, 2", ("segs",))
add("unit_conversion", on(lambda n: n.select("model", "root", "seq", P.unit_conversion(F.col("x"), 0.25, 3.0).alias("cm"), P.unit_conversion_back(F.col("y"), 0.5, 3.0).alias("px"))), f"SELECT {KEY}, seq, x * 0.25e0 + 3 AS cm, (y - 3) / 0.5e0 AS px FROM nodes", ("nodes",))
add("mean_diameters", both(P.mean_diameters, "primary_diameter", "lateral_diameter"), "SELECT n.model, round(avg(diameter) FILTER (parent IS NULL), 3) AS primary_diameter, round(avg(diameter) FILTER (parent IS NOT NULL), 3) AS lateral_diameter FROM nodes n JOIN roots r ON r.model = n.model AND r.root = n.root GROUP BY 1", ("nodes", "roots"))
add("mean_lateral_angle", on_inserted(P.mean_lateral_angle, "angle"), "SELECT model, round(avg(degrees(angle)), 3) AS angle FROM inserted GROUP BY 1", INS)
SEEN = f"(SELECT {KEY}, coalesce(sum(CASE WHEN t1 <= 12.3e0 THEN len WHEN t <= 12.3e0 THEN len * (12.3e0 - t) / (t1 - t) ELSE 0 END), 0) AS length FROM segs GROUP BY 1, 2)"
add(
    "total_lengths",
    both(lambda n, r: P.total_lengths_at(n, r, 12.3)),
    f"SELECT l.model, CAST(sum(CASE WHEN parent IS NULL THEN floor(length) ELSE 0 END) AS BIGINT) AS primaries, CAST(sum(CASE WHEN parent IS NOT NULL THEN floor(length) ELSE 0 END) AS BIGINT) AS laterals FROM {SEEN} l JOIN roots r ON r.model = l.model AND r.root = l.root GROUP BY 1",
    ("segs", "roots"),
)
add("plant_numbers", both(P.plant_numbers), "SELECT * FROM numbered", ("numbered",))
add("root_selection", both(lambda n, r: P.root_selection(P.plant_numbers(n, r), plant=2, laterals=True)), "SELECT * FROM numbered WHERE plant = 2 AND ord > 1", ("numbered",))
add("plant_lengths_at_t", both(lambda n, r: P.plant_lengths_at_t(n, r, 12.3), "length"), f"SELECT p.model, plant, ord, round(sum(length), 3) AS length FROM {SEEN} l JOIN numbered p ON p.model = l.model AND p.root = l.root GROUP BY 1, 2, 3", ("segs", "numbered"))
LAST = "(SELECT model, CAST(ceil(max(t)) AS INTEGER) AS last FROM nodes GROUP BY 1)"
add(
    "primary_depth_series",
    both(P.primary_depth_series),
    f"""SELECT {KEY}, day, coalesce(last_value(depth IGNORE NULLS) OVER (PARTITION BY {KEY} ORDER BY day ROWS UNBOUNDED PRECEDING), first_value(depth IGNORE NULLS) OVER (PARTITION BY {KEY} ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS depth FROM (
      SELECT g.model, g.root, g.day, k.y - g.y0 AS depth FROM (SELECT n.model, n.root, n.y AS y0, CAST(unnest(range(0, l.last)) AS INTEGER) AS day FROM nodes n JOIN roots r ON r.model = n.model AND r.root = n.root AND r.parent IS NULL JOIN {LAST} l ON l.model = n.model WHERE seq = 1) g
      LEFT JOIN (SELECT {KEY}, CAST(greatest(floor(t) - 1, 0) AS INTEGER) AS day, arg_max(y, seq) AS y FROM nodes WHERE seq > 1 GROUP BY 1, 2, 3) k ON k.model = g.model AND k.root = g.root AND k.day = g.day)""",
    ("nodes", "roots"),
)
TIPS = """(SELECT model, root, CAST(round(t) AS INTEGER) AS day, CAST(arg_max(y, seq) AS DOUBLE) AS y, max(c) AS length FROM {segs} WHERE seq > 1 AND abs(t - round(t)) < 1e-6 AND round(t) > 0 GROUP BY 1, 2, 3 UNION ALL SELECT DISTINCT model, root, 0, 0e0, 0e0 FROM {segs})"""
add("tip_series", on(P.tip_series, "length"), f"SELECT {KEY}, day, y, round(length, 3) AS length FROM {TIPS.format(segs='segs')}", ("segs",))
SPEEDS = """(SELECT l.model, l.root, l.day, CAST(y0 - arg_max(y, seq) AS DOUBLE) AS depth, coalesce(arg_max(spe, seq), 0) AS speed FROM (
  SELECT s.model, s.root, seq, y, CAST(round_even(t, 0) AS INTEGER) AS day, last_value(len IGNORE NULLS) OVER w / CASE WHEN first_value(th1 - th) OVER w <= 0 THEN 1e-6 ELSE first_value(th1 - th) OVER w END AS spe
  FROM {segs} s JOIN roots r ON r.model = s.model AND r.root = s.root AND r.parent IS NOT NULL WINDOW w AS (PARTITION BY s.model, s.root ORDER BY seq)) l
  JOIN (SELECT s.model, arg_max(s.y, s.root) AS y0 FROM {segs} s JOIN roots r ON r.model = s.model AND r.root = s.root AND r.parent IS NULL WHERE seq = 1 GROUP BY 1) z ON z.model = l.model GROUP BY l.model, l.root, l.day, y0)"""
add("lateral_speed_depth_series", both(P.lateral_speed_depth_series, "speed"), f"SELECT {KEY}, day, depth, round(speed, 3) AS speed FROM {SPEEDS.format(segs='segs')}", ("segs", "roots"))
START = "SELECT model, root, coalesce(arg_min(depth, day) FILTER (depth <> 0), 0) AS depth FROM {speeds} GROUP BY 1, 2"
add("starting_depth", both(lambda n, r: P.starting_depth(P.lateral_speed_depth_series(n, r))), START.format(speeds=SPEEDS.format(segs="segs")), ("segs", "roots"))
add("convex_hull", both(P.convex_hull))
add(
    "root_report",
    both(P.root_report, "length", "surface", "volume", "diameter", "insertion_position", "insertion_angle", "child_density", "insertion_first_child", "insertion_last_child"),
    f"""SELECT k.model AS image, 'root_' || k.root AS root_name, k.root, round(l.length, 3) AS length, round(coalesce(v.surface, 0), 3) AS surface, round(coalesce(v.volume, 0), 3) AS volume, CAST(NULL AS DOUBLE) AS convexhull_area, round(g.diameter, 3) AS diameter,
    CAST(k.ord AS BIGINT) AS root_order, CASE WHEN k.ord = 1 THEN 'primary' ELSE 'lateral' END AS root_ontology, 'root_' || k.parent AS parent_name, coalesce(CAST(k.parent AS VARCHAR), '-1') AS parent,
    round(coalesce(i.base, 0), 3) AS insertion_position, round(coalesce(degrees(i.angle), 0), 3) AS insertion_angle, coalesce(e.n_child, 0) AS n_child, round(coalesce(y.density, 0), 3) AS child_density,
    -e.a[2] AS first_child, round(e.a[3], 3) AS insertion_first_child, e.b[2] AS last_child, round(e.b[3], 3) AS insertion_last_child
    FROM ranks k JOIN {LENGTH} l ON l.model = k.model AND l.root = k.root JOIN (SELECT {KEY}, avg(diameter) AS diameter FROM nodes GROUP BY 1, 2) g ON g.model = k.model AND g.root = k.root
    LEFT JOIN (SELECT {KEY}, sum(pi() * (a + b) * sqrt((a - b) * (a - b) + len * len)) AS surface, sum(pi() * len * (a * a + a * b + b * b) / 3) AS volume FROM (SELECT *, diameter / 2 AS a, d1 / 2 AS b FROM segs WHERE len IS NOT NULL) GROUP BY 1, 2) v ON v.model = k.model AND v.root = k.root
    LEFT JOIN inserted i ON i.model = k.model AND i.root = k.root LEFT JOIN {ENDS} e ON e.model = k.model AND e.root = k.root LEFT JOIN {DENSITY} y ON y.model = k.model AND y.root = k.root""",
    ("inserted", "ranks", "segs", "nodes"),
)
add(
    "node_report",
    both(P.node_report, "theta", "distance_from_base", "distance_from_apex"),
    f"""SELECT g.model AS image, g.root, 'root_' || g.root AS root_name, seq, x * 1e0 AS x, y * 1e0 AS y, round(theta, 3) AS theta, diameter * 1e0 AS diameter, round(c, 3) AS distance_from_base, round(length - c, 3) AS distance_from_apex,
    CAST(k.ord - 1 AS BIGINT) AS root_order, CASE WHEN k.ord = 1 THEN 'primary' ELSE 'lateral' END AS root_ontology FROM geo g JOIN {LENGTH} l ON l.model = g.model AND l.root = g.root JOIN ranks k ON k.model = g.model AND k.root = g.root""",
    ("geo", "ranks"),
)
add(
    "image_report",
    both(P.image_report, "tot_root_length", "mean_prim_length", "mean_prim_diameter", "mean_lat_density", "mean_lat_length", "mean_lat_diameter", "mean_lat_angle"),
    f"""SELECT r.model AS image, round(sum(n), 3) AS tot_root_length, count(*) FILTER (parent IS NULL) AS n_primary, CAST(coalesce(sum(floor(n)) FILTER (parent IS NULL), 0) AS BIGINT) AS tot_prim_length, round(avg(n) FILTER (parent IS NULL), 3) AS mean_prim_length,
    round(any_value(pd), 3) AS mean_prim_diameter, round(any_value(md), 3) AS mean_lat_density, count(*) FILTER (parent IS NOT NULL) AS n_laterals, CAST(coalesce(sum(floor(n)) FILTER (parent IS NOT NULL), 0) AS BIGINT) AS tot_lat_length,
    round(avg(n) FILTER (parent IS NOT NULL), 3) AS mean_lat_length, round(any_value(ld), 3) AS mean_lat_diameter, round(any_value(ma), 3) AS mean_lat_angle
    FROM roots r JOIN (SELECT model, root, length AS n FROM {LENGTH}) l ON l.model = r.model AND l.root = r.root
    JOIN (SELECT n.model, avg(diameter) FILTER (parent IS NULL) AS pd, avg(diameter) FILTER (parent IS NOT NULL) AS ld FROM nodes n JOIN roots r ON r.model = n.model AND r.root = n.root GROUP BY 1) q ON q.model = r.model
    LEFT JOIN (SELECT model, avg(nullif(density, 0)) AS md FROM {DENSITY} GROUP BY 1) y ON y.model = r.model LEFT JOIN (SELECT model, avg(degrees(angle)) AS ma FROM inserted GROUP BY 1) a ON a.model = r.model GROUP BY r.model""",
    ("inserted", "segs", "roots", "nodes"),
)
add(
    "root_coordinates",
    on(lambda n: P.root_coordinates(n.withColumn("vx", F.col("x") % 3).withColumn("vy", F.col("y") % 2)).select("model", "root", F.transform("points", lambda p: F.concat_ws(":", *(F.round(p[c]).cast("int").cast("string") for c in ("x", "y", "vx", "vy", "diameter", "t", "th")))).alias("p")).withColumn("p", F.array_join("p", " "))),
    f"SELECT {KEY}, string_agg(concat_ws(':', CAST(x AS INTEGER), CAST(y AS INTEGER), CAST(x % 3 AS INTEGER), CAST(y % 2 AS INTEGER), CAST(diameter AS INTEGER), CAST(sign(t) * floor(abs(t) + 0.5) AS INTEGER), CAST(sign(th) * floor(abs(th) + 0.5) AS INTEGER)), ' ' ORDER BY seq) AS p FROM nodes GROUP BY 1, 2",
    ("nodes",),
)


def _listed(s, d):
    """A list of outliers with a repeated entry, and plants that have another number on the expert's side."""
    models = X.roots(s, d).select("model").distinct()
    outliers = models.where("model % 2 = 0").select("model", F.explode(F.array(F.lit(1), F.lit(3), F.lit(3))).alias("plant"))
    remap = models.where("model % 3 = 0").select("model", F.explode(F.array(F.struct(F.lit(2).alias("plant"), F.lit(None).cast("int").alias("expert_plant")), F.struct(F.lit(3).alias("plant"), F.lit(2).alias("expert_plant")))).alias("m"))
    return outliers, remap.select("model", "m.plant", "m.expert_plant", F.lit(True).alias("known"))


add("known_outliers", lambda s, d: P.known_outliers(P.plant_numbers(X.nodes(s, d), X.roots(s, d)).select("model", "plant").distinct(), _listed(s, d)[0]), "SELECT DISTINCT model, plant, model % 2 = 0 AND plant IN (1, 3) AS is_outlier FROM numbered", ("numbered",))
SIDE = """(WITH v AS (SELECT s.model, s.root, day, coalesce(sum(CASE WHEN t1 <= day THEN len WHEN t <= day THEN len * (day - t) / (t1 - t) ELSE 0 END), 0) AS length, min(t) <= day AS there
  FROM (SELECT s.*, unnest([last - 3, last]) AS day, last FROM {segs} s JOIN (SELECT model, CAST(ceil(max(t)) AS BIGINT) AS last FROM {nodes} GROUP BY 1) USING (model)) s GROUP BY 1, 2, 3),
  ends AS (SELECT model, CAST(ceil(max(t)) AS BIGINT) AS last FROM {nodes} GROUP BY 1)
  SELECT p.model, p.plant, max(v.length) FILTER (v.day = last - 3) AS pl, max(coalesce(k.n, 0)) FILTER (v.day = last) AS nl, max(coalesce(k.length, 0)) FILTER (v.day = last - 3) AS ll
  FROM {numbered} p JOIN v ON v.model = p.model AND v.root = p.root JOIN ends e ON e.model = p.model LEFT JOIN (SELECT v.model, r.parent, v.day, count(*) FILTER (there) AS n, sum(v.length) AS length FROM v JOIN roots r ON r.model = v.model AND r.root = v.root WHERE r.parent IS NOT NULL GROUP BY 1, 2, 3) k
    ON k.model = p.model AND k.parent = p.root AND k.day = v.day WHERE p.ord = 1 GROUP BY 1, 2)"""
add(
    "model_comparison",
    lambda s, d: _r(P.model_comparison((X.nodes(s, d, "error"), X.roots(s, d)), (X.nodes(s, d), X.roots(s, d)), *_listed(s, d)), "predicted_primary_length", "predicted_lateral_length", "expert_primary_length", "expert_lateral_length"),
    f"""SELECT coalesce(a.model, b.model) AS model, a.plant, coalesce(a.xp, b.plant) AS expert_plant, round(a.pl, 3) AS predicted_primary_length, a.nl AS predicted_n_laterals, round(a.ll, 3) AS predicted_lateral_length,
    round(b.pl, 3) AS expert_primary_length, b.nl AS expert_n_laterals, round(b.ll, 3) AS expert_lateral_length, coalesce(coalesce(a.model, b.model) % 2 = 0 AND a.plant IN (1, 3), false) AS is_outlier
    FROM (SELECT *, CASE WHEN model % 3 = 0 AND plant = 2 THEN NULL WHEN model % 3 = 0 AND plant = 3 THEN 2 ELSE plant END AS xp FROM {SIDE.format(segs="segs_pred", nodes="nodes_pred", numbered="numbered_pred")}) a
    FULL OUTER JOIN {SIDE.format(segs="segs", nodes="nodes", numbered="numbered")} b ON b.model = a.model AND b.plant = a.xp""",
    ("segs", "segs_pred", "nodes", "nodes_pred", "numbered", "numbered_pred"),
)


def _series(source, segs):
    return f"""SELECT '{source}' AS source, 'depth' AS series, {KEY}, day, depth AS value FROM {SPEEDS.format(segs=segs)} UNION ALL SELECT '{source}', 'speed', {KEY}, day, speed FROM {SPEEDS.format(segs=segs)}
    UNION ALL SELECT '{source}', 'tip', {KEY}, day, y FROM {TIPS.format(segs=segs)} UNION ALL SELECT '{source}', 'length', {KEY}, day, length FROM {TIPS.format(segs=segs)}
    UNION ALL SELECT '{source}', 'start', {KEY}, NULL, depth FROM ({START.format(speeds=SPEEDS.format(segs=segs))})"""


add(
    "lateral_comparison",
    lambda s, d: _r(P.lateral_comparison((X.nodes(s, d, "error"), X.roots(s, d)), (X.nodes(s, d), X.roots(s, d))), "value"),
    f"SELECT source, series, {KEY}, day, round(value, 3) AS value FROM ({_series('predicted', 'segs_pred')} UNION ALL {_series('expert', 'segs')})",
    ("segs", "segs_pred", "roots"),
)
