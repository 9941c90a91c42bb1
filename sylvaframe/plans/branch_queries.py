"""Queries of branches: the order-1 organs are the trunk, other organs are cut at every fourth component, and each fifth link counts as hidden."""

from __future__ import annotations

from functools import reduce
from operator import add as add_up

from pyspark.sql import Window
from pyspark.sql import functions as F

from sylvaframe.operators import branches as B
from sylvaframe.operators import regions as R
from sylvaframe.operators.raster import frames_of
from sylvaframe.plans import fixtures as X
from sylvaframe.plans import region_queries as Q

BOOK = X.Book()
add = BOOK.add
HOURS, SPEED = 8.0, 0.4


def comps(s, d):
    rows = Q.comps(s, d).join(Q.organs(s, d).select("box", "cc_id", (F.col("ord") == 1).alias("trunk")), ["box", "cc_id"])
    return X.remember(s, d, "branch_comps", lambda: rows.select("box", "cc_id", "day", (F.col("day") * HOURS).alias("hour"), "n_px", F.col("cx").alias("x"), F.col("cy").alias("y"), "trunk"))


def chains(s, d):
    own = Window.partitionBy("box", "organ_id").orderBy("idx")
    rows = Q.organs(s, d).where("ord > 1").withColumn("part", F.sum(F.when(F.col("cc_id") % 4 == 0, 1).otherwise(0)).over(own))
    part = Window.partitionBy("box", "organ_id", "part").orderBy("idx")
    return rows.select("box", F.first("cc_id").over(part).alias("start"), (F.row_number().over(part) - 1).alias("depth"), "cc_id", (F.col("cc_id") % 5 == 0).alias("hidden"))


def links(s, d):
    return Q.edges(s, d).select("box", "src", "dst")


def features(s, d):
    return X.remember(s, d, "features", lambda: B.lateral_features(chains(s, d), comps(s, d)))


def starting(s, d):
    """Chains that start at the trunk: laterals."""
    found = chains(s, d).where("depth = 0").join(Q.forest(s, d).select("box", "cc_id", "parent"), ["box", "cc_id"]).join(comps(s, d).where("trunk").select("box", F.col("cc_id").alias("parent")), ["box", "parent"])
    return features(s, d).join(found.where("start % 4 <> 0").select("box", "start"), ["box", "start"], "left_semi")


def orphans(s, d):
    return features(s, d).join(features(s, d).where("depth = 0 and start % 4 = 0").select("box", "start"), ["box", "start"], "left_semi")


def _r(df, *names):
    return df.withColumns({n: F.round(n, 4) for n in names})


X.SQL["branch_comps"] = ("SELECT c.box, c.cc_id, c.day, c.day * 8e0 AS hour, c.n_px, c.cx AS x, c.cy AS y, o.ord = 1 AS trunk FROM comps c JOIN organs o ON o.box = c.box AND o.cc_id = c.cc_id", ("comps", "organs"))
X.SQL["chains"] = (
    """SELECT box, first_value(cc_id) OVER w AS start, row_number() OVER w - 1 AS depth, cc_id, cc_id % 5 = 0 AS hidden FROM (SELECT *, sum(CASE WHEN cc_id % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY box, organ_id ORDER BY idx) AS part FROM organs WHERE ord > 1)
    WINDOW w AS (PARTITION BY box, organ_id, part ORDER BY idx)""",
    ("organs",),
)
X.SQL["features"] = (
    """SELECT *, sum(length_before) OVER w AS length, sum(days_before) OVER w AS days, sum(hours_before) OVER w AS hours, sum(n_px) OVER w AS size, depth = max(depth) OVER (PARTITION BY box, start) AS last,
      sum(CASE WHEN hidden THEN 0 ELSE length_before END) OVER (PARTITION BY box, start) / nullif(sum(length_before) OVER (PARTITION BY box, start), 0) AS visible
    FROM (SELECT h.*, c.day, c.hour, c.n_px, c.x, c.y, coalesce(sqrt((c.x - lag(c.x) OVER v) ** 2 + (c.y - lag(c.y) OVER v) ** 2), 0) AS length_before, coalesce(c.day - lag(c.day) OVER v, 0) AS days_before, coalesce(c.hour - lag(c.hour) OVER v, 0) AS hours_before
      FROM chains h JOIN branch_comps c ON c.box = h.box AND c.cc_id = h.cc_id WINDOW v AS (PARTITION BY h.box, h.start ORDER BY h.depth)) WINDOW w AS (PARTITION BY box, start ORDER BY depth)""",
    ("chains", "branch_comps"),
)
X.SQL["laterals"] = ("SELECT x.* FROM features x SEMI JOIN (SELECT h.box, h.start FROM chains h JOIN forest f ON f.box = h.box AND f.cc_id = h.cc_id AND h.depth = 0 JOIN branch_comps c ON c.box = f.box AND c.cc_id = f.parent AND c.trunk WHERE h.start % 4 <> 0) s ON s.box = x.box AND s.start = x.start", ("features", "forest"))

add(
    "lateral_features",
    lambda s, d: _r(features(s, d).select("box", "start", "cc_id", "length_before", "length", "days", "hours", "size", "visible"), "length_before", "length", "visible"),
    "SELECT box, start, cc_id, round(length_before, 4) AS length_before, round(length, 4) AS length, CAST(days AS BIGINT) AS days, hours, CAST(size AS BIGINT) AS size, round(visible, 4) AS visible FROM features",
    ("features",),
)
add(
    "lateral_rejection",
    lambda s, d: B.lateral_rejection(starting(s, d), 5.0, SPEED),
    f"SELECT box, start, CASE WHEN visible < 0.4 THEN 'hidden' WHEN depth = 0 THEN 'single' WHEN y < 5 THEN 'high' WHEN day < max(day_end) OVER (PARTITION BY box) AND length < {3 * SPEED} THEN 'short' END AS reason FROM (SELECT *, max(day) OVER (PARTITION BY box) AS day_end FROM laterals) WHERE last",
    ("laterals",),
)
add(
    "lateral_mad_rejection",
    lambda s, d: B.lateral_mad_rejection(features(s, d), HOURS, 1.5),
    f"""WITH v AS (SELECT box, start, last, CAST(days AS BIGINT) AS days, f.feature, f.value FROM (SELECT *, unnest([{{'feature': 'length', 'value': CAST(length AS DOUBLE)}}, {{'feature': 'speed', 'value': length / greatest({0.7 * HOURS}e0, days)}}, {{'feature': 'n_px', 'value': CAST(n_px AS DOUBLE)}}, {{'feature': 'size', 'value': CAST(size AS DOUBLE)}}]) AS f FROM features)),
    m AS (SELECT *, median(value) OVER (PARTITION BY box, days, feature) AS median FROM v), h AS (SELECT box, days, feature, any_value(median) AS median, median(value) FILTER (value >= median) AS high FROM m GROUP BY 1, 2, 3)
    SELECT box, start, bool_or(days >= 2 AND NOT last AND value >= h.median AND round((value - h.median) / CASE WHEN high = h.median THEN 1e-8 ELSE high - h.median END, 9) >= 1.5) AS rejected FROM v JOIN h USING (box, days, feature) GROUP BY 1, 2""",
    ("features",),
)
COS = lambda ax, ay, bx, by: f"(({ax}) * ({bx}) + ({ay}) * ({by})) / nullif(sqrt((({ax}) ** 2 + ({ay}) ** 2) * (({bx}) ** 2 + ({by}) ** 2)), 0)"
add(
    "incident_candidates",
    lambda s, d: _r(B.incident_candidates(features(s, d), links(s, d), 1.5), "cost"),
    f"""WITH near AS MATERIALIZED (SELECT box, src AS cc_id, dst AS near FROM edges UNION SELECT box, dst, src FROM edges), f AS MATERIALIZED (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py FROM features WINDOW v AS (PARTITION BY box, start ORDER BY depth)),
    ends AS (SELECT * FROM (SELECT *, max(day) OVER (PARTITION BY box) AS day_end FROM f) WHERE last AND day < day_end),
    over AS (SELECT e.box, e.cc_id, n.near FROM ends e JOIN near n ON n.box = e.box AND n.cc_id = e.cc_id LEFT JOIN f o ON o.box = n.box AND o.cc_id = n.near WHERE o.start IS DISTINCT FROM e.start),
    hit AS (SELECT box, cc_id, near AS other FROM over UNION SELECT o.box, o.cc_id, n.near FROM over o JOIN near n ON n.box = o.box AND n.cc_id = o.near)
    SELECT e.box, e.start, e.cc_id, o.cc_id AS other, round(-({COS('e.x - e.px', 'e.y - e.py', 'o.x - e.x', 'o.y - e.y')}), 4) AS cost FROM ends e JOIN hit h ON h.box = e.box AND h.cc_id = e.cc_id JOIN f o ON o.box = h.box AND o.cc_id = h.other AND o.start <> e.start WHERE sqrt((o.x - e.x) ** 2 + (o.y - e.y) ** 2) <= 3""",
    ("features", "edges"),
)
EDGE = ("day_s", "day_t", "n_s", "n_t", "sx", "sy", "tx", "ty")


def _first_cost(e, last_day):
    hours = {k: F.lit(HOURS) for k in "st"}
    return B.first_order_cost(e, last_day, hours)


def _with_trunks(s, d):
    t = comps(s, d)
    rows = Q.edges(s, d).join(t.select("box", F.col("cc_id").alias("src"), F.col("trunk").alias("trunk_s")), ["box", "src"])
    return rows.join(t.select("box", F.col("cc_id").alias("dst"), F.col("trunk").alias("trunk_t")), ["box", "dst"])


def weighted(s, d):
    return _with_trunks(s, d).withColumn("weight", F.round(_first_cost({c: F.col(c) for c in (*EDGE, "trunk_s", "trunk_t")}, 14), 9))


FIRST = "CASE WHEN {ds} = 0 THEN -1000 WHEN {ds} > {dt} THEN 10000 WHEN {ts} AND NOT {tt} THEN abs({ns} - {nt}) / CAST({ns} + {nt} AS DOUBLE) + 13.5 ELSE abs({ns} - {nt}) / CAST({ns} + {nt} AS DOUBLE) + CASE WHEN abs({dt} - {ds}) < 2 THEN 0 ELSE abs({dt} - {ds}) - 1 END - 0.5 * ({ty} - {sy}) / nullif(sqrt(({tx} - {sx}) ** 2 + ({ty} - {sy}) ** 2), 0) END"
ON_EDGES = FIRST.format(ds="e.day_s", dt="e.day_t", ns="e.n_s", nt="e.n_t", sx="e.sx", sy="e.sy", tx="e.tx", ty="e.ty", ts="s.trunk", tt="t.trunk")
X.SQL["weighted"] = (f"SELECT e.box, e.src, e.dst, round({ON_EDGES}, 9) AS weight FROM edges e JOIN branch_comps s ON s.box = e.box AND s.cc_id = e.src JOIN branch_comps t ON t.box = e.box AND t.cc_id = e.dst", ("edges", "branch_comps"))
add("first_order_cost", lambda s, d: weighted(s, d).select("box", "src", "dst", F.round("weight", 5).alias("weight")), "SELECT box, src, dst, round(weight, 5) AS weight FROM weighted", ("weighted",))


def _second(s, d):
    names = dict(zip(EDGE, ("day_s", "day_t", "n_px_s", "n_px_t", "x_s", "y_s", "x_t", "y_t")))
    cost = _first_cost({**{k: F.col(v) for k, v in names.items()}, "trunk_s": F.col("trunk_s"), "trunk_t": F.col("trunk_t")}, 14)
    return B.second_order_links(comps(s, d), weighted(s, d).select("box", "src", "dst", F.coalesce("weight", F.lit(1e8)).alias("weight")), F.coalesce(cost, F.lit(0.0)))


PAIR = FIRST.format(ds="s.day", dt="t.day", ns="s.n_px", nt="t.n_px", sx="s.x", sy="s.y", tx="t.x", ty="t.y", ts="s.trunk", tt="t.trunk")
GAPS = "(CASE WHEN b.hour = s.hour THEN 1e0 ELSE abs(b.hour - s.hour) END)", "(CASE WHEN s.hour = t.hour THEN 1e0 ELSE abs(s.hour - t.hour) END)"
AHEAD = tuple(f"(s.{c} - b.{c}) / {GAPS[0]}" for c in "xy")
TURN = f"sqrt((t.x - s.x - {AHEAD[0]} * {GAPS[1]}) ** 2 + (t.y - s.y - {AHEAD[1]} * {GAPS[1]}) ** 2) / nullif(sqrt(({AHEAD[0]}) ** 2 + ({AHEAD[1]}) ** 2) * {GAPS[1]}, 0)"
add(
    "second_order_links",
    lambda s, d: _second(s, d).select("box", "src", "dst", F.round("cost", 4).alias("cost")),
    f"""WITH several AS MATERIALIZED (SELECT box, dst AS cc3, arg_min(src, (coalesce(weight, 1e8), src)) AS best FROM weighted GROUP BY 1, 2 HAVING count(*) > 1),
    pairs AS MATERIALIZED (SELECT DISTINCT p.box, p.dst AS cc3, q.dst FROM weighted p JOIN weighted q ON q.box = p.box AND q.src = p.src AND q.dst <> p.dst)
    SELECT v.box, v.cc3 AS src, q.dst, round(coalesce({PAIR}, 0) + coalesce({TURN}, 0), 4) AS cost FROM several v JOIN pairs q ON q.box = v.box AND q.cc3 = v.cc3
    JOIN branch_comps s ON s.box = v.box AND s.cc_id = v.cc3 JOIN branch_comps t ON t.box = v.box AND t.cc_id = q.dst JOIN branch_comps b ON b.box = v.box AND b.cc_id = v.best WHERE t.day >= 2 AND t.day >= s.day""",
    ("weighted", "branch_comps"),
)
add("prune_lateral_branches", lambda s, d: B.prune_lateral_branches(comps(s, d), links(s, d)))
add(
    "reattach_early_laterals",
    lambda s, d: B.reattach_early_laterals(orphans(s, d), comps(s, d), links(s, d), 0.2, 14),
    """WITH e AS MATERIALIZED (SELECT box, start, count(*) AS n, arg_min(x, depth) AS x, arg_min(y, depth) AS y, arg_min(day, depth) AS day, arg_max(x, depth) AS ex, arg_max(y, depth) AS ey FROM features WHERE start % 4 = 0 GROUP BY 1, 2 HAVING count(*) >= 4),
    b AS MATERIALIZED (SELECT l.box, min(l.src) AS src, l.dst FROM edges l JOIN branch_comps t ON t.box = l.box AND t.cc_id = l.src AND t.trunk JOIN e ON e.box = l.box AND e.start = l.dst AND t.day <= e.day WHERE t.day > 0 GROUP BY l.box, l.dst)
    SELECT box, src, dst, false AS hidden FROM b UNION ALL SELECT e.box, arg_min(t.cc_id, ((e.x - t.x) ** 2 + (e.y - t.y) ** 2, t.cc_id)), e.start, true FROM e ANTI JOIN b ON b.box = e.box AND b.dst = e.start JOIN branch_comps t ON t.box = e.box AND t.trunk AND t.day BETWEEN 1 AND e.day
    WHERE sqrt((e.x - e.ex) ** 2 + (e.y - e.ey) ** 2) > 0.2 * 14 / 4 AND e.n > 3.5 GROUP BY e.box, e.start""",
    ("features", "edges"),
)
REACH, FASTEST = 4.0, 0.5


def chain_ends(s, d):
    return X.remember(s, d, "chain_ends", lambda: B.chain_ends(features(s, d)))


def scored(s, d, keep=False):
    ends = chain_ends(s, d)
    apart = F.greatest(F.abs(F.col("a.x") - F.col("b.x")), F.abs(F.col("a.y") - F.col("b.y")))
    return B.hidden_link_score(ends, ends.where("start % 4 = 0"), REACH, FASTEST, HOURS, steps=apart, keep=keep)


def _span(p, q):
    return f"sqrt(({p}.x - {q}.x) ** 2 + ({p}.y - {q}.y) ** 2)"


def _turn(p, q, r, t):
    return COS(f"{q}.x - {p}.x", f"{q}.y - {p}.y", f"{t}.x - {r}.x", f"{t}.y - {r}.y")


X.SQL["chain_ends"] = (
    "SELECT box, start, least(len(s), 3) AS n, s[1] AS f1, s[least(len(s), 2)] AS f2, s[least(len(s), 3)] AS f3, s[-1] AS l1, s[-least(len(s), 2)] AS l2, s[-least(len(s), 3)] AS l3 FROM (SELECT box, start, list({'cc_id': cc_id, 'x': CAST(x AS DOUBLE), 'y': CAST(y AS DOUBLE), 'day': day, 'hour': hour} ORDER BY depth) AS s FROM features GROUP BY 1, 2)",
    ("features",),
)
add(
    "hidden_link_score",
    lambda s, d: _r(scored(s, d).withColumn("score", F.round("score", 9)), "score"),
    f"""WITH p AS MATERIALIZED (SELECT e.box, e.start AS "of", s.start AS "to", e.n AS na, s.n AS nb, e.l1 AS a, e.l2 AS a1, e.l3 AS a2, s.f1 AS b, s.f2 AS b1, s.f3 AS b2 FROM chain_ends e JOIN chain_ends s ON s.box = e.box AND s.start <> e.start AND s.start % 4 = 0 WHERE {_span('e.l1', 's.f1')} <= {REACH}),
    q AS MATERIALIZED (SELECT *, {_span('a', 'b')} AS d, b.hour - a.hour AS wait, CASE WHEN na > 1 THEN a.hour - a1.hour ELSE 0 END + CASE WHEN nb > 1 THEN b1.hour - b.hour ELSE 0 END AS beside, CASE WHEN na > 1 THEN 1 ELSE 0 END + CASE WHEN nb > 1 THEN 1 ELSE 0 END AS sides,
      {_span('a', 'a2')} / CASE WHEN a.hour > a2.hour THEN a.hour - a2.hour ELSE {HOURS}e0 END AS va, {_span('b', 'b2')} / CASE WHEN b2.hour > b.hour THEN b2.hour - b.hour ELSE {HOURS}e0 END AS vb, CASE WHEN b.day = a.day THEN 0.7e0 ELSE b.day - a.day END AS dd FROM p),
    r AS MATERIALIZED (SELECT *, d / CASE WHEN wait <> 0 THEN wait WHEN sides = 0 OR beside <= 0 THEN {HOURS}e0 ELSE beside / greatest(sides, 1) END AS v, CASE WHEN na = 2 THEN 0.5e0 ELSE 1e0 END AS wa, CASE WHEN nb = 2 THEN 0.5e0 ELSE 1e0 END AS wb, na = 1 OR nb = 1 AS alone,
      CASE WHEN na = 1 OR nb = 1 THEN 0.5e0 WHEN na = 3 AND nb = 3 THEN 1e0 ELSE 0.75e0 END AS wc FROM q)
    SELECT box, a.cc_id AS stop, b.cc_id AS start, "of", "to", round(round(CASE WHEN a.day > b.day THEN 2 ELSE (
      wa * CASE WHEN na > 1 THEN coalesce(2 * (1 - {_turn('a2', 'a', 'a', 'b')}), 0.5) ELSE 0.5 END + wb * CASE WHEN nb > 1 THEN coalesce(2 * (1 - {_turn('a', 'b', 'b', 'b2')}), 0.5) ELSE 0.5 END
      + wa * CASE WHEN na > 1 THEN coalesce(abs(va - v) / nullif(va + v, 0), 1) ELSE 0.5 END + wb * CASE WHEN nb > 1 THEN coalesce(abs(vb - v) / nullif(vb + v, 0), 1) ELSE 0.5 END
      + coalesce(1 - 0.5 * (b.y - a.y) / nullif(d, 0), 1) + abs(greatest(abs(a.x - b.x), abs(a.y - b.y)) - dd - 2.5) / 3 + CASE WHEN dd < 2 THEN 0 ELSE 0.15 * (dd - 1) END
      + wc * CASE WHEN alone THEN 0.5 ELSE coalesce(1 - {_turn('a2', 'a', 'b', 'b2')}, 1) END + wc * CASE WHEN alone THEN 0.5 ELSE coalesce(abs(vb - va) / nullif(vb + va, 0), 1) END
      + 0.5 + 0.5 + CASE WHEN v > 0.5 THEN 5 * (v - 0.5) / 0.5 ELSE 0 END) / (2 * wa + 2 * wb + 2 * wc + 4) END, 9), 4) AS score FROM r""",
    ("chain_ends",),
)
add("step_distance", lambda s, d: _r(B.step_distance(features(s, d).where("last").select("box", F.col("cc_id").alias("stop")), comps(s, d), links(s, d), SPEED * HOURS, HOURS, 30.0), "d"))
add("reconnect_broken_branches", lambda s, d: _r(B.reconnect_broken_branches(scored(s, d, keep=True), 1.6, ends=chain_ends(s, d), max_speed=FASTEST, typical_hours=HOURS), "score"))


REACH_OUT = 3
SIDES = """SELECT p.box, CASE WHEN p.day < q.day THEN p.cc_id ELSE q.cc_id END AS src, CASE WHEN p.day < q.day THEN q.cc_id ELSE p.cc_id END AS dst, (p.x + q.x) / 2e0 AS x, (p.y + q.y) / 2e0 AS y, CASE WHEN p.day < q.day THEN q.x - p.x ELSE p.x - q.x END AS nx,
      CASE WHEN p.day < q.day THEN q.y - p.y ELSE p.y - q.y END AS ny FROM labelled p JOIN labelled q ON p.box = q.box AND p.day <> q.day AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1))"""
ALONG = lambda u: f"CASE WHEN {u} > 0 THEN {u} - 0.5 ELSE -({u}) END"
add(
    "best_facet",
    lambda s, d: _r(R.best_facet(Q.labelled(s, d), Q.comps(s, d), REACH_OUT), "score"),
    f"""WITH sides AS MATERIALIZED ({SIDES}), o AS MATERIALIZED (SELECT s.box, s.src, s.dst, s.x, s.y, min(sqrt(u ** 2 + v ** 2)) AS outside FROM (SELECT *, CAST(floor(x) + i AS INTEGER) AS px, CAST(floor(y) + j AS INTEGER) AS py, {ALONG('(floor(x) + i - x)')} AS u, {ALONG('(floor(y) + j - y)')} AS v FROM sides, range(-{REACH_OUT + 1}, {REACH_OUT + 2}) a(i), range(-{REACH_OUT + 1}, {REACH_OUT + 2}) b(j)) s
      LEFT JOIN labelled l ON l.box = s.box AND l.x = s.px AND l.y = s.py WHERE u <= {REACH_OUT} AND v <= {REACH_OUT} AND (l.cc_id IS NULL OR l.cc_id NOT IN (s.src, s.dst)) GROUP BY ALL),
    r AS (SELECT s.*, round(2 * coalesce((nx * (t.cx - c.cx) + ny * (t.cy - c.cy)) / nullif(sqrt((t.cx - c.cx) ** 2 + (t.cy - c.cy) ** 2), 0), 0) + 2 * coalesce(outside, 1e8), 9) AS score FROM sides s LEFT JOIN o ON o.box = s.box AND o.src = s.src AND o.dst = s.dst AND o.x = s.x AND o.y = s.y
      JOIN comps c ON c.box = s.box AND c.cc_id = s.src JOIN comps t ON t.box = s.box AND t.cc_id = s.dst)
    SELECT box, src, dst, -m[3] AS x, -m[2] AS y, CAST(-m[4] AS INTEGER) AS axis, round(m[1], 4) AS score FROM (SELECT box, src, dst, max((score, -y, -x, CASE WHEN nx <> 0 THEN 0 ELSE -1 END)) AS m FROM r GROUP BY 1, 2, 3)""",
    ("labelled", "comps"),
)
CLASSES = 7


def _bounds(rows, by, value, name):
    """SQL of rows once for each class whose bound exceeds their value."""
    return f"""(SELECT * EXCLUDE (r, total, q), unnest(range({CLASSES})) AS {name}, unnest(list_concat(q, [CAST('infinity' AS DOUBLE)])) AS {name}_below FROM (SELECT *, [{', '.join(f"max(CASE WHEN r = {c} * total // {CLASSES} THEN {value} END) OVER (PARTITION BY {by})" for c in range(1, CLASSES))}] AS q
      FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {value}, id) - 1 AS r, count(*) OVER (PARTITION BY {by}) AS total FROM {rows})))"""


CELLS = f"""WITH {Q.SAMPLES}, b1 AS MATERIALIZED (SELECT * FROM {_bounds('samples', 'box', 'rate', 'rate_class')} WHERE rate < rate_class_below), b2 AS MATERIALIZED (SELECT * FROM {_bounds('b1', 'box, rate_class', 'ratio', 'ratio_class')} WHERE ratio < ratio_class_below),
    speed_cells AS MATERIALIZED (SELECT box, rate_class, rate_class_below, ratio_class, ratio_class_below, count(*) AS n, any_value(m) AS median, median(speed) FILTER (speed <= m) AS low, median(speed) FILTER (speed >= m) AS high
      FROM (SELECT *, median(speed) OVER (PARTITION BY box, rate_class, rate_class_below, ratio_class, ratio_class_below) AS m FROM b2) GROUP BY 1, 2, 3, 4, 5)"""
MID = ("median", "low", "high")


def _cells(s, d):
    return R.binned_speed_stats(Q.samples(s, d), CLASSES)


add(
    "binned_speed_stats",
    lambda s, d: _r(_cells(s, d), *MID).select("box", "rate_class", "ratio_class", "n", *MID),
    f"{CELLS} SELECT box, CAST(rate_class AS INTEGER) AS rate_class, CAST(ratio_class AS INTEGER) AS ratio_class, n, {', '.join(f'round({c}, 4) AS {c}' for c in MID)} FROM speed_cells",
    ("timed",),
)
add(
    "binned_speed_lookup",
    lambda s, d: _r(R.binned_speed_lookup(Q.samples(s, d).select("box", "id", "rate", "ratio"), _cells(s, d)), *MID),
    f"""{CELLS} SELECT s.box, s.id, CAST(c.rate_class AS INTEGER) AS rate_class, CAST(c.ratio_class AS INTEGER) AS ratio_class, c.n, {', '.join(f'round(c.{c}, 4) AS {c}' for c in MID)} FROM samples s JOIN speed_cells c ON c.box = s.box AND s.rate < c.rate_class_below AND s.ratio < c.ratio_class_below
    QUALIFY row_number() OVER (PARTITION BY s.box, s.id ORDER BY c.rate_class, c.ratio_class) = 1""",
    ("timed",),
)


def _image(s, d):
    wide = X.wide(s, d)
    return wide.select("box", "x", "y", reduce(add_up, (F.col(c) for c in frames_of(wide))).alias("v"))


SMALL = {"line": 2, "join": 2, "widen": 2, "grow": 1, "low": 60.0, "high": 500.0}
add("meniscus_mask", lambda s, d: R.meniscus_mask(_image(s, d), **SMALL)[0])
add("interest_area", lambda s, d: R.meniscus_mask(_image(s, d), **SMALL)[1])
