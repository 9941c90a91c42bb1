"""Queries of edits and of their replay. Models are a user's events of ten days, with five roots each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.operators import replay as R
from sylvaframe.operators.models import edit_log
from sylvaframe.plans import fixtures as X

BOOK = X.Book()
add = BOOK.add
#: Hours between two dates.
STEP = 24.0
ACTIONS = (R.MOVE, R.REMOVE, R.MIDDLE, R.SWITCH, R.PRIMARY, R.BRANCH, R.EXTEND, R.BACK, R.TIME, "")


def _events(s, d) -> DataFrame:
    days = F.expr("unix_micros(cast(ts as timestamp)) - 1704067200000000").cast("long")
    return X.table(s, d, "events").withColumn("model", F.expr("user_id * 4") + F.floor(days / 864000000000)).withColumn("root", F.col("event_id") % 5)


def nodes(s, d) -> DataFrame:
    """Nodes at half dates, from all events but clicks."""
    own = Window.partitionBy("model", "root").orderBy("ts", "event_id")
    rows = _events(s, d).where("event_type <> 'click'").withColumn("seq", F.row_number().over(own))
    down = F.sum(1 + F.col("event_id") % 5).over(own.rowsBetween(Window.unboundedPreceding, 0))
    t = 1 + (F.col("seq") - 1) / 2
    return rows.select("model", "root", "seq", (12 * F.col("root") + F.col("event_id") % 7).cast("double").alias("x"), down.cast("double").alias("y"), F.lit(1.0).alias("diameter"), (t * STEP).alias("th"), t.cast("double").alias("t"))


def roots(s, d) -> DataFrame:
    """Root 0 is a primary; 1, 2 and 4 hang on it, 3 on 1."""
    parent = F.when(F.col("root") == 3, 1).when(F.col("root") > 0, 0)
    return nodes(s, d).select("model", "root").distinct().select("model", "root", parent.cast("long").alias("parent"))


def log_lines(s, d) -> DataFrame:
    """A log of the clicks: each at a node that the model has at first, with one or two more points beside it."""
    clicks = _events(s, d).where("event_type = 'click'").select("model", "event_id", "ts", F.col("root"))
    at = nodes(s, d).withColumn("n", F.max("seq").over(Window.partitionBy("model", "root")))
    found = clicks.join(at, ["model", "root"]).withColumn("kind", F.expr("event_id div 5 % 10"))
    want = F.when(F.col("kind") == 6, F.col("n")).when(F.col("kind") == 7, 1).otherwise(1 + F.expr("event_id div 50") % F.col("n"))
    found = found.where(F.col("seq") == want)
    action = F.element_at(F.array(*(F.lit(a or "OTHER") for a in ACTIONS)), F.col("kind").cast("int") + 1)
    step = F.when(F.col("kind") == 7, -0.5).when(F.col("kind") == 2, 0.25).otherwise(F.col("event_id") % 3 * 0.5)
    point = lambda i: F.array(F.lit(f"Pt_{i}"), *((F.col(c) + k).cast("string") for c, k in (("x", 2.0 * i), ("y", 1.5 * i), ("t", step * i))))
    n = F.when(F.col("kind") == 1, 1).otherwise(2 + F.col("event_id") % 2).cast("int")
    fields = F.flatten(F.array(F.array(action, n.cast("string")), point(0), point(1), point(2)))
    return found.select("model", F.row_number().over(Window.partitionBy("model").orderBy("ts", "event_id")).alias("line"), F.slice(fields, F.lit(1), 2 + 4 * n).alias("fields"))


def _r(df):
    return df.select("model", "root", "seq", *(F.round(c, 3).alias(c) for c in ("x", "y", "t", "th")))


add("edit_replay", lambda s, d: _r(R.edit_replay(nodes(s, d), roots(s, d), edit_log(log_lines(s, d)), STEP)[0]))

X.SQL["rep_nodes"] = (
    f"""SELECT model, root, seq, (12 * root + event_id % 7)::DOUBLE AS x, (sum(1 + event_id % 5) OVER w)::DOUBLE AS y, (1 + (seq - 1) / 2) * {STEP}e0 AS th, 1 + (seq - 1) / 2 AS t FROM (
      SELECT *, row_number() OVER (PARTITION BY model, root ORDER BY ts, event_id) AS seq FROM (
        SELECT *, user_id * 4 + (epoch_us(ts) - 1704067200000000) // 864000000000 AS model, event_id % 5 AS root FROM events WHERE event_type <> 'click'))
    WINDOW w AS (PARTITION BY model, root ORDER BY seq)""",
    (),
)
X.SQL["rep_roots"] = ("SELECT DISTINCT model, root, CASE WHEN root = 3 THEN 1 WHEN root > 0 THEN 0 END AS parent FROM rep_nodes", ("rep_nodes",))
#: One click for each model: the middle node of the root with the most nodes, and its first and last one.
X.SQL["rep_clicks"] = (
    """SELECT c.model, c.root, c.n, m.seq, m.x, m.y, m.t, l.x AS lx, l.y AS ly, l.t AS lt, f.x AS fx, f.y AS fy, f.t AS ft FROM (
      SELECT model, max((n, -root))[1] AS n, -max((n, -root))[2] AS root FROM (SELECT model, root, count(*) AS n FROM rep_nodes GROUP BY 1, 2) GROUP BY 1) c
    JOIN rep_nodes m ON m.model = c.model AND m.root = c.root AND m.seq = (c.n + 1) // 2 JOIN rep_nodes l ON l.model = c.model AND l.root = c.root AND l.seq = c.n JOIN rep_nodes f ON f.model = c.model AND f.root = c.root AND f.seq = 1""",
    ("rep_nodes",),
)


def clicks(s, d) -> DataFrame:
    n = nodes(s, d)
    most = n.groupBy("model", "root").agg(F.count("*").alias("n")).groupBy("model").agg(F.max(F.struct("n", (-F.col("root")).alias("r"))).alias("m")).select("model", (-F.col("m.r")).alias("root"), "m.n")
    at = lambda seq, prefix: n.join(most, ["model", "root"]).where(F.col("seq") == seq).select("model", "root", "n", *(F.col(c).alias(f"{prefix}{c}") for c in ("seq", "x", "y", "t")))
    both = at(F.expr("(n + 1) div 2"), "").join(at(F.col("n"), "l").drop("lseq"), ["model", "root", "n"])
    return both.join(at(F.lit(1), "f").drop("fseq"), ["model", "root", "n"])


def points(*places: tuple[str, str, str]) -> Column:
    return F.array(*(F.struct(*(F.expr(e).cast("double").alias(c) for e, c in zip(p, "xyz"))) for p in places))


def edit(name: str, places: tuple[tuple[str, str, str], ...], edited: str) -> None:
    """A query of one edit for each model, and its SQL: `edited` gives model, root, place, x, y, t, th, whether a root is a primary, and whether it is retimed."""

    def query(s, d):
        asked = clicks(s, d).select("model", points(*places).alias("points"))
        return _r(getattr(R, name)(nodes(s, d), roots(s, d), asked, STEP)[0])

    whole = lambda c: f"abs({c} - round_even({c}, 0)) < 1e-6"
    w = "WINDOW w AS (PARTITION BY model, root ORDER BY place)"
    add(
        name,
        query,
        f"""WITH edited AS MATERIALIZED ({edited}), z AS (SELECT *, top AND sum(CASE WHEN nxt = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY model, root ORDER BY place) = 0 AS starts FROM (SELECT *, lead(t) OVER w AS nxt FROM edited {w})),
    u AS (SELECT model, root, place, x, y, changed, CASE WHEN starts AND changed THEN 0 ELSE t END AS t, CASE WHEN starts AND changed THEN 0 ELSE th END AS th FROM z),
    e AS (SELECT *, sum(leg) OVER w AS c, {whole('t')} AND NOT coalesce({whole('nt')} AND round_even(nt, 0) = round_even(t, 0), false) AS exact FROM (SELECT *, lead(t) OVER w AS nt, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS leg FROM u {w}) {w}),
    m AS (SELECT *, last_value(CASE WHEN exact THEN (c, t, th) END IGNORE NULLS) OVER (PARTITION BY model, root ORDER BY place ROWS UNBOUNDED PRECEDING) AS a, first_value(CASE WHEN exact THEN (c, t, th) END IGNORE NULLS) OVER (PARTITION BY model, root ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e),
    k AS (SELECT *, changed AND NOT exact AND a IS NOT NULL AND b IS NOT NULL AS moves, CASE WHEN b[1] - a[1] < 1e-6 THEN 0.5 ELSE (c - a[1]) / (b[1] - a[1]) END AS share FROM m)
    SELECT model, root, CAST(row_number() OVER (PARTITION BY model, root ORDER BY place) AS INTEGER) AS seq, round(x, 3) AS x, round(y, 3) AS y, round(CASE WHEN moves THEN a[2] + share * (b[2] - a[2]) ELSE t END, 3) AS t, round(CASE WHEN moves THEN a[3] + share * (b[3] - a[3]) ELSE th END, 3) AS th FROM k""",
        ("rep_clicks", "rep_roots"),
    )


D2 = "round((n.x - q.x) ** 2 + (n.y - q.y) ** 2, 6)"
OLD = "SELECT n.model, n.root, n.seq::DOUBLE AS place, n.x, n.y, n.t, n.th, r.parent IS NULL AS top"


def hit(x: str, y: str, z: str, primaries: bool = False) -> str:
    """SQL of what a click finds: model, root and seq."""
    return f"""(SELECT model, m[2] AS root, m[3] AS seq FROM (SELECT q.model, min(({D2}, n.root, n.seq)) AS m FROM (SELECT model, {x} AS x, {y} AS y, {z} AS z FROM rep_clicks) q
    JOIN rep_nodes n ON n.model = q.model AND n.t <= q.z {'AND n.root = 0' if primaries else ''} GROUP BY 1))"""


BASE = "FROM rep_nodes n JOIN rep_roots r ON r.model = n.model AND r.root = n.root"
edit(
    "edit_remove_point",
    (("x", "y", "t"),),
    f"""SELECT * FROM (WITH RECURSIVE h AS MATERIALIZED (SELECT h.model, h.root, coalesce(max(n.seq), 0) + 1 AS cut FROM {hit('x', 'y', 't')} h LEFT JOIN rep_nodes n ON n.model = h.model AND n.root = h.root AND n.seq < h.seq AND n.t = floor(n.t) GROUP BY 1, 2),
      several AS MATERIALIZED (SELECT model, parent FROM rep_roots GROUP BY 1, 2 HAVING count(*) > 1),
      next AS MATERIALIZED (SELECT f.model, f.root, r.parent, coalesce(arg_max(o.nxt, o.seq) FILTER (o.nxt IS NOT NULL AND o.y < f.y), min(o.seq)) AS node FROM rep_nodes f JOIN rep_roots r ON r.model = f.model AND r.root = f.root AND f.seq = 1
        JOIN (SELECT *, lead(seq) OVER (PARTITION BY model, root ORDER BY seq) AS nxt FROM rep_nodes) o ON o.model = r.model AND o.root = r.parent GROUP BY 1, 2, 3),
      gone AS (SELECT x.model, x.root FROM next x JOIN h ON h.model = x.model AND h.root = x.parent AND x.node >= h.cut JOIN several v ON v.model = x.model AND v.parent = x.parent
        UNION SELECT r.model, r.root FROM gone g JOIN rep_roots r ON r.model = g.model AND r.parent = g.root JOIN several v ON v.model = r.model AND v.parent = r.parent)
      {OLD}, h.model IS NOT NULL AS changed {BASE} LEFT JOIN h ON h.model = n.model AND h.root = n.root
      WHERE (h.model IS NULL OR n.seq < h.cut) AND (n.model, n.root) NOT IN (SELECT (model, root) FROM gone))""",
)
edit(
    "edit_create_primary",
    (("lx + 40", "1", "1"), ("lx + 41", "3", "1"), ("lx + 43", "5", "1"), ("lx + 43", "9", "2")),
    f"""{OLD}, false AS changed {BASE} UNION ALL SELECT c.model, m.root + 1, k.place, c.lx + k.dx, k.y, k.z, k.z * 24e0, true, true FROM rep_clicks c JOIN (SELECT model, max(root) AS root FROM rep_nodes GROUP BY 1) m ON m.model = c.model,
    (VALUES (0e0, 40, 1e0, 0e0), (1e0, 41, 3e0, 0e0), (2e0, 43, 5e0, 1e0), (3e0, 43, 9e0, 2e0)) k(place, dx, y, z)""",
)
edit(
    "edit_create_branch",
    (("x + 1", "y", "floor(t) + 1"), ("x + 4", "y + 1", "floor(t) + 1"), ("x + 5", "y + 6", "floor(t) + 2")),
    f"""{OLD}, false AS changed {BASE} UNION ALL SELECT c.model, m.root + 1, k.place, c.x + k.dx, c.y + k.dy, floor(c.t) + k.dz, (floor(c.t) + k.dz) * 24e0, false, true FROM rep_clicks c JOIN {hit('x + 1', 'y', 'floor(t) + 1', True)} h ON h.model = c.model
    JOIN (SELECT model, max(root) AS root FROM rep_nodes GROUP BY 1) m ON m.model = c.model, (VALUES (0e0, 1, 0, 1), (1e0, 4, 1, 1), (2e0, 5, 6, 2)) k(place, dx, dy, dz)""",
)
ENDS = "(SELECT model, root, max(seq) AS n FROM rep_nodes GROUP BY 1, 2)"
edit(
    "edit_extend",
    (("lx", "ly", "lt"), ("lx + 2", "ly + 3", "lt"), ("lx + 1", "ly + 8", "lt + 1")),
    f"""SELECT o.* EXCLUDE (n), h.model IS NOT NULL AS changed FROM ({OLD}, n.seq AS n {BASE}) o LEFT JOIN (SELECT h.* FROM {hit('lx', 'ly', 'lt')} h JOIN {ENDS} e ON e.model = h.model AND e.root = h.root AND e.n = h.seq AND h.seq > 1 JOIN rep_nodes n ON n.model = h.model AND n.root = h.root AND n.seq = h.seq JOIN rep_clicks c ON c.model = h.model AND n.t = c.lt) h ON h.model = o.model AND h.root = o.root
    UNION ALL SELECT c.model, h.root, h.seq + k.i::DOUBLE, c.lx + k.dx, c.ly + k.dy, c.lt + k.dz, floor(c.lt + k.dz) * 24e0, r.parent IS NULL, true FROM rep_clicks c JOIN {hit('lx', 'ly', 'lt')} h ON h.model = c.model AND h.seq > 1 JOIN {ENDS} e ON e.model = h.model AND e.root = h.root AND e.n = h.seq
    JOIN rep_nodes n ON n.model = h.model AND n.root = h.root AND n.seq = h.seq AND n.t = c.lt JOIN rep_roots r ON r.model = h.model AND r.root = h.root, (VALUES (1, 2, 3, 0), (2, 1, 8, 1)) k(i, dx, dy, dz)""",
)
edit(
    "edit_back_extend",
    (("fx", "fy", "ft"), ("fx + 2", "fy - 3", "ft - 0.5"), ("fx + 1", "fy - 8", "ft - 1")),
    f"""SELECT o.* EXCLUDE (th, n), CASE WHEN h.seq = o.n THEN floor(o.t) * 24e0 ELSE o.th END AS th, h.model IS NOT NULL AS changed FROM ({OLD}, n.seq AS n {BASE}) o LEFT JOIN {hit('fx', 'fy', 'ft')} h ON h.model = o.model AND h.root = o.root AND h.seq = 1
    UNION ALL BY NAME SELECT c.model, h.root, -k.i::DOUBLE AS place, c.fx + k.dx AS x, c.fy + k.dy AS y, c.ft + k.dz AS t, floor(c.ft + k.dz) * 24e0 AS th, r.parent IS NULL AS top, true AS changed FROM rep_clicks c JOIN {hit('fx', 'fy', 'ft')} h ON h.model = c.model AND h.seq = 1 JOIN rep_roots r ON r.model = h.model AND r.root = h.root, (VALUES (1, 2, -3, -0.5e0), (2, 1, -8, -1e0)) k(i, dx, dy, dz)""",
)
SEG = "(SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(t) OVER w AS t1, lead(th) OVER w AS th1 FROM rep_nodes WINDOW w AS (PARTITION BY model, root ORDER BY seq))"
edit(
    "edit_add_middle",
    (("x + 1", "y + 1", "t + 0.5"), ("x + 2", "y + 1", "t + 0.2"), ("x + 3", "y + 2", "t + 0.4")),
    f"""SELECT * FROM (WITH h AS MATERIALIZED (SELECT q.model, arg_min(s, (round(((s.x1 - s.x) * (q.y - s.y) - (s.y1 - s.y) * (q.x - s.x)) ** 2 / ((s.x1 - s.x) ** 2 + (s.y1 - s.y) ** 2), 6), s.root, s.seq)) AS s, any_value(q) AS q FROM (SELECT model, x + 1 AS x, y + 1 AS y, t + 0.5 AS z, t FROM rep_clicks) q JOIN {SEG} s ON s.model = q.model AND s.x1 IS NOT NULL AND s.t <= q.z
        AND (s.x1 - s.x) * (q.x - s.x) + (s.y1 - s.y) * (q.y - s.y) BETWEEN 0 AND (s.x1 - s.x) ** 2 + (s.y1 - s.y) ** 2 WHERE round(((s.x1 - s.x) * (q.y - s.y) - (s.y1 - s.y) * (q.x - s.x)) ** 2 / ((s.x1 - s.x) ** 2 + (s.y1 - s.y) ** 2), 6) < 400 GROUP BY 1)
      {OLD}, h.model IS NOT NULL AS changed {BASE} LEFT JOIN h ON h.model = n.model AND h.s.root = n.root
      UNION ALL SELECT h.model, h.s.root, h.s.seq + k.i / 3e0, h.q.x + k.dx, h.q.y + k.dy, h.q.t + k.dz, h.s.th + (h.s.th1 - h.s.th) * ((h.q.t + k.dz - h.s.t) / (h.s.t1 - h.s.t)), r.parent IS NULL, true FROM h JOIN rep_roots r ON r.model = h.model AND r.root = h.s.root, (VALUES (1, 1, 0, 0.2e0), (2, 2, 1, 0.4e0)) k(i, dx, dy, dz))""",
)
edit("edit_switch", (("x", "y", "t"), ("x + 9", "y + 1", "t + 0.5")), "SELECT NULL")
del BOOK.sql["edit_switch"]
