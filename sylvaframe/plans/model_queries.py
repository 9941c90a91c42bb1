"""Queries of models, series, runs, matches and edit logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaframe.operators import models as M
from sylvaframe.plans import fixtures as X

BOOK = X.Book()
add = BOOK.add


def _r(df, *names):
    return df.withColumns({n: F.round(n, 3) for n in names})


def on(fn, *names):
    return lambda s, d: _r(fn(X.nodes(s, d)), *names)


def both(fn, *names):
    return lambda s, d: _r(fn(X.nodes(s, d), X.roots(s, d)), *names)


FIRST = "(SELECT model, root, x AS fx, y AS fy FROM nodes WHERE seq = 1)"
add(
    "nearest_root",
    on(M.nearest_root),
    f"SELECT model, root, m[2] AS nearest, m[1] AS d2 FROM (SELECT f.model, f.root, min(((n.x - fx) * (n.x - fx) + (n.y - fy) * (n.y - fy), n.root)) AS m FROM {FIRST} f JOIN nodes n ON n.model = f.model AND n.root <> f.root GROUP BY 1, 2)",
    ("nodes",),
)
add(
    "reattach_laterals",
    both(M.reattach_laterals),
    f"""SELECT r.model, r.root, m[2] AS parent FROM roots r LEFT JOIN (SELECT f.model, f.root, min(((n.x - fx) * (n.x - fx) + (n.y - fy) * (n.y - fy), n.root)) AS m FROM {FIRST} f
    JOIN nodes n ON n.model = f.model JOIN roots p ON p.model = n.model AND p.root = n.root AND p.parent IS NULL GROUP BY 1, 2) b ON b.model = r.model AND b.root = r.root AND r.parent IS NOT NULL""",
    ("nodes", "roots"),
)
add(
    "append_node",
    on(lambda n: M.append_node(n, n.where("seq = 1 and root % 2 = 0").select("model", "root", "x", "y", (F.col("t") + 40).alias("t")))),
    "SELECT model, root, seq, x, y, t FROM nodes UNION ALL SELECT n.model, n.root, k.last + 1, n.x, n.y, n.t + 40 FROM nodes n JOIN (SELECT root, max(seq) AS last FROM nodes GROUP BY 1) k ON k.root = n.root WHERE seq = 1 AND n.root % 2 = 0",
    ("nodes",),
)
add(
    "prepend_node",
    on(lambda n: M.append_node(n, n.where("seq = 1 and root % 2 = 0").select("model", "root", (F.col("x") - 3).alias("x"), "y", (F.col("t") - 1).alias("t")), before=True)),
    "SELECT model, root, seq + CASE WHEN root % 2 = 0 THEN 1 ELSE 0 END AS seq, x, y, t FROM nodes UNION ALL SELECT model, root, 1, x - 3, y, t - 1 FROM nodes WHERE seq = 1 AND root % 2 = 0",
    ("nodes",),
)
add(
    "apply_point_transform",
    lambda s, d: M.apply_point_transform(X.nodes(s, d), s.range(200).select(F.col("id").alias("x"), F.col("id").alias("y"), (F.col("id") % 3).alias("dx"), (F.col("id") % 4).alias("dy")), F.col("seq") % 2 == 0),
    "SELECT model, root, seq, x - CASE WHEN seq % 2 = 0 AND x = y AND x BETWEEN 0 AND 199 THEN x % 3 ELSE 0 END AS x, y - CASE WHEN seq % 2 = 0 AND x = y AND x BETWEEN 0 AND 199 THEN y % 4 ELSE 0 END AS y FROM nodes",
    ("nodes",),
)
add(
    "model_ordering",
    both(M.model_ordering),
    f"""SELECT model, root, parent, CASE WHEN parent IS NULL THEN row_number() OVER (PARTITION BY model, parent ORDER BY fx, root) ELSE row_number() OVER (PARTITION BY model, parent ORDER BY fy, root) END AS place FROM {FIRST} JOIN roots USING (model, root)""",
    ("nodes", "roots"),
)
add("laterals_per_plant", lambda s, d: M.laterals_per_plant(X.roots(s, d)), "SELECT r.model, r.root AS plant, count(k.root) AS n FROM roots r LEFT JOIN roots k ON k.model = r.model AND k.parent = r.root WHERE r.parent IS NULL GROUP BY 1, 2", ("roots",))
add(
    "plant_time_series",
    both(M.plant_time_series, "primary_length", "lateral_length"),
    """WITH v AS (SELECT model, root, day, coalesce(sum(CASE WHEN t1 <= day THEN len WHEN t <= day THEN len * (day - t) / (t1 - t) ELSE 0 END), 0) AS length, min(t) <= day AS there
      FROM (SELECT s.*, CAST(unnest(range(1, last + 1)) AS INTEGER) AS day FROM segs s JOIN (SELECT model, CAST(ceil(max(t)) AS BIGINT) AS last FROM nodes GROUP BY 1) USING (model)) GROUP BY 1, 2, 3)
    SELECT v.model, v.root AS plant, v.day, round(any_value(v.length), 3) AS primary_length, count(*) FILTER (k.there) AS n_laterals, round(coalesce(sum(k.length), 0), 3) AS lateral_length
    FROM v JOIN roots r ON r.root = v.root AND r.parent IS NULL LEFT JOIN (SELECT v.*, r.parent FROM v JOIN roots r ON r.root = v.root) k ON k.parent = v.root AND k.day = v.day GROUP BY 1, 2, 3""",
    ("segs", "roots", "nodes"),
)
HIDDEN = "(x + y) % 5 = 0"
add("organ_segments", on(lambda n: M.organ_segments(n, F.expr(HIDDEN))), f"SELECT model, root, CAST(part AS BIGINT) AS part, min(seq) AS first, max(seq) AS last, count(*) AS n FROM (SELECT *, sum(CAST({HIDDEN} AS INTEGER)) OVER (PARTITION BY model, root ORDER BY seq) AS part FROM nodes) GROUP BY 1, 2, 3", ("nodes",))
add("hidden_runs", on(lambda n: M.hidden_runs(n, F.expr(HIDDEN))), f"SELECT model, root, min(seq) AS first, count(*) AS n FROM (SELECT *, seq - row_number() OVER (PARTITION BY model, root ORDER BY seq) AS g FROM nodes WHERE {HIDDEN}) GROUP BY model, root, g", ("nodes",))
add("time_knots", on(M.time_knots, "distance"), "SELECT model, root, CAST(floor(t) AS BIGINT) AS day, round(max(c), 3) AS distance FROM segs GROUP BY 1, 2, 3", ("segs",))


def _lines(s, d):
    """Lines of edit logs: every 40th edit of a model's log has an empty action, which ends it."""
    v = lambda e: F.expr(e).cast("string")
    label = lambda k: F.lit(f"Pt_{k}")
    fields = F.concat(
        F.array(F.when(F.expr("event_id % 397 = 0"), F.lit("")).otherwise(F.concat(F.lit("ACTION_"), v("event_id % 9"))), v("1 + event_id % 2")), F.array(label(0), v("value"), v("value + event_id % 5"), v("event_id % 28 + 1")),
        F.when(F.expr("event_id % 2 = 1"), F.array(label(1), v("2 * value"), v("value"), v("event_id % 28 + 2"))).otherwise(F.array().cast("array<string>")),
    )
    return X.table(s, d, "events").where("event_type = 'click'").select(F.expr(f"user_id div {X.ROOTS}").alias("model"), F.col("event_id").alias("line"), fields.alias("fields"))


CLICKS = "SELECT user_id // 30 AS model, event_id AS line, event_id, value, CASE WHEN event_id % 397 = 0 THEN '' ELSE 'ACTION_' || (event_id % 9) END AS action FROM events WHERE event_type = 'click'"
EDITS = f"""SELECT model, CAST(seq AS BIGINT) AS seq, action, p AS point, CASE WHEN p = 0 THEN value ELSE 2 * value END AS x, CASE WHEN p = 0 THEN value + event_id % 5 ELSE value END AS y, CAST(event_id % 28 + 1 + p AS DOUBLE) AS z
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY line) AS seq, sum(CASE WHEN action = '' THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY line) AS ended FROM ({CLICKS})), (VALUES (0), (1)) k(p) WHERE ended = 0 AND p <= event_id % 2"""
add("edit_log", lambda s, d: M.edit_log(_lines(s, d)), EDITS)
add("edit_undo", lambda s, d: M.edit_undo(M.edit_log(_lines(s, d))), f"SELECT * FROM ({EDITS}) QUALIFY seq < max(seq) OVER (PARTITION BY model)")
add(
    "trimmed_matches",
    lambda s, d: M.trimmed_matches(X.table(s, d, "orders").select((F.col("o_custkey") % 20).alias("block"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), ["block"], "score", 1000.0, 0.8),
    "SELECT block, id, score FROM (SELECT o_custkey % 20 AS block, o_orderkey AS id, o_totalprice AS score, percent_rank() OVER (PARTITION BY o_custkey % 20 ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_totalprice > 1000) WHERE r <= 0.8",
)
add(
    "chain_displacements",
    lambda s, d: M.chain_displacements(X.table(s, d, "orders").select((F.col("o_custkey") % 20).alias("series"), F.col("o_orderkey").alias("t"), (F.col("o_custkey") % 7 - 3).alias("dx"), (F.col("o_custkey") % 5 - 2).alias("dy")), "series"),
    "SELECT o_custkey % 20 AS series, o_orderkey AS t, o_custkey % 7 - 3 AS dx, o_custkey % 5 - 2 AS dy, CAST(sum(o_custkey % 7 - 3) OVER w AS BIGINT) AS total_dx, CAST(sum(o_custkey % 5 - 2) OVER w AS BIGINT) AS total_dy FROM orders WINDOW w AS (PARTITION BY o_custkey % 20 ORDER BY o_orderkey DESC)",
)
