"""Queries of inventories, time bases, scalar helpers and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaframe.functions import scalars as C
from sylvaframe.operators import timebase as T
from sylvaframe.plans import fixtures as X

BOOK = X.Book()
add = BOOK.add
OBS = ("observations",)


def acquisitions(s, d):
    """box, i, h: the observations of each object as acquisition times."""
    return T.inventory_observations(X.observations(s, d)).select(F.col("object").alias("box"), F.col("num_obs").cast("long").alias("i"), F.col("hours").alias("h"))


INV = """SELECT object, file, CAST(row_number() OVER (PARTITION BY object ORDER BY mtime, file) - 1 AS INTEGER) AS num_obs,
  round((epoch_us(mtime) - epoch_us(min(mtime) OVER (PARTITION BY object))) / 3.6e9, 2) AS hours FROM {}"""
ACQ = f"(SELECT object AS box, CAST(num_obs AS BIGINT) AS i, hours AS h FROM ({INV.format('observations')}))"

add("inventory_observations", lambda s, d: T.inventory_observations(X.observations(s, d)), INV.format("observations"), OBS)
add("inventory_objects", lambda s, d: T.inventory_objects(X.observations(s, d)), "SELECT object, min(mtime) AS first, max(mtime) AS last, count(*) AS n_images FROM observations GROUP BY object", OBS)
add("inventory_totals", lambda s, d: T.inventory_totals(X.observations(s, d)), "SELECT min(mtime) AS first, max(mtime) AS last, count(DISTINCT object) AS n_objects, count(*) AS n_images FROM observations", OBS)
add(
    "inventory_by_code",
    lambda s, d: T.inventory_by_code(X.observations(s, d).withColumn("code", F.when(F.col("file") % 5 == 0, "").when(F.col("file") % 7 == 0, None).otherwise(F.col("object"))), "code"),
    INV.format("(SELECT CASE WHEN file % 5 = 0 OR file % 7 = 0 THEN 'NOT_FOUND' ELSE object END AS object, file, mtime FROM observations)"),
    OBS,
)
add(
    "experiment_flags",
    lambda s, d: T.experiment_flags(X.table(s, d, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 2 == 0, "Split_V01").otherwise("HaveNoSurface_"), "p_name").alias("value")), "value").drop("value"),
    "SELECT p_partkey, p_size % 2 = 0 AS is_split, p_size % 2 <> 0 AS is_gaps FROM part",
)
add(
    "first_params",
    lambda s, d: T.first_params(X.table(s, d, "part").select((F.col("p_partkey") % 7).alias("dataset"), F.col("p_partkey").alias("line"), F.col("p_brand").alias("key"), F.col("p_name").alias("value"))),
    "SELECT p_partkey % 7 AS dataset, p_brand AS key, arg_min(p_name, p_partkey) AS value FROM part GROUP BY ALL",
)
add(
    "pending_steps",
    lambda s, d: T.pending_steps(
        X.table(s, d, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 9 == 0, "TRASH_").otherwise(""), "s_name").alias("box")),
        X.table(s, d, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 9 == 0, "TRASH_").otherwise(""), "s_name").alias("box"), (F.col("s_suppkey") % 8 + 1).cast("int").alias("step")),
        1,
        8,
    ),
    """SELECT box, CAST(step AS INTEGER) AS step, box LIKE '%TRASH%' AS skips FROM (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'TRASH_' ELSE '' END || s_name AS box, s_suppkey % 8 + 1 AS done FROM supplier)
    CROSS JOIN (SELECT unnest(range(1, 9)) AS step) WHERE step <> done""",
)
add(
    "pair_files",
    lambda s, d: T.pair_files(
        X.table(s, d, "part").where("p_partkey % 3 > 0").select(F.concat(F.lit("f."), F.col("p_partkey").cast("string"), F.lit(".tif")).alias("image")),
        X.table(s, d, "part").where("p_partkey % 4 > 0").select(F.concat(F.lit("f."), F.col("p_partkey").cast("string"), F.lit(".rsml")).alias("model")),
        X.table(s, d, "part").where("p_partkey % 5 = 0").select(F.concat(F.lit("f."), F.col("p_partkey").cast("string"), F.lit(".csv")).alias("output")),
    ),
    """SELECT 'f.' || p_partkey AS stem, CASE WHEN p_partkey % 3 > 0 THEN 'f.' || p_partkey || '.tif' END AS image, CASE WHEN p_partkey % 4 > 0 THEN 'f.' || p_partkey || '.rsml' END AS model
    FROM part WHERE (p_partkey % 3 > 0 OR p_partkey % 4 > 0) AND p_partkey % 5 <> 0""",
)


def _r(df, *names):
    return df.withColumns({n: F.round(n, 4) for n in names})


MID = f"SELECT box, i + 1 AS i, (h + p) / 2 AS h FROM (SELECT *, lag(h) OVER (PARTITION BY box ORDER BY i) AS p FROM {ACQ}) WHERE p IS NOT NULL"
add(
    "hours_midpoints",
    lambda s, d: _r(T.hours_midpoints(acquisitions(s, d)), "h"),
    f"""SELECT box, i, round(h, 4) AS h FROM ({MID}) UNION ALL SELECT box, CAST(k AS BIGINT), round(a - (2 - k) * (b - a), 4) FROM
    (SELECT box, arg_min(h, i) AS a, arg_max(h, i) AS b FROM ({MID}) WHERE i IN (2, 3) GROUP BY box), (VALUES (0), (1)) z(k)""",
    OBS,
)
add(
    "hours_extremities",
    lambda s, d: T.hours_extremities(acquisitions(s, d), 8.0),
    f"SELECT box, i + 1 AS i, h FROM {ACQ} WHERE i >= 1 UNION ALL SELECT DISTINCT box, 1, 0.0 FROM {ACQ} UNION ALL SELECT DISTINCT box, 0, -8.0 FROM {ACQ}",
    OBS,
)
add("mean_sampling_interval", lambda s, d: _r(T.mean_sampling_interval(acquisitions(s, d)), "mean_gap"), f"SELECT round(avg(g), 4) AS mean_gap FROM (SELECT h - lag(h) OVER (PARTITION BY box ORDER BY i) AS g FROM {ACQ})", OBS)


def _interpolation(s, d):
    knots = X.table(s, d, "orders").groupBy((F.col("o_custkey") % 50).alias("k"), F.datediff("o_orderdate", F.lit("1995-01-01")).alias("x")).agg(F.sum("o_totalprice").alias("y"))
    values = X.table(s, d, "part").select((F.col("p_partkey") % 50).alias("k"), "p_partkey", (F.col("p_size") * 61.5 - 300).alias("v"))
    return _r(T.linear_interpolation(values, knots, ["k"]), "y")


add(
    "linear_interpolation",
    _interpolation,
    """WITH knots AS MATERIALIZED (SELECT o_custkey % 50 AS k, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x, sum(o_totalprice) AS y FROM orders GROUP BY ALL),
    v AS (SELECT p_partkey % 50 AS k, p_partkey, CAST(p_size * 61.5 - 300 AS DOUBLE) AS v FROM part),
    j AS (SELECT v.*, lo.x AS lx, lo.y AS ly, hi.x AS hx, hi.y AS hy FROM v ASOF LEFT JOIN knots lo ON lo.k = v.k AND lo.x <= v.v ASOF LEFT JOIN knots hi ON hi.k = v.k AND hi.x >= v.v)
    SELECT k, p_partkey, v, round(CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL OR lx = v THEN ly ELSE ly + (v - lx) / (hx - lx) * (hy - ly) END, 4) AS y FROM j""",
)
L = lambda s, d: X.table(s, d, "lineitem")
E_ = lambda s, d: X.table(s, d, "events")
ev = lambda fn: lambda s, d: E_(s, d).select("event_id", *fn())
c = F.col
add("round2", ev(lambda: [C.round_dead((c("event_id") % 2001 - 1000) / 64, 2, 0.01).alias("r2"), C.round_dead((c("event_id") % 2001 - 1000) / 64, 4, 0.0001).alias("r4")]),
    "SELECT event_id, CASE WHEN abs(v) < 0.01 THEN 0 ELSE sign(v) * round(abs(v), 2) END AS r2, CASE WHEN abs(v) < 0.0001 THEN 0 ELSE sign(v) * round(abs(v), 4) END AS r4 FROM (SELECT event_id, (event_id % 2001 - 1000) / 64 AS v FROM events)")
add("euclidean_distance", ev(lambda: [F.round(C.distance(c("value"), c("user_id"), c("event_id") % 100, F.lit(7)), 4).alias("dist")]),
    "SELECT event_id, round(sqrt((event_id % 100 - value) ** 2 + (7 - user_id) ** 2), 4) AS dist FROM events")
add("direction_angle", ev(lambda: [F.round(C.direction_angle((c("event_id") % 7 - 3).cast("double"), (c("event_id") % 5 - 2).cast("double")), 4).alias("theta")]),
    """SELECT event_id, round(CASE WHEN dx = 0 AND dy = 0 THEN NULL WHEN dy <= 0 THEN acos(greatest(-1, least(1, dx / sqrt(dx * dx + dy * dy)))) ELSE 2 * pi() - acos(greatest(-1, least(1, dx / sqrt(dx * dx + dy * dy)))) END, 4) AS theta
    FROM (SELECT event_id, CAST(event_id % 7 - 3 AS DOUBLE) AS dx, CAST(event_id % 5 - 2 AS DOUBLE) AS dy FROM events)""")
add("similarity_cost", ev(lambda: [F.round(C.similarity_cost(c("value"), (c("event_id") % 50).cast("double")), 4).alias("cost")]), "SELECT event_id, round(abs(value - event_id % 50) / nullif(value + event_id % 50, 0), 4) AS cost FROM events")
add("replace_range_value", ev(lambda: [C.replace_range_value(c("value"), 10, 20, -1.0).alias("v")]), "SELECT event_id, CASE WHEN value >= 10 AND value < 20 THEN -1 ELSE value END AS v FROM events")
add("replace_nonfinite", ev(lambda: [C.replace_nonfinite(F.when(c("event_id") % 5 == 0, float("nan")).when(c("event_id") % 7 == 0, float("inf")).otherwise(c("value")), -2.0).alias("v")]),
    "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN -2 ELSE value END AS v FROM events")
add("correlation", lambda s, d: _r(T.correlation(L(s, d), ["l_suppkey"], "l_quantity", "l_linenumber"), "r"),
    """SELECT l_suppkey, CASE WHEN vx > 1e-12 AND vy > 1e-12 THEN round(cv / sqrt(vx * vy), 4) ELSE 0 END AS r FROM (SELECT l_suppkey, count(*) * sum(l_quantity * l_linenumber) - sum(l_quantity) * sum(l_linenumber) AS cv,
    count(*) * sum(l_quantity * l_quantity) - sum(l_quantity) * sum(l_quantity) AS vx, CAST(count(*) * sum(l_linenumber * l_linenumber) - sum(l_linenumber) * sum(l_linenumber) AS DOUBLE) AS vy FROM lineitem GROUP BY 1)""")
add("common_prefix", lambda s, d: T.common_prefix(X.table(s, d, "supplier").select("s_nationkey", "s_name"), ["s_nationkey"], "s_name"),
    "SELECT s_nationkey, left(a, (SELECT max(k) FROM range(0, length(a) + 1) z(k) WHERE left(a, k) = left(b, k))) AS prefix FROM (SELECT s_nationkey, min(s_name) AS a, max(s_name) AS b FROM supplier GROUP BY 1)")
add("count_occurrences", lambda s, d: X.table(s, d, "documents").select("doc_id", C.count_occurrences(c("text"), F.lit("en")).alias("n")), "SELECT doc_id, CAST((length(text) - length(replace(text, 'en', ''))) / 2 AS INTEGER) AS n FROM documents")
add(
    "guess_label",
    lambda s, d: T.guess_label(
        X.table(s, d, "part").select(F.concat("p_name", F.lit("_"), F.concat(F.lit("Supplier#"), F.lpad((c("p_partkey") % 1200).cast("string"), 9, "0"))).alias("name")).distinct(),
        X.table(s, d, "supplier").select(c("s_name").alias("label"), c("s_suppkey").alias("pos"), F.right("s_name", F.lit(4)).alias("suffix")),
    ),
    """SELECT name, arg_max(label, hits * 1000000 - pos) AS label, max(hits) AS hits FROM (SELECT name, label, pos, CAST(coalesce((length(name) - length(replace(name, suffix, ''))) / 4, 0) AS INTEGER) AS hits
    FROM (SELECT DISTINCT p_name || '_Supplier#' || lpad(CAST(p_partkey % 1200 AS VARCHAR), 9, '0') AS name FROM part) LEFT JOIN (SELECT s_name AS label, s_suppkey AS pos, right(s_name, 4) AS suffix FROM supplier) ON contains(name, suffix)) GROUP BY name""",
)
add(
    "apply_dates_by_name",
    lambda s, d: T.apply_dates_by_name(
        X.table(s, d, "orders").select((c("o_custkey") % 50).alias("seq"), F.concat(F.lit("img"), c("o_orderkey").cast("string"), F.lit(" ")).alias("name")),
        X.table(s, d, "orders").where("o_orderkey % 3 > 0").select(
            (c("o_custkey") % 50).alias("seq"), c("o_orderkey").alias("line"), F.concat(F.lit(" img"), c("o_orderkey").cast("string")).alias("name"),
            F.when(c("o_orderkey") % 5 == 0, "none").otherwise(F.concat(F.lit("Date="), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_Time="), F.lpad((c("o_orderkey") % 24).cast("string"), 2, "0"), F.lit("-15-00"))).alias("text"),
        ),
    ),
    """SELECT o_custkey % 50 AS seq, 'img' || o_orderkey || ' ' AS name, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN date_trunc('day', o_orderdate) + to_hours(o_orderkey % 24) + INTERVAL 15 MINUTE END AS taken_at FROM orders""",
)
add("tail_aligned_join", lambda s, d: T.tail_aligned_join(X.table(s, d, "supplier").select(c("s_nationkey").alias("k"), "s_suppkey"), X.table(s, d, "customer").select(c("c_nationkey").alias("k"), "c_custkey"), ["k"], ["s_suppkey"], ["c_custkey"]).drop("from_end"),
    "SELECT k, s_suppkey, c_custkey FROM (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS n FROM supplier) JOIN (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS n FROM customer) USING (k, n)")
add("coverage_check", lambda s, d: T.coverage_check(L(s, d).select((c("l_orderkey") % 3000).alias("id")), 3000), "SELECT i AS id, coalesce(n, 0) AS times FROM range(1, 3001) z(i) LEFT JOIN (SELECT l_orderkey % 3000 AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = i WHERE coalesce(n, 0) <> 1")
add(
    "cell_class_summary",
    lambda s, d: T.cell_class_summary(L(s, d).select(c("l_suppkey").alias("image"), c("l_quantity").alias("area"), (c("l_returnflag") == "R").alias("flag")), X.table(s, d, "supplier").where("s_acctbal >= 0").select(c("s_suppkey").alias("image"))),
    """SELECT image, area, fa AS flagged_area, n, nf AS n_flagged, CASE WHEN s_suppkey IS NOT NULL THEN format('{:.2f}', round(100 * fa / area, 2)) ELSE 'NA' END AS percent, CASE WHEN s_suppkey IS NULL THEN 'no annotation' END AS reason FROM
    (SELECT l_suppkey AS image, sum(l_quantity) AS area, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS fa, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS nf FROM lineitem GROUP BY 1)
    LEFT JOIN supplier ON s_suppkey = image AND s_acctbal >= 0""",
)
add("mad_double_sided", lambda s, d: _r(T.mad_double_sided(L(s, d), ["l_suppkey"], c("l_quantity")), "median", "low", "high"),
    """SELECT l_suppkey, m AS median, round(median(l_quantity) FILTER (l_quantity <= m), 4) AS low, round(median(l_quantity) FILTER (l_quantity >= m), 4) AS high
    FROM lineitem JOIN (SELECT l_suppkey, median(l_quantity) AS m FROM lineitem GROUP BY 1) USING (l_suppkey) GROUP BY ALL""")
add("time_cost", ev(lambda: [F.round(C.time_cost(c("user_id"), c("event_id") % 60), 4).alias("cost")]), "SELECT event_id, CASE WHEN g < 0 THEN 100 ELSE round(1 - 1 / (1e0 + abs(g - 1)), 4) END AS cost FROM (SELECT event_id, event_id % 60 - user_id AS g FROM events)")
add("orientation_cost", ev(lambda: [F.round(C.orientation_cost(F.lit(0.0), F.lit(1.0), (c("event_id") % 7 - 3).cast("double"), (c("event_id") % 5 - 2).cast("double")), 4).alias("cost")]),
    "SELECT event_id, round(((1 - dy / nullif(sqrt(dx * dx + dy * dy), 0)) / 2) ** 2, 4) AS cost FROM (SELECT event_id, CAST(event_id % 7 - 3 AS DOUBLE) AS dx, CAST(event_id % 5 - 2 AS DOUBLE) AS dy FROM events)")
add("connectivity_cost", ev(lambda: [F.round(C.connectivity_cost(F.array_repeat(F.lit(1), (c("event_id") % 11).cast("int"))), 4).alias("cost")]), "SELECT event_id, CASE WHEN event_id % 11 < 2 THEN 100 ELSE round(1 - 1 / (1e0 + event_id % 11 - 2), 4) END AS cost FROM events")
add("mad_cost", ev(lambda: [F.round(C.mad_cost(c("value"), F.lit(20.0), F.lit(12.0), F.lit(31.0)), 4).alias("cost")]), "SELECT event_id, round(1 - exp(-abs(value - 20) / (1.4826 * (CASE WHEN value < 20 THEN 8.0 ELSE 11.0 END + 1e-6)) / 2), 4) AS cost FROM events")
add("speed_colour", ev(lambda: [C.speed_colour(c("value"), 64.0).alias("level")]), "SELECT event_id, CAST(greatest(0, least(255, floor(50 + 205 * value / 64.0))) AS INTEGER) AS level FROM events")
add("anomaly_code", ev(lambda: [C.anomaly_code(F.concat_ws("_", "event_type", F.lit("too"), "event_type")).alias("code")]), "SELECT event_id, upper(left(event_type, 1) || 't' || left(event_type, 1)) AS code FROM events")
