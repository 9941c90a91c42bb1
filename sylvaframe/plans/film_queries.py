"""Queries of block and patch matches and of film schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaframe.functions import scalars as C
from sylvaframe.operators import pixels as P
from sylvaframe.operators import registration as G
from sylvaframe.plans import fixtures as X

BOOK = X.Book()
add = BOOK.add

#: Blocks of 4 x 4 every 3 pixels whose variance is over a limit, and displacements up to 1.
SIZE, STRIDE, VARIANCE, REACH = 4, 3, 50.0, 1


def _corr(n, a, b, aa, bb, ab):
    va, vb = f"({n} * {aa} - {a} * {a})", f"({n} * {bb} - {b} * {b})"
    return f"round(CASE WHEN {aa} > 1e-19 AND {bb} > 1e-19 AND {va} > 1e-9 AND {vb} > 1e-9 THEN ({n} * {ab} - {a} * {b}) / sqrt(CASE WHEN {va} > 1e-9 AND {vb} > 1e-9 THEN {va} * {vb} ELSE 1 END) ELSE 0 END, 9)"


add(
    "block_match",
    lambda s, d: G.block_match(X.raster(s, d), P.block_candidates(X.raster(s, d), SIZE, STRIDE, VARIANCE), SIZE, REACH).withColumn("score", C.rounded("score", 5)),
    f"""WITH grid AS MATERIALIZED (SELECT box, t, x, y, v, {STRIDE} * i AS bx, {STRIDE} * j AS "by" FROM raster JOIN range(0, 14) k(i) ON x BETWEEN {STRIDE} * i AND {STRIDE} * i + {SIZE - 1} JOIN range(0, 14) l(j) ON y BETWEEN {STRIDE} * j AND {STRIDE} * j + {SIZE - 1}),
    blocks AS MATERIALIZED (SELECT box, t, bx, "by" FROM grid GROUP BY ALL HAVING count(*) = {SIZE * SIZE} AND var_pop(v) > {VARIANCE}),
    scored AS (SELECT g.box, g.t, g.bx, g."by", k.dx, k.dy, {_corr('count(*)', 'sum(g.v)', 'sum(m.v)', 'sum(g.v * g.v)', 'sum(m.v * m.v)', 'sum(g.v * m.v)')} AS score
      FROM grid g SEMI JOIN blocks b ON b.box = g.box AND b.t = g.t AND b.bx = g.bx AND b."by" = g."by", (SELECT * FROM range(-{REACH}, {REACH} + 1) p(dx), range(-{REACH}, {REACH} + 1) q(dy)) k, raster m
      WHERE m.box = g.box AND m.t = g.t + 1 AND m.x = g.x + k.dx AND m.y = g.y + k.dy GROUP BY ALL HAVING count(*) = {SIZE * SIZE})
    SELECT box, t, CAST(bx AS BIGINT) AS bx, CAST("by" AS BIGINT) AS "by", CAST(-m[3] AS INTEGER) AS dx, CAST(-m[4] AS INTEGER) AS dy, round(m[1], 5) AS score FROM (SELECT box, t, bx, "by", max((score, -(dx * dx + dy * dy), -dx, -dy)) AS m FROM scored GROUP BY ALL)""",
    ("raster",),
)
#: Patches of an image's borders: whole numbers from vectors; a bottom patch is mostly the top one two positions on.
IMAGE = 60


def patches(s, d):
    v = X.table(s, d, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: F.floor(1000 * x.cast("double"))).alias("v"))
    own = v.select((F.expr(f"vec_id div {IMAGE}")).alias("image"), (F.col("vec_id") % IMAGE).alias("i"), F.col("v").alias("top"))
    ahead = own.select("image", (F.col("i") - 2).alias("i"), F.col("top").alias("ahead"))
    weight = F.when(F.col("i") % 7 < 3, 1).otherwise(0)
    both = own.join(ahead, ["image", "i"], "left").select("image", "i", "top", F.coalesce("ahead", "top").alias("ahead"))
    return both.select("image", "i", "top", F.zip_with("ahead", "top", lambda a, b: a * weight + F.element_at("top", 1) - b * (1 - weight)).alias("bottom"))


add(
    "gap_correspondence",
    lambda s, d: G.gap_correspondence(patches(s, d), 3, 0.6, 5.0, 1.0),
    f"""WITH v AS (SELECT vec_id // {IMAGE} AS image, vec_id % {IMAGE} AS i, list_transform(embedding, lambda x: floor(1000 * CAST(x AS DOUBLE))) AS top FROM embeddings WHERE embedding IS NOT NULL),
    p AS MATERIALIZED (SELECT v.image, v.i, v.top, list_transform(list_zip(coalesce(a.top, v.top), v.top), lambda z: z[1] * (CASE WHEN v.i % 7 < 3 THEN 1 ELSE 0 END) + v.top[1] - z[2] * (CASE WHEN v.i % 7 < 3 THEN 0 ELSE 1 END)) AS bottom FROM v LEFT JOIN v a ON a.image = v.image AND a.i = v.i + 2),
    q AS (SELECT a.image, a.i, b.i AS j, stddev_pop(a.x) AS d_top, {_corr('count(*)', 'sum(a.x)', 'sum(b.x)', 'sum(a.x * a.x)', 'sum(b.x * b.x)', 'sum(a.x * b.x)')} AS r
      FROM (SELECT image, i, unnest(top) AS x, generate_subscripts(top, 1) AS k FROM p) a JOIN (SELECT image, i, unnest(bottom) AS x, generate_subscripts(bottom, 1) AS k FROM p) b ON b.image = a.image AND b.k = a.k AND abs(a.i - b.i) <= 3 GROUP BY 1, 2, 3),
    kept AS (SELECT image, i, -m[2] AS j FROM (SELECT image, i, max((r, -j)) AS m, any_value(d_top) AS d_top FROM q GROUP BY 1, 2) JOIN (SELECT image, i, list_stddev_pop(bottom) AS d_bottom FROM p) USING (image, i) WHERE m[1] >= 0.6 AND d_top >= 5 AND d_bottom >= 5),
    marked AS (SELECT image, i, coalesce(lag(i) OVER (PARTITION BY image ORDER BY i, real DESC), -1) AS before FROM (SELECT image, i, true AS real FROM kept UNION ALL SELECT image, max(i), false FROM p GROUP BY image))
    SELECT image, i, j, true AS real FROM kept UNION ALL SELECT image, CAST(trunc(before + 1.5e0 * k) AS BIGINT), CAST(trunc(before + 1.5e0 * k) AS BIGINT), false FROM (SELECT *, unnest(range(1, CAST(ceil((i - before) / 1.5e0 - 1) AS BIGINT))) AS k FROM marked WHERE i - before > 4)""",
)


def film_hours(s, d):
    """A film for each supplier: 10 to 27 observations, 8, 16 or 24 hours apart."""
    rows = X.table(s, d, "supplier").select(F.col("s_suppkey").alias("film"), F.explode(F.sequence(F.lit(0).cast("long"), 10 + F.col("s_suppkey") % 18)).alias("i"))
    return rows.withColumn("h", F.col("i") * 8.0 * (1 + F.col("film") % 3))


SLOW = " ".join(f"WHEN t < h_end / {part} THEN {by}e0" for part, by in G.SLOW_START)
add(
    "frame_schedule",
    lambda s, d: G.frame_schedule(film_hours(s, d), 2.5).withColumns({c: F.round(c, 4) for c in ("t", "from_bef", "to_aft", "share")}),
    f"""WITH RECURSIVE films AS MATERIALIZED (SELECT s_suppkey AS film, 10 + s_suppkey % 18 AS n, (10 + s_suppkey % 18) * 8e0 * (1 + s_suppkey % 3) AS h_end, 8e0 * (1 + s_suppkey % 3) AS apart FROM supplier),
    times AS (SELECT film, -1 AS frame, 0e0 AS t, n, h_end, apart FROM films UNION ALL SELECT film, frame + 1, t + 2.5e0 / (CASE {SLOW} ELSE 1e0 END), n, h_end, apart FROM times WHERE t + 2.5e0 / (CASE {SLOW} ELSE 1e0 END) < h_end),
    shown AS (SELECT *, CAST(floor(t / apart) AS BIGINT) AS k FROM times WHERE frame >= 0)
    SELECT film, frame, round(t, 4) AS t, CASE WHEN k = 0 THEN 0 ELSE k - 1 END AS bef, k AS aft, round(CASE WHEN k = 0 THEN 0 ELSE t - k * apart END, 4) AS from_bef, round(CASE WHEN k = 0 THEN h_end / n ELSE (k + 1) * apart - t END, 4) AS to_aft,
      round(CASE WHEN k = 0 THEN 0 ELSE (t - k * apart) / apart END, 4) AS share FROM shown
    UNION ALL SELECT film, CAST(c + e AS INTEGER), round(h_end, 4), n - 1, n, round(h_end / n, 4), 0, 1 FROM (SELECT film, max(frame) + 1 AS c, any_value(n) AS n, any_value(h_end) AS h_end FROM times GROUP BY film), range({G.END_FRAMES}) z(e)""",
)
