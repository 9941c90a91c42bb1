"""What only larger tables show: near-ties, and operators that keep their rows few."""

import datetime
import math
import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from sylvaframe.operators import pixels as P
from sylvaframe.operators import raster as R
from sylvaframe.operators import regions
from sylvaframe.operators.groups import whole_groups
from sylvaframe.operators.regions import connected_components
from sylvaframe.plans import fixtures, registry
from sylvaframe.sources import rsml


def test_dates_of_near_ties_follow_the_sql(spark, tmp_path):
    """Products of 9.375 at frame 12 and 9.387 at frame 25: the later one's lead is less than 13 thousandths."""
    rows = [(1, 5, 34, float(q), "N", datetime.datetime(1995 + t // 4, t % 4 * 3 + 1, 15)) for t, q in ((12, 35), (17, 2), (25, 16))]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.queries()["appearance_date_map"](spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = duck.sql(registry.oracle_sql()["appearance_date_map"]).fetchall()
    assert [tuple(r) for r in got] == want and want[0][-1] == 13
    plain = R.appearance_date_map(fixtures.raster(spark, str(tmp_path)), 3, 5).collect()
    assert plain[0]["day"] == 26


def test_small_groups_share_a_call_and_large_ones_stay_whole(spark):
    rows = spark.range(60_000).select(F.struct((F.col("id") % 9000).alias("a"), F.when(F.col("id") % 9000 > 4, F.lit("b")).alias("b")).alias("key"), F.col("id").alias("v"))
    rows = rows.unionByName(spark.range(30_000).select(F.struct(F.lit(-1).cast("long").alias("a"), F.lit("b").alias("b")).alias("key"), F.col("id").alias("v")))

    def run(table, group):
        n = table.num_rows
        counts = [0] * (int(group[-1]) + 1)
        for g in group:
            counts[g] += 1
        return pa.table({"key": table.column("key"), "v": table.column("v"), "size": pa.array([counts[g] for g in group], pa.int64()), "call": pa.array([n] * n, pa.int64())})

    got = whole_groups(rows.repartition(7), ["key"], run, f"key {rows.schema['key'].dataType.simpleString()}, v long, size long, call long", least=5000).cache()
    sizes = rows.groupBy("key").count()
    assert got.count() == 90_000 and got.join(sizes, "key").where("size <> count").isEmpty()
    assert got.agg(F.sum(1 / F.col("call"))).first()[0] < 30


def test_filters_over_tiles_equal_plain_ones(spark):
    """Sparse frames over negative places, some without a value, in tiles smaller than the filters' reach."""
    r = random.Random(3)
    image = {(t, x, y): None if r.random() < 0.1 else r.randrange(90) for t in (0, 1) for x in range(-9, 12) for y in range(-4, 9) if r.random() < 0.6}
    pixels = spark.createDataFrame([("b", *p, v) for p, v in image.items()], "box string, t int, x int, y int, v int")
    element = [(0, -3), (2, 1), (1, 0), (-1, 0)]
    for dilate, pick in ((True, max), (False, min)):
        found = R.dilate_erode(pixels, element, dilate, tile=2)
        assert found.schema == pixels.schema
        want = {}
        for t, x, y in image:
            near = [image[q] for dx, dy in element if (q := (t, x + dx, y + dy)) in image]
            if near:
                want[t, x, y] = pick((v for v in near if v is not None), default=None)
        assert {(w["t"], w["x"], w["y"]): w["v"] for w in found.collect()} == want
    for sigma in (0.8, 1.4):
        n = int(3 * sigma)
        got = {(w["t"], w["x"], w["y"]): w["v"] for w in R.gaussian_smooth(pixels, sigma, tile=5).collect()}
        assert got.keys() == image.keys()
        for t, x, y in image:
            near = [(math.exp(-(i * i + j * j) / (2 * sigma * sigma)), image[t, x + i, y + j]) for i in range(-n, n + 1) for j in range(-n, n + 1) if (t, x + i, y + j) in image]
            known = [k * v for k, v in near if v is not None]
            want = sum(known) / sum(k for k, _ in near) if known else None
            assert got[t, x, y] is want is None or abs(got[t, x, y] - want) < 1e-9


def test_template_does_not_multiply_pixels(spark):
    """Gaps in a column leave no window; a window over a pixel without a value counts it as nothing."""
    rows = [("b", 0, 0, y, v) for y, v in ((0, 1.0), (1, 3.0), (2, 2.0), (4, 5.0), (5, 5.0), (6, None), (7, 1.0))]
    found = R.template_correlation(spark.createDataFrame(rows, "box string, t int, x int, y int, v double"), [1, 2, 1])
    got = {r["y"]: round(r["r"], 4) for r in found.collect()}
    assert got == {0: 0.866, 4: 0.5, 5: -0.6547}
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_wide_pixels_tell_the_same_as_their_rows(spark):
    """Scores, dates, blocks and moved frames of wide pixels against the operators on rows, without a sort or a row for each frame before the result."""
    r = random.Random(5)
    frames = [f"v{k}" for k in range(12)]
    rows = [("b", x, y, *(float(r.choice((0, 0, 3, r.randrange(40)))) for _ in frames)) for x in range(9) for y in range(7) if r.random() < 0.8]
    wide = spark.createDataFrame(rows, "box string, x int, y int, " + ", ".join(f"{c} double" for c in frames)).repartition(3, "x")
    pixels = R.rows_of(wide)
    plans = []
    for found, plain in (
        (R.scores_of(wide, "rupture", 1.5), R.rupture_score(pixels, 1.5)),
        (R.scores_of(wide, "slope", 1.5), R.local_slope(pixels, 1.5)),
        (R.dates_of(wide, 3, 5), R.appearance_date_map(pixels, 3, 5)),
        (R.dates_of(wide, 3, 5, early=1000), R.appearance_date_map(pixels, 3, 5, early=1000)),
        (R.subsample_wide(wide, 4), R.subsample_grid(pixels, 4)),
        (P.displace_wide(wide, 1.25, -0.5), P.apply_displacement(pixels, 1.25, -0.5)),
    ):
        got, want = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in df.select(plain.columns).collect()) for df in (found, plain))
        assert got == want and got
        plans.append(found._jdf.queryExecution().toString())
    assert not any("Window" in plan for plan in plans)


def test_components_over_tiles_equal_a_flood_fill(spark):
    """Regions that wind through many tiles, at negative places too; inside a tile no round is needed."""
    r = random.Random(8)
    day = {(x, y): r.choice((0, 1, 1, 1, 2)) for x in range(-7, 14) for y in range(-5, 12) if r.random() < 0.9}
    want, seen, number = {}, set(), 0
    for y, x in sorted((y, x) for (x, y), d in day.items() if d):
        if (x, y) in seen:
            continue
        number, todo = number + 1, [(x, y)]
        seen.add((x, y))
        while todo:
            i, j = todo.pop()
            want[i, j] = number
            for q in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if q not in seen and day.get(q) == day[i, j]:
                    seen.add(q)
                    todo.append(q)
    dates = spark.createDataFrame([("b", x, y, d) for (x, y), d in day.items()], "box string, x int, y int, day int")
    for tile in (1, 3, 128):
        got = {(w["x"], w["y"]): w["cc_id"] for w in connected_components(dates, tile=tile).collect()}
        assert got == want


def test_tags_do_not_look_into_their_files_text(spark, tmp_path):
    """A file's program is read once: above the tags' rows the plan has no more use for the text."""
    points = "".join(f'<point x="{i}" y="1"/>' for i in range(7))
    text = f'<rsml><metadata><software>Root System Analyzer</software></metadata><scene><plant ID="1"><root ID="1.1" label="a"><geometry><polyline>{points}</polyline></geometry></root></plant></scene></rsml>'
    (tmp_path / "m.rsml").write_text(text)
    texts = rsml.read_texts(spark, str(tmp_path))
    rows = rsml.read_standard(texts)
    assert sorted((r["seq"], r["x"]) for r in rows.collect()) == [(1, 0.0), (6, 5.0)]
    plan = rsml._tags(texts)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.partition("Generate")[0]
    assert "regexp_extract(tag" in above and "<software>" not in above


def test_sides_are_looked_up_in_tiles(spark):
    """Equal sides over tiles of any size, and the samples around a side are no rows: nothing but the pixels of rims is repeated."""
    rng = random.Random(8)
    rows = [(box, x, y, 1 + (x // 3 + y // 2) % 3, (x // 3) * 20 + y // 2) for box in "ab" for x in range(-4, 15) for y in range(14) if rng.random() < 0.95]
    labelled = spark.createDataFrame(rows, "box string, x int, y int, day int, cc_id long")
    comps = labelled.groupBy("box", "cc_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    found = [sorted(map(tuple, regions.best_facet(labelled, comps, 3.0, tile).collect())) for tile in (128, 5, 1)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 50
    assert regions.best_facet(labelled, comps, 3.0)._jdf.queryExecution().optimizedPlan().toString().count("Generate") <= 2
