"""Values at a limit, ties of rounding and noise of sums, as tables of 1 GB have them."""

import datetime
import random

import duckdb

from sylvaframe.operators import anomalies as A
from sylvaframe.operators import pixels as P
from sylvaframe.plans import registry


def test_a_block_at_the_limit_is_not_over_it(spark):
    """Sixteen whole numbers whose variance is exactly 50; sums in floats end beside it, by their order."""
    rng, rows, n = random.Random(5), [], 0
    while n < 60:
        values = [rng.randrange(25) for _ in range(16)]
        if 16 * sum(v * v for v in values) - sum(values) ** 2 == 50 * 256:
            rows += [(f"b{n}", 0, i // 4, i % 4, float(v)) for i, v in enumerate(values)]
            n += 1
    rows += [("over", 0, i // 4, i % 4, 15.0 * (i % 2)) for i in range(16)]
    pixels = spark.createDataFrame(rows, "box string, t int, x int, y int, v double")
    assert [tuple(r) for r in P.block_candidates(pixels, 4, 3, 50.0).collect()] == [("over", 0, 0, 0, 56.25)]


def differing(spark, folder, name):
    """Rows of a query that its SQL has not, and the other way round, over a folder's tables."""
    duck = duckdb.connect()
    for path in folder.glob("*.parquet"):
        duck.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    answer = duck.sql(registry.oracle_sql()[name])
    got = {tuple(r[c] for c in answer.columns) for r in registry.queries()[name](spark, str(folder)).collect()}
    want = set(answer.fetchall())
    assert want
    return got - want, want - got


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_shipdate timestamp"


def test_a_score_between_two_numbers_follows_the_sql(spark, tmp_path):
    """A correlation of 0.078855 to nine places."""
    values = {12: {(8, 36): 40, (9, 37): 28, (10, 39): 40, (13, 36): 41}, 13: {(10, 36): 25, (11, 35): 42, (12, 39): 15, (13, 37): 46}}
    rows = [(1, x, y, float(values[t].get((x, y), 0)), "N", datetime.datetime(1995 + t // 4, t % 4 * 3 + 1, 15)) for t in values for x in range(8, 14) for y in range(35, 40)]
    spark.createDataFrame(rows, LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert differing(spark, tmp_path, "block_match") == (set(), set())


def test_half_a_hundredth_of_a_percent_goes_up(spark, tmp_path):
    """4,464 of 15,872 are 28.125 percent."""
    day = datetime.datetime(1996, 1, 1)
    spark.createDataFrame([(1, 1, 7, 4464.0, "R", day), (1, 1, 7, 11408.0, "N", day), (1, 1, 8, 3.0, "R", day)], LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(7, 10.0), (8, -1.0)], "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    assert differing(spark, tmp_path, "cell_class_summary") == (set(), set())
    found = {r["image"]: r["percent"] for r in registry.queries()["cell_class_summary"](spark, str(tmp_path)).collect()}
    assert found == {7: "28.13", 8: "NA"}


def test_noise_of_deviations_follows_the_sql(spark):
    """Two equal radii, then three that differ in the last bit alone: the limit is the noise of their deviation."""
    radii = [1.0, 1.0, 1.414213562373095, 1.414213562373095, 1.4142135623730951, 2.0, 3.0]
    frame = spark.createDataFrame([("a", i, i - 1 if i else None, 0, i, r) for i, r in enumerate(radii)], "box string, cc_id long, parent long, organ_id long, idx long, radius double")
    links = spark.createDataFrame([("a", i, i + 1, 1.0) for i in range(6)], "box string, src long, dst long, cost double")
    edges = spark.createDataFrame([("a", i, j) for j in range(1, 7) for i in (j - 1, j + 10)], "box string, src long, dst long")
    got = {r["a"]: r["value"] for r in A.radius_sudden_change(frame, links, edges).where("kind = 'node'").collect()}
    duck = duckdb.connect()
    duck.sql(f"CREATE TABLE r AS SELECT unnest(range(7)) AS i, unnest({radii}) AS v")
    want = duck.sql("""SELECT i, abs(m1 - m0) / ((s0 + s1) / 0.6745e0) FROM (SELECT i, avg(v) OVER p AS m0, stddev_samp(v) OVER p AS s0, avg(v) OVER n AS m1, stddev_samp(v) OVER n AS s1 FROM r
        WINDOW p AS (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), n AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE i BETWEEN 2 AND 5 AND abs(m1 - m0) > (s0 + s1) / 0.6745e0""").fetchall()
    assert {k: round(v, 4) for k, v in got.items()} == {k: round(v, 4) for k, v in want} and got[2] > 1e15


def test_places_between_two_numbers_follow_the_sql(spark, tmp_path):
    """A root at x = -3 after one day and at -6 after six is at -5.2125 after 112.5 hours."""
    rows = [(0, datetime.datetime(2024, 1, 1, 5), 0, "view", 1.0), (7, datetime.datetime(2024, 1, 6, 5), 0, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert differing(spark, tmp_path, "tip_trajectory") == (set(), set())
