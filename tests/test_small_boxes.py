"""Small boxes go through their rounds inside tasks, larger ones over tables, with equal rows; repairs copy no more than the trees that they touch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import anomalies as A
from sylvaframe.operators import graph, repairs
from sylvaframe.plans import anomaly_queries as N
from sylvaframe.plans import region_queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def forest(spark):
    """Boxes of trees of some depth, some of whose parents are missing."""
    rng, rows = random.Random(3), []
    for box in "abc":
        for i in range(40):
            parent = None if i < 3 or rng.random() < 0.1 else 1000 + i if rng.random() < 0.05 else rng.randrange(max(0, i - 5), i) * 3
            rows.append((box, i * 3, parent, rng.randrange(1, 50), rng.randrange(2)))
    return spark.createDataFrame(rows, "box string, cc_id long, parent long, n_px int, light int").cache()


def rows_of(df):
    return df.schema.simpleString(), sorted(map(str, df.collect()))


def test_pointers_inside_a_task_and_over_tables(spark, forest, monkeypatch):
    rng = random.Random(4)
    pairs = spark.createDataFrame([(rng.choice("abc"), rng.randrange(42) * 3, rng.randrange(42) * 3) for _ in range(300)], "box string, anc long, node long")
    cuts, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(0) or cut(df))
    runs = {
        "along_paths": lambda most: graph.along_paths(forest, F.col("light"), most=most),
        "below": lambda most: graph.below(forest, ["n_px"], ["light"], most=most),
        "within": lambda most: graph.within(forest, pairs, most=most),
    }
    for name, run in runs.items():
        found, n = [], []
        for most in (1000, 0):
            before = len(cuts)
            found.append(rows_of(run(most)))
            n.append(len(cuts) - before)
        assert found[0] == found[1] and found[0][1], name
        assert n[0] == 1 < 3 < n[1], name


def test_a_circle_ends(spark):
    forest = spark.createDataFrame([("a", 1, 2), ("a", 2, 1)], "box string, cc_id long, parent long")
    with pytest.raises(Exception, match="circle"):
        graph.along_paths(forest).collect()


def test_a_gain_copies_two_trees(spark, monkeypatch):
    forest, edges, times, proposals = Q.forest(spark, SF), Q.costed(spark, SF), N.times(spark, SF), N.proposals(spark, SF)
    trees = {(r["box"], r["cc_id"]): r["root"] for r in graph.along_paths(forest).collect()}
    size = {}
    for (box, _), root in trees.items():
        size[box, root] = size.get((box, root), 0) + 1
    asked = {tuple(r) for r in proposals.select("box", "src", "dst", "other").collect()}
    want = sum(size[t] for box, _, dst, other in asked for t in {(box, trees[box, dst]), (box, trees[box, other])})
    copied, organs = [], A.organs
    flagged = A.flag_forest(forest, times, A._links(forest, edges), edges, N.TYPICAL)
    monkeypatch.setattr(A, "organs", lambda df: copied.append(df.count()) or organs(df))
    A.what_if_gain(forest, times, edges, proposals, N.TYPICAL, flagged).collect()
    assert len(copied) == 1 and 0 < copied[0] <= want


def test_flags_of_counted_ends(spark):
    rng = random.Random(5)
    rows = [(str(c), float(rng.choice([0, 8, 8, 8, 16, 16, 24, 200]))) for c in range(30) for _ in range(c)]
    ends = spark.createDataFrame(rows, "case string, end double")
    got = {r["case"]: r["n"] for r in A._late(ends.groupBy("case", "end").agg(F.count("*").alias("n"))).collect()}
    frame = ends.select(F.col("case").alias("box"), F.monotonically_increasing_id().alias("cc_id"), F.col("end").alias("h_tip"), F.lit(0).alias("idx")).withColumn("organ_id", F.col("cc_id")).cache()
    want = {r["box"]: r["count"] for r in A.final_time_outlier(frame).groupBy("box").count().collect()}
    assert got == want and got


def test_statistics_inside_a_task_join_nothing(spark, forest):
    """Equal rows to those of joined tables, and no join that could send a table to the driver."""
    whole = forest.withColumn("x", F.col("cc_id") % 7)
    inside, joined = graph.forest_statistics(whole), graph.forest_statistics(whole, most=0)
    assert rows_of(inside) == rows_of(joined) and inside.count() > 5
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan


def test_repairs_inside_a_task_and_over_tables(spark, monkeypatch):
    """Equal repairs and forests, the boxes of tables in many more writes."""
    forest, edges, times = Q.forest(spark, SF).cache(), Q.costed(spark, SF).cache(), N.times(spark, SF).cache()
    cuts, cut = [], A.cut
    monkeypatch.setattr(A, "cut", lambda df: cuts.append(0) or cut(df))
    found, n = [], []
    for most in (1 << 15, 0):
        before = len(cuts)
        after, done = A.greedy_repair(forest, times, edges, N.TYPICAL, most_rounds=2, most=most)
        found.append((rows_of(after.select(*forest.columns)), rows_of(done)))
        n.append(len(cuts) - before)
    assert found[0] == found[1] and found[0][1][1]
    assert n[0] == 2 and n[1] > 20


def test_flags_of_arrays_are_those_of_tables(spark):
    forest, edges, times = Q.forest(spark, SF), Q.costed(spark, SF), N.times(spark, SF)
    want = {r["box"]: r["level"] for r in A.anomaly_counts(A.flag_forest(forest, times, A._links(forest, edges), edges, N.TYPICAL)[1]).collect()}
    got, box_forest = {}, repairs.BoxForest
    nodes = forest.join(times, ["box", "cc_id"]).toPandas().sort_values("cc_id")
    for box, own in nodes.groupby("box"):
        ids, mine = own["cc_id"].to_numpy(), edges.where(F.col("box") == box).toPandas()
        place = lambda v: np.searchsorted(ids, v)  # noqa: B023, E731
        node = {c: own[c].to_numpy(dtype=float) for c in ("n_px", "cx", "cy", "fx", "fy", "h_start", "h_tip")} | {"cc_id": ids}
        up = np.where(own["parent"].isna(), -1, place(own["parent"].fillna(-1)))
        edge = {c: mine[c].to_numpy(dtype=float) for c in ("cost", "fx", "fy")} | {c: place(mine[c]) for c in ("src", "dst")}
        with np.errstate(all="ignore"):
            got[box] = box_forest(node, edge, N.TYPICAL).flags(up, node["fx"], node["fy"])
    assert {b: n for b, n in got.items() if n} == want and want
