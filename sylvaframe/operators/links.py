"""Operators of graphs of components: spanning trees, trunks, seeds and costs of alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.functions import scalars as C
from sylvaframe.operators.cut import cut
from sylvaframe.operators.graph import along_paths, component_labels


def minimum_spanning_tree(edges: DataFrame) -> DataFrame:
    """Edges (box, src, dst, cost) of each box's minimum spanning forest, ties by (src, dst): in each round every component takes its cheapest edge to another one, then they are joined.

    A round works on what the last one has left: components are its nodes, of which at most half remain, and edges inside one are gone.
    """
    left = cut(edges.select("box", "src", "dst", "cost", F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b"))
    taken = []
    while not left.isEmpty():
        both = left.select("box", F.col("a").alias("node"), "cost", "src", "dst", "a", "b").unionByName(left.select("box", F.col("b").alias("node"), "cost", "src", "dst", "a", "b"))
        best = cut(both.groupBy("box", "node").agg(F.min(F.struct("cost", "src", "dst", "a", "b")).alias("m")).select("box", "m.*").distinct())
        taken.append(best.select("box", "src", "dst", "cost"))
        labels = component_labels(best.select("box", F.col("a").alias("node")).unionByName(best.select("box", F.col("b").alias("node"))), best.select("box", "a", "b"))
        # Every node that still has an edge has taken one, so it has a label.
        side = lambda n: labels.select("box", F.col("node").alias(n), F.col("label").alias(f"l_{n}"))  # noqa: B023, E731
        left = cut(left.join(side("a"), ["box", "a"]).join(side("b"), ["box", "b"]).where("l_a <> l_b").select("box", "src", "dst", "cost", F.col("l_a").alias("a"), F.col("l_b").alias("b")))
    return reduce(lambda a, b: a.unionByName(b), taken) if taken else left.select("box", "src", "dst", "cost")


def trunk_identification(attributes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of trunks (box, cc_id), and the edges without those from elsewhere into a trunk. A trunk follows the cheapest outgoing edges from a component of date 1."""
    nexts = edges.groupBy("box", F.col("src").alias("cc_id")).agg(F.min_by("dst", F.struct("cost", "dst")).alias("next"))
    trunk = cut(attributes.where("day = 1").select("box", "cc_id"))
    front = trunk
    while not front.isEmpty():
        ahead = front.join(nexts, ["box", "cc_id"]).select("box", F.col("next").alias("cc_id")).distinct()
        front = cut(ahead.join(trunk, ["box", "cc_id"], "left_anti"))
        trunk = cut(trunk.unionByName(front))
    into = edges.join(trunk.withColumnRenamed("cc_id", "dst"), ["box", "dst"], "left_semi").join(trunk.withColumnRenamed("cc_id", "src"), ["box", "src"], "left_anti")
    return trunk, edges.join(into.select("box", "src", "dst"), ["box", "src", "dst"], "left_anti")


def seeded_reachability(attributes: DataFrame, edges: DataFrame, n: int, xmin: float, xmax: float) -> DataFrame:
    """Components (box, cc_id) that edges, in any direction, join to one of each box's n largest components of date 1 within a range of x (the least id of equals)."""
    ranked = attributes.where((F.col("day") == 1) & F.col("cx").between(xmin, xmax)).withColumn("n", F.row_number().over(Window.partitionBy("box").orderBy(F.desc("n_px"), "cc_id")))
    labels = cut(component_labels(attributes.select("box", F.col("cc_id").alias("node")), edges.select("box", F.col("src").alias("a"), F.col("dst").alias("b"))))
    wanted = labels.join(ranked.where(F.col("n") <= n).select("box", F.col("cc_id").alias("node")), ["box", "node"], "left_semi").select("box", "label").distinct()
    return labels.join(wanted, ["box", "label"], "left_semi").select("box", F.col("node").alias("cc_id"))


def min_directed_tree(attributes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each component with its cheapest predecessor (box, cc_id, parent) and stamp: the first component of its tree."""
    best = edges.groupBy("box", F.col("dst").alias("cc_id")).agg(F.min_by("src", F.struct("cost", "src")).alias("parent"))
    forest = attributes.select("box", "cc_id").join(best, ["box", "cc_id"], "left")
    return forest.join(along_paths(forest).select("box", "cc_id", F.col("root").alias("stamp")), ["box", "cc_id"])


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    return (ax * bx + ay * by) / F.nullif(F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by), F.lit(0.0))


def downwardness(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cosine of the way from a to b with downwards."""
    return cosine(bx - ax, by - ay, F.lit(0.0), F.lit(1.0))


def alignment_cost(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], c: tuple[Column, Column, Column]) -> Column:
    """How far a third place (x, y, hour) lies from where the first two lead, over the way that they lead; steps without a duration count as one hour."""
    ab, bc = (F.when(p[2] == q[2], 1.0).otherwise(F.abs(p[2] - q[2])) for p, q in ((a, b), (b, c)))
    vx, vy = (b[0] - a[0]) / ab, (b[1] - a[1]) / ab
    way = F.sqrt(vx * vx + vy * vy) * bc
    return C.distance(c[0], c[1], b[0] + vx * bc, b[1] + vy * bc) / F.nullif(way, F.lit(0.0))


def line_in_object(lines: DataFrame, pixels: DataFrame, step: float = 0.33) -> DataFrame:
    """Share of samples of each line (box, id, x0, y0, x1, y1), a step apart, whose rounded place is a pixel of the object."""
    n = F.greatest(F.lit(1), F.ceil(C.distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) / step)).cast("int")
    rows = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a, b, name: F.floor(F.round(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n"), 6) + 0.5).cast("int").alias(name)
    samples = rows.select("box", "id", "i", at("x0", "x1", "x"), at("y0", "y1", "y"))
    return samples.join(pixels.select("box", "x", "y", F.lit(1).alias("hit")), ["box", "x", "y"], "left").groupBy("box", "id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
