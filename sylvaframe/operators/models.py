"""Models of roots: selections, series by plant, runs along organs, matches and edit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.operators.nearest import nearest
from sylvaframe.operators.timebase import linear_interpolation
from sylvaframe.operators.traits import ROOT, along, last_dates, segments


def first_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(*ROOT).agg(F.min_by("x", "seq").alias("fx"), F.min_by("y", "seq").alias("fy"))


def _starts(nodes: DataFrame) -> DataFrame:
    return first_nodes(nodes).select(*ROOT, F.col("fx").alias("px"), F.col("fy").alias("py"))


def nearest_root(nodes: DataFrame) -> DataFrame:
    """For each root the other root of its model with the node nearest to its first node, the least id of equals."""
    things = nodes.select("model", F.col("root").alias("nearest"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return nearest(_starts(nodes), things, ["model"], ["root"], ["nearest"], where=F.col("root") != F.col("nearest")).drop("n")


def reattach_laterals(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots with laterals' parents set to the primary that has the node nearest to their first node."""
    primaries = roots.where("parent is null").select(*ROOT)
    things = nodes.join(primaries, ROOT).select("model", F.col("root").alias("parent"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    laterals = _starts(nodes).join(roots.where("parent is not null").select(*ROOT), ROOT)
    best = nearest(laterals, things, ["model"], ["root"], ["parent"])
    return roots.select(*ROOT).join(best.select(*ROOT, "parent"), ROOT, "left")


def append_node(nodes: DataFrame, new: DataFrame, before: bool = False) -> DataFrame:
    """Nodes with one more after the last, or before the first, of some roots (model, root, x, y, t).

    A node before the first takes its number, and the root's others are counted on by one. Roots that have no nodes get none.
    """
    place = F.min("seq") if before else F.max("seq") + 1
    added = new.join(nodes.groupBy(*ROOT).agg(place.alias("seq")), ROOT).select(*ROOT, "seq", "x", "y", "t")
    old = nodes.select(*ROOT, "seq", "x", "y", "t")
    if before:
        moved = added.select(*ROOT, F.lit(1).alias("by")).distinct()
        old = old.join(moved, ROOT, "left").select(*ROOT, (F.col("seq") + F.coalesce("by", F.lit(0))).alias("seq"), "x", "y", "t")
    return old.unionByName(added)


def apply_point_transform(nodes: DataFrame, field: DataFrame, at: Column) -> DataFrame:
    """Nodes under a condition moved against a displacement field (x, y, dx, dy) of their rounded places."""
    moved = nodes.join(field, ["x", "y"], "left")
    step = lambda c: F.when(at, F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    return moved.select(*ROOT, "seq", (F.col("x") - step("dx")).alias("x"), (F.col("y") - step("dy")).alias("y"))


def model_ordering(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Primaries numbered by the x of their first node, laterals of a parent by its y."""
    rows = first_nodes(nodes).join(roots, ROOT)
    by_x = F.row_number().over(Window.partitionBy("model", "parent").orderBy("fx", "root"))
    by_y = F.row_number().over(Window.partitionBy("model", "parent").orderBy("fy", "root"))
    return rows.select(*ROOT, "parent", F.when(F.col("parent").isNull(), by_x).otherwise(by_y).alias("place"))


def laterals_per_plant(roots: DataFrame) -> DataFrame:
    """Number of roots on each primary."""
    primaries = roots.where("parent is null").select("model", F.col("root").alias("plant"))
    children = roots.select("model", F.col("parent").alias("plant")).groupBy("model", "plant").agg(F.count("*").alias("n"))
    return primaries.join(children, ["model", "plant"], "left").fillna({"n": 0})


def visible_lengths(nodes: DataFrame) -> DataFrame:
    """Per root and date, up to its model's last: length that is visible then, and whether the root is there.

    A segment enters once, at the date from which it is whole, and with a part at each date that falls inside it; a running sum over the dates
    does the rest. So there are as many rows as segments and dates of roots, not their product.
    """
    ends, begins = F.ceil("t1").cast("int"), F.ceil("t").cast("int")
    legs = segments(nodes).where("t1 is not null")
    whole = legs.select(*ROOT, F.greatest(F.lit(1), ends).alias("day"), F.col("len").alias("whole"), F.lit(0.0).alias("part"))
    first = F.greatest(F.lit(1), begins)
    inner = legs.withColumn("day", F.explode(F.when(first <= ends - 1, F.sequence(first, ends - 1))))
    part = inner.select(*ROOT, "day", F.lit(0.0).alias("whole"), (F.col("len") * (F.col("day") - F.col("t")) / (F.col("t1") - F.col("t"))).alias("part"))
    sums = whole.unionByName(part).groupBy(*ROOT, "day").agg(F.sum("whole").alias("whole"), F.sum("part").alias("part"))
    born = nodes.groupBy(*ROOT).agg(F.min("t").alias("born")).join(last_dates(nodes), "model")
    grid = born.withColumn("day", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "last_date")))).where("day <= last_date").join(sums, [*ROOT, "day"], "left")
    past = Window.partitionBy(*ROOT).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    length = F.coalesce(F.sum("whole").over(past), F.lit(0.0)) + F.coalesce("part", F.lit(0.0))
    return grid.select(*ROOT, "day", length.alias("length"), (F.col("born") <= F.col("day")).alias("there"))


def plant_time_series(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Per primary and date, up to the model's last: its length, how many of its laterals have appeared, and their length."""
    by_root = visible_lengths(nodes)
    top = by_root.join(roots.where("parent is null").select(*ROOT), ROOT).select("model", F.col("root").alias("plant"), "day", F.col("length").alias("primary_length"))
    side = by_root.join(roots.where("parent is not null"), ROOT).groupBy("model", F.col("parent").alias("plant"), "day").agg(F.count_if("there").alias("n_laterals"), F.sum("length").alias("lateral_length"))
    return top.join(side, ["model", "plant", "day"], "left").fillna({"n_laterals": 0, "lateral_length": 0.0})


def organ_segments(nodes: DataFrame, hidden: Column) -> DataFrame:
    """Runs of nodes of a root that no hidden link parts: number, first and last node."""
    islands = nodes.withColumn("part", F.sum(hidden.cast("int")).over(along()))
    return islands.groupBy(*ROOT, "part").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"))


def hidden_runs(nodes: DataFrame, hidden: Column) -> DataFrame:
    """Runs of consecutive hidden nodes."""
    marked = nodes.where(hidden).withColumn("grp", F.col("seq") - F.row_number().over(along()))
    return marked.groupBy(*ROOT, "grp").agg(F.min("seq").alias("first"), F.count("*").alias("n")).drop("grp")


def time_knots(nodes: DataFrame) -> DataFrame:
    """The farthest arc length of each root on each date."""
    return segments(nodes).groupBy(*ROOT, F.floor("t").alias("day")).agg(F.max("c").alias("distance"))


def distance_to_time(distances: DataFrame, knots: DataFrame) -> DataFrame:
    """Distances (model, root, v) with y: their date, between the knots (model, root, day, distance) of their root."""
    return linear_interpolation(distances, knots.select(*ROOT, F.col("distance").alias("x"), F.col("day").alias("y")), ROOT)


def edit_log(lines: DataFrame) -> DataFrame:
    """Points of edits from log lines (model, line, fields): model, seq, action, point (from 0), x, y and z.

    A line has its action, the number n of its points, and n times a label, x, y and z. A model's log ends at its first empty action.
    """
    order = Window.partitionBy("model").orderBy("line")
    action = F.get("fields", F.lit(0))
    ended = F.sum(F.when(F.coalesce(F.trim(action), F.lit("")) == "", 1).otherwise(0)).over(order)
    rows = lines.select("model", "line", "fields", action.alias("action"), F.row_number().over(order).cast("long").alias("seq"), ended.alias("ended")).where("ended = 0")
    n = F.coalesce(F.get("fields", F.lit(1)).try_cast("int"), F.lit(0))
    points = rows.withColumn("point", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    at = lambda k, name: F.get("fields", 4 * F.col("point") + 2 + k).try_cast("double").alias(name)
    return points.select("model", "seq", "action", "point", at(1, "x"), at(2, "y"), at(3, "z"))


def edit_undo(log: DataFrame) -> DataFrame:
    """All edits of each model but the last."""
    return log.withColumn("last", F.max("seq").over(Window.partitionBy("model"))).where("seq < last").drop("last")


def trimmed_matches(matches: DataFrame, by: list[str], score: str, least: float, share: float) -> DataFrame:
    """Matches over a score, and of those the best share of their group."""
    rank = F.percent_rank().over(Window.partitionBy(*by).orderBy(F.desc(score), "id"))
    return matches.where(F.col(score) > least).withColumn("rank", rank).where(F.col("rank") <= share).drop("rank")


def chain_displacements(steps: DataFrame, by: str) -> DataFrame:
    """Displacements (t, dx, dy) of neighbours summed up to the last image."""
    later = Window.partitionBy(by).orderBy(F.desc("t"))
    return steps.withColumn("total_dx", F.sum("dx").over(later)).withColumn("total_dy", F.sum("dy").over(later))
