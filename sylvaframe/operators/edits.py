"""Edits of a model's nodes at clicked points. Points are (pid, model, x, y, z); a clicked node is the nearest one born by z."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.operators.polylines import retime_nodes
from sylvaframe.operators.traits import ROOT, drop_interpolated_nodes, insert_missing_dates, nearest_node, rebase_time

NODE = [*ROOT, "seq"]


def edit_inform(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """The clicked nodes with their place and dates."""
    return nearest_node(points, nodes).join(nodes.select(*NODE, "x", "y", "t", "th"), NODE)


def _last_click(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """The clicked nodes; of several clicks at a node the last counts."""
    clicked = nearest_node(points, nodes).select(*NODE, "pid")
    return clicked.groupBy(*NODE).agg(F.max("pid").alias("pid"))


def edit_move_point(nodes: DataFrame, roots: DataFrame, moves: DataFrame) -> DataFrame:
    """Nodes with each clicked one at its new place (moves: points with to_x and to_y), retimed."""
    to = _last_click(moves, nodes).join(moves.select("pid", "to_x", "to_y"), "pid").select(*NODE, "to_x", "to_y")
    rows = nodes.join(to, NODE, "left")
    changed = {"x": F.coalesce("to_x", F.col("x").cast("double")), "y": F.coalesce("to_y", F.col("y").cast("double"))}
    return retime_nodes(rows.select(*(changed[c].alias(c) if c in changed else c for c in nodes.columns)), roots)


def edit_change_time(nodes: DataFrame, roots: DataFrame, changes: DataFrame, step_hours: float) -> DataFrame:
    """model, root, seq, x, y and t of nodes with the dates of clicked ones set (changes: points with to_t), one more at each date that is passed without a node, retimed."""
    to = _last_click(changes, nodes).join(changes.select("pid", "to_t"), "pid").select(*NODE, "to_t")
    rows = nodes.join(to, NODE, "left").withColumn("t", F.coalesce("to_t", "t")).withColumn("th", F.when(F.col("to_t").isNotNull(), F.col("to_t") * step_hours).otherwise(F.col("th")))
    full = insert_missing_dates(rows.select(*nodes.columns)).withColumn("th", F.col("t") * step_hours).withColumn("diameter", F.lit(1))
    return retime_nodes(full.select(*NODE, "x", "y", "diameter", "th", "t"), roots).select(*NODE, "x", "y", "t")


def resample_model(nodes: DataFrame, step_hours: float) -> DataFrame:
    """Nodes on whole dates of a time step only: dates by the step, one more node at each date that is passed, the others dropped."""
    return drop_interpolated_nodes(insert_missing_dates(rebase_time(nodes, step_hours))).drop("inserted")


def frame_sources(frames: DataFrame, hours: DataFrame) -> DataFrame:
    """For each frame (frame, h) the observation (i, hours) before the first one that is later; the last if none is."""
    later = frames.join(F.broadcast(hours), F.col("hours") > F.col("h")).groupBy("frame").agg((F.min("i") - 1).alias("source"))
    last = hours.agg(F.max("i").alias("last"))
    return frames.join(later, "frame", "left").crossJoin(F.broadcast(last)).select("frame", F.coalesce("source", "last").alias("source"))


def ordered(log: DataFrame) -> DataFrame:
    """The rounds of a log: the k-th edit of each model (model, seq) is in round k."""
    return log.withColumn("round", F.dense_rank().over(Window.partitionBy("model").orderBy("seq")))
