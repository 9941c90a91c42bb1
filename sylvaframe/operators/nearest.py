"""Nearest things of points, through grids that grow until the answer is certain."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.operators.cut import cut


def _squared(px: str, py: str, tx: str, ty: str) -> Column:
    return (F.col(px) - F.col(tx)) * (F.col(px) - F.col(tx)) + (F.col(py) - F.col(ty)) * (F.col(py) - F.col(ty))


def nearest(points: DataFrame, things: DataFrame, by: list[str], point: list[str], order: list[str], k: int = 1, where: Column | None = None, digits: int = 6, growth: float = 4.0) -> DataFrame:
    """Each point's k nearest things that share its keys and meet a condition: by, point, order, d2 (squared distance, rounded) and n (from 1).

    points: by, point (their ids), px, py; things: by, order (their ids, which break ties), tx, ty; the condition may use columns of both.
    A point meets the things of its grid cell and the eight around it, so all that are nearer than a cell's width are among them;
    points with fewer than k of those go on to a grid of `growth` times the width, until a width spans all. A round moves the points
    that are still open, and things once. Points without coordinates get nothing.
    """
    points = points.where("px is not null and py is not null").transform(cut)
    things = things.where("tx is not null and ty is not null").transform(cut)
    low_high = lambda df, x, y: df.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count("*")).first()
    a, b = low_high(points, "px", "py"), low_high(things, "tx", "ty")
    groups = things.select(*by).distinct().count()
    spans = [max(a[2 * i + 1], b[2 * i + 1]) - min(a[2 * i], b[2 * i]) for i in (0, 1)] if a[4] and b[4] else [0, 0]
    extent = float(max(spans)) or 1.0
    # Cells of an even spread would hold a few times k things.
    width = min(extent, max(extent / 2**20, math.sqrt(max(float(spans[0]), extent / 1000) * max(float(spans[1]), extent / 1000) * 4 * k * max(1, groups) / max(1, b[4]))))
    best_first = Window.partitionBy(*by, *point).orderBy("d2", *order)
    schema = [*by, *point, *order, "d2", "n"]
    done, open_points = None, points
    while True:
        last = width >= extent
        cell = lambda v: F.floor(F.col(v) / F.lit(width))  # noqa: B023, E731
        steps = F.sequence(F.lit(-1), F.lit(1))
        near = open_points.withColumn("gx", F.explode(F.transform(steps, lambda i: cell("px") + i))).withColumn("gy", F.explode(F.transform(steps, lambda i: cell("py") + i)))
        pairs = near.join(things.withColumn("gx", cell("tx")).withColumn("gy", cell("ty")), [*by, "gx", "gy"])
        pairs = pairs.where(where) if where is not None else pairs
        pairs = pairs.withColumn("d2", F.round(_squared("px", "py", "tx", "ty").cast("double"), digits)).select(*by, *point, *order, "d2")
        ranked = pairs.withColumn("n", F.row_number().over(best_first)).where(F.col("n") <= k).select(*schema)
        if last:
            return ranked if done is None else done.unionByName(ranked)
        ranked = ranked.transform(cut)
        sure = ranked.where((F.col("n") == k) & (F.col("d2") <= width * width * (1 - 1e-9))).select(*by, *point)
        found = ranked.join(sure, [*by, *point], "left_semi")
        done = found if done is None else done.unionByName(found)
        open_points = open_points.join(sure, [*by, *point], "left_anti").transform(cut)
        if open_points.isEmpty():
            return done
        width *= growth
