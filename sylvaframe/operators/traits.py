"""Polylines of roots: geometry, time and traits. A node row is (model, root, seq, x, y, diameter, th, t)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.functions import scalars as C
from sylvaframe.operators.nearest import nearest

ROOT = ["model", "root"]


def along():
    return Window.partitionBy(*ROOT).orderBy("seq")


def segments(nodes: DataFrame) -> DataFrame:
    """Nodes with the next one's place, time and diameter, the length to it, and c: the arc length before the node."""
    following = {f"{new}": F.lead(old).over(along()) for new, old in (("x1", "x"), ("y1", "y"), ("t1", "t"), ("th1", "th"), ("d1", "diameter"))}
    rows = nodes.withColumns(following).withColumn("len", C.distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1")))
    past = along().rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("c", F.coalesce(F.sum("len").over(past), F.lit(0.0)))


def node_geometry(nodes: DataFrame) -> DataFrame:
    """Length and direction to the next node, and a diameter of at least 1."""
    theta = C.direction_angle((F.col("x1") - F.col("x")).cast("double"), (F.col("y1") - F.col("y")).cast("double"))
    return segments(nodes).select(*ROOT, "seq", "len", theta.alias("theta"), F.greatest("diameter", F.lit(1)).alias("diameter"))


def clamp_times(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("th", F.greatest("th", F.lit(0.0))).withColumn("t", F.when(F.col("t") < 1, 0.0).otherwise(F.col("t")))


def is_exact(t: Column, eps: float = 1e-6) -> Column:
    """Whether a date is a whole observation."""
    return F.abs(t - F.rint(t)) < eps


def drop_interpolated_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes on observations only, numbered anew; roots without any are gone."""
    kept = nodes.where(is_exact(F.col("t")))
    return kept.withColumn("seq", F.row_number().over(along()))


def rebase_time(nodes: DataFrame, step_hours: float) -> DataFrame:
    return nodes.withColumn("t", F.col("th") / step_hours)


def hours_axis(models: DataFrame, step_hours: float, n: int) -> DataFrame:
    """The axis that goes with rebased times: model, date (0 to n - 1) and hours of each model."""
    dates = models.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("date")) if n > 0 else models.select("model", F.lit(0).alias("date")).limit(0)
    return dates.withColumn("hours", F.col("date") * F.lit(float(step_hours)))


def insert_missing_dates(nodes: DataFrame) -> DataFrame:
    """Nodes with one more at each whole date that a segment passes without a node, placed by time."""
    crossed = F.sequence(F.floor("t") + 1, F.ceil("t1") - 1)
    gaps = segments(nodes).where("ceil(t1) - 1 >= floor(t) + 1").withColumn("day", F.explode(crossed))
    share = (F.col("day") - F.col("t")) / (F.col("t1") - F.col("t"))
    between = lambda a, b: (F.col(a) + share * (F.col(b) - F.col(a))).alias(a)
    new = gaps.select(*ROOT, (F.col("seq") + share / 2).alias("place"), between("x", "x1"), between("y", "y1"), F.col("day").cast("double").alias("t"), F.lit(True).alias("inserted"))
    old = nodes.select(*ROOT, F.col("seq").cast("double").alias("place"), F.col("x").cast("double"), F.col("y").cast("double"), "t", F.lit(False).alias("inserted"))
    return old.unionByName(new).withColumn("seq", F.row_number().over(Window.partitionBy(*ROOT).orderBy("place"))).drop("place")


def densify_polyline(nodes: DataFrame, longest: float) -> DataFrame:
    """Each segment in 2**k equal pieces, so that none is longer than `longest`."""
    k = F.greatest(F.lit(0), F.ceil(F.log2(F.col("len") / longest)))
    pieces = F.coalesce(F.when(F.col("len") > longest, F.pow(F.lit(2.0), k)).otherwise(1.0), F.lit(1.0)).cast("int")
    rows = segments(nodes).withColumn("n", pieces).withColumn("i", F.explode(F.sequence(F.lit(0), pieces - 1)))
    at = lambda a, b: F.when(F.col("i") == 0, F.col(a)).otherwise(F.col(a) + F.col("i") / F.col("n") * (F.col(b) - F.col(a))).alias(a)
    return rows.select(*ROOT, "seq", "i", at("x", "x1"), at("y", "y1"))


def root_length(nodes: DataFrame, at: float | None = None) -> DataFrame:
    """Length of each root, whole or as far as it is visible at a time, with a part of the last segment."""
    part = F.col("len")
    if at is not None:
        share = (at - F.col("t")) / (F.col("t1") - F.col("t"))
        part = F.when(F.col("t1") <= at, F.col("len")).when(F.col("t") <= at, F.col("len") * share).otherwise(0.0)
    return segments(nodes).groupBy(*ROOT).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("length"))


def root_surface_volume(nodes: DataFrame) -> DataFrame:
    """Lateral surface and volume of the cone frustums between nodes."""
    a, b, h = F.col("diameter") / 2, F.col("d1") / 2, F.col("len")
    surface = F.pi() * (a + b) * F.sqrt((a - b) * (a - b) + h * h)
    volume = F.pi() * h * (a * a + a * b + b * b) / 3
    return segments(nodes).where("len is not null").groupBy(*ROOT).agg(F.sum(surface).alias("surface"), F.sum(volume).alias("volume"))


def root_diameter(nodes: DataFrame, low: float, high: float) -> DataFrame:
    """Mean diameter, and the median one of nodes within a range of arc length."""
    inside = F.when(F.col("c").between(low, high), F.col("diameter"))
    return segments(nodes).groupBy(*ROOT).agg(F.avg("diameter").alias("mean"), F.median(inside).alias("median"))


def root_shape(nodes: DataFrame) -> DataFrame:
    """Mean absolute change of direction, mean direction and the distance from end to end."""
    turns = node_geometry(nodes).withColumn("turn", F.abs(F.col("theta") - F.lag("theta").over(along())))
    ends = nodes.groupBy(*ROOT).agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    span = ends.select(*ROOT, C.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")).alias("span"))
    return turns.groupBy(*ROOT).agg(F.avg("turn").alias("tortuosity"), F.avg("theta").alias("orientation")).join(span, ROOT)


def root_bbox(nodes: DataFrame) -> DataFrame:
    """Extent and last date over all nodes but the last."""
    inner = segments(nodes).where("x1 is not null")
    return inner.groupBy(*ROOT).agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.max("t").alias("last_date"))


def model_extent(nodes: DataFrame) -> DataFrame:
    """Least place, width, height and centre of each model, over all nodes but the last of each root; width_sum and height_sum add both ends (the size of an image with equal margins)."""
    low = lambda c: F.min(f"{c}min")
    high = lambda c: F.max(f"{c}max")
    spans = [(high(c) - low(c)).alias(name) for c, name in (("x", "width"), ("y", "height"))]
    sums = [(high(c) + low(c)).alias(f"{name}_sum") for c, name in (("x", "width"), ("y", "height"))]
    centre = [(low(c) + (high(c) - low(c)) / 2).alias(f"c{c}") for c in ("x", "y")]
    return root_bbox(nodes).groupBy("model").agg(low("x").alias("xmin"), low("y").alias("ymin"), *spans, *sums, *centre)


def insertion_node(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """For each lateral the node of its parent that is nearest to its first node, the first of equals, by grids."""
    first = nodes.groupBy(*ROOT).agg(F.min_by("x", "seq").alias("px"), F.min_by("y", "seq").alias("py")).join(roots.where("parent is not null"), ROOT)
    other = nodes.select("model", F.col("root").alias("parent"), F.col("seq").alias("at_seq"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return nearest(first, other, ["model", "parent"], ["root"], ["at_seq"]).select(*ROOT, "parent", "at_seq", "d2")


def root_counts(nodes: DataFrame, roots: DataFrame, at: float) -> DataFrame:
    """Primaries and laterals of each model, in all and appeared by a time."""
    born = nodes.groupBy(*ROOT).agg(F.min("t").alias("born")).join(roots, ROOT)
    top, seen = F.col("parent").isNull(), F.col("born") <= at
    return born.groupBy("model").agg(F.count_if(top).alias("primaries"), F.count_if(~top).alias("laterals"), F.count_if(top & seen).alias("primaries_at"), F.count_if(~top & seen).alias("laterals_at"))


def length_summary(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Mean lengths of primaries, laterals and all; totals, those of primaries and laterals with each root cut to whole units."""
    sized = root_length(nodes).join(roots, ROOT)
    top, n = F.col("parent").isNull(), F.col("length")
    whole = F.floor(n)
    return sized.groupBy("model").agg(
        F.avg(F.when(top, n)).alias("mean_primary"), F.avg(F.when(~top, n)).alias("mean_lateral"), F.avg(n).alias("mean_all"), F.sum(n).alias("total"),
        F.sum(F.when(top, whole).otherwise(0)).alias("total_primary"), F.sum(F.when(~top, whole).otherwise(0)).alias("total_lateral"),
    )


def nearest_node(points: DataFrame, nodes: DataFrame, where: Column | None = None) -> DataFrame:
    """For each point (pid, model, x, y, z) the nearest node that is born by z and meets a condition, the least (root, seq) of equals."""
    own = [c for c in points.columns if c not in ("model", "pid", "x", "y")]
    asked = points.select("model", "pid", F.col("x").alias("px"), F.col("y").alias("py"), *own)
    more = [c for c in nodes.columns if c not in ("model", "root", "seq", "x", "y")]
    things = nodes.select(*ROOT, "seq", F.col("x").alias("tx"), F.col("y").alias("ty"), *more)
    born = F.col("t") <= F.col("z")
    return nearest(asked, things, ["model"], ["pid"], ["root", "seq"], where=born if where is None else born & where).drop("n")


def last_dates(nodes: DataFrame) -> DataFrame:
    """model and last_date: the last date of each model, rounded up."""
    return nodes.groupBy("model").agg(F.ceil(F.max("t")).cast("int").alias("last_date"))


def length_series(nodes: DataFrame) -> DataFrame:
    """Arc length at the last exact node of each date, carried forward, and its growth since the date before."""
    exact = segments(nodes).where(is_exact(F.col("t"))).groupBy(*ROOT, F.col("t").cast("int").alias("day")).agg(F.max("c").alias("c"))
    grid = nodes.select(*ROOT).distinct().join(last_dates(nodes), "model").select(*ROOT, F.explode(F.sequence(F.lit(1), F.col("last_date"))).alias("day"))
    by = Window.partitionBy(*ROOT).orderBy("day")
    filled = grid.join(exact, [*ROOT, "day"], "left").withColumn("length", F.coalesce(F.last("c", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    return filled.select(*ROOT, "day", "length", (F.col("length") - F.coalesce(F.lag("length").over(by), F.lit(0.0))).alias("growth"))
