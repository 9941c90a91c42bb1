"""Pixels of components: links, distances inside a mask, entries and ends, and paths over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.functions import scalars as C
from sylvaframe.operators.cut import cut
from sylvaframe.operators.raster import frames_of
from sylvaframe.operators.waves import wave

PIXEL = ["box", "x", "y"]


def pixel_graph(labelled: DataFrame) -> DataFrame:
    """Links of 8-neighbours within a component (box, cc_id, ax, ay, bx, by) with their length; each pair once."""
    halves = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1))))
    a = labelled.select("box", "cc_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(halves).alias("m"))
    a = a.select("box", "cc_id", "ax", "ay", (F.col("ax") + F.col("m.dx")).alias("bx"), (F.col("ay") + F.col("m.dy")).alias("by"), F.sqrt(F.abs("m.dx") + F.abs("m.dy")).alias("length"))
    return a.join(labelled.select("box", "cc_id", F.col("x").alias("bx"), F.col("y").alias("by")), ["box", "cc_id", "bx", "by"])


def geodesic_distance(mask: DataFrame, seeds: DataFrame, straight: float = 1000.0, diagonal: float = 1414.0, inverted: bool = False) -> DataFrame:
    """box, x, y and d: the chamfer distance of each reachable pixel of a mask from the seeds in it; inverted: the box's largest distance less it."""
    known = wave(mask, seeds.withColumn("label", F.lit(0)), ["box"], straight, diagonal).select(*PIXEL, "d")
    if inverted:
        most = known.groupBy("box").agg(F.max("d").alias("most"))
        return known.join(most, "box").select(*PIXEL, (F.col("most") - F.col("d")).alias("d"))
    return known


def outside_distance(pixels: DataFrame, objects: DataFrame) -> DataFrame:
    """Distance of the background's pixels from the nearest object (box, x, y), one for a side and 1.414 for a corner; through all pixels."""
    reached = geodesic_distance(pixels, objects, 1.0, 1.414)
    return reached.join(objects.select(*PIXEL), PIXEL, "left_anti")


def farthest_pixel(labelled: DataFrame, entries: DataFrame) -> DataFrame:
    """For each component the pixel with the largest distance inside it from its entry (box, cc_id, x, y), then with the largest straight one, then the least."""
    own = ["box", "cc_id"]
    # Each component is a mask of its own.
    named = lambda df: df.select(F.struct("box", "cc_id").alias("box"), "x", "y")
    far = geodesic_distance(named(labelled), named(entries)).select("box.box", "box.cc_id", "x", "y", "d")
    rows = far.join(entries.select(*own, F.col("x").alias("ex"), F.col("y").alias("ey")), own)
    straight = (F.col("x") - F.col("ex")) * (F.col("x") - F.col("ex")) + (F.col("y") - F.col("ey")) * (F.col("y") - F.col("ey"))
    best = rows.groupBy(*own).agg(F.max(F.struct("d", straight.alias("e"), (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))).alias("m"))
    return best.select(*own, (-F.col("m.x")).alias("x"), (-F.col("m.y")).alias("y"), "m.d")


def entry_exit_pixels(labelled: DataFrame, forest: DataFrame) -> DataFrame:
    """Each component's entry: the topmost pixel where it has no parent, else the one nearest to the connection (fx, fy); the least (y, x) of equals."""
    rows = labelled.select("box", "cc_id", "x", "y").join(forest.select("box", "cc_id", "fx", "fy"), ["box", "cc_id"])
    d2 = F.when(F.col("fx").isNull(), 0.0).otherwise((F.col("x") - F.col("fx")) * (F.col("x") - F.col("fx")) + (F.col("y") - F.col("fy")) * (F.col("y") - F.col("fy")))
    return rows.groupBy("box", "cc_id").agg(F.min(F.struct(F.round(d2, 6).alias("d2"), "y", "x")).alias("m")).select("box", "cc_id", "m.x", "m.y")


def facet_side(sx: Column, sy: Column, tx: Column, ty: Column) -> Column:
    """The place half a pixel before the target of a link, along the axis of its direction, or along both where it is diagonal; null without a direction."""
    n = F.nullif(C.distance(sx, sy, tx, ty), F.lit(0.0))
    ux, uy = (tx - sx) / n, (ty - sy) / n
    off = lambda u, other: F.when(F.abs(other) > 0.707, 0.0).otherwise(-0.5 * F.signum(u))
    x = F.when(F.abs(ux) > 0.707, -0.5 * F.signum(ux)).otherwise(off(ux, uy))
    y = F.when(F.abs(ux) > 0.707, 0.0).otherwise(F.when(F.abs(uy) > 0.707, -0.5 * F.signum(uy)).otherwise(off(uy, ux)))
    return F.when(n.isNotNull(), F.struct((tx + x).alias("x"), (ty + y).alias("y")))


def path_cumulative_distance(path: DataFrame, by: list[str], segment: str, order: str) -> DataFrame:
    """Points of paths with their running length; a segment goes on from the length at the end of the one before, without the gap between them."""
    inside = Window.partitionBy(*by, segment).orderBy(order)
    leg = F.coalesce(C.distance(F.lag("x").over(inside), F.lag("y").over(inside), F.col("x"), F.col("y")), F.lit(0.0))
    return path.withColumn("leg", leg).withColumn("distance", F.sum("leg").over(Window.partitionBy(*by).orderBy(segment, order))).drop("leg")


def polyline_simplify(points: DataFrame, by: list[str], tolerance: float, pinned: Column | None = None) -> DataFrame:
    """The vertices of polylines (by, seq, x, y) that stay: the ends, pinned ones, and in each stretch between two of them the farthest from its chord, as long as that is over
    the tolerance (the first of equals).

    All stretches of all polylines are split in the same round; a stretch's vertices are ranked by one aggregate.
    """
    keep = F.coalesce(pinned, F.lit(False)) if pinned is not None else F.lit(False)
    whole = Window.partitionBy(*by)
    rows = cut(points.withColumn("kept", keep | (F.col("seq") == F.min("seq").over(whole)) | (F.col("seq") == F.max("seq").over(whole))))
    while True:
        up, down = Window.partitionBy(*by).orderBy("seq"), Window.partitionBy(*by).orderBy(F.desc("seq"))
        mark = F.when(F.col("kept"), F.struct("seq", "x", "y"))
        spans = rows.withColumn("a", F.last(mark, ignorenulls=True).over(up)).withColumn("b", F.last(mark, ignorenulls=True).over(down)).where("not kept")
        ux, uy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
        n = F.sqrt(ux * ux + uy * uy)
        off = F.when(n > 0, F.abs(ux * (F.col("y") - F.col("a.y")) - uy * (F.col("x") - F.col("a.x"))) / F.nullif(n, F.lit(0.0))).otherwise(C.distance(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y")))
        far = spans.groupBy(*by, F.col("a.seq").alias("start")).agg(F.max(F.struct(F.round(off, 9).alias("off"), (-F.col("seq")).alias("s"))).alias("m")).where(F.col("m.off") > tolerance)
        far = cut(far.select(*by, (-F.col("m.s")).alias("seq"), F.lit(True).alias("new")))
        if far.isEmpty():
            return rows.where("kept").drop("kept")
        rows = cut(rows.join(far, [*by, "seq"], "left").withColumn("kept", F.col("kept") | F.coalesce("new", F.lit(False))).drop("new"))


def _corners(dx: float, dy: float) -> Column:
    """The four whole moves around a displacement, with their bilinear weights."""
    fx, fy = dx - F.floor(F.lit(dx)), dy - F.floor(F.lit(dy))
    return F.array(*(F.struct((F.floor(F.lit(dx)) + i).alias("dx"), (F.floor(F.lit(dy)) + j).alias("dy"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)))


def displace_wide(wide: DataFrame, dx: float, dy: float) -> DataFrame:
    """apply_displacement of wide pixels (see raster), as pixel rows: a place's frames are summed side by side, and its weights once."""
    frames, w = frames_of(wide), F.col("m.w")
    moved = wide.withColumn("m", F.explode(_corners(dx, dy))).where(w > 0)
    places = moved.groupBy("box", (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y")).agg(*(F.sum(F.col(c) * w).alias(c) for c in frames), F.sum(w).alias("w"))
    return places.select("box", "x", "y", F.posexplode(F.array(*(F.col(c) / F.col("w") for c in frames))).alias("t", "v")).select("box", "t", "x", "y", "v")


def apply_displacement(pixels: DataFrame, dx: float, dy: float) -> DataFrame:
    """Pixels (box, t, x, y, v) moved by a displacement, by bilinear weights of the four pixels around each place, normalised over those that are there."""
    corners = _corners(dx, dy)
    moved = pixels.withColumn("m", F.explode(corners)).where("m.w > 0")
    places = moved.select("box", "t", (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"), (F.col("v") * F.col("m.w")).alias("v"), F.col("m.w").alias("w"))
    return places.groupBy("box", "t", "x", "y").agg((F.sum("v") / F.sum("w")).alias("v"))


def block_candidates(pixels: DataFrame, size: int, stride: int, least_variance: float) -> DataFrame:
    """Full blocks (box, t, bx, by: their corner) on a regular grid whose pixels' variance (nine places) is over a limit, whatever the order in which it is summed."""
    first = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride))
    at = lambda c: F.transform(F.sequence(first(c), F.floor(F.col(c) / stride)), lambda k: k * stride)
    rows = pixels.withColumn("bx", F.explode(at("x"))).withColumn("by", F.explode(at("y")))
    blocks = rows.groupBy("box", "t", "bx", "by").agg(F.count("*").alias("n"), F.var_pop("v").alias("variance"))
    return blocks.where((F.col("n") == size * size) & (F.round("variance", 9) > least_variance)).drop("n")


def segment_raster(segments: DataFrame, frames: DataFrame, dotted: Column | None = None, dot_every: int = 2) -> DataFrame:
    """Pixels (frame, x, y, value) of segments (model, x, y, x1, y1, t, t1, value) that are visible at a frame's time, the last one cut at it; the largest value of a pixel counts.

    Of dotted segments (hidden ones) every dot_every-th pixel is drawn, from their start.
    Frames (frame, time) are joined to the dates at which segments begin, which are few, and by those to the segments.
    """
    dates = segments.where("x1 is not null").select("t").distinct()
    shown = dates.join(F.broadcast(frames), F.col("time") >= F.col("t")).select("t", "frame", "time")
    rows = segments.where("x1 is not null").join(shown, "t")
    share = F.when(F.col("t1") <= F.col("time"), 1.0).otherwise((F.col("time") - F.col("t")) / (F.col("t1") - F.col("t")))
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x1") - F.col("x")), F.abs(F.col("y1") - F.col("y"))) * share)).cast("int")
    step = F.lit(1) if dotted is None else F.when(dotted, dot_every).otherwise(1)
    rows = rows.withColumn("share", share).withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"), step)))
    at = lambda a, b: F.floor(F.round(F.col(a) + (F.col(b) - F.col(a)) * F.col("share") * F.col("i") / F.col("n"), 6) + 0.5).alias(a)
    return rows.select("model", "frame", at("x", "x1"), at("y", "y1"), "value").groupBy("model", "frame", "x", "y").agg(F.max("value").alias("value"))


def tip_trajectory(nodes: DataFrame, roots: DataFrame, frames: DataFrame) -> DataFrame:
    """Each root's place and speed (x, y, vx, vy) at each frame's hours, -1 outside its life, and 1 for primaries or 2 for laterals as kind.

    Frames (frame, hours) are a film's: they are sent to the roots, and each root's are merged with its nodes in sorted passes.
    """
    key, values = ["model", "root"], ("x", "y", "vx", "vy")
    knots = nodes.select(*key, F.col("th").alias("h"), F.lit(1).alias("kind"), "seq", F.struct("th", *(F.col(v).cast("double").alias(v) for v in values)).alias("knot"), F.lit(None).cast("int").alias("frame"))
    asked = roots.select(*key).crossJoin(F.broadcast(frames)).select(*key, F.col("hours").alias("h"), F.lit(0).alias("kind"), F.lit(0).alias("seq"), F.lit(None).cast(knots.schema["knot"].dataType).alias("knot"), "frame")
    up, down = Window.partitionBy(*key).orderBy("h", "kind", "seq"), Window.partitionBy(*key).orderBy(F.desc("h"), F.desc("kind"), F.desc("seq"))
    both = knots.unionByName(asked).withColumn("a", F.last("knot", ignorenulls=True).over(up)).withColumn("b", F.last("knot", ignorenulls=True).over(down)).where("kind = 0")
    gone, span = F.col("h") - F.col("a.th"), F.col("b.th") - F.col("a.th")
    lives = F.col("a").isNotNull() & F.col("b").isNotNull()
    at = lambda v: F.when(lives, F.col(f"b.{v}") * gone / span + (1 - gone / span) * F.col(f"a.{v}")).otherwise(-1.0).alias(v)
    kinds = roots.select(*key, F.when(F.col("parent").isNull(), 1).otherwise(2).alias("kind"))
    return both.select(*key, "frame", *(at(v) for v in values)).join(kinds, key)
