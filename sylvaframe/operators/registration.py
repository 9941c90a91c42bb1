"""Matching of image blocks and border patches, and the schedule of a film's frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.functions import scalars as C

#: Up to these parts of the film's length a step is divided by these numbers.
SLOW_START = ((30, 3.0), (22, 2.5), (18, 2.2), (15, 2.0), (13, 1.8), (11, 1.6), (9, 1.4), (8, 1.2))
END_FRAMES = 15


def pearson(n: Column, a: Column, b: Column, aa: Column, bb: Column, ab: Column) -> Column:
    """The correlation of two samples from their sums; 0 where a sum of squares or a variance is about 0."""
    va, vb = n * aa - a * a, n * bb - b * b
    sound = (aa > 1e-19) & (bb > 1e-19) & (va > 1e-9) & (vb > 1e-9)
    return F.when(sound, (n * ab - a * b) / F.sqrt(F.when(sound, va * vb).otherwise(1.0))).otherwise(0.0)


def block_match(pixels: DataFrame, blocks: DataFrame, size: int, reach: int) -> DataFrame:
    """For each block (box, t, bx, by: its corner) the displacement (dx, dy) up to `reach` after which the next frame correlates best, and the score.

    Equal scores (nine places) go to the shorter displacement, then to the lesser (dx, dy); only displacements that stay in the image count.
    Sums over a block come from sliding sums along x and then y, so a pixel enters once for each displacement however many blocks hold it.
    """
    moves = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)))).alias("m")
    later = pixels.select("box", (F.col("t") - 1).alias("t"), "x", "y", F.col("v").alias("w"))
    asked = pixels.select("box", "t", "x", "y", "v", moves).select("box", "t", "x", "y", "v", "m.dx", "m.dy")
    shifted = asked.join(later.withColumnsRenamed({"x": "mx", "y": "my"}), (F.col("mx") == F.col("x") + F.col("dx")) & (F.col("my") == F.col("y") + F.col("dy")) & (asked["box"] == later["box"]) & (asked["t"] == later["t"]))
    key = ["box", "t", "dx", "dy"]
    rows = shifted.select(asked["box"], asked["t"], "dx", "dy", "x", "y", F.lit(1).alias("n"), "v", "w", (F.col("v") * F.col("v")).alias("vv"), (F.col("w") * F.col("w")).alias("ww"), (F.col("v") * F.col("w")).alias("vw"))
    sums = ("n", "v", "w", "vv", "ww", "vw")
    along_x = Window.partitionBy(*key, "y").orderBy("x").rangeBetween(0, size - 1)
    lines = rows.select(*key, "x", "y", *(F.sum(c).over(along_x).alias(c) for c in sums))
    corners = blocks.select("box", F.col("bx").cast("int").alias("x")).distinct()
    lines = lines.join(corners, ["box", "x"], "left_semi")
    along_y = Window.partitionBy(*key, "x").orderBy("y").rangeBetween(0, size - 1)
    whole = lines.select(*key, F.col("x").alias("bx"), F.col("y").alias("by"), *(F.sum(c).over(along_y).alias(c) for c in sums)).where(F.col("n") == size * size)
    scored = whole.join(blocks.select("box", "t", "bx", "by"), ["box", "t", "bx", "by"], "left_semi")
    score = C.rounded(pearson(*(F.col(c).cast("double") for c in ("n", "v", "w", "vv", "ww", "vw"))), 9)
    best = F.max(F.struct(score.alias("score"), (-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("near"), (-F.col("dx")).alias("x"), (-F.col("dy")).alias("y"))).alias("m")
    return scored.groupBy("box", "t", "bx", "by").agg(best).select("box", "t", "bx", "by", (-F.col("m.x")).alias("dx"), (-F.col("m.y")).alias("dy"), "m.score")


def gap_correspondence(patches: DataFrame, reach: int, least_r: float, least_deviation: float, sigma: float) -> DataFrame:
    """Pairs (image, i, j) of border positions that belong together, from patches (image, i, top, bottom: arrays of equal length).

    A top patch takes the bottom patch within `reach` that correlates best (the first of equals), if the correlation and the deviations of both patches at i
    are large enough. Where more than four sigma lie between pairs, or before and after them, positions every 1.5 sigma are paired with themselves.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    squares = lambda xs: total(F.transform(xs, lambda x: x * x))
    rows = patches.select("image", "i", F.col("top").cast("array<double>").alias("top"), F.col("bottom").cast("array<double>").alias("bottom"))
    rows = rows.select("*", *(total(F.col(c)).alias(f"s_{c}") for c in ("top", "bottom")), *(squares(F.col(c)).alias(f"q_{c}") for c in ("top", "bottom")), F.size("top").cast("double").alias("n"))
    deviation = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.col(f"q_{c}") / F.col("n") - F.col(f"s_{c}") * F.col(f"s_{c}") / (F.col("n") * F.col("n"))))
    tops = rows.select("image", "i", "top", "s_top", "q_top", "n", deviation("top").alias("d_top"), deviation("bottom").alias("d_bottom"), F.explode(F.sequence(F.col("i") - reach, F.col("i") + reach)).alias("j"))
    pairs = tops.join(rows.select("image", F.col("i").alias("j"), "bottom", "s_bottom", "q_bottom"), ["image", "j"])
    r = F.round(pearson(F.col("n"), F.col("s_top"), F.col("s_bottom"), F.col("q_top"), F.col("q_bottom"), total(F.zip_with("top", "bottom", lambda a, b: a * b))), 9)
    best = pairs.groupBy("image", "i").agg(F.max(F.struct(r.alias("r"), (-F.col("j")).alias("j"))).alias("m"), F.first("d_top").alias("d_top"), F.first("d_bottom").alias("d_bottom"))
    kept = best.where((F.col("m.r") >= least_r) & (F.col("d_top") >= least_deviation) & (F.col("d_bottom") >= least_deviation)).select("image", "i", (-F.col("m.j")).alias("j"), F.lit(True).alias("real"))
    ends = rows.groupBy("image").agg(F.max("i").alias("i")).select("image", "i", F.col("i").alias("j"), F.lit(False).alias("real"))
    step = 1.5 * sigma
    gap = F.col("i") - F.col("before")
    marked = kept.unionByName(ends).withColumn("before", F.coalesce(F.lag("i").over(Window.partitionBy("image").orderBy("i", F.desc("real"))), F.lit(int(-step)).cast("long")))
    count = (F.ceil(gap / step - 1) - 1).cast("int")
    holes = marked.where((gap > 4 * sigma) & (count >= 1)).select("image", "before", F.explode(F.sequence(F.lit(1), count)).alias("k"))
    at = (F.col("before") + F.col("k") * step).cast("long")
    return kept.select("image", "i", "j", "real").unionByName(holes.select("image", at.alias("i"), at.alias("j"), F.lit(False).alias("real")))


def frame_schedule(hours: DataFrame, step: float, slow_start: bool = True) -> DataFrame:
    """Frames of films (film, frame, t) with the observations around them: bef, aft, hours from and to them, and the share from the earlier one.

    hours: observations (film, i from 0, h). Times run by `step`, slowed at the start, up to the last observation, which END_FRAMES more frames repeat.
    A film's times are folded in its row, as each depends on the one before; its observations are merged with its frames in a sorted pass.
    """
    films = hours.groupBy("film").agg(F.max("h").alias("end"), F.max("i").alias("last"))

    def onward(times: Column, _: Column) -> Column:
        at, end = F.coalesce(F.try_element_at(times, F.lit(-1)), F.lit(0.0)), F.col("end")
        by = F.lit(1.0)
        for part, number in reversed(SLOW_START) if slow_start else ():
            by = F.when(at < end / part, number).otherwise(by)
        return F.when(at + step / by < end, F.concat(times, F.array(at + step / by))).otherwise(times)

    longest = F.ceil(F.col("end") / step * (SLOW_START[0][1] if slow_start else 1)).cast("int") + 1
    times = F.aggregate(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), F.array().cast("array<double>"), onward)
    timed = films.withColumn("times", times)
    frames = timed.select("film", "end", "last", F.posexplode("times").alias("frame", "t"))
    ends = timed.select("film", "end", "last", F.explode(F.sequence(F.lit(0), F.lit(END_FRAMES - 1))).alias("k"), F.size("times").alias("n"))

    following = F.lead("h").over(Window.partitionBy("film").orderBy("i"))
    knots = hours.select("film", F.col("h").alias("t"), F.lit(0).alias("kind"), F.struct("i", "h", following.alias("next")).alias("knot"))
    asked = frames.select("film", "t", F.lit(1).alias("kind"), F.lit(None).cast(knots.schema["knot"].dataType).alias("knot"), "end", "last", "frame")
    both = knots.withColumns({"end": F.lit(None).cast("double"), "last": F.lit(None).cast(asked.schema["last"].dataType), "frame": F.lit(None).cast("int")}).unionByName(asked)
    found = both.withColumn("k", F.last("knot", ignorenulls=True).over(Window.partitionBy("film").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))).where("kind = 1")
    first = F.coalesce(F.col("k.i"), F.lit(0)) == 0
    to_bef, to_aft = F.col("t") - F.col("k.h"), F.col("k.next") - F.col("t")
    shown = found.select(
        "film", "frame", "t", F.when(first, 0).otherwise(F.col("k.i") - 1).alias("bef"), F.when(first, 0).otherwise(F.col("k.i")).alias("aft"),
        F.when(first, 0.0).otherwise(to_bef).alias("from_bef"), F.when(first, F.col("end") / F.col("last")).otherwise(to_aft).alias("to_aft"), F.when(first, 0.0).otherwise(to_bef / (to_bef + to_aft)).alias("share"),
    )
    still = ends.select("film", (F.col("n") + F.col("k")).alias("frame"), F.col("end").alias("t"), (F.col("last") - 1).alias("bef"), F.col("last").alias("aft"), (F.col("end") / F.col("last")).alias("from_bef"), F.lit(0.0).alias("to_aft"), F.lit(1.0).alias("share"))
    return shown.unionByName(still)
