"""Inventories, time bases, interpolation and label helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.functions import scalars as C


def inventory_observations(files: DataFrame) -> DataFrame:
    """Files (object, file, mtime) numbered by time from 0 within their object, with hours since its first to two places."""
    by_time = Window.partitionBy("object").orderBy("mtime", "file")
    first = F.min("mtime").over(Window.partitionBy("object"))
    hours = F.round((F.unix_micros(F.col("mtime").cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 3.6e9, 2)
    return files.select("object", "file", (F.row_number().over(by_time) - 1).alias("num_obs"), hours.alias("hours"))


def inventory_objects(files: DataFrame) -> DataFrame:
    return files.groupBy("object").agg(F.min("mtime").alias("first"), F.max("mtime").alias("last"), F.count("*").alias("n_images"))


def inventory_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.min("mtime").alias("first"), F.max("mtime").alias("last"), F.count_distinct("object").alias("n_objects"), F.count("*").alias("n_images"))


def inventory_by_code(files: DataFrame, code: str) -> DataFrame:
    """Inventory of files by a decoded label; files without one form NOT_FOUND."""
    label = F.coalesce(F.nullif(F.col(code), F.lit("")), F.lit("NOT_FOUND"))
    return inventory_observations(files.withColumn("object", label))


def experiment_flags(params: DataFrame, value: str) -> DataFrame:
    return params.withColumn("is_split", F.contains(F.col(value), F.lit("Split_V01"))).withColumn("is_gaps", F.contains(F.col(value), F.lit("HaveNoSurface_")))


def first_params(lines: DataFrame) -> DataFrame:
    """The first value of each key of parameter lines (dataset, line, key, value)."""
    return lines.groupBy("dataset", "key").agg(F.min_by("value", "line").alias("value"))


def pending_steps(boxes: DataFrame, done: DataFrame, first: int, last: int) -> DataFrame:
    """Steps (box, step) that are not done yet, and whether the box's work is skipped."""
    steps = boxes.select("box", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("step"))
    return steps.join(done, ["box", "step"], "left_anti").withColumn("skips", F.contains(F.col("box"), F.lit("TRASH")))


def pair_files(images: DataFrame, models: DataFrame, existing: DataFrame) -> DataFrame:
    """Images and models of one stem whose output does not exist; either side is null where its partner is missing."""
    stem = lambda c: F.regexp_replace(F.col(c), "[.][^.]*$", "")
    pairs = images.withColumn("stem", stem("image")).join(models.withColumn("stem", stem("model")), "stem", "full_outer")
    return pairs.join(existing.select(stem("output").alias("stem")), "stem", "left_anti")


def hours_midpoints(acq: DataFrame) -> DataFrame:
    """Hours (box, i, h) at i + 1: the mean of an acquisition and the one before; 0 and 1 go back by the gap of 2 and 3."""
    by = Window.partitionBy("box").orderBy("i")
    means = acq.withColumn("m", (F.col("h") + F.lag("h").over(by)) / 2).where("m is not null").select("box", (F.col("i") + 1).alias("i"), F.col("m").alias("h"))
    ends = means.where("i in (2, 3)").groupBy("box").agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))
    back = ends.select("box", F.explode(F.array(F.lit(1), F.lit(0))).alias("k"), "a", "b")
    return means.unionByName(back.select("box", F.col("k").cast("long").alias("i"), (F.col("a") - (2 - F.col("k")) * (F.col("b") - F.col("a"))).alias("h")))


def hours_extremities(acq: DataFrame, typical: float) -> DataFrame:
    later = acq.where("i >= 1").select("box", (F.col("i") + 1).alias("i"), "h")
    start = acq.select("box").distinct().select("box", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("i"), F.lit(0.0).alias("h")), F.struct(F.lit(0).cast("long").alias("i"), F.lit(-typical).alias("h")))).alias("e"))
    return later.unionByName(start.select("box", "e.i", "e.h"))


def mean_sampling_interval(acq: DataFrame) -> DataFrame:
    gaps = acq.withColumn("gap", F.col("h") - F.lag("h").over(Window.partitionBy("box").orderBy("i")))
    return gaps.agg(F.avg("gap").alias("mean_gap"))


def linear_interpolation(values: DataFrame, knots: DataFrame, key: list[str], at: str = "v") -> DataFrame:
    """Values with `y`: piecewise linear over their key's knots (x, y), clamped at both ends.

    Knots and values are merged in sorted passes of each key, up for the knot below and down for the one above, so no value
    meets more than its two knots. A key's rows are sorted in one task, spilling to disk beyond its memory.
    """
    rows = values.select(*key, F.col(at).alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("ky"), F.struct(*values.columns).alias("row"))
    marks = knots.select(*key, F.col("x").cast("double").alias("x"), F.lit(0).alias("kind"), F.col("y").cast("double").alias("ky"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    both = marks.unionByName(rows)
    order = Window.partitionBy(*key).orderBy("x", "kind")
    knot = F.when(F.col("kind") == 0, F.struct("x", "ky"))
    low = F.last(knot, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    down = Window.partitionBy(*key).orderBy(F.desc("x"), "kind")
    high = F.last(knot, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("low", low).withColumn("high", high).where("kind = 1")
    share = (F.col("x") - F.col("low.x")) / (F.col("high.x") - F.col("low.x"))
    between = F.col("low.ky") + share * (F.col("high.ky") - F.col("low.ky"))
    y = F.when(F.col("low").isNull(), F.col("high.ky")).when(F.col("high").isNull() | (F.col("low.x") == F.col("x")), F.col("low.ky")).otherwise(between)
    return found.select("row.*", y.alias("y"))


def correlation(rows: DataFrame, by: list[str], x: str, y: str, eps: float = 1e-12) -> DataFrame:
    """Pearson's coefficient; 0 where a variance or a sum of squares is about 0."""
    x, y, n = F.col(x), F.col(y), F.count("*")
    vx, vy = n * F.sum(x * x) - F.sum(x) * F.sum(x), n * F.sum(y * y) - F.sum(y) * F.sum(y)
    r = (n * F.sum(x * y) - F.sum(x) * F.sum(y)) / F.sqrt(vx * vy)
    return rows.groupBy(*by).agg(F.when((vx > eps) & (vy > eps), r).otherwise(0.0).alias("r"))


def common_prefix(labels: DataFrame, by: list[str], label: str) -> DataFrame:
    """Longest common prefix of labels other than TRASH and NOT_FOUND: that of the least and the greatest."""
    ends = labels.where(~F.col(label).isin("TRASH", "NOT_FOUND")).groupBy(*by).agg(F.min(label).alias("a"), F.max(label).alias("b"))
    n = F.sequence(F.lit(0), F.least(F.length("a"), F.length("b")))
    longest = F.array_max(F.filter(n, lambda k: F.substring(F.col("a"), 1, k) == F.substring(F.col("b"), 1, k)))
    return ends.select(*by, F.substring(F.col("a"), F.lit(1), longest).alias("prefix"))


def guess_label(files: DataFrame, labels: DataFrame) -> DataFrame:
    """For each file name the label (label, pos, suffix) whose suffix occurs most often in it, the first of equals; null if none occurs.

    A name's substrings of the suffixes' lengths are joined to the suffixes by equality. The driver only reads the distinct lengths,
    of which there are no more than the longest suffix has characters.
    """
    lengths = sorted(r[0] for r in labels.select(F.length("suffix")).where("length(suffix) > 0").distinct().collect())
    names = files.select("name").distinct()
    cuts = [F.when(F.length("name") >= n, F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substring(F.col("name"), i, F.lit(n)))).otherwise(F.array()) for n in lengths]  # noqa: B023
    parts = names.withColumn("suffix", F.explode(F.array_distinct(F.concat(*cuts)) if cuts else F.array().cast("array<string>")))
    hits = ((F.length("name") - F.length(F.replace("name", F.col("suffix"), F.lit("")))) / F.length("suffix")).cast("int")
    best = parts.join(labels, "suffix").withColumn("hits", hits).groupBy("name").agg(F.max(F.struct("hits", (-F.col("pos")).alias("pos"), "label")).alias("best"))
    return names.join(best, "name", "left").select("name", F.col("best.label").alias("label"), F.coalesce("best.hits", F.lit(0)).alias("hits"))


def apply_dates_by_name(files: DataFrame, dates: DataFrame) -> DataFrame:
    """Files (seq, name) with the time in the first line of dates (seq, line, name, text) of their sequence and trimmed name, written `Date=yyyy-MM-dd_Time=HH-mm-ss`."""
    part = lambda n: F.regexp_extract("text", r"Date=(\d{4}-\d{2}-\d{2})_Time=(\d{2}-\d{2}-\d{2})", n)
    when = F.try_to_timestamp(F.nullif(F.concat(part(1), F.lit(" "), part(2)), F.lit(" ")), F.lit("yyyy-MM-dd HH-mm-ss"))
    first = dates.groupBy("seq", F.trim("name").alias("key")).agg(F.min_by("text", "line").alias("text")).withColumn("taken_at", when)
    return files.withColumn("key", F.trim("name")).join(first, ["seq", "key"], "left").drop("key", "text")


def tail_aligned_join(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two sorted lists matched from their ends."""
    last = lambda order: F.row_number().over(Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order)))
    return left.withColumn("from_end", last(left_order)).join(right.withColumn("from_end", last(right_order)), [*by, "from_end"])


def coverage_check(ids: DataFrame, last: int) -> DataFrame:
    """Ids from 1 to last that don't occur exactly once."""
    wanted = ids.sparkSession.range(1, last + 1)
    seen = ids.groupBy("id").agg(F.count("*").alias("times"))
    return wanted.join(seen, "id", "left").fillna({"times": 0}).where("times <> 1")


def cell_class_summary(cells: DataFrame, annotated: DataFrame) -> DataFrame:
    """Per image: areas and counts of all and of flagged cells, and the share in percent, of which half a hundredth goes up; NA and a reason for images without annotation."""
    sums = cells.groupBy("image").agg(
        F.sum("area").alias("area"), F.sum(F.when(F.col("flag"), F.col("area")).otherwise(0.0)).alias("flagged_area"), F.count("*").alias("n"), F.count_if("flag").alias("n_flagged")
    )
    known = sums.join(annotated.select("image", F.lit(True).alias("known")), "image", "left")
    share = F.when(F.col("known"), F.format_number(C.rounded(100 * F.col("flagged_area") / F.nullif("area", F.lit(0.0)), 2), 2)).otherwise("NA")
    return known.select("image", "area", "flagged_area", "n", "n_flagged", share.alias("percent"), F.when(F.col("known").isNull(), "no annotation").alias("reason"))


def mad_double_sided(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Median, and the medians of the values at most and at least as large as it."""
    m = rows.withColumn("v", value).withColumn("median", F.median("v").over(Window.partitionBy(*by)))
    v = F.col("v")
    return m.groupBy(*by).agg(F.first("median").alias("median"), F.median(F.when(v <= F.col("median"), v)).alias("low"), F.median(F.when(v >= F.col("median"), v)).alias("high"))
