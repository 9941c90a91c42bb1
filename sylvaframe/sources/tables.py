"""Image listings, inventories, parameter files and plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of image files.
IMAGES = ("jpg", "jpeg", "png", "tif", "tiff")
_INVENTORY = "Num_obs INT, `DateThour(24h-format)` STRING, Hours_since_series_start DOUBLE, Relative_path_to_the_img STRING"


def scan_image_files(spark: SparkSession, path: str, endings: Sequence[str] = IMAGES) -> DataFrame:
    """path, mtime and length of all files below a path whose name ends, in any case, in one of the endings. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kept = files.where(F.lower("path").rlike("[.](" + "|".join(endings) + ")$"))
    return kept.select("path", F.col("modificationTime").alias("mtime"), "length")


def write_inventory(observations: DataFrame, path: str) -> None:
    """One folder of CSV files for each object (object, num_obs, taken_at, hours, file)."""
    rows = observations.select("object", F.col("num_obs").alias("Num_obs"), F.date_format("taken_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("DateThour(24h-format)"), F.col("hours").alias("Hours_since_series_start"), F.col("file").cast("string").alias("Relative_path_to_the_img"))
    rows.repartition("object").write.partitionBy("object").csv(path, header=True)


def scan_inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    """object, num_obs, taken_at, hours and file of all inventories below a path; the object is a folder `object=...`, else the file's name without its ending."""
    rows = spark.read.csv(path, header=True, schema=_INVENTORY)
    if "object" in spark.read.csv(path, header=True).columns:
        rows = spark.read.csv(path, header=True, schema=f"{_INVENTORY}, object STRING")
    else:
        rows = rows.withColumn("object", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(\.[^./]*)?$", 1))
    return rows.select("object", F.col("Num_obs").alias("num_obs"), F.to_timestamp("DateThour(24h-format)").alias("taken_at"), F.col("Hours_since_series_start").alias("hours"), F.col("Relative_path_to_the_img").alias("file"))


def write_params(params: DataFrame, boxes: DataFrame, path: str) -> None:
    """Parameter files in folders by dataset: the lines (dataset, line, key, value, info), then Img_i_name and Img_i_step of the boxes (dataset, i, name, step)."""
    pairs = F.array(F.struct(F.lit("name").alias("k"), F.col("name").alias("v")), F.struct(F.lit("step").alias("k"), F.col("step").cast("string").alias("v")))
    per_box = boxes.select("dataset", "i", F.posexplode(pairs).alias("j", "p")).select("dataset", (F.lit(1 << 40) + 2 * F.col("i") + F.col("j")).alias("line"), F.concat(F.lit("Img_"), F.col("i").cast("string"), F.lit("_"), F.col("p.k")).alias("key"), F.col("p.v").alias("value"), F.lit("").alias("info"))
    rows = params.select("dataset", F.col("line").cast("long").alias("line"), "key", "value", "info").unionByName(per_box)
    # A dataset's file is small and its order counts, so it is one task's.
    rows.repartition("dataset").sortWithinPartitions("dataset", "line").select("dataset", "key", "value", "info").write.partitionBy("dataset").csv(path)


def scan_params_csv(spark: SparkSession, path: str) -> DataFrame:
    """dataset, key, value and info: the first line of each key in each parameter file."""
    texts = spark.read.text(path, wholetext=True)
    if "dataset" not in texts.columns:
        texts = texts.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(\.[^./]*)?$", 1).alias("dataset"), "value")
    lines = texts.select("dataset", F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).where("text <> ''")
    fields = F.from_csv("text", "key STRING, value STRING, info STRING").alias("f")
    parsed = lines.select("dataset", "line", fields).where("f.key is not null")
    first = parsed.groupBy("dataset", F.col("f.key").alias("key")).agg(F.min_by("f", "line").alias("f"))
    return first.select("dataset", "key", F.col("f.value").alias("value"), F.col("f.info").alias("info"))


def typed(value: Column, to: str, missing) -> Column:
    """A parameter as a number; `missing` where there is none or it is something else."""
    return F.coalesce(value.try_cast(to), F.lit(missing).cast(to))


def write_table(table: DataFrame, path: str) -> None:
    table.write.csv(path, header=True)
