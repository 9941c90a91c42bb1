"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(df: DataFrame, column: str, name: str | None = None) -> str:
    """The DDL of a column, for the schema of an Arrow function."""
    return f"`{name or column}` {df.schema[column].dataType.simpleString()}"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which `column` has about `limit` bytes at most (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size, dtype=np.int64) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, max_rows: int, max_chars: int, id_col: str, text_col: str) -> DataFrame:
    """`id_col`, `label` and `text_col` of at most max_rows labelled documents, by a hash of the id, with at most max_chars characters in all.

    Where they have more characters, the longest go first, so a long text never keeps others out. Rows without a label (null) are no
    candidates; of contradicting labels the larger counts; of several texts of one id the one of the least hash. Labelled documents of two
    classes of which the sample has one only are an error. The sample is checkpointed, so that what is computed of it is computed of it alone.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    known = labels.select(labels[id_col].alias(id_col), label.alias("label")).where("label is not null")
    some = known.groupBy(id_col).agg(F.max("label").alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    texts = docs.select(docs[id_col].alias(id_col), docs[text_col].alias(text_col)).join(F.broadcast(some), id_col)
    sample = texts.groupBy(id_col, "label").agg(F.min_by(text_col, F.xxhash64(text_col)).alias(text_col)).checkpoint()
    so_far = F.sum(F.coalesce(F.length(text_col), F.lit(0))).over(Window.orderBy(F.length(text_col), F.xxhash64(id_col), id_col))  # of max_rows numbers at most
    fits = sample.select(id_col, so_far.alias("so_far")).where(F.col("so_far") <= max_chars).select(id_col)
    found = sample.join(F.broadcast(fits), id_col, "left_semi")
    classes = lambda rows: rows.select("label").distinct().limit(2).count()
    if classes(found) < 2 and classes(known.join(docs.select(docs[id_col].alias(id_col)), id_col, "left_semi")) == 2:
        raise ValueError(f"the sample of {max_rows} rows and {max_chars} characters has one class of labels, the labelled documents have more")
    return found


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Reads spark.checkpoint.dir from the session; only where none is named (tests) a folder under the warehouse is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        )
