"""Cutting the lineage of iterations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def folder(df: DataFrame) -> str:
    """The place that driver and executors share for what iterations write: spark.checkpoint.dir, only where none is named (tests) a folder under the warehouse."""
    spark = df.sparkSession
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as a table and read again.

    Against a checkpoint the rows are computed once instead of twice, and the new plan knows their real size: sizes that a checkpoint
    keeps are multiplied in each join, so a loop's estimates grow beyond any number.
    """
    path = f"{folder(df)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
