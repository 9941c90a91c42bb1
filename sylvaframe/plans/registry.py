"""All queries of the library."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from sylvaframe.plans.fixtures import Query

FAMILIES = ("raster_queries", "timebase_queries", "region_queries", "trait_queries", "model_queries", "anomaly_queries", "report_queries", "polyline_queries", "pixel_queries", "replay_queries", "organ_queries", "film_queries", "branch_queries", "source_queries")


def books():
    return [import_module(f"sylvaframe.plans.{name}").BOOK for name in FAMILIES]


def queries() -> dict[str, Query]:
    return {name: query for book in books() for name, query in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in books() for name, sql in book.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of appearance of all pixels."""
    return queries()["appearance_date_map"](spark, sf_dir)
