"""Connected components of a large graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm._common import ensure_checkpoint_dir


#: A node with more than this share of all rows is a hub.
_SHARE = 1 / 1000


def with_least(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (u, v) with m, the least of u and its neighbours in `pairs` (u, v), and m by u.

    The minimum is combined before it is shuffled. Hubs, of which there are 1,000 at most, send their minimum to all tasks instead of
    their rows to one; the other rows are joined by u.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    total = pairs.count()
    is_hub = F.col("n") > max(16, int(total * _SHARE))
    hubs = F.broadcast(least.where(is_hub).select("u", F.col("m").alias("hub_m")))
    marked = rows.join(hubs, "u", "left")
    others = marked.where("hub_m is null").select("u", "v").join(least.where(~is_hub).select("u", "m"), "u")
    return marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(others), least.select("u", "m")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, _ = with_least(both.where("v > u"), both)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).checkpoint()
    joined, least = with_least(down, down)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node), for all nodes of edges a, b that join two different nodes."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen = None
    while True:
        edges = small_star(large_star(edges)).checkpoint()
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
