"""Queries that write files of the formats and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sylvaframe.operators import timebase as T
from sylvaframe.plans import fixtures as X
from sylvaframe.sources import rsml, tables

BOOK = X.Book()
add = BOOK.add


def folder(s, name):
    """A new folder in the place that driver and executors share."""
    X.checkpoints(s)
    return f"{s.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _documents(s, d, standard):
    nodes = X.nodes(s, d).withColumn("vx", F.col("x") / 8).withColumn("vy", F.col("y") / 4)
    path = folder(s, "rsml")
    rsml.write_rsml(rsml.to_rsml(nodes, X.roots(s, d), [8.0 * i for i in range(1, 23)], 19.0, standard), path)
    return rsml.read_texts(s, path)


IDS = """ids AS (SELECT model, root, plant, plant || '.1' AS id FROM numbered WHERE parent IS NULL
  UNION ALL SELECT r.model, r.root, i.plant, i.id || '.' || r.n FROM (SELECT *, row_number() OVER (PARTITION BY model, parent ORDER BY root) AS n FROM roots WHERE parent IS NOT NULL) r JOIN ids i ON i.model = r.model AND i.root = r.parent)"""
COLUMNS = "n.model, CAST(i.plant AS VARCHAR) AS plant, i.id AS root_id, length(i.id) - length(replace(i.id, '.', '')) AS ord, n.seq, n.x * 1e0 AS x, n.y * 1e0 AS y, n.diameter * 1e0 AS diameter, n.t, n.th"
add(
    "scan_rsml_extended",
    lambda s, d: rsml.read_extended(_documents(s, d, False)).drop("label"),
    f"WITH RECURSIVE {IDS} SELECT {COLUMNS}, n.x / 8e0 AS vx, n.y / 4e0 AS vy FROM nodes n JOIN ids i ON i.model = n.model AND i.root = n.root",
    ("nodes", "roots", "numbered"),
)
add("scan_rsml_standard", lambda s, d: rsml.read_standard(_documents(s, d, True)).drop("label"), f"WITH RECURSIVE {IDS} SELECT {COLUMNS} FROM nodes n JOIN ids i ON i.model = n.model AND i.root = n.root", ("nodes", "roots", "numbered"))
add(
    "sink_rsml",
    lambda s, d: rsml.metadata(_documents(s, d, False)).select("model", "unit", "size", "file_key", F.element_at("hours", -1).alias("last_hour"), F.size("hours").alias("n_hours"), "dpi"),
    "SELECT DISTINCT model, 'pixel(um)' AS unit, 19e0 AS size, CAST(model AS VARCHAR) AS file_key, 176e0 AS last_hour, 23 AS n_hours, 0e0 AS dpi FROM roots",
    ("roots",),
)


def _inventory(s, d):
    files = X.observations(s, d)
    rows = T.inventory_observations(files).join(files.select("object", "file", F.col("mtime").alias("taken_at")), ["object", "file"])
    path = folder(s, "inventory")
    tables.write_inventory(rows, path)
    return tables.scan_inventory_csv(s, path)


add(
    "scan_inventory_csv",
    _inventory,
    """SELECT object, CAST(file AS VARCHAR) AS file, mtime AS taken_at, CAST(row_number() OVER (PARTITION BY object ORDER BY mtime, file) - 1 AS INTEGER) AS num_obs, round((epoch_us(mtime) - epoch_us(min(mtime) OVER (PARTITION BY object))) / 3.6e9, 2) AS hours FROM observations""",
    ("observations",),
)


def _params(s, d):
    lines = X.table(s, d, "part").select((F.col("p_partkey") % 7).alias("dataset"), F.col("p_partkey").alias("line"), F.col("p_brand").alias("key"), F.concat_ws(", ", "p_name", F.col("p_size").cast("string")).alias("value"), F.col("p_type").alias("info"))
    boxes = X.table(s, d, "supplier").select((F.col("s_suppkey") % 7).alias("dataset"), F.col("s_suppkey").alias("i"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 8).alias("step"))
    path = folder(s, "params")
    tables.write_params(lines, boxes, path)
    return tables.scan_params_csv(s, path).withColumn("dataset", F.col("dataset").cast("long"))


PARAMS = """SELECT p_partkey % 7 AS dataset, p_brand AS key, arg_min(p_name || ', ' || p_size, p_partkey) AS value, arg_min(p_type, p_partkey) AS info FROM part GROUP BY ALL
UNION ALL SELECT s_suppkey % 7, 'Img_' || s_suppkey || '_name', s_name, NULL FROM supplier UNION ALL SELECT s_suppkey % 7, 'Img_' || s_suppkey || '_step', CAST(s_suppkey % 8 AS VARCHAR), NULL FROM supplier"""
add("scan_params_csv", _params, PARAMS)
add(
    "sink_params_csv",
    lambda s, d: _params(s, d).where(F.col("key").startswith("Img_")).select("dataset", "key", tables.typed(F.col("value"), "int", -1).alias("number")),
    "SELECT s_suppkey % 7 AS dataset, 'Img_' || s_suppkey || '_name' AS key, -1 AS number FROM supplier UNION ALL SELECT s_suppkey % 7, 'Img_' || s_suppkey || '_step', CAST(s_suppkey % 8 AS INTEGER) FROM supplier",
)


def _table(s, d):
    path = folder(s, "table")
    rows = X.table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    tables.write_table(rows, path)
    return s.read.csv(path, header=True, schema=rows.schema)


add("sink_csv_table", _table, "SELECT c_custkey, c_name, c_acctbal FROM customer")
add("scan_image_files", lambda s, d: tables.scan_image_files(s, d, ("parquet",)).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length"))
