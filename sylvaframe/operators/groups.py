"""Functions over whole groups of rows, many small groups at a time, and tiles of pixels with their borders."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbers(table: pa.Table, by: list[str]) -> np.ndarray:
    """The number of each row's group, in rows sorted by the groups."""
    part = table.select(by).combine_chunks()
    while any(pa.types.is_struct(f.type) for f in part.schema):
        part = part.flatten()
    new = np.zeros(table.num_rows, bool)
    for column in part.columns:
        codes = pa.concat_arrays(column.chunks).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def whole_groups(rows: DataFrame, by: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, least: int = 20_000) -> DataFrame:
    """What `run` makes of tables that hold groups whole, with the number of each row's group.

    Rows are dealt and sorted by their group and stream through a task. A call for each group costs more than small groups do, so a table has
    `least` rows or more, cut where a group ends; a task holds no more than that, a group and a batch.
    """

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= least:
                table = pa.Table.from_batches(held)
                group = numbers(table, by)
                end = int(np.searchsorted(group, group[-1]))
                if end:
                    yield from run(table.slice(0, end).combine_chunks(), group[:end]).to_batches()
                    held, n = table.slice(end).combine_chunks().to_batches(), n - end
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from run(table, numbers(table, by)).to_batches()

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(stream, schema)


def parted(rows: DataFrame, most: int, by: tuple[str, ...] = ("box",)) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups that have at most `most`, and the others' (None without any)."""
    large = rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*by)
    if large.isEmpty():
        return rows, None
    return rows.join(large, [*by], "left_anti"), rows.join(large, [*by], "left_semi")


def halves_up(x: np.ndarray) -> np.ndarray:
    """Numbers rounded at the ninth place as Spark does: half a unit of their shortest decimal form goes up."""
    scaled = x * 1e9
    out = np.floor(scaled + 0.5) / 1e9
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def tiled(pixels: DataFrame, tile: int, reach: tuple[int, int] = (1, 1), lent: Column | None = None) -> DataFrame:
    """Pixels (x, y) with their tile (tx, ty) and own, and once more for each other tile that has pixels within `reach` of theirs (only those with `lent`)."""
    rx, ry = reach
    at = lambda c: F.floor(F.col(c) / tile)
    own = pixels.withColumns({"tx": at("x"), "ty": at("y"), "own": F.lit(True)})
    away = lambda c, r: (F.pmod(F.col(c), F.lit(tile)) < r) | (F.pmod(F.col(c), F.lit(tile)) >= tile - r)
    span = lambda c, r: F.sequence(F.floor((F.col(c) - r) / tile), F.floor((F.col(c) + r) / tile))
    rim = pixels.where(away("x", rx) | away("y", ry))
    rim = rim if lent is None else rim.where(lent)
    near = rim.withColumn("tx", F.explode(span("x", rx))).withColumn("ty", F.explode(span("y", ry)))
    return own.unionByName(near.where((F.col("tx") != at("x")) | (F.col("ty") != at("y"))).withColumn("own", F.lit(False)))
