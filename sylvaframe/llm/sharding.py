"""Sharding by a minimax contiguous partition.

Rows with equal texts form an atomic group, and the groups stand in the order of a 64-bit hash. The smallest shard
capacity for which a greedy pass needs no more than the wanted shards is found by binary search, and the order is cut
where that pass cuts.

The order is not gathered. The driver holds sums of a few thousand hash cells; while the search can't tell two
capacities apart by them, only the cells in which a cut may lie are summed again at 256 times the resolution. It ends
with the exact minimax capacity over single groups, after a number of passes that grows with the logarithm of the rows.

Nulls are texts without bytes and form one group with empty texts. Repeated rows stay together and get slots of their
own. An empty table gives an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.llm._common import ensure_checkpoint_dir

#: Bits of the first cells, and of each further division of a cell.
FIRST_BITS, STEP_BITS = 12, 8


@dataclass(frozen=True)
class Cell:
    """Neighbouring groups: their first and last hash, the sum of their sizes, and the bits of the hash they share."""

    first: int
    last: int
    size: int
    bits: int

    @property
    def single(self) -> bool:
        return self.first == self.last


def greedy(cells: list[Cell], starts: list[int], capacity: int, shards: int, fluid: bool) -> list[int] | None:
    """Offsets at which a greedy pass cuts, None if it needs more shards.

    fluid: cells of several groups may be cut anywhere, which never needs more shards than the true groups do;
    else cells stay whole, which never needs fewer.
    """
    total = starts[-1]
    at, cuts = 0, []
    for _ in range(shards):
        if total - at <= capacity:
            return cuts
        i = bisect_right(starts, at + capacity) - 1  # the cell in which the capacity ends
        if fluid and not cells[i].single:
            at += capacity
        else:
            if starts[i] <= at:
                return None
            at = starts[i]
        cuts.append(at)
    return None


def smallest(cells: list[Cell], starts: list[int], shards: int, fluid: bool) -> int:
    """The smallest capacity that is feasible for a kind of cells, by binary search."""
    low, high = 0, starts[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy(cells, starts, middle, shards, fluid) is None:
            low = middle + 1
        else:
            high = middle
    return low


def undecided(cells: list[Cell], shards: int) -> tuple[int, list[Cell], list[int]]:
    """Lower bound of the capacity, the cells that hide the exact one, and the first hashes of all shards but one.

    Where no cell hides anything, the capacity is exact.
    """
    starts = [0]
    for c in cells:
        starts.append(starts[-1] + c.size)
    low, high = (smallest(cells, starts, shards, fluid) for fluid in (True, False))
    firsts = [cells[bisect_right(starts, at) - 1].first for at in greedy(cells, starts, high, shards, False) or []]
    hiding: dict[Cell, None] = {}
    if low < high:
        for a, b in zip(bounds(cells, starts, low, shards, False), bounds(cells, starts, high, shards, True)):
            for i in range(bisect_right(starts, a) - 1, min(bisect_right(starts, b), len(cells))):
                if not cells[i].single:
                    hiding[cells[i]] = None
    return low, list(hiding), firsts


def bounds(cells: list[Cell], starts: list[int], capacity: int, shards: int, fluid: bool) -> list[int]:
    """Offsets that the true pass's cuts don't go below (whole cells) or above (fluid ones)."""
    at, cuts = 0, []
    for _ in range(shards - 1):
        i = bisect_right(starts, at + capacity) - 1
        inside = fluid and i < len(cells) and not cells[i].single
        at = at + capacity if inside else max(at, starts[i])
        cuts.append(at)
    return cuts


def sums(rows: DataFrame, key: Column, bits: int) -> list[Cell]:
    found = rows.groupBy(key.alias("cell")).agg(F.min("hash").alias("first"), F.max("hash").alias("last"), F.sum("size").alias("size"))
    return sorted((Cell(r["first"], r["last"], r["size"], bits) for r in found.collect()), key=lambda c: c.first)


def minimax_firsts(rows: DataFrame, shards: int) -> list[int]:
    """First hashes of all shards but the first, for rows of hash and size."""
    cells = sums(rows, F.shiftright("hash", 64 - FIRST_BITS), FIRST_BITS)
    while True:
        _, hiding, firsts = undecided(cells, shards)
        if not hiding:
            return firsts
        finer: list[Cell] = []
        for bits in sorted({c.bits for c in hiding}):
            prefixes = [c.first >> (64 - bits) for c in hiding if c.bits == bits]
            more = min(64, bits + STEP_BITS)
            some = rows.where(F.shiftright("hash", 64 - bits).isin(prefixes))
            finer += sums(some, F.shiftright("hash", 64 - more) if more < 64 else F.col("hash"), more)
        gone = set(hiding)
        cells = sorted([c for c in cells if c not in gone] + finer, key=lambda c: c.first)


def at_or_after(hash_col: Column, firsts: Iterable[int]) -> Column:
    """How many of the cuts lie at or before a hash: the shard."""
    return sum((F.when(hash_col >= F.lit(f), 1).otherwise(0) for f in firsts), F.lit(0)).cast("int")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", rows_per_slot_block: int = 10_000) -> DataFrame:
    """`id_col`, size (UTF-8 bytes and 1), text_crc32, shard (from 0) and slot (gapless from 0 in each shard).

    The largest shard is as small as it can be for shards that are runs of whole groups in hash order.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        docs[id_col].alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    ).checkpoint()
    dealt = rows.withColumn("shard", at_or_after(F.col("hash"), minimax_firsts(rows, shards)))
    blocks = rows.count() // rows_per_slot_block // shards + 1
    return with_slots(dealt, blocks).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def with_slots(dealt: DataFrame, blocks: int) -> DataFrame:
    """Adds the slot: each shard's rows are numbered in blocks by a hash of the id, and the blocks one after the other."""
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "size", "hash"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "hash"))
    return dealt.withColumn("within", within).join(offsets, ["shard", "block"]).withColumn("slot", F.col("offset") + F.col("within") - 1)
