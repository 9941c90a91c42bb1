"""Exact top-k search by inner product, with a three-phase uniform threshold.

Components are rounded down to integers, so scores are exact. A vector is held as a few segments of its components, and a
segment's partial scores of a query form one list. Blocks of queries meet blocks of candidates, in two passes with three phases:

1. each list of a block sends its best k entries; their exact scores give each query a safe cutoff, which at least k candidates reach;
2. the cutoff goes back to the blocks. With partial scores counted from each list's least one, a candidate that reaches the
   cutoff has a partial score of at least the cutoff's even share in some list: all entries above that share are collected;
3. what other lists add is in the same block, so the collected entries are scored exactly there, and only the block's best k
   that reach the cutoff leave it.

No group holds more than a block of queries and one of candidates. Of equal vectors in a block only those of the k + 1
least ids can be among the best k, and only they are scored.

Null vectors and vectors with null, NaN or infinite components take no part, nor do null ids. Shorter vectors count as
padded by zeros. Rows that repeat an id are candidates of their own, but for queries of that id; as queries they share
k results. Fewer candidates than k give fewer rows; an empty table
gives an empty result. Components beyond 2**31 in size are outside the contract. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.llm._common import ensure_checkpoint_dir


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and v (array<long>) of the vectors that take part."""
    values = F.col("v")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & values.isNotNull() & finite)
    return rows.select("id", F.transform(values, lambda x: F.floor(x * scale)).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, padded by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    flat = column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    for row, start, size in zip(out, np.cumsum(sizes) - sizes, sizes):
        row[:size] = flat[start : start + size]
    return out


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where no sum can pass 2**53."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), np.int64)
    if float(np.abs(queries).max()) * float(np.abs(candidates).max()) * queries.shape[1] < 2.0**53:
        return (queries.astype(np.float64) @ candidates.T.astype(np.float64)).astype(np.int64)
    return queries @ candidates.T


def first_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows in the order of ids, of equal vectors those of the k + 1 least ids, and of each id k of them."""
    order = np.argsort(ids, kind="stable")
    _, which = np.unique(vectors[order], axis=0, return_inverse=True)
    which, own = which.ravel(), ids[order]
    by = np.argsort(which, kind="stable")
    new_vector = np.diff(which[by], prepend=-1) != 0
    new_id = new_vector | (np.diff(own[by], prepend=own[by[0]]) != 0)
    count = lambda starts, ends: np.cumsum(starts) - np.repeat(np.cumsum(starts)[ends], np.diff(np.append(ends, len(by))))
    id_place = count(new_id, np.flatnonzero(new_vector))
    copy_place = count(np.ones(len(by), np.int64), np.flatnonzero(new_id))
    keep = np.zeros(len(by), bool)
    keep[by] = (id_place <= k) & (copy_place < k)
    return order[keep]


@dataclass(frozen=True)
class Layout:
    """What the passes need to know of the vectors: k, their width and where the segments are cut."""

    k: int
    width: int
    cuts: tuple[int, ...]

    def load(self, queries: pa.Table, candidates: pa.Table):
        """Ids and segments of both sides; candidates by id, copies that can't be among the best k left out."""
        ids, vectors = candidates.column("id").to_numpy(), matrix(candidates.column("v"), self.width)
        keep = first_copies(ids, vectors, self.k) if len(ids) else np.arange(0)
        split = [slice(a, b) for a, b in zip(self.cuts, self.cuts[1:])]
        own = matrix(queries.column("v"), self.width)
        return queries.column("id").to_numpy(), ids[keep], [own[:, s] for s in split], [vectors[keep][:, s] for s in split]


class Blocks:
    """Pairs of a query block and a candidate block, and the passes over them."""

    def __init__(self, rows: DataFrame, is_query: Column, k: int, segments: int, width: int, query_block: int, candidate_block: int):
        n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
        self.segments = segments
        self.layout = Layout(k, width, tuple(np.linspace(0, width, segments + 1).astype(int).tolist()))
        qb, cb = n_queries // query_block + 1, n // candidate_block + 1
        apart = [F.col(c).alias(c) for c in ("id", "v")]  # columns of their own, as both sides of a cogroup stem from the same rows
        self.queries = rows.where(is_query).select(*apart).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(qb)))
        candidates = rows.select(*apart).withColumn("cb", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(cb)))
        self.candidates = candidates.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long"))))
        self.each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cb - 1).cast("long")))

    def run(self, queries: DataFrame, fn, schema: str) -> DataFrame:
        left = queries.withColumn("cb", self.each).groupBy("qb", "cb")
        return left.cogroup(self.candidates.groupBy("qb", "cb")).applyInArrow(fn, schema)

    def best_lists(self) -> DataFrame:
        """Phase 1: each list's best k entries of a block, with their exact scores, and its least partial score."""
        schema = pa.schema([("query_id", pa.int64()), ("segment", pa.int32()), ("least", pa.int64()), ("entries", pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())])))])

        layout, k = self.layout, self.layout.k

        def fn(queries: pa.Table, candidates: pa.Table) -> pa.Table:
            q, c, qs, cs = layout.load(queries, candidates)
            parts = [products(a, b) for a, b in zip(qs, cs)]
            rows = []
            for i, query in enumerate(q.tolist()):
                own = c != query
                for s, part in enumerate(parts):
                    if not own.any():
                        continue
                    value = np.where(own, part[i], np.iinfo(np.int64).min)
                    top = np.argpartition(-value, k - 1)[:k] if len(value) > k else np.arange(len(value))
                    top = top[own[top]]
                    score = sum(other[i, top] for other in parts)
                    entries = [{"id": x, "score": y} for x, y in zip(c[top].tolist(), score.tolist())]
                    rows.append({"query_id": query, "segment": s, "least": int(part[i][own].min()), "entries": entries})
            return pa.Table.from_pylist(rows, schema=schema)

        return self.run(self.queries, fn, "query_id long, segment int, least long, entries array<struct<id:long,score:long>>")

    def resolved(self, queries: DataFrame) -> DataFrame:
        """Phases 2 and 3: the entries of at least the query's share in some list, and of those the best k that reach the cutoff."""
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

        layout, segments = self.layout, self.segments

        def fn(queries: pa.Table, candidates: pa.Table) -> pa.Table:
            q, c, qs, cs = layout.load(queries, candidates)
            share, cutoff = matrix(queries.column("shares"), segments), queries.column("cutoff").to_numpy()
            parts = [products(a, b) for a, b in zip(qs, cs)]
            collected = np.zeros((len(q), len(c)), bool)
            for s, part in enumerate(parts):
                collected |= part >= share[:, s : s + 1]
            i, j = np.nonzero(collected & (q[:, None] != c[None, :]))
            score = sum((part[i, j] for part in parts), np.zeros(len(i), np.int64))
            reach = score >= cutoff[i]
            i, j, score = i[reach], j[reach], score[reach]
            order = np.lexsort((c[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            best = place < layout.k
            return pa.table([q[i[best]], c[j[best]], score[best]], schema=schema)

        return self.run(queries, fn, "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    segments: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = 2048,
    candidate_block: int = 8192,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k best other vectors, equal scores by the lesser id.

    is_query: a condition on a column `id`.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = quantized(vectors, id_col, vector_col, scale).checkpoint()
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    blocks = Blocks(rows, is_query, k, max(1, min(segments, width)), width, query_block, candidate_block)
    m = blocks.segments

    lists = blocks.best_lists().checkpoint()
    gathered = lists.select("query_id", F.explode("entries").alias("e")).select("query_id", F.col("e.id").alias("vec_id"), F.col("e.score").alias("score")).distinct()
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoff = gathered.withColumn("n", F.row_number().over(best_first)).where(F.col("n") <= k).groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("found"))
    least = lists.groupBy("query_id", "segment").agg(F.min("least").alias("least")).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("segment", "least"))), lambda x: x["least"]).alias("least")
    )
    known = least.join(cutoff, "query_id")
    floor = F.aggregate("least", F.lit(0).cast("long"), lambda a, x: a + x)
    # Fewer gathered than k: every candidate is a result, and the share is each list's least entry.
    share = F.when(F.col("found") < k, F.lit(0).cast("long")).otherwise(F.expr(f"(cutoff - bottom) div {m}"))
    known = known.withColumn("bottom", floor).withColumn("shares", F.transform("least", lambda x: x + F.greatest(share, F.lit(0).cast("long")))).checkpoint()

    queries = blocks.queries.join(known.select(F.col("query_id").alias("id"), "shares", "cutoff"), "id")
    scored = blocks.resolved(queries)
    return scored.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
