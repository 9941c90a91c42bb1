"""Ranked lexical search over bit-sliced Bloom signatures, exact for the best k.

1. Each document gets a Bloom signature of its terms, whose width is a power of two in proportion to them. A term enters once for each
   level that its frequency reaches (1, 2, 4, 8). Documents of one width meet in blocks of bounded size, and a block is turned into slices: for
   each place of the signature a bitmap of its documents.
2. The slices of a term's places, joined by AND, hold all of its documents and a few others. A level bounds the frequency
   from above, so the weighted sum over a query's terms bounds each document's score from above.
3. The documents of the highest bounds are scored exactly; the k-th best of them is a score that the k best reach.
4. Every document whose bound reaches it is scored exactly from its whole text, and the k best remain.

Terms are runs of letters and digits of ASCII and of all characters beyond it, with A-Z lower-cased. Weights, lengths and scores are
64-bit integers. Queries are taken in blocks of bounded size, which the driver reads; their terms' document frequencies are counted over all
documents. Null texts have no terms. Documents without an id count in the statistics and are not ranked. Repeated rows are ranked each for
itself, and equal scores by the lesser id. Long texts are read whole; they get wider signatures, in blocks of fewer documents. Queries without
terms, an empty table of queries or of documents give no rows. Columns other than the ids and the texts are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.llm._common import ensure_checkpoint_dir, slices

#: Every byte that is no part of a term becomes a space; A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
LEVELS, PROBES, BITS = 4, 4, 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def places(hashes: np.ndarray, level: int, widths: np.ndarray | int) -> np.ndarray:
    """The places of terms' hashes on a level in signatures of the given widths: a column for each probe."""
    seeded = mixed(hashes + np.array([level], np.uint64) * _ODD)
    step = mixed(seeded) | np.uint64(1)
    probes = seeded[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]
    return (probes & (np.asarray(widths, np.uint64) - np.uint64(1)).reshape(-1, 1)).astype(np.int64)


class Signer:
    """Signatures of texts; hashes of terms are remembered for a while."""

    def __init__(self, entries: int = 200_000):
        self.entries, self.memory = entries, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.memory) > self.entries:
            self.memory.clear()
        get, found = self.memory.get, []
        for w in words:
            h = get(w)
            if h is None:
                h = self.memory[w] = xxhash.xxh3_64_intdigest(w)
            found.append(h)
        return np.array(found, np.uint64)

    def sign(self, texts: list[str | None]) -> tuple[list[int], list[int], list[int], list[bytes]]:
        """Of each text: its terms with repeats, its highest frequency, the width and the bits of its signature."""
        counted = [Counter(terms(t)) for t in texts]
        frequencies = np.array([f for c in counted for f in c.values()], np.int64)
        hashes = self.hashes([w for c in counted for w in c])
        doc = np.repeat(np.arange(len(texts)), [len(c) for c in counted])
        level = np.minimum(np.floor(np.log2(np.maximum(frequencies, 1))).astype(np.int64), LEVELS - 1)
        entries = np.bincount(doc, level + 1, minlength=len(texts)).astype(np.int64)
        widths = 1 << np.ceil(np.log2(np.maximum(entries * BITS, 64))).astype(np.int64)
        starts = np.cumsum(widths) - widths
        flags = np.zeros(int(widths.sum()), bool)
        for k in range(LEVELS):
            some = level >= k
            flags[(starts[doc[some]][:, None] + places(hashes[some], k, widths[doc[some]])).ravel()] = True
        packed = np.packbits(flags).tobytes()
        bits = [packed[a // 8 : (a + w) // 8] for a, w in zip(starts.tolist(), widths.tolist())]
        return [c.total() for c in counted], [max(c.values(), default=0) for c in counted], widths.tolist(), bits


def signatures(docs: DataFrame) -> DataFrame:
    """id, a hash of the text, n, its highest frequency, width and bits, for rows of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                n, most, widths, bits = signer.sign(batch.column("text").to_pylist())
                values = [batch.column("id"), batch.column("h"), *(pa.array(x, pa.int64()) for x in (n, most, widths)), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(values, ["id", "h", "n", "most", "width", "bits"])

    return docs.select("id", "h", "text").mapInArrow(run, "id long, h long, n long, most long, width long, bits binary")


INDEX = pa.schema([("width", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("ids", "hashes", "n", "most")), ("slices", pa.binary())])


def sliced(block: pa.Table) -> pa.Table:
    """One row for a block of documents: their lists, and for each place of the signature a bitmap of them."""
    width = block.column("width")[0].as_py()
    rows = np.frombuffer(b"".join(block.column("bits").to_pylist()), np.uint8).reshape(block.num_rows, width // 8)
    cut = [np.packbits(np.unpackbits(rows[:, a : a + 1024], axis=1).T, axis=1).tobytes() for a in range(0, width // 8, 1024)]
    row = {c: [block.column(k).to_pylist()] for c, k in (("ids", "id"), ("hashes", "h"), ("n", "n"), ("most", "most"))}
    return pa.table({"width": [width], **row, "slices": [b"".join(cut)]}, schema=INDEX)


def build_index(docs: DataFrame, block_rows: int, block_bits: int) -> tuple[DataFrame, DataFrame]:
    """The blocks, and one row of the number and the length of all documents with terms. Written once, under spark.checkpoint.dir."""
    spark = docs.sparkSession
    place = f"{spark.sparkContext.getCheckpointDir()}/signatures-{uuid.uuid4().hex}"
    signatures(docs).write.parquet(place)
    signed = spark.read.parquet(place).where("n > 0")
    totals = signed.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length"))
    rows = F.greatest(F.lit(64), F.least(F.lit(block_rows), F.floor(F.lit(block_bits) / F.col("width"))))
    blocks = signed.groupBy("width").agg(F.count("*").alias("rows")).select("width", F.ceil(F.col("rows") / rows).alias("blocks"))  # a row for each power of two
    dealt = signed.where("id is not null").join(F.broadcast(blocks), "width").withColumn("block", F.pmod(F.xxhash64("id", "h"), F.col("blocks")))
    made = dealt.select("id", "h", "n", "most", "width", "bits", "block").groupBy("width", "block").applyInArrow(sliced, "width long, ids array<long>, hashes array<long>, n array<long>, most array<long>, slices binary")
    made.write.parquet(f"{place}-index")
    return spark.read.parquet(f"{place}-index"), totals


@dataclass(frozen=True)
class Queries:
    """A block of queries: their ids, their terms as numbers, and what the terms weigh."""

    ids: list
    words: list[bytes]
    owned: list[np.ndarray]
    documents: int
    length: int
    weights: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list[tuple], documents: int, length: int) -> Queries:
        number: dict[bytes, int] = {}
        owned = [np.array(sorted({number.setdefault(w, len(number)) for w in terms(text)}), np.int64) for _, text in rows]
        return cls([i for i, _ in rows], list(number), owned, documents, length)

    def weighted(self, frequency: dict[int, int]) -> Queries:
        weights = [math.floor(1000 * math.log((2 * self.documents + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(self.words))]
        return Queries(self.ids, self.words, self.owned, self.documents, self.length, np.array(weights, np.int64))

    @cached_property
    def number(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def lengths(self, n: np.ndarray) -> np.ndarray:
        return 50 + 50 * n * self.documents // self.length

    def impacts(self, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 20 * m)

    def bounds(self, row: dict, group: range) -> np.ndarray:
        """Upper bounds of the scores of a block's documents (columns) for some of the queries (rows)."""
        n, most = (np.array(row[c], np.int64) for c in ("n", "most"))
        bitmaps = np.frombuffer(row["slices"], np.uint8).reshape(row["width"], -1)
        own = np.unique(np.concatenate([self.owned[i] for i in group]))
        hashes = np.array([xxhash.xxh3_64_intdigest(self.words[t]) for t in own], np.uint64)
        m, bound, held = self.lengths(n), np.zeros((len(own), len(n)), np.int64), None
        for level in range(LEVELS):
            found = np.bitwise_and.reduce(bitmaps[places(hashes, level, row["width"])], axis=1)
            held = found if held is None else held & found
            tf = np.minimum(most, 2 ** (level + 1) - 1) if level < LEVELS - 1 else most
            np.copyto(bound, self.impacts(tf, m)[None, :], where=np.unpackbits(held, axis=1, count=len(n)).astype(bool))
        bound *= self.weights[own][:, None]
        return np.stack([bound[np.searchsorted(own, self.owned[i])].sum(0) for i in group])

    def scores(self, text: str | None, items: np.ndarray) -> np.ndarray:
        """The exact scores of a text for some of the queries."""
        found = Counter(words := terms(text))
        tf, get = np.zeros(len(self.words), np.int64), self.number.get
        for w, f in found.items():
            if (t := get(w)) is not None:
                tf[t] = f
        parts = self.weights * self.impacts(tf, self.lengths(np.array(len(words))))
        return np.array([parts[self.owned[i]].sum() for i in items], np.int64)


def document_frequencies(docs: DataFrame, queries: Queries) -> dict[int, int]:
    """How many documents hold each of the queries' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = Counter(), queries.number
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total.update(known.keys() & set(terms(text)))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([known[w] for w in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return {r["term"]: r["n"] for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def reaching(index: DataFrame, queries: Queries, least: dict[int, int], most: int | None) -> DataFrame:
    """item, id, h and bound of the documents whose bound is at least `least` of the item (1 where it has none); of a block the `most` highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, hashes = (np.array(row[c], np.int64) for c in ("ids", "hashes"))
                some = [i for i, own in enumerate(queries.owned) if len(own)]
                for start in range(0, len(some), 64):
                    group = some[start : start + 64]
                    bounds = queries.bounds(row, group)
                    cut = np.array([least.get(i, 1) for i in group], np.int64)
                    if most is not None and most < len(ids):
                        cut = np.maximum(cut, np.partition(bounds, len(ids) - most, axis=1)[:, len(ids) - most])
                    i, d = np.nonzero(bounds >= cut[:, None])
                    values = (np.array(group)[i], ids[d], hashes[d], bounds[i, d])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in values], ["item", "id", "h", "bound"])

    return index.mapInArrow(run, "item long, id long, h long, bound long")


def rescored(docs: DataFrame, candidates: DataFrame, queries: Queries, broadcast_rows: int) -> DataFrame:
    """item, id and score (over 0) of candidates (item, id, h), from whole texts. Candidates are broadcast up to broadcast_rows pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                items = [np.array(x, np.int64) for x in batch.column("items").to_pylist()]
                scores = [queries.scores(t, x) for t, x in zip(batch.column("text").to_pylist(), items)]
                score, item = np.concatenate([np.zeros(0, np.int64), *scores]), np.concatenate([np.zeros(0, np.int64), *items])
                ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(items)), [len(x) for x in items])))
                keep = pa.array(score > 0)
                yield pa.RecordBatch.from_arrays([pa.array(item).filter(keep), ids.filter(keep), pa.array(score).filter(keep)], ["item", "id", "score"])

    small = candidates.count() <= broadcast_rows
    wanted = candidates.groupBy("id", "h").agg(F.collect_set("item").alias("items"))  # as many as there are queries in a block at most
    found = docs.join(F.broadcast(wanted) if small else wanted, ["id", "h"]).select("id", "text", "items")
    return found.mapInArrow(run, "item long, id long, score long")


def rank(
    items: DataFrame,
    docs: DataFrame,
    k: int = 50,
    item_col: str = "item_id",
    id_col: str = "doc_id",
    text_col: str = "text",
    item_block: int = 1024,
    block_rows: int = 2048,
    block_bits: int = 1 << 25,
    broadcast_rows: int = 1 << 20,
) -> DataFrame:
    """`item_col`, rank (from 1), `id_col` and score: each query's k documents of the highest scores over 0.

    Ids of documents are integers. item_block: about so many queries are taken at a time. An index block has block_rows documents and
    block_bits bits at most, about, but 64 documents at least are wanted. Rows of one id and text are one query.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    docs = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    index, totals = build_index(docs, block_rows, block_bits)
    documents, length = totals.first()
    asked = items.select(items[item_col].alias("item_id"), F.coalesce(items[text_col], F.lit("")).alias("text")).distinct()
    n_blocks = max(1, math.ceil(asked.count() / item_block))
    best_first = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    results = []
    for number in range(n_blocks):
        rows = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == number).orderBy("item_id", "text").collect()]
        queries = Queries.of(rows, documents, length)
        if not queries.words or not documents:
            continue
        queries = queries.weighted(document_frequencies(docs, queries))
        first = 4 * k // max(1, index.count()) + 4
        highest = Window.partitionBy("item").orderBy(F.desc("bound"), "id", "h")
        likely = reaching(index, queries, {}, first).withColumn("n", F.row_number().over(highest)).where(F.col("n") <= 2 * k).drop("n", "bound").checkpoint()
        scored = rescored(docs, likely, queries, broadcast_rows).withColumn("n", F.row_number().over(best_first)).where(F.col("n") == k)
        least = {r["item"]: r["score"] for r in scored.select("item", "score").collect()}
        candidates = reaching(index, queries, least, None).drop("bound").checkpoint()
        found = rescored(docs, candidates, queries, broadcast_rows).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
        names = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(queries.ids)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        results.append(found.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    if not results:
        kind = asked.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"`{item_col}` {kind}, rank int, `{id_col}` long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
