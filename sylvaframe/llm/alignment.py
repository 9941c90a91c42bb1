"""Alignment of two tokenizers' tokens by sparse products of token-byte incidence matrices.

Both tokenizers cut the same bytes. A slice of documents makes one incidence matrix for each tokenizer, with a row for each token
occurrence and a column for each byte, in compressed sparse rows built by hand. Row by row (Gustavson), A·Bᵀ
gives the pairs of occurrences that overlap, with the number of bytes they share. Bytes at which tokens of both end cut
the tokens into groups; products of token-group incidence matrices give the pairs that share a group.

Over the corpus, a pair of ids counts the documents that hold it linked. Each document's distinct pairs are written once as a table,
counted with a partial aggregation, and joined with the counts: by a broadcast up to a checked number of pairs, beyond it by a
shuffle in which the most frequent pairs (1,000 at most) are broadcast.

Null and empty texts, and texts whose joined token bytes differ from a space and the text, have no tokens. Long texts are
encoded whole. Repeated rows and repeated ids are documents of their own; an empty table gives an empty result; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm._common import ensure_checkpoint_dir, field, slices

_LONG_SPACE = regex.compile(r"\s{2000}")


@dataclass(frozen=True)
class Csr:
    """A sparse matrix: row i has the columns and values from indptr[i] to indptr[i + 1]."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    width: int

    @classmethod
    def of_lengths(cls, lengths: np.ndarray) -> Csr:
        """Each row has the next `length` columns."""
        indptr = offsets(lengths)
        n = int(indptr[-1])
        return cls(indptr, np.arange(n, dtype=np.int32), np.ones(n, np.int32), n)

    @classmethod
    def of_labels(cls, labels: np.ndarray, width: int) -> Csr:
        """Each row has one column: its label."""
        return cls(np.arange(len(labels) + 1, dtype=np.int32), labels.astype(np.int32), np.ones(len(labels), np.int32), width)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1, dtype=np.int32), np.diff(self.indptr))

    def transposed(self) -> Csr:
        indptr = offsets(np.bincount(self.indices, minlength=self.width))
        rows, data = self.rows(), self.data
        if (self.indices[1:] < self.indices[:-1]).any():
            order = np.argsort(self.indices, kind="stable")
            rows, data = rows[order], data[order]
        return Csr(indptr, rows, data, len(self.indptr) - 1)

    def part(self, first: int, last: int) -> Csr:
        a, b = self.indptr[first], self.indptr[last]
        return Csr(self.indptr[first : last + 1] - a, self.indices[a:b], self.data[a:b], self.width)


def offsets(sizes: np.ndarray) -> np.ndarray:
    """Where runs of the given sizes start, and where the last ends; a slice of texts is far below 2**31 bytes."""
    out = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=out[1:])
    return out


def row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """For each row of a·b the number of products that its row-wise product adds up (the symbolic phase)."""
    upto = np.concatenate([[0], np.cumsum(np.diff(b.indptr)[a.indices], dtype=np.int64)])
    return upto[a.indptr[1:]] - upto[a.indptr[:-1]]


def product(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of a·b: each row of a adds up the rows of b at its columns."""
    counts = np.diff(b.indptr)[a.indices]
    if (counts == 1).all():
        rows, at, scale = a.rows(), b.indptr[a.indices], a.data
    else:
        ends = np.cumsum(counts, dtype=np.int64)
        rows, scale = np.repeat(a.rows(), counts), np.repeat(a.data, counts)
        at = np.repeat(b.indptr[a.indices] - (ends - counts), counts) + np.arange(int(ends[-1]))
    columns, values = b.indices[at], scale * b.data[at]
    new = np.ones(len(rows), bool)
    np.not_equal(rows[1:], rows[:-1], out=new[1:])
    if (~new[1:] & (columns[1:] < columns[:-1])).any():
        order = np.lexsort((columns, rows))
        columns, values = columns[order], values[order]
    new[1:] |= columns[1:] != columns[:-1]
    first = np.flatnonzero(new)
    return rows[first], columns[first], np.add.reduceat(values, first) if len(first) else values


class LevelTokenizer:
    """Ids and token bytes of a byte-level tokenizers file.

    Texts of characters that no version of Unicode classes otherwise are encoded by tiktoken from the file's own vocabulary and merges
    (where its steps are those that tiktoken takes), others by the tokenizers library.
    """

    STEPS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        level = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(level[c] for c in token) if all(c in level for c in token) else token.encode()
        state = json.loads(self.library.to_str())
        model, added = state["model"], {t["content"] for t in state["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        ids = [vocabulary["".join(m)] for m in merges]
        plain = state["pre_tokenizer"] == self.STEPS and state["normalizer"] is None and model["type"] == "BPE" and not model["dropout"]
        plain = plain and ids == sorted(set(ids)) and all(vocabulary[t] < ids[0] for t in vocabulary if len(t) == 1)
        ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in added}
        self.fast = tiktoken.Encoding("level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain else None
        self.known: set[str] = set()
        self.other: set[str] = set()

    def settled(self, text: str) -> bool:
        """Whether all characters of a text are of the same class in the oldest and the newest Unicode tables at hand."""
        chars = set(text)
        for c in chars - self.known - self.other:
            kind = unicodedata.category(c)
            sure = c in "\t\n\r " or (kind[0] in "LNPS" and unicodedata.ucd_3_2_0.category(c) == kind)
            (self.known if sure else self.other).add(c)
        return chars <= self.known and not _LONG_SPACE.search(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        found: list[list[int] | None] = [self.fast.encode_ordinary(t) if self.fast and self.settled(t) else None for t in texts]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, x in zip(rest, self.library.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
            found[i] = x.ids
        return found


class PieceTokenizer:
    """Ids and token bytes of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Aligner:
    """Tokens of both tokenizers for a slice of documents, and what joins them."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = (LevelTokenizer(a_path), PieceTokenizer(b_path))
        self.lengths = [np.array([len(x) for x in side.bytes], np.int32) for side in self.sides]
        #: Decimal ids followed by nothing, a comma, a bar and a semicolon.
        self.written = [np.array([[f"{i}{end}" for i in range(len(side.bytes))] for end in ("", ",", "|", ";")], object) for side in self.sides]

    def tokens(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Both token lists of each text; empty where they don't spell a space and the text."""
        some = [i for i, t in enumerate(texts) if t]
        a, b = self.sides
        found: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        for i, x, y in zip(some, a.encode([" " + texts[i] for i in some]), b.encode([texts[i] for i in some])):
            data = b" " + texts[i].encode()
            if b"".join(map(a.bytes.__getitem__, x)) == data and b"".join(map(b.bytes.__getitem__, y)) == data:
                found[i] = (x, y)
        return found

    def aligned(self, texts: list[str | None]) -> Aligned:
        return Aligned(self, self.tokens(texts))


class Aligned:
    """A slice of documents: ids, matrices, groups and links. Tokens and groups are numbered over the slice."""

    def __init__(self, aligner: Aligner, tokens: list[tuple[list[int], list[int]]]):
        self.aligner, n = aligner, len(tokens)
        self.sizes = [np.array([len(t[side]) for t in tokens], np.int64) for side in (0, 1)]
        self.ids = [np.fromiter(chain.from_iterable(t[side] for t in tokens), np.int64, int(self.sizes[side].sum())) for side in (0, 1)]
        self.docs = [np.repeat(np.arange(n), size) for size in self.sizes]
        self.matrices = [Csr.of_lengths(length[ids]) for length, ids in zip(aligner.lengths, self.ids)]
        ends = [m.indptr[1:] for m in self.matrices]
        is_end, is_cut = (np.zeros(int(self.matrices[0].width) + 1, bool) for _ in range(2))
        is_end[ends[0]] = True
        cuts = ends[1][is_end[ends[1]]]
        is_cut[cuts] = True
        self.groups = [np.cumsum(is_cut[e]) - is_cut[e] for e in ends]  # the number of cuts before a token's end
        self.n_groups = np.bincount(self.docs[1][is_cut[ends[1]]], minlength=n)
        self.incidence = [Csr.of_labels(g, len(cuts)) for g in self.groups]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's occurrences that overlap, and by how many bytes."""
        a, b = self.matrices
        return product(a, b.transposed())

    def n_shared(self) -> np.ndarray:
        """For each document the number of pairs of occurrences that share a group."""
        a, b = self.incidence
        return np.bincount(self.docs[0], row_sizes(a, b.transposed()), minlength=len(self.sizes[0])).astype(np.int64)

    def shared(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A's and B's occurrences that share a group, some rows of the product at a time (about `most` pairs, one row at least)."""
        a, b = self.incidence[0], self.incidence[1].transposed()
        upto, first = np.cumsum(row_sizes(a, b)), 0
        while first < len(upto):
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + most, "right")))
            rows, columns, values = product(a.part(first, last), b)
            yield rows + first, columns, values
            first = last

    def written(self) -> list[str]:
        """Each document's groups: ids of A, a bar, ids of B, and a semicolon between groups."""
        parts, order = [], []
        doc_ends = [np.cumsum(s) for s in self.sizes]
        for side in (0, 1):
            group, ends = self.groups[side], np.full(len(self.groups[side]), 1)
            ends[np.append(group[1:] != group[:-1], True)[: len(group)]] = 2 + side
            if side:
                ends[doc_ends[1][self.sizes[1] > 0] - 1] = 0
            parts.append(self.aligner.written[side][ends, self.ids[side]])
            order.append(group * 2 + side)
        placed = np.concatenate(parts)[np.argsort(np.concatenate(order), kind="stable")].tolist()
        upto = [0, *(doc_ends[0] + doc_ends[1]).tolist()]
        return ["".join(placed[x:y]) for x, y in zip(upto, upto[1:])]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def link_table(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, batch_bytes: int) -> DataFrame:
    """A row for each document: its numbers, its groups as text, its distinct linked pairs of ids and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        wide = len(own.sides[1].bytes)
        for whole in batches:
            for batch in slices(whole, "text", batch_bytes):
                found = own.aligned(batch.column("text").to_pylist())
                n = batch.num_rows
                a, b, _ = found.links()
                pair, doc = found.ids[0][a] * wide + found.ids[1][b], found.docs[0][a]
                order = np.lexsort((pair, doc))
                pair, doc = pair[order], doc[order]
                first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1]))[: len(pair)])
                times = np.diff(np.append(first, len(pair)))
                upto = offsets(np.bincount(doc[first], minlength=n))
                lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x, kind)) for x, kind in ((pair[first], pa.int64()), (times, pa.int32()))]
                numbers = (found.sizes[0], found.sizes[1], found.n_groups, np.bincount(doc, minlength=n), found.n_shared())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("row"), *(pa.array(x, pa.int64()) for x in numbers), pa.array(found.written(), pa.string()), *lists],
                    ["id", "row", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "pairs", "times"],
                )

    narrow = docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"), docs[text_col].alias("text"))
    numbers = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_shared"))
    return narrow.mapInArrow(run, f"{field(narrow, 'id')}, row long, {numbers}, groups string, pairs array<long>, times array<int>")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, broadcast_rows: int = 1 << 20) -> DataFrame:
    """`id_col`, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_shared of each row.

    a_path: a byte-level tokenizers `.json`, which gets a space and the text; b_path: a sentencepiece `.model`, which adds that space.
    n_best: links whose pair is in as many documents as any pair of its A id. count_sum: the sum of its links' counts of documents.
    n_shared: pairs of occurrences that share a group. Up to broadcast_rows pairs of ids, their counts are broadcast.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    spark = docs.sparkSession
    found = link_table(docs, a_path, b_path, id_col, text_col, batch_bytes)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    place = f"{spark.sparkContext.getCheckpointDir()}/alignment-{uuid.uuid4().hex}"
    found.withColumn("groups_sha256", digest).drop("groups").write.parquet(place)
    found = spark.read.parquet(place)

    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.floor(F.col("pair") / F.lit(wide_of(b_path)))).checkpoint()
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")).checkpoint()
    linked = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    if counts.count() <= broadcast_rows:
        known = linked.join(F.broadcast(counts), "pair")
    else:
        hot = F.col("n") > counts.agg(F.sum("n")).first()[0] // 1000
        marked = linked.join(F.broadcast(counts.where(hot).withColumnsRenamed({"n": "hot_n", "best": "hot_best"})), "pair", "left")
        others = marked.where("hot_n is null").select("row", "pair", "times").join(counts.where(~hot), "pair")
        known = others.unionByName(marked.where("hot_n is not null").withColumnsRenamed({"hot_n": "n", "hot_best": "best"}))
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    numbers = found.select("id", "row", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return numbers.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def wide_of(b_path: str) -> int:
    """The number of B's ids: a pair is A's id times this and B's id."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def occurrences(docs: DataFrame, a_path: str, b_path: str, shared: bool = False, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 18) -> DataFrame:
    """`id_col`, a, b and weight: pairs of token places (from 0 in their document) that overlap by `weight` bytes, or that share a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for whole in batches:
            for batch in slices(whole, "text", batch_bytes):
                found = own.aligned(batch.column("text").to_pylist())
                starts = [np.cumsum(s) - s for s in found.sizes]
                for a, b, weight in found.shared(1 << 18) if shared else [found.links()]:
                    doc = found.docs[0][a]
                    places = (pa.array(a - starts[0][doc]), pa.array(b - starts[1][doc]), pa.array(weight, pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), *places], ["id", "a", "b", "weight"])

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, f"{field(narrow, 'id')}, a long, b long, weight long").withColumnRenamed("id", id_col)
