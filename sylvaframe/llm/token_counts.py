"""Token counts of whole texts.

Texts go to the tokenizer library in batches balanced by bytes, and only the lengths come back. A long text is
split where no vocabulary piece can span the cut, so that the counts of its parts add up to the count of the whole.

Nulls count as empty texts (0 bytes, 0 tokens). Repeated rows give repeated results; an empty table gives an empty
result; columns other than the id and the text are neither read nor returned.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sylvaframe.llm._common import field, slices


class PieceCounter:
    """Counts by a sentencepiece model."""

    def __init__(self, model: str, chunk_bytes: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk = chunk_bytes
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.known = {p for p in pieces if len(p) == 1}
        # A character of no piece: put before a later part, it takes the model's leading space and joins with nothing.
        self.guard = next(c for c in map(chr, range(0x378, 0x10000)) if not any(c in p for p in pieces))
        self.guard_tokens = len(self.sp.encode(self.guard))
        # Rules that rewrite text could reach over a cut; a model that has any gets whole texts.
        plain = "ﬁ ①  é a"
        self.splits = self.sp.decode(self.sp.encode(plain)) == plain

    def safe(self, a: str, b: str) -> bool:
        """Whether no piece holds `ab` and both are characters of the vocabulary, so a cut between them changes nothing."""
        a, b = a.replace(" ", "▁"), b.replace(" ", "▁")
        return a + b not in self.inside and a in self.known and b in self.known

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """The text in parts of about the chunk size, where there is no safe cut a longer one, and how many tokens of each are its guard's."""
        start = 0
        while self.splits and len(text) - start > self.chunk:
            at = next((i for i in range(start + self.chunk, start + self.chunk // 2, -1) if self.safe(text[i - 1], text[i])), 0)
            at = at or next((i for i in range(start + self.chunk, len(text)) if self.safe(text[i - 1], text[i])), 0)
            if not at:
                break
            yield self.guarded(text[start:at], start)
            start = at
        yield self.guarded(text[start:], start)

    def guarded(self, part: str, start: int) -> tuple[str, int]:
        return (self.guard + part, self.guard_tokens) if start else (part, 0)

    def lengths(self, parts: list[tuple[str, int]]) -> list[int]:
        return [len(ids) - extra for ids, (_, extra) in zip(self.sp.encode([p for p, _ in parts], num_threads=1), parts)]


class FileCounter:
    """Counts by a tokenizers file; texts stay whole, as its steps can reach over any cut."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        yield text, 0

    def lengths(self, parts: list[tuple[str, int]]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch([p for p, _ in parts], add_special_tokens=False)]


@cache
def counter(model: str, chunk_bytes: int) -> PieceCounter | FileCounter:
    return FileCounter(model) if model.endswith(".json") else PieceCounter(model, chunk_bytes)


def batched(parts: Iterable[tuple[int, tuple[str, int]]], limit: int) -> Iterator[list[tuple[int, tuple[str, int]]]]:
    """Lists of texts' numbers and parts, with about `limit` characters at most."""
    held, size = [], 0
    for number, part in parts:
        if held and size + len(part[0]) > limit:
            yield held
            held, size = [], 0
        held.append((number, part))
        size += len(part[0])
    if held:
        yield held


def count_tokens(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, chunk_bytes: int = 1 << 16
) -> DataFrame:
    """`id_col`, n_bytes (UTF-8) and n_tokens of each row's whole text, without added special tokens.

    model: path of a sentencepiece `.model` or a tokenizers `.json`, readable on the executors.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model, chunk_bytes)
        for whole in batches:
            for batch in slices(whole, "text", 4 * batch_bytes):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                totals = np.zeros(len(texts), np.int64)
                for some in batched(((i, p) for i, t in enumerate(texts) for p in own.parts(t)), batch_bytes):
                    np.add.at(totals, [i for i, _ in some], own.lengths([p for _, p in some]))
                n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id"), n_bytes, pa.array(totals)], ["id", "n_bytes", "n_tokens"])

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(count, f"{field(narrow, 'id')}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
