"""Byte-level BPE encoding and decoding with a rank file.

The merge loop keeps a rank queue: a bucket for each merge rank holds positions in the linked list of parts, and a
hierarchical bitmap over the ranks gives the lowest rank by find-first-set. A position whose pair has changed since
it was queued is stale and is skipped. A merge costs the same in a pre-token of any length. Short pre-tokens that
aren't remembered share one queue: their lists lie one after the other, and a bucket's merges are made together.

Nulls encode as empty texts (no ids). Repeated rows give repeated results; an empty table gives an empty result;
other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sylvaframe.llm._common import field, slices

#: A space between white space and white space or the end; only there a cut before a space could change the matches.
_RUN = regex.compile(r"\s (?:\s|\Z)")
_ENDS = (",", ".")


#: Bits of a bitmap word; two levels of such words serve 65,536 ranks.
WIDTH = 256
_BIT = [1 << i for i in range(WIDTH)]


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str, cache_entries: int = 240_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.byte_rank = [self.ranks[bytes([b])] for b in range(256)]
        self.byte_ids = np.array(self.byte_rank, np.int64)
        self.byte_pairs = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        self.leaves = [0] * (max(self.token) // WIDTH + 1)  # all 0 between merges
        self.pairs = dict(self.splits())
        self.pattern = regex.compile(pattern)
        self.source = pattern
        self.limit = cache_entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.end = {c: array("i", self.merge(c.encode())).tobytes() for c in _ENDS}
        tokens = [self.token.get(i, b"") for i in range(max(self.token) + 1)]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def splits(self) -> Iterator[tuple[int, int]]:
        """All pairs of neighbours that merge, and the rank of each: the ways to cut a token in two."""
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    yield a << 32 | b, rank

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. `root` has a bit for each word of `leaves` that isn't 0, a leaf one for each bucket."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        ids = [self.byte_rank[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known, leaves, bit = self.pairs.get, self.leaves, _BIT
        buckets: dict[int, list[int]] = {}
        pair, root = [-1] * n, 0  # pair: the rank of each position's merge with its successor
        for at in range(n - 1):
            if (rank := known(ids[at] << 32 | ids[at + 1], -1)) >= 0:
                pair[at] = rank
                if rank in buckets:
                    buckets[rank].append(at)  # in order, so a heap
                else:
                    buckets[rank] = [at]
                    leaves[rank >> 8] |= bit[rank & 255]
                    root |= 1 << (rank >> 8)
        while root:
            high = (root & -root).bit_length() - 1
            word = leaves[high]
            low = word & -word
            rank = high << 8 | low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                leaves[high] = word = word ^ low
                if not word:
                    root ^= 1 << high
            if pair[at] != rank:
                continue  # stale
            gone = after[at]
            ids[at], ids[gone], pair[gone] = rank, -1, -1
            nxt = after[at] = after[gone]
            prior = before[at]
            for left, right in ((at, nxt), (prior, at)):
                if left < 0:
                    continue
                if right == n:
                    pair[left] = -1
                    continue
                before[right] = left
                pair[left] = new = known(ids[left] << 32 | ids[right], -1)
                if new < 0:
                    continue
                if new in buckets:
                    heappush(buckets[new], left)
                else:
                    buckets[new] = [left]
                    leaves[new >> 8] |= bit[new & 255]
                    root |= 1 << (new >> 8)
        return [i for i in ids if i >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as 32-bit integers, of pre-tokens that aren't tokens themselves, by one queue for all.

        A pre-token's merges keep their order: its next pair leaves the queue when no lower rank is left anywhere, and
        of several pairs with one rank only its leftmost is merged before the queue is asked again.
        """
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        ids, pair = np.full(n + 1, -1), np.full(n + 1, -1)  # place n stands for either end
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ids[:n] = self.byte_ids[data]
        pair[: n - 1] = self.byte_pairs[data[:-1] << 8 | data[1:]]
        after[ends - 1], before[ends - sizes], pair[ends - 1] = n, n, -1
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        cuts = np.flatnonzero(np.diff(pair[order], prepend=-1))
        buckets = {int(pair[x[0]]): x.tolist() for x in np.split(order, cuts[1:]) if len(x)}
        leaves, bit, root = self.leaves, _BIT, 0
        for rank in buckets:
            leaves[rank >> 8] |= bit[rank & 255]
            root |= 1 << (rank >> 8)
        known = self.pairs.get
        while root:
            high = (root & -root).bit_length() - 1
            word = leaves[high]
            low = word & -word
            rank = high << 8 | low.bit_length() - 1
            at = np.array(buckets[rank])
            at = at[pair[at] == rank]  # the others are stale
            later: list[int] = []
            if len(at) > 1:
                at.sort()
                of = owner[at]
                same = of[1:] == of[:-1]
                if same.any():
                    first = np.concatenate([[True], ~same])
                    later, at = at[~first].tolist(), at[first]
            if later:
                buckets[rank] = later
            else:
                del buckets[rank]
                leaves[high] = word = word ^ low
                if not word:
                    root ^= 1 << high
            if not len(at):
                continue
            gone = after[at]
            nxt, prior = after[gone], before[at]
            ids[at], ids[gone], pair[gone], after[at] = rank, -1, -1, nxt
            before[nxt] = at
            left = np.concatenate([prior[prior < n], at])
            right = after[left]
            new = np.array([*map(known, (ids[left] << 32 | ids[right]).tolist(), repeat(-1))])
            new[right == n] = -1
            pair[left] = new
            merging = new >= 0
            for place, rank in zip(left[merging].tolist(), new[merging].tolist()):
                if rank in buckets:
                    buckets[rank].append(place)
                else:
                    buckets[rank] = [place]
                    leaves[rank >> 8] |= bit[rank & 255]
                    root |= 1 << (rank >> 8)
        alive = np.flatnonzero(ids[:n] >= 0)
        flat = ids[alive].astype(np.int32).tobytes()
        stops = (np.cumsum(np.bincount(owner[alive], minlength=len(pieces))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]

    def split(self, text: str) -> list[str]:
        """The pattern's matches. Characters that are newer than Python's Unicode tables are classed as tiktoken classes them."""
        if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in text):
            return self.pattern.findall(text)
        stand_in = "".join(newer(c) if unicodedata.category(c) == "Cn" else c for c in text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(stand_in)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as 32-bit integers.

        For the patterns of such rank files no match goes from a character other than white space into a following
        space, so each word with the space before it is encoded on its own and remembered for a while.
        """
        out: list[list[bytes | str]] = []
        new: dict[str, None] = {}  # units without ids: a word has its space before it, other units are split as they are
        for text in texts:
            if not text or "(?!\\S)" not in self.source or _RUN.search(text):
                parts: list[bytes | str] = self.split(text)
            else:
                words = text.split(" ")
                get = self.young.get
                parts = [words[0], *(get(w) or self.again(w) for w in words[1:])]
            new.update(dict.fromkeys(p for p in parts if p.__class__ is str))
            out.append(parts)
        found = self.resolve(list(new))
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return [b"".join([p if p.__class__ is bytes else found[p] for p in parts]) for parts in out]

    def again(self, word: str) -> bytes | str:
        """Remembered ids of a space and a word, else both as a unit. A last comma or full stop after a letter is a match of its own."""
        found = self.old.get(word)
        if found is not None:
            self.young[word] = found
        elif word[-1:] in _ENDS and word[-2:-1].isalpha():
            core = self.young.get(word[:-1]) or self.old.get(word[:-1])
            return " " + word if core is None else core + self.end[word[-1]]
        return " " + word if found is None else found

    def resolve(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units; those of a space and a word are remembered, without a last comma or full stop."""
        core = {u: u[:-1] if u[-1:] in _ENDS and u[:1] == " " and u[-2:-1].isalpha() else u for u in units}
        split = {u: [u] if u[:1] == " " and u[1:].isalpha() else self.split(u) for u in dict.fromkeys(core.values())}
        ids: dict[str, bytes] = {}
        short: list[str] = []
        for piece in {p for pieces in split.values() for p in pieces}:
            if piece[:1] == " " and (value := self.young.get(piece[1:]) or self.old.get(piece[1:])):
                ids[piece] = value
                continue
            data = piece.encode()
            if data in self.ranks or len(data) >= 64:
                ids[piece] = array("i", self.merge(data)).tobytes()
            else:
                short.append(piece)
        if short:
            ids.update(zip(short, self.merge_many([p.encode() for p in short])))
        found = {u: b"".join([ids[p] for p in pieces]) for u, pieces in split.items()}
        self.young.update((u[1:], value) for u, value in found.items() if u[:1] == " " and 1 < len(u) < 64)
        return {u: found[c] if c == u else found[c] + self.end[u[-1]] for u, c in core.items()}

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of some ids, joined."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)]


@cache
def _classes():
    import tiktoken

    one = {bytes([i]): i for i in range(256)}
    return [tiktoken.Encoding(k, pat_str=p, mergeable_ranks=one, special_tokens={}) for k, p in (("l", r"\p{L}"), ("n", r"\p{N}"))]


def newer(c: str) -> str:
    """A stand-in of the class that tiktoken's pattern engine gives a character: a letter, a digit or neither."""
    letter, number = _classes()
    return "a" if letter.encode_ordinary(c) else "1" if number.encode_ordinary(c) else "﷐"


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """`id_col` and ids (array<int>) of each row's whole text by the ranks in `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for batch in slices(whole, "text", batch_bytes):
                parts = own.encode([t or "" for t in batch.column("text").to_pylist()])
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), ids], ["id", "ids"])

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, f"{field(narrow, 'id')}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns `keep` and bytes (binary): the decoded ids of each row. Null ids decode as none."""
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out = [own.decode(np.asarray(x.values, np.int64)).tobytes() if x.is_valid else b"" for x in batch.column("ids")]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.binary())], [*names, "bytes"])

    narrow = encoded.select(*(encoded[c].alias(n) for c, n in zip(keep, names)), encoded[ids_col].alias("ids"))
    schema = ", ".join([*(field(narrow, n) for n in names), "bytes binary"])
    return narrow.mapInArrow(run, schema).toDF(*keep, "bytes")
