"""Packing documents into training sequences of several context sizes.

Each partition is packed as it streams, in rounds of a bounded number of tokens. A document's whole windows are
sequences of their own; what is left is routed to the tier (context size, a power of two) that it fits. Tiers are packed
from the longest: a window starts with the tier's longest piece, its gap is filled by the longest pieces that fit, from
its own and the shorter tiers, and what no piece fits is cut from the next longer one. A window without enough pieces
left waits for the next round; the last one of a partition is cut into full windows of the shorter powers of two, so
no sequence has padding. Sequences of one tier are dealt to steps of equal token counts, so that steps are alike in attention cost.

Nulls are empty texts and have the end id only. Repeated rows are packed each. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sylvaframe.llm._common import field, slices

#: The steps of a tokenizers file for which words are encoded apart: white space parts words, and within one the split is that of PARTS.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Letters beyond ASCII that stand for themselves under NFC, and whose lower case is one character.
_LETTERS = "".join(c for c in map(chr, range(0xC0, 0x180)) if c.isalpha() and len(c.lower()) == 1)
_PLAIN = re.compile(f"[!-&(-~{_LETTERS}]+")
_PARTS = re.compile(f"[a-z{_LETTERS}]+|[0-9]|[^a-z0-9{_LETTERS}]+")


class Encoder:
    """Ids by a tokenizers file, as packed 32-bit integers. Words are remembered up to a number of bytes.

    Words of ASCII and Latin letters, digits and marks go to the file's model by their parts; words of other characters and those
    with an apostrophe go through all steps of the library, and so does a whole text that holds a special string, or every text
    if the file's steps are others than _STEPS.
    """

    def __init__(self, path: str, memory_bytes: int = 80 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.specials = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.held = memory_bytes // 2, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        self.by_word = {k: steps[k] for k in _STEPS} == _STEPS and steps["model"]["type"] == "BPE"
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {ord(c): level.pre_tokenize_str(c)[0][0] for c in {x.lower() for x in _LETTERS}}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by the library, a few at a time: what it returns holds far more than the ids."""
        found: list[bytes] = []
        for i in range(0, len(texts), 2048):
            found += [np.array(x.ids, np.uint32).tobytes() for x in self.tokenizer.encode_batch(texts[i : i + 2048], add_special_tokens=False)]
        return found

    def learn(self, words: list[bytes]) -> None:
        """Puts the ids of new words, and of the parts they have, into the memory."""
        young, tokenize, table = self.young, self.model.tokenize, self.table
        before, added, odd = len(young), 0, []

        def ids_of(part: str) -> bytes:
            return array("I", [t.id for t in tokenize(part if part.isascii() else part.translate(table))]).tobytes()

        for w, text in zip(words, b"\n".join(words).decode().split("\n")):
            if not _PLAIN.fullmatch(text):
                odd.append(w)
            elif text.isalpha():
                young[w] = ids = ids_of(text.lower())
                added += len(w) + len(ids)
            else:
                found = []
                for part in _PARTS.findall(text.lower()):
                    key = part.encode()
                    ids = young.get(key)
                    if ids is None:
                        young[key] = ids = ids_of(part)
                        added += len(key) + len(ids)
                    found.append(ids)
                young[w] = ids = b"".join(found)
                added += len(w) + len(ids)
        for w, ids in zip(odd, self.whole([w.decode() for w in odd])):
            young[w] = ids
            added += len(w) + len(ids)
        self.held += added + 170 * (len(young) - before)  # two objects and an entry each

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        split: list[list[bytes] | None] = []
        missing: dict[bytes, None] = {}
        for text in texts:
            low = text.encode().lower()  # ASCII letters only, as the file's own step would
            if b"|>" in low and any(s in low for s in self.specials):
                split.append(None)
                continue
            words = low.split()
            for w in set(words).difference(self.young):
                found = self.old.get(w)
                if found is None:
                    missing[w] = None
                else:
                    self.young[w] = found
                    self.held += len(w) + len(found) + 170
            split.append(words)
        self.learn(list(missing))
        get = self.young.__getitem__
        found = [self.whole([t])[0] if words is None else b"".join(map(get, words)) for t, words in zip(texts, split)]
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        return found


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Pool:
    """Pieces by length; a bitmap over lengths gives the longest at most, or the shortest over, a size."""

    def __init__(self):
        self.bits = 0
        self.by_length: dict[int, list] = {}

    def put(self, length: int, piece) -> None:
        if length:
            self.by_length.setdefault(length, []).append(piece)
            self.bits |= 1 << length

    def take(self, length: int):
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
            self.bits ^= 1 << length
        return piece

    def longest(self, at_most: int) -> int:
        return (self.bits & ((2 << at_most) - 1)).bit_length() - 1 if self.bits else -1

    def shortest_over(self, size: int) -> int:
        over = self.bits >> (size + 1)
        return (over & -over).bit_length() + size if over else -1


class Packer:
    """Packs pieces (document, start, length); full sequences go to `done` as (tier, pieces)."""

    def __init__(self, window: int, lowest_tier: int):
        self.window, self.lowest = window, lowest_tier
        self.pool = Pool()
        self.done: list[tuple[int, list[tuple]]] = []

    def add(self, doc, length: int) -> None:
        full = length // self.window
        self.done += [(self.window, [(doc, i * self.window, self.window)]) for i in range(full)]
        self.pool.put(length - full * self.window, (doc, full * self.window))

    def fill(self) -> None:
        """Packs tiers from the longest; a window that can't be filled goes back to the pool, with what it has."""
        tier = self.window
        while tier >= 1:
            while (length := self.pool.longest(tier)) > (tier // 2 if tier > self.lowest else 0):
                pieces = [(*self.pool.take(length), length)]
                gap = tier - length
                while gap:
                    if (length := self.pool.longest(gap)) > 0:
                        pieces.append((*self.pool.take(length), length))
                        gap -= length
                    elif (length := self.pool.shortest_over(gap)) > 0:
                        doc, start = self.pool.take(length)
                        pieces.append((doc, start, gap))
                        self.pool.put(length - gap, (doc, start + gap))
                        gap = 0
                    else:
                        break
                if gap:  # the pool is empty: these are all that is left
                    for doc, start, length in pieces:
                        self.pool.put(length, (doc, start))
                    return
                self.done.append((tier, pieces))
            if tier <= self.lowest:
                return
            tier //= 2

    def finish(self) -> None:
        """The rest, as full windows of the shorter powers of two."""
        self.fill()
        rest = [(*piece, length) for length in sorted(self.pool.by_length, reverse=True) for piece in self.pool.by_length[length]]
        self.pool = Pool()
        total = sum(length for *_, length in rest)
        rest.reverse()
        while total:
            tier = min(self.window, 1 << total.bit_length() - 1)
            total -= tier
            pieces, gap = [], tier
            while gap:
                doc, start, length = rest.pop()
                pieces.append((doc, start, min(gap, length)))
                if length > gap:
                    rest.append((doc, start + gap, length - gap))
                gap -= min(gap, length)
            self.done.append((tier, pieces))


def steps(done: list[tuple[int, list[tuple]]], step_tokens: int) -> list[int]:
    """A step for each sequence: those of a tier go by attention cost, in turns, to steps of step_tokens."""
    out, first = [0] * len(done), 0
    for tier in sorted({t for t, _ in done}, reverse=True):
        own = sorted((i for i, (t, _) in enumerate(done) if t == tier), key=lambda i: -sum(n * n for *_, n in done[i][1]))
        n = -(-len(own) * tier // step_tokens)
        for k, i in enumerate(own):
            turn, place = divmod(k, n)
            out[i] = first + (place if turn % 2 == 0 else n - 1 - place)
        first += n
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = 4096,
    lowest_tier: int = 512,
    step_tokens: int = 1 << 17,
    round_tokens: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces: `id_col`, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, tier, step_id.

    window and lowest_tier are powers of two. sequence_id and step_id hold the partition in their upper half.
    """
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        packer, held, numbers = Packer(window, lowest_tier), 0, [TaskContext.get().partitionId() << 32] * 2

        def emit() -> Iterator[pa.RecordBatch]:
            order = steps(packer.done, step_tokens)
            rows = []
            for k, ((tier, pieces), step) in enumerate(zip(packer.done, order)):
                offset = 0
                for (doc, ids), start, length in pieces:
                    rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, numbers[0] + k, offset, tier, numbers[1] + step))
                    offset += length
            numbers[0] += len(packer.done)
            numbers[1] += max(order, default=-1) + 1
            packer.done = []
            for i in range(0, len(rows), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2048]), types)], [*names])

        types = None
        for whole in batches:
            types = [whole.schema.field("id").type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            for batch in slices(whole, "text", 1 << 20):
                for doc, ids in zip(batch.column("id").to_pylist(), own.encode([t or "" for t in batch.column("text").to_pylist()])):
                    ids += end
                    packer.add((doc, ids), len(ids) // 4)
                    held += len(ids) // 4
                if held > round_tokens:
                    packer.fill()
                    yield from emit()
                    held = 0
        packer.finish()
        if packer.done:
            yield from emit()

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"{field(narrow, 'id', id_col)}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_id long"
    return narrow.mapInArrow(run, schema)
