"""Similarity join of documents by the Jaccard coefficient of their word n-gram sets.

1. Each whole text gets a MinHash signature; rows of the signature form bands whose number and width are chosen for a
   target recall at the threshold. Equal texts are one class from here on, with its least id as representative.
2. Representatives are shuffled on band hashes. Within a bucket, signatures are compared in blocks and a spanning forest of
   plausible pairs is kept; the forests' components hold all pairs that may reach the threshold.
3. A component's documents meet in blocks of bounded size that are dealt over the cluster. Within a block, documents that have a
   plausible partner there are verified on their full n-gram sets. A block gives each document's number of links and a
   spanning forest of its links, not the pairs.

Words are what ASCII white space separates, in lower case. A text of fewer words than an n-gram has one n-gram, of all
its words; one without words has none and links with equal texts only. Null texts are empty. Rows without an id get no
class. Ids are integers; rows that repeat one with other texts are documents of their own, which the representative's id doesn't tell
apart. Long texts count whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm._common import ensure_checkpoint_dir, slices
from sylvaframe.llm.components import connected_components

_MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """Bands and rows: the widest bands that reach the recall at the threshold within most_hashes."""
    for rows in range(most_hashes, 0, -1):
        p = threshold**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of n-gram hashes; hashes of words are remembered for a while."""

    def __init__(self, n: int, entries: int = 120_000):
        self.n, self.entries, self.memory = n, entries, {}
        self.powers = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    def grams(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of a text's n-grams."""
        words = (text or "").lower().encode().split()
        get = self.memory.get
        codes = [get(w) for w in words]
        if None in codes:
            if len(self.memory) > self.entries:
                self.memory.clear()
            for i, (w, code) in enumerate(zip(words, codes)):
                if code is None:
                    codes[i] = self.memory[w] = xxhash.xxh3_64_intdigest(w)
        x = np.array(codes, np.uint64)
        n = min(self.n, len(x))
        if not n:
            return x
        total = np.zeros(len(x) - n + 1, np.uint64)
        for k in range(n):
            total += x[k : len(x) - n + 1 + k] * self.powers[k]
        return np.unique(mix(total))


class Signer:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        seeds = np.arange(1, bands * rows + 1, dtype=np.uint64)
        self.factors = mix(seeds * np.uint64(7919)) | np.uint64(1)
        self.powers = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def sign(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max)
        for i in range(0, len(grams), 2048):
            np.minimum(least, (grams[i : i + 2048, None] * self.factors).min(0), out=least)
        return least

    def band_hashes(self, least: np.ndarray) -> np.ndarray:
        joined = (least.reshape(self.bands, self.rows) * self.powers).sum(1, dtype=np.uint64)
        return mix(joined + np.arange(self.bands, dtype=np.uint64) * _MIX).view(np.int64)


def sketches(docs: DataFrame, signer: Signer, n: int) -> DataFrame:
    """id, two hashes of the text, the number of n-grams, a signature of 16 bits a row and the band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                sizes, signs, bands = [], [], []
                for text in batch.column("text").to_pylist():
                    grams = shingler.grams(text)
                    least = signer.sign(grams)
                    sizes.append(len(grams))
                    signs.append((mix(least) >> np.uint64(48)).astype("<u2").tobytes())
                    bands.append(signer.band_hashes(least) if len(grams) else None)
                values = [*(batch.column(c) for c in ("id", "h1", "h2")), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(values, ["id", "h1", "h2", "grams", "signature", "bands"])

    narrow = docs.select(
        docs["id"].cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h1"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("h2"), "text"
    )
    return narrow.mapInArrow(run, "id long, h1 long, h2 long, grams long, signature binary, bands array<long>")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys, which stand together, as one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def blocked(rows: DataFrame, key: str, chunks: str) -> DataFrame:
    """Deals the rows of a key to blocks: each pair of its chunks meets in the block (low, high) once."""
    own = F.pmod(F.xxhash64("id"), F.col(chunks))
    other = F.sequence(F.lit(0).cast("long"), F.col(chunks) - 1)
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(other))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", chunks)
    return dealt.repartition(F.col(key), F.col("low"), F.col("high")).sortWithinPartitions(key, "low", "high", "id")


def sides(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block without repeated ids; positions of its left and of its right chunk (the same in a diagonal block)."""
    ids = block.column("id").to_numpy()
    _, rows = np.unique(ids, return_index=True)
    low, high = block.column("low")[0].as_py(), block.column("high")[0].as_py()
    own = block.column("own").to_numpy()[rows]
    return rows, np.flatnonzero(own == low), np.flatnonzero(own == high)


def components_of(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the first row that links between two sides join to it."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, left, np.where(linked, label[right][None, :], n).min(1, initial=n))
        np.minimum.at(new, right, np.where(linked, label[left][:, None], n).min(0, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """A star for each component of the links between two sides: pairs of a node and the component's first."""
    return [(int(ids[i]), int(ids[j])) for i, j in enumerate(components_of(linked, left, right, len(ids))) if i != j]


def signatures(block: pa.Table, rows: np.ndarray) -> np.ndarray:
    return np.array([np.frombuffer(block.column("signature")[int(i)].as_py(), "<u2") for i in rows])


def plausible(signs: np.ndarray, left: np.ndarray, right: np.ndarray, least_agreement: float) -> np.ndarray:
    """Whether the signatures of a left and a right document agree in at least the given share of their rows."""
    need, others = least_agreement * signs.shape[1], signs[right]
    found = np.zeros((len(left), len(right)), bool)
    for k, i in enumerate(left):
        found[k] = (others == signs[i]).sum(1) >= need
    return found


def between(linked: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, signs: np.ndarray, least_agreement: float) -> list[tuple[int, int]]:
    """Edges that join what the chunks' own blocks join already: a large group of copies gives one for a pair of its chunks, not one for each document."""
    left, right, linked = left[linked.any(1)], right[linked.any(0)], linked[linked.any(1)][:, linked.any(0)]
    own = np.minimum(*(components_of(plausible(signs, side, side, least_agreement), side, side, len(ids)) for side in (left, right)))
    i, j = np.nonzero(linked)
    groups = np.unique(np.stack([own[left[i]], own[right[j]]]), axis=1)
    firsts, places = np.unique(groups, return_inverse=True)
    a, b = places.reshape(groups.shape)
    joined = np.zeros((len(firsts), len(firsts)), bool)
    joined[a, b] = True
    every = np.arange(len(firsts))
    return forest(joined, every, every, ids[firsts])


def plausible_edges(blocks: DataFrame, least_agreement: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for block in runs(batches, ["bucket", "low", "high"]):
            rows, left, right = sides(block)
            if len(rows) < 2:
                continue
            ids, signs = block.column("id").to_numpy()[rows], signatures(block, rows)
            linked = plausible(signs, left, right, least_agreement)
            if block.column("low")[0] == block.column("high")[0]:
                out += forest(linked, left, right, ids)
            elif linked.any():
                out += between(linked, left, right, ids, signs, least_agreement)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[gram] > 1  # the others are in one set only
    owner, gram = owner[shared], gram[shared]
    number = np.cumsum(count > 1) - 1
    gram = number[gram]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    total, width = np.zeros((len(left), len(right)), np.float32), 4096
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(gram, [start, start + width])
        if a == b:
            continue
        has = np.zeros((len(sets), int(min(width, gram[b - 1] - start + 1))), np.float32)
        has[owner[a:b], gram[a:b] - start] = 1
        total += has[left] @ has[right].T
    return total


def verified(blocks: DataFrame, threshold: float, n: int, least_agreement: float) -> DataFrame:
    """Links by block: rows of a node and its links (b null), and rows of a spanning forest's edges (links null)."""

    def with_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                grams = pa.array([shingler.grams(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), grams], [*kept, "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["component", "low", "high"]):
            rows, left, right = sides(block)
            if len(rows) < 2:
                continue
            likely = plausible(signatures(block, rows), left, right, least_agreement) & (left[:, None] != right[None, :])
            left, right = left[likely.any(1)], right[likely.any(0)]
            if not len(left):
                continue
            ids, copies = (block.column(c).to_numpy()[rows] for c in ("id", "copies"))
            sets = [np.frombuffer(block.column("set")[int(i)].as_py(), np.uint64) for i in rows]
            sizes = np.array([len(s) for s in sets], np.float64)
            inter = common(sets, left, right).astype(np.float64)
            linked = inter >= threshold * (sizes[left][:, None] + sizes[right][None, :] - inter) - 1e-9
            linked &= left[:, None] != right[None, :]
            links = np.zeros(len(rows), np.int64)
            np.add.at(links, left, linked @ copies[right])
            if block.column("low")[0] != block.column("high")[0]:
                np.add.at(links, right, linked.T @ copies[left])
            some = np.flatnonzero(links)
            edges = forest(linked, left, right, ids)
            a = [*ids[some].tolist(), *(x for x, _ in edges)]
            b = [*[None] * len(some), *(y for _, y in edges)]
            w = [*links[some].tolist(), *[None] * len(edges)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, w)], ["a", "b", "links"])

    kept = ["component", "chunks", "id", "copies", "signature"]
    sets = blocks.select(*kept, "text").mapInArrow(with_grams, "component long, chunks long, id long, copies long, signature binary, set binary")
    return blocked(sets, "component", "chunks").mapInArrow(run, "a long, b long, links long")


def ngram_join(
    docs: DataFrame,
    threshold: float = 0.8,
    n: int = 5,
    recall: float = 0.9995,
    most_hashes: int = 128,
    block_rows: int = 512,
    block_grams: int = 1 << 19,
    broadcast_rows: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`id_col`, class_id (the least id of all that links join), n_links (rows with an equal or a similar text, its own
    not counted) and representative (the least id of its equal texts), for each row.

    A pair is plausible if its signatures agree in as many rows as a pair at the threshold does but for 1 in 30,000.
    Buckets, candidates' components and candidates are broadcast up to broadcast_rows of them, and joined by a shuffle beyond.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall, most_hashes)
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    known = sketches(docs, Signer(bands, rows), n).checkpoint()
    classes = known.groupBy("h1", "h2").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("signature").alias("signature"), F.first("bands").alias("bands")
    )
    reps = classes.where("rep is not null").checkpoint()

    # From here on a text's hash stands for it, as different texts can share an id.
    points = reps.select(F.explode("bands").alias("bucket"), F.col("h1").alias("id"))
    buckets = points.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    # Of buckets with the same members one is enough.
    buckets = buckets.where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n").checkpoint()
    if buckets.count() <= broadcast_rows:
        members = reps.select(F.explode("bands").alias("bucket"), F.col("h1").alias("id"), "signature").join(F.broadcast(buckets), "bucket")
    else:
        members = points.join(buckets, "bucket").join(reps.select(F.col("h1").alias("id"), "signature"), "id")
    members = members.withColumn("chunks", F.ceil(F.col("n") / block_rows)).drop("n")
    slack = 4 * math.sqrt(threshold * (1 - threshold) / (bands * rows))
    edges = plausible_edges(blocked(members, "bucket", "chunks"), threshold - slack)
    linked = connected_components(edges).checkpoint()
    small = linked.count() <= broadcast_rows
    found = reps.select(F.col("h1").alias("node"), "copies", "grams", "signature", "rep").join(F.broadcast(linked) if small else linked, "node")
    sizes = found.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / block_rows, F.sum("grams") / block_grams)).alias("chunks"))
    candidates = found.join(sizes, "component").select("component", F.greatest("chunks", F.lit(1)).alias("chunks"), F.col("node").alias("id"), "copies", "signature", "rep").checkpoint()

    texts = docs.select(F.col("id").alias("rep"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("id"), "text")
    links = verified(texts.join(F.broadcast(candidates) if small else candidates, ["id", "rep"]), threshold, n, threshold - slack).checkpoint()
    counts = links.where("links is not null").groupBy(F.col("a").alias("h1")).agg(F.sum("links").alias("links"))
    joined = connected_components(links.where("links is null").select("a", "b")).withColumnRenamed("node", "h1").join(reps.select("h1", "rep"), "h1").checkpoint()
    least = joined.groupBy("component").agg(F.min("rep").alias("least")).checkpoint()
    joined = joined.join(F.broadcast(least) if least.count() <= broadcast_rows else least, "component").select("h1", "least")
    result = reps.select("h1", "h2", "rep", "copies").join(counts, "h1", "left").join(joined, "h1", "left")
    result = result.select(
        "h1", "h2", "rep", F.coalesce("least", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    own = known.select("id", "h1", "h2").join(result, ["h1", "h2"], "left")
    has = F.col("id").isNotNull()
    return own.select(
        F.col("id").alias(id_col), F.when(has, F.col("class_id")).alias("class_id"), F.when(has, F.col("n_links")).alias("n_links"), F.when(has, F.col("rep")).alias("representative")
    )
