"""Mixing sources to target weights, with a multivariate-hypergeometric splitting tree.

1. A source's target is its weight's share of the words that the mix wants; a target stops at `most_passes` times its source,
   and what is over is shared again by weight. A target is a number of whole passes over the source and a rest.
2. Each source's documents are dealt by a hash to 4,096 cells, and neighbouring cells form blocks of about equal words over all
   sources. Each pass takes all of a source's blocks; the rest takes blocks in the order of the hash, and cuts the one document at
   which the target is met.
3. The numbers of blocks are split among the output shards by a tree: a node halves its shards, and the left half's share of each
   source is drawn without replacement from the node's blocks (one hypergeometric draw after the other, by inversion). So each
   source's quotas add up exactly, and a shard has as many blocks as any other but for one.
4. A source's blocks stand in a permuted order in which each shard owns a run of its quota: no block of a pass is in two
   shards. `shards` shuffles a shard's rows locally.

All of it is Spark expressions. The tree has a row for each of its nodes, with an array of a number for each source; groups are
cells, blocks and sources' cells, never all rows of a source. Long texts count whole. Null texts have no words; they are never in the mix.
A null source is a source of its own, the last. Rows that agree in id, text and source are taken alike (if the cut falls among them, each
gets the same number of words). Rows without an id take part. An empty table gives an empty result. Columns that are not
named in `keep` are ignored, whatever their names. The same rows and seed give the same mix, however they are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.llm._common import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` from a population are marked ones: the inverse distribution at u (0 to 1).

    Probabilities are taken from the most likely number upwards and then downwards, in proportion to the most likely one's,
    so none overflows and what underflows is nothing.
    """
    most = F.least(marked, draws)
    least = F.greatest(F.lit(0).cast("long"), draws - (population - marked))
    likely = F.least(most, F.greatest(least, F.floor((draws + 1) * (marked + 1) / (population + 2))))
    given = F.struct(*(x.cast("double").alias(n) for x, n in ((population, "n"), (marked, "k"), (draws, "d"), (least, "least"), (most, "most"), (likely, "likely"), (u, "u"))))

    def chances(p: Column, limit: Column) -> Column:
        """The sum of all chances, and the first number at which their sum passes the limit."""

        def step(acc: Column, s: Column) -> Column:
            up = s <= p["most"] - p["likely"]
            x = F.when(up, p["likely"] + s).otherwise(p["most"] - s)
            rise = (p["k"] - x + 1) * (p["d"] - x + 1) / (x * (p["n"] - p["k"] - p["d"] + x))
            fall = (x + 1) * (p["n"] - p["k"] - p["d"] + x + 1) / ((p["k"] - x) * (p["d"] - x))
            before = F.when(s == p["most"] - p["likely"] + 1, 1.0).otherwise(acc["w"])
            w = F.when(s == 0, 1.0).when(up, acc["w"] * rise).otherwise(before * fall)
            return let(w, lambda w: F.struct(
                w.alias("w"), (acc["sum"] + w).alias("sum"), F.when(acc["at"].isNull() & (acc["sum"] + w > limit), x).otherwise(acc["at"]).alias("at")
            ))

        none = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), (p["most"] - p["least"]).cast("long")), none, step)

    drawn = let(given, lambda p: F.coalesce(chances(p, chances(p, F.lit(float("inf")))["sum"] * p["u"])["at"], p["likely"]))
    return drawn.cast("long")


def drawn_left(counts: Column, draws: Column, seed: Sequence[Column]) -> Column:
    """Of `draws` blocks from a node with the given number of each source's blocks: each source's part."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    none = F.struct(total.alias("population"), draws.cast("long").alias("draws"), F.array().cast("array<long>").alias("left"))

    def step(acc: Column, count: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(*seed, F.size(acc["left"])), 11) * 2.0**-53
        part = hypergeometric(acc["population"], count, acc["draws"], u)
        return let(part, lambda x: F.struct(
            (acc["population"] - count).alias("population"), (acc["draws"] - x).alias("draws"), F.concat(acc["left"], F.array(x)).alias("left")
        ))

    return F.aggregate(counts, none, step, lambda acc: acc["left"])


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, place and quota, from `quotas` (place from 0, blocks): how many of each source's blocks a shard gets."""
    counts = F.transform(F.array_sort(F.collect_list(F.struct("place", "blocks"))), lambda x: x["blocks"])
    nodes = quotas.agg(counts.alias("counts"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("total"))
    nodes = nodes.select(F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "total", "counts")
    upto = lambda i: F.floor(F.col("total") * i / F.lit(shards).cast("decimal(20,0)")).cast("long")  # noqa: E731  blocks of all shards before i
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        left = drawn_left(F.col("counts"), upto(F.col("middle")) - upto(F.col("low")), (F.lit(seed), F.col("low"), F.col("high")))
        split = nodes.withColumn("middle", middle).withColumn("left", F.when(F.col("high") - F.col("low") > 1, left))
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        node = lambda low, high, counts: F.struct(low.alias("low"), high.alias("high"), counts.alias("counts"))
        own = node(F.col("low"), F.col("high"), F.col("counts"))
        halves = F.array(node(F.col("low"), F.col("middle"), F.col("left")), node(F.col("middle"), F.col("high"), right))
        nodes = split.select("total", F.explode(F.when(F.col("left").isNull(), F.array(own)).otherwise(halves)).alias("node")).select("total", "node.*")
    return nodes.select(F.col("low").cast("int").alias("shard"), F.posexplode("counts").alias("place", "quota")).where("quota > 0")


def with_targets(sources: DataFrame, weights: Sequence[float], share: float, most_passes: int) -> DataFrame:
    """Adds place (from 0, by code point, the null source, '', last) and target to sources and their sizes."""
    every, by_place = Window.partitionBy(), Window.orderBy(F.col("source") == "", "source")
    first_full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source") == "", "source").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sources.withColumn("place", F.row_number().over(by_place) - 1).withColumn("most", F.col("source_size") * most_passes)
    numbered = numbered.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("place") % len(weights) + 1))
    # Sources are full in the order of most / weight. With the first few full, the others get this much for a unit of weight; the
    # number of full ones that leaves none above gives the most.
    full, taken = (F.coalesce(F.sum(c).over(first_full), F.lit(0)) for c in ("most", "weight"))
    unit = (share * F.sum("source_size").over(every) - full) / (F.sum("weight").over(every) - taken)
    level = F.max("unit").over(every)
    return numbered.withColumn("unit", unit).withColumn("target", F.least(F.col("most").cast("double"), level * F.col("weight"))).drop("unit", "most", "weight")


def small_or_not(table: DataFrame, most: int) -> DataFrame:
    """A checkpointed table, marked for a broadcast if it has at most `most` rows."""
    return F.broadcast(table) if table.count() <= most else table


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most_passes: int = 2,
    shards: int = 16,
    blocks: int = 1024,
    seed: int = 0,
    keep: Sequence[str] = ("doc_id",),
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    broadcast_rows: int = 1 << 17,
) -> DataFrame:
    """`keep`, size, source_size, target and draws (pass, shard, words: a document's words or, at the cut, its first few).

    weights: of the sources by code point, repeated as often as needed. share: words of the mix by words of all documents.
    blocks: of all sources in one pass, about; a source has one at least and 4,096 at most. Tables by cell or of cut documents
    are broadcast up to broadcast_rows rows, and joined by a shuffle beyond.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    source = F.coalesce(F.concat(F.lit("+"), docs[source_col].cast("string")), F.lit(""))
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), source.alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
    rows = rows.withColumn("cell", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")).checkpoint()
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("words")).checkpoint()

    sources = with_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most_passes)
    want, every = F.floor(F.col("target") + 0.5), Window.partitionBy()
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", want - F.col("passes") * F.col("source_size"))
    own_blocks = F.round(F.col("source_size") * blocks / F.greatest(F.sum("source_size").over(every), F.lit(1)))
    sources = sources.withColumn("blocks", F.least(F.lit(CELLS), F.greatest(F.lit(1), own_blocks)).cast("long")).checkpoint()

    placed = cells.join(sources, "source")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("place").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.least(F.greatest(F.col("rest") - before, F.lit(0)), F.col("words"))
    placed = placed.withColumn("last", last).withColumn("block", F.floor(F.col("cell") * F.col("blocks") / CELLS).cast("int")).checkpoint()

    held = placed.where("words > 0").groupBy("place", "block").agg(F.first("passes").alias("passes"), F.sum("last").alias("last"))
    upto = F.col("passes") + F.when(F.col("last") > 0, 1).otherwise(0)
    drawn = held.where(upto > 0).select("place", "block", F.explode(F.sequence(F.lit(1).cast("long"), upto)).alias("pass"))
    quotas = sources.select("place").join(drawn.groupBy("place").agg(F.count("*").alias("blocks")), "place", "left").fillna(0, ["blocks"])
    leaves = splitting_tree(quotas, shards, seed).checkpoint()
    upto = F.sum("quota").over(Window.partitionBy("place").orderBy("shard"))
    slots = leaves.withColumn("upto", upto).select("place", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("slot"))
    permuted = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(seed), "place", "block", "pass"), "block", "pass")
    dealt = drawn.withColumn("slot", F.row_number().over(permuted).cast("long")).join(slots, ["place", "slot"])
    dealt = dealt.groupBy("place", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    fates = placed.join(dealt, ["place", "block"], "left").select("source", "cell", "source_size", "target", "passes", "words", "last", "dealt").checkpoint()
    fates = small_or_not(fates, broadcast_rows)

    cut = rows.join(fates.where("last > 0 and last < words").select("source", "cell", "last"), ["source", "cell"])
    cut = cut.groupBy("source", "cell", "key").agg(F.first("size").alias("own"), F.count("*").alias("copies"), F.first("last").alias("last"))
    size = F.col("own") * F.col("copies")
    earlier = F.coalesce(F.sum(size).over(Window.partitionBy("source", "cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.floor(F.least(F.greatest(F.col("last") - earlier, F.lit(0)), size) / F.col("copies"))
    cut = small_or_not(cut.select("source", "cell", "key", part.alias("part")).checkpoint(), broadcast_rows)

    found = rows.join(fates, ["source", "cell"]).join(cut, ["source", "cell", "key"], "left")
    rest = F.coalesce("part", F.when(F.col("last") == F.col("words"), F.col("size")).otherwise(0))
    draws = F.transform(F.coalesce("dealt", F.array()), lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.when(d["pass"] <= F.col("passes"), F.col("size")).otherwise(rest).alias("words")))
    return found.select("row.*", "size", "source_size", "target", F.filter(draws, lambda d: d["words"] > 0).alias("draws"))


def taken(draws: Column) -> Column:
    """Words that the mix takes of a document, repeats counted."""
    return F.aggregate(draws, F.lit(0).cast("long"), lambda a, d: a + d["words"])


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, separated by single spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), F.lit(1), n.cast("int")), " ")


def shards_of(mixed: DataFrame, seed: int = 0, text_col: str | None = None, cells: int = 64) -> DataFrame:
    """The mix's rows: `keep`, shard, place (gapless from 0 in each shard, in a shuffled order), pass and words.

    text_col: a kept column of texts; that of the document at a source's cut becomes its first words. A shard's rows are numbered
    in cells of the order, so none is in one task.
    """
    kept = [c for c in mixed.columns if c not in ("source_size", "target", "draws")]
    rows = mixed.select(*kept, F.explode("draws").alias("d")).select(*kept, "d.*")
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "shard", "pass", *(c for c in kept if c != "size"))).withColumn("cell", F.pmod("order", F.lit(cells)))
    if text_col:
        rows = rows.withColumn(text_col, F.when(F.col("words") < F.col("size"), first_words(F.col(text_col), F.col("words"))).otherwise(F.col(text_col)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("order"))
    placed = rows.withColumn("within", within).join(offsets, ["shard", "cell"])
    return placed.withColumn("place", F.col("offset") + F.col("within") - 1).drop("cell", "order", "within", "offset", "size")
