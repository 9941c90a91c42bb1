"""Components of graphs and closures of forests, for all boxes at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sylvaframe.operators.cut import cut
from sylvaframe.operators.groups import parted, whole_groups

#: Nodes of a box up to which its pointers are followed inside a task.
MOST = 1 << 20


def component_labels(nodes: DataFrame, edges: DataFrame, by: str = "box") -> DataFrame:
    """`by`, node and label: the least node that is connected to it. nodes: `by`, node; edges: `by`, a, b.

    Each round takes the least label among neighbours and then the label's own label, so labels go over a path in a
    number of rounds that grows with its logarithm. Rounds are cut by checkpoints and end when no label changes.
    """
    both = edges.select(by, "a", "b").unionByName(edges.select(by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct().transform(cut)
    labels = nodes.select(by, "node", F.col("node").alias("label")).distinct()
    while True:
        offers = both.join(labels.withColumnRenamed("node", "b"), [by, "b"]).select(by, F.col("a").alias("node"), "label")
        # What a label's holders see is offered to the label itself too (hooking), then labels are followed (jumping).
        least = offers.groupBy(by, "node").agg(F.min("label").alias("new"))
        seen = labels.join(least, [by, "node"], "left").select(by, "node", "label", F.least("label", F.coalesce("new", "label")).alias("new"))
        hooks = seen.groupBy(by, F.col("label").alias("node")).agg(F.min("new").alias("hook"))
        hooked = seen.join(hooks, [by, "node"], "left").select(by, "node", "label", F.least("new", F.coalesce("hook", "new")).alias("new"))
        jump = hooked.select(by, F.col("node").alias("new"), F.col("new").alias("far"))
        moved = hooked.join(jump, [by, "new"], "left").select(by, "node", F.col("label").alias("old"), F.least("new", F.coalesce("far", "new")).alias("label")).transform(cut)
        labels = moved.drop("old")
        if moved.where("old <> label").isEmpty():
            return labels


def closure(forest: DataFrame) -> DataFrame:
    """box, node, anc and depth for each node and each of its ancestors, itself at depth 0, by doubling of pointers.

    Its size is the sum of all depths; what only needs a sum over ancestors or descendants uses along_paths and below instead.
    """
    own = forest.select("box", F.col("cc_id").alias("node"), F.col("cc_id").alias("anc"), F.lit(0).alias("depth"))
    reach = forest.where("parent is not null").select("box", F.col("cc_id").alias("node"), F.col("parent").alias("anc"), F.lit(1).alias("depth"))
    step = 1
    done = own.unionByName(reach).transform(cut)
    while True:
        # Rows of depth up to `step` are known; the farthest are extended by all that start there.
        far = done.where(F.col("depth") == step).select("box", "node", F.col("anc").alias("mid"), F.col("depth").alias("d0"))
        more = far.join(done.where("depth > 0").select("box", F.col("node").alias("mid"), "anc", F.col("depth").alias("d1")), ["box", "mid"])
        more = more.select("box", "node", "anc", (F.col("d0") + F.col("d1")).alias("depth")).transform(cut)
        if more.isEmpty():
            return done
        done = done.unionByName(more).transform(cut)
        step *= 2


def _places(nodes: pa.Table, group: np.ndarray, asked: pa.Table, of: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
    """For each of some columns of asked rows the nodes' row of that cc_id in the same group, -1 without one."""
    n = nodes.num_rows
    parts = [*nodes.column("cc_id").chunks, *(c for name in names for c in asked.column(name).chunks)]
    ids = pa.concat_arrays(parts).dictionary_encode().indices
    known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    key = np.concatenate([group, *(of for _ in names)]) * (ids.max(initial=0) + 1) + ids
    order = np.argsort(key[:n], kind="stable")
    at = np.minimum(np.searchsorted(key[:n][order], key[n:]), n - 1)
    found = np.where(known[n:] & (key[:n][order][at] == key[n:]), order[at], -1) if n else np.full(len(key), -1)
    return np.split(found, len(names)) if len(names) > 1 else [found]


def _ups(rows: pa.Table, group: np.ndarray) -> np.ndarray:
    """The row of each row's `up` in its group, -1 without one."""
    return _places(rows, group, rows, group, ("up",))[0]


def _followed(up: np.ndarray):
    """The rows that a pointer still leads from, and where to, with pointers that skip twice as far each time."""
    for _ in range(up.size.bit_length() + 1):
        some = np.flatnonzero(up >= 0)
        if not len(some):
            return
        to = up[some]
        yield some, to
        up[some] = up[to]
    raise ValueError("the pointers of a forest close a circle")


def _paths_inside(rows: pa.Table, group: np.ndarray) -> pa.Table:
    up, depth, lights = _ups(rows, group), *(rows.column(c).to_numpy().astype(np.int64) for c in ("depth", "lights"))
    root, begins = np.arange(len(up)), rows.column("begins").to_numpy(zero_copy_only=False).astype(bool)
    start, steps = np.where(begins, root, -1), np.zeros(len(up), np.int64)
    for some, to in _followed(up):
        news = (start[some] < 0) & (start[to] >= 0)
        first, offer = some[news], (start[to[news]], depth[some[news]] + steps[to[news]])
        sums = depth[some] + depth[to], root[to], lights[some] + lights[to]
        depth[some], root[some], lights[some] = sums
        start[first], steps[first] = offer
    ids = rows.column("cc_id").combine_chunks()
    named = pa.StructArray.from_arrays([pa.array(steps), ids.take(pa.array(np.maximum(start, 0)))], ["steps", "id"], mask=pa.array(start < 0))
    return pa.table({"box": rows.column("box"), "cc_id": ids, "depth": depth, "root": ids.take(pa.array(root)), "lights": lights, "start": named})


def along_paths(forest: DataFrame, light: Column | None = None, most: int = MOST) -> DataFrame:
    """For each node what its path to the root holds: depth, root, lights (number of light nodes) and the nearest start
    (the node itself or an ancestor that is light or a root) with the steps to it.

    A node's pointer skips twice as far each round and carries what lies before it, so a round holds one row a node. Boxes of at most `most` nodes
    go through their rounds inside a task, the others' rounds are joins over tables.
    """
    marked = (F.coalesce(light, F.lit(0)) if light is not None else F.lit(0)).cast("long")
    top = F.col("parent").isNull()
    kinds = {c: forest.schema[c].dataType.simpleString() for c in ("box", "cc_id")}
    rows = forest.select(
        "box", "cc_id", F.col("parent").cast(kinds["cc_id"]).alias("up"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), marked.alias("lights"), (top | (marked == 1)).alias("begins"),
    ).transform(cut)
    small, rows = parted(rows, most)
    found = whole_groups(small, ["box"], _paths_inside, f"box {kinds['box']}, cc_id {kinds['cc_id']}, depth long, root {kinds['cc_id']}, lights long, start struct<steps:long,id:{kinds['cc_id']}>")
    if rows is None:
        return found
    own = F.when(F.col("begins"), F.struct(F.lit(0).cast("long").alias("steps"), F.col("cc_id").alias("id")))
    rows = rows.select("box", "cc_id", "up", "depth", F.col("cc_id").alias("root"), "lights", own.alias("start"))
    while not rows.where("up is not null").isEmpty():
        far = rows.select("box", F.col("cc_id").alias("up"), *(F.col(c).alias(f"far_{c}") for c in ("up", "depth", "root", "lights", "start")))
        start = F.when(F.col("far_start").isNotNull(), F.struct((F.col("depth") + F.col("far_start.steps")).alias("steps"), F.col("far_start.id").alias("id")))
        # A pointer to a node that is not there ends the path.
        rows = rows.join(far, ["box", "up"], "left").select(
            "box", "cc_id", F.col("far_up").alias("up"), (F.col("depth") + F.coalesce("far_depth", F.lit(0))).alias("depth"), F.coalesce("far_root", "root").alias("root"),
            (F.col("lights") + F.coalesce("far_lights", F.lit(0))).alias("lights"), F.coalesce("start", start).alias("start"),
        ).transform(cut)
    return found.unionByName(rows.drop("up"))


def _within_inside(rows: pa.Table, group: np.ndarray) -> pa.Table:
    paired = rows.column("anc").is_valid().to_numpy() if rows.num_rows else np.zeros(0, bool)
    nodes, pairs = rows.filter(pa.array(~paired)).combine_chunks(), rows.filter(pa.array(paired)).combine_chunks()
    anc, at = _places(nodes, group[~paired], pairs, group[paired], ("anc", "cc_id"))
    up = _ups(nodes, group[~paired])
    depth = (up >= 0).astype(np.int64)
    for some, to in _followed(up.copy()):
        depth[some] += depth[to]
    there = (anc >= 0) & (at >= 0)
    steps = np.where(there, depth[at] - depth[anc], -1) if len(depth) else np.full(len(at), -1)
    asked = np.flatnonzero(steps >= 0)
    bit = 0
    while len(asked) and (steps[asked] >> bit).any():
        moved = asked[(steps[asked] >> bit) & 1 == 1]
        at[moved] = up[at[moved]]
        up, bit = np.where(up >= 0, up[up], -1), bit + 1
    kept = pairs.take(pa.array(asked[at[asked] == anc[asked]]))
    return pa.table({"box": kept.column("box"), "anc": kept.column("anc"), "node": kept.column("cc_id")})


def within(forest: DataFrame, pairs: DataFrame, most: int = MOST) -> DataFrame:
    """Of pairs (box, anc, node) those whose node is anc or below it.

    A pair is lifted by as many steps as its depths differ, one power of two a round, so a round holds one row a node and one a pair, never all
    pairs of ancestors. Boxes of at most `most` nodes and pairs go through their rounds inside a task, the others' rounds are joins over tables.
    """
    kinds = {c: forest.schema[c].dataType.simpleString() for c in ("box", "cc_id")}
    pairs = pairs.select("box", *(F.col(c).cast(kinds["cc_id"]).alias(c) for c in ("anc", "node"))).dropna().distinct()
    asked = pairs.select("box", F.col("node").alias("cc_id"), F.lit(None).cast(kinds["cc_id"]).alias("up"), "anc")
    known = forest.select("box", "cc_id", F.col("parent").cast(kinds["cc_id"]).alias("up"), F.lit(None).cast(kinds["cc_id"]).alias("anc")).join(pairs.select("box"), "box", "left_semi")
    small, large = parted(known.unionByName(asked).transform(cut), most)
    found = whole_groups(small, ["box"], _within_inside, f"box {kinds['box']}, anc {kinds['cc_id']}, node {kinds['cc_id']}")
    if large is None:
        return found
    forest = large.where("anc is null").select("box", "cc_id", F.col("up").alias("parent"))
    pairs = large.where("anc is not null").select("box", "anc", F.col("cc_id").alias("node"))
    depth = along_paths(forest, most=most).select("box", "cc_id", "depth").transform(cut)
    deep = lambda c: depth.select("box", F.col("cc_id").alias(c), F.col("depth").alias(f"{c}_depth"))
    left = pairs.join(deep("anc"), ["box", "anc"]).join(deep("node"), ["box", "node"]).where("node_depth >= anc_depth")
    left = left.select("box", "anc", "node", F.col("node").alias("at"), (F.col("node_depth") - F.col("anc_depth")).alias("steps")).transform(cut)
    jump = forest.where("parent is not null").select("box", F.col("cc_id").alias("at"), F.col("parent").alias("to"))
    while not left.where("steps > 0").isEmpty():
        moved = left.join(jump, ["box", "at"], "left").withColumn("at", F.when(F.col("steps") % 2 == 1, F.col("to")).otherwise(F.col("at")))
        left = moved.select("box", "anc", "node", "at", F.expr("steps div 2").alias("steps")).transform(cut)
        jump = jump.join(jump.select("box", F.col("at").alias("to"), F.col("to").alias("far")), ["box", "to"]).select("box", "at", F.col("far").alias("to")).transform(cut)
    return found.unionByName(left.where("at = anc").select("box", "anc", "node"))


def _below_inside(sums: list[str], greatest: list[str]):
    def run(rows: pa.Table, group: np.ndarray) -> pa.Table:
        value = {c: rows.column(c).to_numpy().copy() for c in (*sums, *greatest)}
        for some, to in _followed(_ups(rows, group)):
            sent = {c: v[some] for c, v in value.items()}
            for c in sums:
                np.add.at(value[c], to, sent[c])
            for c in greatest:
                np.maximum.at(value[c], to, sent[c])
        return pa.table({"box": rows.column("box"), "cc_id": rows.column("cc_id"), **value})

    return run


def below(forest: DataFrame, sums: list[str], greatest: list[str] = (), most: int = MOST) -> DataFrame:
    """Sums and maxima of columns over each node and all its descendants, by doubling of pointers: one row a node in each round.

    Boxes of at most `most` nodes go through their rounds inside a task, the others' rounds are joins over tables.
    """
    kinds = {f.name: f.dataType.simpleString() for f in forest.schema}
    whole = [F.col(c).cast("long").alias(c) if isinstance(forest.schema[c].dataType, IntegralType) else F.col(c) for c in sums]
    rows = forest.select("box", "cc_id", F.col("parent").cast(kinds["cc_id"]).alias("up"), *whole, *greatest).transform(cut)
    kinds |= {f.name: f.dataType.simpleString() for f in rows.schema}
    small, rows = parted(rows, most)
    found = whole_groups(small, ["box"], _below_inside([*sums], [*greatest]), ", ".join(f"{c} {kinds[c]}" for c in ("box", "cc_id", *sums, *greatest)))
    if rows is None:
        return found
    while not rows.where("up is not null").isEmpty():
        sent = rows.where("up is not null").groupBy("box", F.col("up").alias("cc_id")).agg(*(F.sum(c).alias(f"s_{c}") for c in sums), *(F.max(c).alias(f"g_{c}") for c in greatest))
        skip = rows.select("box", F.col("cc_id").alias("up"), F.col("up").alias("next"))
        grown = rows.join(sent, ["box", "cc_id"], "left").join(skip, ["box", "up"], "left")
        rows = grown.select(
            "box", "cc_id", F.col("next").alias("up"), *((F.col(c) + F.coalesce(f"s_{c}", F.lit(0))).alias(c) for c in sums), *(F.greatest(c, f"g_{c}").alias(c) for c in greatest)
        ).transform(cut)
    return found.unionByName(rows.drop("up"))


def subtree_totals(forest: DataFrame) -> DataFrame:
    """box, cc_id, n_nodes and px of each node's subtree."""
    return below(forest.withColumn("n_nodes", F.lit(1).cast("long")).withColumn("px", F.col("n_px").cast("long")), ["n_nodes", "px"])


def leaves(forest: DataFrame) -> DataFrame:
    return forest.join(forest.where("parent is not null").select("box", F.col("parent").alias("cc_id")).distinct(), ["box", "cc_id"], "left_anti")


def downstream_accumulation(forest: DataFrame) -> DataFrame:
    """For each leaf the running size and count of its path are added to each ancestor, so a node counts once for each leaf below it."""
    leaf = leaves(forest).select("box", "cc_id", F.lit(1).cast("long").alias("own"))
    n_leaves = below(forest.join(leaf, ["box", "cc_id"], "left").withColumn("n", F.coalesce("own", F.lit(0).cast("long"))), ["n"])
    weighted = forest.join(n_leaves, ["box", "cc_id"]).withColumn("px", F.col("n_px") * F.col("n"))
    return below(weighted, ["px", "n"])


def forest_roots(forest: DataFrame) -> DataFrame:
    return forest.where("parent is null")


def node_depth(forest: DataFrame) -> DataFrame:
    return along_paths(forest).select("box", "cc_id", "depth")


def node_height(forest: DataFrame) -> DataFrame:
    """Steps to the farthest descendant."""
    deep = forest.join(node_depth(forest), ["box", "cc_id"]).withColumn("deepest", F.col("depth"))
    return below(deep, [], ["deepest"]).join(deep.select("box", "cc_id", "depth"), ["box", "cc_id"]).select("box", "cc_id", (F.col("deepest") - F.col("depth")).alias("height"))


def descendants(forest: DataFrame) -> DataFrame:
    """All pairs of a node and a node below it."""
    return closure(forest).where("depth > 0").select("box", F.col("anc").alias("cc_id"), F.col("node").alias("descendant"))


def leaves_below(forest: DataFrame) -> DataFrame:
    """All pairs of a node and a leaf below it; a leaf is its own."""
    ends = leaves(forest).select("box", F.col("cc_id").alias("node"))
    return closure(forest).join(ends, ["box", "node"], "left_semi").select("box", F.col("anc").alias("cc_id"), F.col("node").alias("leaf"))


def children(forest: DataFrame) -> DataFrame:
    """Number of children, and whether there is none."""
    n = forest.where("parent is not null").groupBy("box", F.col("parent").alias("cc_id")).agg(F.count("*").alias("n"))
    return forest.select("box", "cc_id").join(n, ["box", "cc_id"], "left").fillna({"n": 0}).withColumn("is_leaf", F.col("n") == 0)


def prune_small_trees(forest: DataFrame, least_nodes: int, least_px: int) -> DataFrame:
    """Nodes of trees with at least least_nodes nodes and more than least_px pixels."""
    rooted = forest.join(along_paths(forest).select("box", "cc_id", "root"), ["box", "cc_id"])
    kept = rooted.groupBy("box", "root").agg(F.count("*").alias("n"), F.sum("n_px").alias("px")).where((F.col("n") >= least_nodes) & (F.col("px") > least_px))
    return rooted.join(kept, ["box", "root"], "left_semi").select("box", "cc_id", "root")


def heavy_children(forest: DataFrame) -> DataFrame:
    """The forest with light: 0 for roots and for the child of most downstream pixels (the least id of equals), else 1."""
    sized = forest.join(subtree_totals(forest).select("box", "cc_id", "px"), ["box", "cc_id"])
    first = F.row_number().over(Window.partitionBy("box", "parent").orderBy(F.desc("px"), "cc_id"))
    return sized.withColumn("light", F.when(F.col("parent").isNull() | (first == 1), 0).otherwise(1)).drop("px")


def organs(forest: DataFrame) -> DataFrame:
    """box, cc_id, ord (1 and the light nodes above), organ_id (its first node), idx in the organ, root and parent."""
    rows = along_paths(heavy_children(forest), F.col("light"))
    found = rows.select("box", "cc_id", (1 + F.col("lights")).alias("ord"), F.col("start.id").alias("organ_id"), F.col("start.steps").alias("idx"), "root")
    return found.join(forest.select("box", "cc_id", "parent"), ["box", "cc_id"])


def organ_path(organ_nodes: DataFrame) -> DataFrame:
    """Each organ's nodes from its first on."""
    steps = F.array_sort(F.collect_list(F.struct("idx", "cc_id")))
    return organ_nodes.groupBy("box", "organ_id").agg(F.transform(steps, lambda p: p["cc_id"]).alias("path"))


def main_path(organ_nodes: DataFrame) -> DataFrame:
    return organ_nodes.where("ord = 1").select("box", "cc_id", "organ_id", "idx")


def lateral_starts(organ_nodes: DataFrame) -> DataFrame:
    """First nodes of laterals, with the node that they come from."""
    return organ_nodes.where("ord > 1 and organ_id = cc_id").select("box", "cc_id", "parent", "ord")


def attachment_points(organ_nodes: DataFrame) -> DataFrame:
    """For each lateral the node, the organ and the place in that organ that it comes from."""
    at = organ_nodes.select("box", F.col("cc_id").alias("parent"), F.col("organ_id").alias("parent_organ"), F.col("idx").alias("at"))
    return organ_nodes.where("organ_id = cc_id and parent is not null").select("box", "organ_id", "parent").join(at, ["box", "parent"])


def direct_lateral_organs(organ_nodes: DataFrame) -> DataFrame:
    return attachment_points(organ_nodes).select("box", F.col("parent_organ").alias("on_organ"), F.col("organ_id").alias("organ"))


def all_lateral_organs(forest: DataFrame, organ_nodes: DataFrame) -> DataFrame:
    """All pairs of a node and a lateral of a higher order whose first node is below it."""
    start = organ_nodes.where("organ_id = cc_id").select("box", F.col("cc_id").alias("descendant"), F.col("ord").alias("start_ord"))
    own = organ_nodes.select("box", "cc_id", "ord")
    return descendants(forest).join(start, ["box", "descendant"]).join(own, ["box", "cc_id"]).where("start_ord > ord").select("box", "cc_id", F.col("descendant").alias("organ"))


def plant_index(forest: DataFrame) -> DataFrame:
    """Plants are numbered by the x of their roots within a box."""
    number = F.row_number().over(Window.partitionBy("box").orderBy("x", "cc_id"))
    plants = forest_roots(forest).select("box", F.col("cc_id").alias("root"), number.alias("plant"))
    return along_paths(forest).select("box", "cc_id", "root").join(plants, ["box", "root"]).select("box", "cc_id", "plant")


def main_trunk_path(organ_nodes: DataFrame, plants: DataFrame) -> DataFrame:
    """Nodes of each plant's first organ, in order."""
    return main_path(organ_nodes).join(plants, ["box", "cc_id"]).select("box", "plant", "idx", "cc_id")


def drop_lateral_chain(forest: DataFrame, edges: DataFrame, organ_nodes: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest and the edges (box, src, dst) without the nodes of some laterals' chains (box, organ_id); primaries stay."""
    gone = organ_nodes.where("ord > 1").join(chains, ["box", "organ_id"], "left_semi").select("box", "cc_id")
    left = edges.join(gone.withColumnRenamed("cc_id", "src"), ["box", "src"], "left_anti").join(gone.withColumnRenamed("cc_id", "dst"), ["box", "dst"], "left_anti")
    return forest.join(gone, ["box", "cc_id"], "left_anti"), left


def chain_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The last component on each component's chain of cheapest outgoing edges (box, src, dst, cost), and the number of steps to it.

    Edges go to later components, so chains end.
    """
    nexts = edges.groupBy("box", F.col("src").alias("cc_id")).agg(F.min_by("dst", F.struct("cost", "dst")).alias("parent"))
    pointers = nodes.select("box", "cc_id").join(nexts, ["box", "cc_id"], "left")
    return along_paths(pointers).select("box", "cc_id", F.col("root").alias("last"), F.col("depth").alias("steps"))


def _plants_inside(rows: pa.Table, group: np.ndarray) -> pa.Table:
    up, n = _ups(rows, group), rows.num_rows
    top, inner = rows.column("up").combine_chunks().is_null().to_numpy(zero_copy_only=False), np.zeros(n, bool)
    inner[up[up >= 0]] = True
    root, depth = np.arange(n), (~top).astype(np.int64)
    for some, to in _followed(up):
        sums = depth[some] + depth[to], root[to]
        depth[some], root[some] = sums
    rank = lambda c: np.unique(rows.column(c).to_numpy()[top], return_inverse=True)[1]
    starts = np.flatnonzero(top)[np.lexsort((rank("cc_id"), rank("x"), group[top]))]
    place = np.full(n, -1)
    place[starts] = np.arange(len(starts))
    at = place[root]
    own, px = at >= 0, rows.column("px").to_numpy()
    count = lambda some: np.bincount(at[some], minlength=len(starts)).astype(np.int64)
    height, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), px.dtype)
    np.maximum.at(height, at[own], depth[own])
    np.add.at(total, at[own], px[own])
    number = np.arange(len(starts)) - np.searchsorted(group[starts], group[starts]) + 1
    ends = count(own & ~inner)
    # Each organ of a plant ends at one of its leaves, and one organ is no lateral.
    values = {"plant": number.astype(np.int32), "n_nodes": count(own), "height": height, "px": total, "n_leaves": ends, "n_laterals": ends - 1}
    return pa.table({"box": rows.column("box").take(pa.array(starts)), **values})


def forest_statistics(forest: DataFrame, most: int = MOST) -> DataFrame:
    """Per plant: nodes, greatest depth, pixels, leaves and laterals. Boxes of at most `most` nodes are added up inside a task, without a join; the others' tables are joined."""
    whole = "long" if isinstance(forest.schema["n_px"].dataType, IntegralType) else "double"
    kinds = {c: forest.schema[c].dataType.simpleString() for c in ("box", "cc_id")}
    small, large = parted(forest, most)
    rows = small.select("box", "cc_id", F.col("parent").cast(kinds["cc_id"]).alias("up"), "x", F.coalesce(F.col("n_px").cast(whole), F.lit(0).cast(whole)).alias("px"))
    found = whole_groups(rows, ["box"], _plants_inside, f"box {kinds['box']}, plant int, n_nodes long, height long, px {whole}, n_leaves long, n_laterals long")
    return found if large is None else found.unionByName(_joined_statistics(large))


def _joined_statistics(forest: DataFrame) -> DataFrame:
    ends = leaves(forest).select("box", "cc_id", F.lit(1).alias("leaf"))
    rows = forest.select("box", "cc_id", "n_px").join(plant_index(forest), ["box", "cc_id"]).join(organs(forest), ["box", "cc_id"]).join(node_depth(forest), ["box", "cc_id"]).join(ends, ["box", "cc_id"], "left")
    return rows.groupBy("box", "plant").agg(
        F.count("*").alias("n_nodes"), F.max("depth").alias("height"), F.sum("n_px").alias("px"), F.count("leaf").alias("n_leaves"), F.count_if(F.expr("organ_id = cc_id and ord > 1")).alias("n_laterals")
    )


def tree_consistency(organ_nodes: DataFrame, active: DataFrame) -> DataFrame:
    """Components with an active successor (box, src, dst) but none of their own order."""
    has = organ_nodes.join(active.select("box", F.col("src").alias("cc_id")).distinct(), ["box", "cc_id"], "left_semi")
    own = organ_nodes.select("box", "cc_id", "ord")
    same = active.join(own.select("box", F.col("cc_id").alias("src"), "ord"), ["box", "src"]).join(own.select("box", F.col("cc_id").alias("dst"), F.col("ord").alias("to")), ["box", "dst"]).where("ord = to")
    return has.join(same.select("box", F.col("src").alias("cc_id")), ["box", "cc_id"], "left_anti").select("box", "cc_id", "ord")


def drop_unselected_edges(edges: DataFrame, active: Column) -> DataFrame:
    """Edges with is_out and the reason: those that are not active and not out yet go out."""
    out = F.coalesce(F.col("reason").isNotNull(), F.lit(False)) if "reason" in edges.columns else F.lit(False)
    known = F.col("reason") if "reason" in edges.columns else F.lit(None).cast("string")
    return edges.withColumn("reason", F.when(out, known).when(~active, F.lit("NON_ACTIVATED_STEP5"))).withColumn("is_out", F.col("reason").isNotNull())


def exclusion_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of excluded nodes and of excluded edges for each reason."""
    both = nodes.select(F.lit("node").alias("kind"), "reason").unionByName(edges.select(F.lit("edge").alias("kind"), "reason"))
    return both.where("reason is not null").groupBy("kind", "reason").agg(F.count("*").alias("n"))
