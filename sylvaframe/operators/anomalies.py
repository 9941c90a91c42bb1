"""Flags on organs that look wrong, and candidates for their repair.

A frame of organ nodes has box, cc_id, parent, ord, organ_id, idx, n_px, cx, cy, fx, fy (the connection to the parent), h_start and h_tip.
Flags are rows (box, kind, a, b, reason, value): a node a, or the edge from a to b.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.functions import scalars as C
from sylvaframe.operators.cut import cut
from sylvaframe.operators.graph import along_paths, organs, subtree_totals, within
from sylvaframe.operators.groups import whole_groups
from sylvaframe.operators.regions import EPS, surface_growth_rate
from sylvaframe.operators.repairs import repairs_inside
from sylvaframe.operators.timebase import mad_double_sided

FLAG = ["box", "kind", "a", "b", "reason", "value"]


def organ_frame(forest: DataFrame, organ_nodes: DataFrame, times: DataFrame) -> DataFrame:
    """The frame of organ nodes from a forest with places and connections, its organs and its components' hours."""
    place = organ_nodes.select("box", "cc_id", "ord", "organ_id", "idx")
    return forest.select("box", "cc_id", "parent", "n_px", "cx", "cy", "fx", "fy").join(place, ["box", "cc_id"]).join(times.select("box", "cc_id", "h_start", "h_tip"), ["box", "cc_id"])


def _organ() -> Window:
    return Window.partitionBy("box", "organ_id").orderBy("idx")


def _sized(frame: DataFrame) -> DataFrame:
    return frame.withColumn("size", F.count("*").over(Window.partitionBy("box", "organ_id")))


def _node(rows: DataFrame, reason: str, value: str) -> DataFrame:
    return rows.select("box", F.lit("node").alias("kind"), F.col("cc_id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(reason).alias("reason"), F.col(value).alias("value"))


def _edge(rows: DataFrame, src: str, dst: str, reason: str, value: str) -> DataFrame:
    return rows.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select("box", F.lit("edge").alias("kind"), F.col(src).alias("a"), F.col(dst).alias("b"), F.lit(reason).alias("reason"), F.col(value).alias("value"))


def deviations(value: Column) -> Column:
    """Scaled deviations of a value on its side of the median (columns median, low, high)."""
    side = F.when(value < F.col("median"), F.col("median") - F.col("low")).otherwise(F.col("high") - F.col("median"))
    return F.abs(value - F.col("median")) / (1.4826 * side + EPS)


def estimated_radius(frame: DataFrame) -> DataFrame:
    """The frame with radius: pixels over the length of the middle line.

    The line goes from the connection of the organ before to the one after; where one is missing it is twice the way from the centre to the
    other; a node alone has the root of its pixels. Without length the radius is that of a disk.
    """
    into, out = F.col("idx") > 0, F.lead("fx").over(_organ()).isNotNull()
    rows = frame.withColumn("nfx", F.lead("fx").over(_organ())).withColumn("nfy", F.lead("fy").over(_organ())).withColumn("out", out)
    to_in, to_out = C.distance(F.col("cx"), F.col("cy"), F.col("fx"), F.col("fy")), C.distance(F.col("cx"), F.col("cy"), F.col("nfx"), F.col("nfy"))
    through = C.distance(F.col("fx"), F.col("fy"), F.col("nfx"), F.col("nfy"))
    line = F.when(into & F.col("out"), through).when(F.col("out"), 2 * to_out).when(into, 2 * to_in).otherwise(F.sqrt("n_px"))
    rows = rows.withColumn("line", line)
    return rows.withColumn("radius", F.when(F.col("line") > 0, F.col("n_px") / F.nullif("line", F.lit(0.0))).otherwise(F.sqrt(F.col("n_px") / F.pi()))).drop("nfx", "nfy", "out", "line")


def _best_out(links: DataFrame) -> DataFrame:
    """The cheapest active edge out of each node (links: box, src, dst, cost)."""
    return links.groupBy("box", F.col("src").alias("cc_id")).agg(F.min_by("dst", F.struct("cost", "dst")).alias("next"))


def radius_outlier(frame: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes of organs of three or more whose radius lies 6 (organs over 7), 8 (over 5) or 100 deviations from the organ's median, and their edges; frame: with radius."""
    stats = mad_double_sided(frame, ["box", "organ_id"], F.col("radius"))
    rows = _sized(frame).where("size >= 3").join(stats, ["box", "organ_id"]).withColumn("v", deviations(F.col("radius")))
    limit = F.when(F.col("size") > 7, 6.0).when(F.col("size") > 5, 8.0).otherwise(100.0)
    rows = rows.where(F.col("v") > limit).join(_best_out(links), ["box", "cc_id"], "left")
    return _node(rows, "RADIUS_OUTLIER", "v").unionByName(_edge(rows, "parent", "cc_id", "RADIUS_OUTLIER_IN_TARGET", "v")).unionByName(_edge(rows, "cc_id", "next", "RADIUS_OUTLIER_IN_SOURCE", "v"))


def radius_sudden_change(frame: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes from the third to the last but one of organs over 5, with two or more edges in and an active one out, where the mean radius of this and the next one
    or two differs from that of the two before by more than the sum of both deviations over 0.6745, and their edges."""
    return _sudden_change(frame, links, incoming(edges))


def incoming(edges: DataFrame) -> DataFrame:
    """Number of edges into each node: box, cc_id and n_in."""
    return edges.groupBy("box", F.col("dst").alias("cc_id")).agg(F.count("*").alias("n_in"))


def _running_deviation(values: Column) -> Column:
    """The sample deviation of an array's values; mean and squares move on from value to value in their order, so that equal arrays give equal noise."""
    start = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "mean", "squares")))

    def onward(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    return F.aggregate(values, start, onward, lambda s: F.when(s["n"] > 1, F.sqrt(s["squares"] / (s["n"] - 1))))


def _sudden_change(frame: DataFrame, links: DataFrame, n_in: DataFrame) -> DataFrame:
    past, ahead = _organ().rowsBetween(-2, -1), _organ().rowsBetween(0, 2)
    rows = _sized(frame).select("*", F.avg("radius").over(past).alias("m0"), _running_deviation(F.collect_list("radius").over(past)).alias("s0"), F.avg("radius").over(ahead).alias("m1"), _running_deviation(F.collect_list("radius").over(ahead)).alias("s1"))
    rows = rows.where("size > 5 and idx >= 2 and idx < size - 1").join(n_in.where("n_in >= 2"), ["box", "cc_id"]).join(_best_out(links), ["box", "cc_id"])
    gap, limit = F.abs(F.col("m1") - F.col("m0")), (F.col("s0") + F.col("s1")) / 0.6745
    rows = rows.where(gap > limit).withColumn("v", gap / F.nullif(limit, F.lit(0.0)))
    return _node(rows, "RADIUS_SUDDEN_CHANGE", "v").unionByName(_edge(rows, "parent", "cc_id", "RADIUS_SUDDEN_CHANGE_AT_TARGET", "v")).unionByName(_edge(rows, "cc_id", "next", "RADIUS_SUDDEN_CHANGE_AT_SOURCE", "v"))


def _ends(frame: DataFrame, *more: str) -> DataFrame:
    """Last nodes of organs with their time: box, cc_id and end."""
    lasts = frame.groupBy("box", "organ_id", *more).agg(F.max_by(F.struct("cc_id", "h_tip"), "idx").alias("e"))
    return lasts.select("box", *more, "e.cc_id", F.col("e.h_tip").alias("end"))


def final_time_outlier(frame: DataFrame) -> DataFrame:
    """Last nodes of organs that end more than 3 deviations from the median end of the box's organs, of which there must be over 3."""
    ends = _ends(frame)
    n = ends.groupBy("box").agg(F.count("*").alias("n")).where("n > 3").select("box")
    rows = ends.join(n, "box").join(mad_double_sided(ends, ["box"], F.col("end")), "box").withColumn("v", deviations(F.col("end")))
    return _node(rows.where("v > 3"), "FINAL_TIME_OUTLIER", "v")


def _cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    norm = F.nullif(F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / norm))


def _steps(frame: DataFrame) -> DataFrame:
    beside = {"prev": F.lag("cc_id"), "pcx": F.lag("cx"), "pcy": F.lag("cy"), "next": F.lead("cc_id"), "nfx": F.lead("fx"), "nfy": F.lead("fy")}
    return frame.withColumns({name: column.over(_organ()) for name, column in beside.items()}).withColumn("into", F.col("prev").isNotNull())


def sharp_angle(frame: DataFrame, least: float = 0.5) -> DataFrame:
    """Edges into and out of nodes where the way from connection to centre to connection turns by more than 60 degrees; values are degrees."""
    rows = _steps(frame).where("into and next is not null")
    cosine = _cosine(F.col("cx") - F.col("fx"), F.col("cy") - F.col("fy"), F.col("nfx") - F.col("cx"), F.col("nfy") - F.col("cy"))
    rows = rows.withColumn("cosine", cosine).where(F.col("cosine") < least).withColumn("v", F.degrees(F.acos("cosine")))
    return _edge(rows, "prev", "cc_id", "SHARP_ANGLE_AT_TARGET", "v").unionByName(_edge(rows, "cc_id", "next", "SHARP_ANGLE_AT_SOURCE", "v"))


def sharp_angle_terminal(frame: DataFrame, least: float = 0.5) -> DataFrame:
    """Last nodes, and their edge, whose direction from the centre before differs from that from the connection."""
    rows = _steps(frame).where("into and next is null")
    cosine = _cosine(F.col("cx") - F.col("pcx"), F.col("cy") - F.col("pcy"), F.col("cx") - F.col("fx"), F.col("cy") - F.col("fy"))
    rows = rows.withColumn("cosine", cosine).where(F.col("cosine") < least).withColumn("v", F.degrees(F.acos("cosine")))
    return _node(rows, "SHARP_ANGLE_TERMINAL", "v").unionByName(_edge(rows, "prev", "cc_id", "SHARP_ANGLE_AT_TERMINAL_TARGET", "v"))


def sharp_edge_angle(frame: DataFrame, least: float = 0.5) -> DataFrame:
    """Edges within an organ that turn at their connection, from centre to centre."""
    rows = _steps(frame).where("into")
    cosine = _cosine(F.col("fx") - F.col("pcx"), F.col("fy") - F.col("pcy"), F.col("cx") - F.col("fx"), F.col("cy") - F.col("fy"))
    rows = rows.withColumn("cosine", cosine).where(F.col("cosine") < least).withColumn("v", F.degrees(F.acos("cosine")))
    return _edge(rows, "prev", "cc_id", "SHARP_EDGE_ANGLE", "v")


def weird_child_surface(frame: DataFrame, typical: float) -> DataFrame:
    """Edges to laterals whose rate of growth lies more than 2 deviations from those of the 24 edges with the most alike parents.

    The edges of a box are ranked by the parent's log rate; a window of 25 ranks around an edge, shifted at the ends, gives its
    neighbours. Boxes with under 10 such edges have no flags.
    """
    rows = _weird(_rates(frame, typical))
    return _edge(rows, "parent", "cc_id", "WEIRD_CHILD_ORGAN_SURFACE", "v")


def _rates(frame: DataFrame, typical: float, *more: str) -> DataFrame:
    """Edges to laterals with both ends' log rates: box, parent, cc_id, rate and p_rate."""
    rate = frame.select("box", "cc_id", F.log(surface_growth_rate(F.col("n_px"), F.col("h_start"), F.col("h_tip"), typical) + EPS).alias("rate"))
    pairs = frame.where("idx = 0 and parent is not null").select("box", "parent", "cc_id", *more).join(rate, ["box", "cc_id"])
    return pairs.join(rate.select("box", F.col("cc_id").alias("parent"), F.col("rate").alias("p_rate")), ["box", "parent"])


def _middle(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The median of n values from first on in each sorted row; NaN without any."""
    at = lambda k: np.take_along_axis(values, np.minimum(first + np.maximum(k, 0), values.shape[1] - 1)[:, None], 1)[:, 0]
    return np.where(n > 0, 0.5 * at((n - 1) // 2) + 0.5 * at(n // 2), np.nan)


def _alike(names: list[str]):
    def run(rows: pa.Table, group: np.ndarray) -> pa.Table:
        at = rows.column("rank").to_numpy().astype(np.int64)
        order = np.lexsort((at, group))
        rows, at, n = rows.take(pa.array(order)), at[order] - 1, rows.column("n").to_numpy().astype(np.int64)[order]
        rate = rows.column("rate").fill_null(np.nan).to_numpy()
        found = []
        for a in range(0, len(rate), 1 << 16):
            own = np.arange(a, min(a + (1 << 16), len(rate)))
            begin = own - at[own] + np.maximum(0, np.minimum(at[own] - 12, n[own] - 25))
            near = begin[:, None] + np.arange(25)
            mine = (near < (own - at[own] + n[own])[:, None]) & (near != own[:, None])
            values = np.sort(np.where(mine, rate[np.minimum(near, len(rate) - 1)], np.nan), axis=1)
            known, none = (~np.isnan(values)).sum(axis=1), np.zeros(len(own), np.int64)
            median = _middle(values, none, known)
            under = (values < median[:, None]).sum(axis=1)
            found.append((median, _middle(values, none, (values <= median[:, None]).sum(axis=1)), _middle(values, under, known - under)))
        stats = {c: pa.array(np.concatenate(v), from_pandas=True) for c, v in zip(("median", "low", "high"), zip(*found))}
        return pa.table({c: rows.column(c) for c in names} | stats)

    return run


def _weird(pairs: DataFrame) -> DataFrame:
    """Of edges to laterals (box, parent, cc_id, rate, p_rate) those with v, the deviations of their rate from the 24 most alike ones, over 2."""
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("box").orderBy(F.round("p_rate", 9), "cc_id"))).withColumn("n", F.count("*").over(Window.partitionBy("box"))).where("n >= 10")
    names = ["box", "parent", "cc_id", "rate"]
    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in names) + ", median double, low double, high double"
    return whole_groups(ranked.select(*names, "rank", "n"), ["box"], _alike(names), schema).withColumn("v", deviations(F.col("rate"))).where("v > 2")


#: Flags that look at all organs of a box; the others look at one organ alone.
OF_BOX = ("FINAL_TIME_OUTLIER", "WEIRD_CHILD_ORGAN_SURFACE")


def _union(parts: list[DataFrame]) -> DataFrame:
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


def _organ_flags(frame: DataFrame, links: DataFrame, n_in: DataFrame) -> list[DataFrame]:
    return [radius_outlier(frame, links), _sudden_change(frame, links, n_in), sharp_angle(frame), sharp_angle_terminal(frame), sharp_edge_angle(frame)]


def all_flags(frame: DataFrame, links: DataFrame, edges: DataFrame, typical: float) -> DataFrame:
    """All flags of the organs; frame: with radius."""
    return _union([*_organ_flags(frame, links, incoming(edges)), final_time_outlier(frame), weird_child_surface(frame, typical)])


def anomaly_counts(flags: DataFrame) -> DataFrame:
    """Per box: flagged nodes and edges, and the number of flags."""
    of = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.struct("a", "b")))
    return flags.groupBy("box").agg(of("node").alias("nodes"), of("edge").alias("edges"), F.count("*").alias("level"))


def anomaly_inventory(flags: DataFrame) -> DataFrame:
    """Flagged nodes and edges with their reasons and values."""
    listed = F.array_sort(F.collect_list(F.struct("reason", F.round("value", 3).alias("value"))))
    return flags.groupBy("box", "kind", "a", "b").agg(F.count("*").alias("level"), listed.alias("reasons"))


def levels(flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number of flags by node (box, cc_id, level) and by edge (box, src, dst, level)."""
    nodes = flags.where("kind = 'node'").groupBy("box", F.col("a").alias("cc_id")).agg(F.count("*").alias("level"))
    return nodes, flags.where("kind = 'edge'").groupBy("box", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("level"))


def neighbourhood_anomaly(nodes: DataFrame, edges: DataFrame, links: DataFrame, flags: DataFrame) -> DataFrame:
    """Per node its own level, those of active edges at it, and those of the nodes that any edge (box, src, dst) joins to it."""
    by_node, by_edge = levels(flags)
    active = by_edge.join(links.select("box", "src", "dst"), ["box", "src", "dst"], "left_semi")
    ends = [active.select("box", F.col(c).alias("cc_id"), "level") for c in ("src", "dst")]
    across = [edges.select("box", F.col(a).alias("cc_id"), F.col(b).alias("o")).join(by_node.withColumnRenamed("cc_id", "o"), ["box", "o"]).select("box", "cc_id", "level") for a, b in (("src", "dst"), ("dst", "src"))]
    total = by_node
    for part in (*ends, *across):
        total = total.unionByName(part)
    sums = total.groupBy("box", "cc_id").agg(F.sum("level").alias("level"))
    return nodes.select("box", "cc_id").join(sums, ["box", "cc_id"], "left").fillna({"level": 0})


def alternative_incoming(edges: DataFrame, links: DataFrame, flags: DataFrame) -> DataFrame:
    """For each radius outlier the other edges into it that have fewer flags than its active one: box, cc_id, src (now), other, level and other_level."""
    _, by_edge = levels(flags)
    known = edges.select("box", "src", "dst").join(by_edge, ["box", "src", "dst"], "left").fillna({"level": 0})
    odd = flags.where("reason = 'RADIUS_OUTLIER'").select("box", F.col("a").alias("dst")).distinct()
    now = known.join(links.select("box", "src", "dst"), ["box", "src", "dst"], "left_semi").join(odd, ["box", "dst"])
    other = known.join(links.select("box", "src", "dst"), ["box", "src", "dst"], "left_anti").select("box", "dst", F.col("src").alias("other"), F.col("level").alias("other_level"))
    return now.join(other, ["box", "dst"]).where("other_level < level").select("box", F.col("dst").alias("cc_id"), "src", "other", "level", "other_level")


def rewire_candidates(frame: DataFrame, edges: DataFrame, flags: DataFrame, reach: float = 3.0) -> DataFrame:
    """For each edge to a lateral of a weird surface the components that it could come from instead, through its source: box, src, dst and other.

    They are neighbours of the source (over any edge), not later than the target, within `reach` times the doubled way from the connection to the
    target, on the other side of the connection, at most 45 degrees off the edge's direction, and flagged themselves or at an edge.
    """
    odd = flags.where("reason = 'WEIRD_CHILD_ORGAN_SURFACE'").select("box", F.col("a").alias("src"), F.col("b").alias("dst"))
    place = lambda name, p: frame.select("box", F.col("cc_id").alias(name), *(F.col(c).alias(f"{p}_{c}") for c in ("cx", "cy", "h_tip")))
    around = edges.select("box", "src", F.col("dst").alias("other")).unionByName(edges.select("box", F.col("dst").alias("src"), F.col("src").alias("other"))).distinct()
    flagged = flags.where("kind = 'node'").select("box", F.col("a").alias("other")).unionByName(flags.where("kind = 'edge'").select("box", F.explode(F.array("a", "b")).alias("other"))).distinct()
    rows = odd.join(frame.select("box", F.col("cc_id").alias("dst"), "fx", "fy"), ["box", "dst"]).join(place("dst", "t"), ["box", "dst"])
    rows = rows.join(around, ["box", "src"]).where("other <> dst").join(place("other", "o"), ["box", "other"]).join(flagged, ["box", "other"], "left_semi")
    tx, ty = F.col("t_cx") - F.col("fx"), F.col("t_cy") - F.col("fy")
    way, to = 2 * F.sqrt(tx * tx + ty * ty), C.distance(F.col("t_cx"), F.col("t_cy"), F.col("o_cx"), F.col("o_cy"))
    beyond = tx * (F.col("o_cx") - F.col("fx")) + ty * (F.col("o_cy") - F.col("fy")) <= 0
    cosine = (tx * (F.col("t_cx") - F.col("o_cx")) + ty * (F.col("t_cy") - F.col("o_cy"))) / (way / 2 * to + EPS)
    return rows.where((F.col("o_h_tip") <= F.col("t_h_tip")) & (to <= reach * way) & beyond & (cosine >= F.sqrt(F.lit(0.5)))).select("box", "src", "dst", "other")


def repair_heuristic(proposals: DataFrame, flags: DataFrame, sizes: DataFrame) -> DataFrame:
    """Proposals (box, src, dst, other) with gain, half of the flags of the edge and its target, and what is downstream of the target (sizes: box, cc_id, n_nodes, px)."""
    by_node, by_edge = levels(flags)
    rows = proposals.join(by_edge, ["box", "src", "dst"], "left").join(by_node.select("box", F.col("cc_id").alias("dst"), F.col("level").alias("own")), ["box", "dst"], "left")
    rows = rows.join(sizes.select("box", F.col("cc_id").alias("dst"), "n_nodes", "px"), ["box", "dst"], "left")
    return rows.select("box", "src", "dst", "other", ((F.coalesce("level", F.lit(0)) + F.coalesce("own", F.lit(0))) / 2).alias("gain"), "n_nodes", "px")


def affected_neighbourhood(proposals: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that a proposal (box, src, dst, other) touches: its three, all at an edge of the target, and those that edges of the old and the new source lead to."""
    key = ["box", "src", "dst", "other"]
    out = edges.select("box", F.col("src").alias("at"), F.col("dst").alias("cc_id"))
    into = edges.select("box", F.col("dst").alias("at"), F.col("src").alias("cc_id"))
    own = proposals.select(*key, F.explode(F.array("src", "dst", "other")).alias("cc_id"))
    ahead = proposals.select(*key, F.explode(F.array("src", "dst", "other")).alias("at")).join(out, ["box", "at"]).select(*key, "cc_id")
    behind = proposals.withColumn("at", F.col("dst")).join(into, ["box", "at"]).select(*key, "cc_id")
    return own.unionByName(ahead).unionByName(behind).distinct()


def affected_edges(proposals: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (a, b) at a node that a proposal touches."""
    key = ["box", "src", "dst", "other"]
    nodes = affected_neighbourhood(proposals, edges)
    plain = edges.select("box", F.col("src").alias("a"), F.col("dst").alias("b"))
    both = [nodes.join(plain.withColumnRenamed(c, "cc_id"), ["box", "cc_id"]).withColumnRenamed("cc_id", c).select(*key, "a", "b") for c in ("a", "b")]
    return both[0].unionByName(both[1]).distinct()


def flag_forest(forest: DataFrame, times: DataFrame, links: DataFrame, edges: DataFrame, typical: float) -> tuple[DataFrame, DataFrame]:
    """The organ frame with radius and all flags of a forest."""
    frame = estimated_radius(organ_frame(forest, organs(forest), times)).transform(cut)
    return frame, all_flags(frame, links.transform(cut), edges, typical).transform(cut)


def _links(forest: DataFrame, edges: DataFrame) -> DataFrame:
    """Active edges with their costs; those that no edge stands for cost 100."""
    active = forest.where("parent is not null").select("box", F.col("parent").alias("src"), F.col("cc_id").alias("dst"))
    return active.join(edges.select("box", "src", "dst", "cost"), ["box", "src", "dst"], "left").fillna({"cost": 100.0})


def rewired(forest: DataFrame, edges: DataFrame, proposals: DataFrame) -> DataFrame:
    """The forest with the targets of proposals (one for each target) under their new parents; the connection is the one between the new and the old parent."""
    sides = edges.select("box", "src", "dst", "fx", "fy").unionByName(edges.select("box", F.col("dst").alias("src"), F.col("src").alias("dst"), "fx", "fy"))
    at = proposals.select("box", "src", "dst", "other").join(sides.select("box", "src", F.col("dst").alias("other"), F.col("fx").alias("nfx"), F.col("fy").alias("nfy")), ["box", "src", "other"])
    rows = forest.join(at.select("box", F.col("dst").alias("cc_id"), "other", "nfx", "nfy"), ["box", "cc_id"], "left")
    changed = {"parent": F.coalesce("other", "parent"), "fx": F.coalesce("nfx", "fx"), "fy": F.coalesce("nfy", "fy")}
    return rows.select(*(changed[c].alias(c) if c in changed else c for c in forest.columns))


def what_if_gain(forest: DataFrame, times: DataFrame, edges: DataFrame, proposals: DataFrame, typical: float, flagged: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Proposals with gain: by how much the number of flags of the box falls if the proposal alone is followed. flagged: the forest's frame and flags, where they are known.

    A proposal changes the organs of two trees, its target's and its new source's: only these are copied, under a name of the proposal's own, and all copies are flagged by one run
    of the same operators. Flags that look at all organs of a box take the other trees' organ ends and edges to laterals as they are. Proposals that would close a circle
    have no gain and are left out.
    """
    circles = within(forest, proposals.select("box", F.col("dst").alias("anc"), F.col("other").alias("node"))).select("box", F.col("anc").alias("dst"), F.col("node").alias("other"))
    open_ones = proposals.select("box", "src", "dst", "other").join(circles, ["box", "dst", "other"], "left_anti").select("box", "src", "dst", "other")
    cases = open_ones.withColumn("case", F.concat_ws("#", "box", "src", "dst", "other")).transform(cut)
    asked = cases.select("box").distinct()
    mine = lambda df: df.join(asked, "box", "left_semi")  # noqa: E731  boxes without an open proposal are not flagged
    frame, flags = map(mine, flagged) if flagged is not None else flag_forest(mine(forest), mine(times), _links(mine(forest), edges), mine(edges), typical)
    trees = along_paths(mine(forest)).select("box", "cc_id", F.col("root").alias("tree")).transform(cut)
    ends = cases.select("box", "case", F.explode(F.array("dst", "other")).alias("cc_id"))
    touched = ends.join(trees, ["box", "cc_id"]).select("box", "case", "tree").distinct().transform(cut)

    # The copies: the touched trees after each case, their frame and what stands at their nodes in the box.
    named = lambda df: df.drop("box").withColumnRenamed("case", "box")
    nodes = touched.join(trees, ["box", "tree"]).select("box", "case", "cc_id").transform(cut)
    at_nodes = lambda df: named(nodes.join(df, ["box", "cc_id"]))
    sides = edges.select("box", "src", "dst", "cost", "fx", "fy")
    of_cases = cases.select("box", "case", F.array("src", "other").alias("pair")).select("box", "case", F.explode(F.array(F.struct(F.col("pair")[0].alias("src"), F.col("pair")[1].alias("dst")), F.struct(F.col("pair")[1].alias("src"), F.col("pair")[0].alias("dst")))).alias("e")).select("box", "case", "e.*")
    changed = rewired(at_nodes(forest).select(*forest.columns), named(of_cases.join(sides, ["box", "src", "dst"])), named(cases)).transform(cut)
    active = changed.where("parent is not null").select(F.col("box").alias("case"), F.col("parent").alias("src"), F.col("cc_id").alias("dst")).join(cases.select("box", "case"), "case")
    links = named(active.join(sides.select("box", "src", "dst", "cost"), ["box", "src", "dst"], "left").fillna({"cost": 100.0})).select("box", "src", "dst", "cost").transform(cut)
    copy = estimated_radius(organ_frame(changed, organs(changed), at_nodes(times.select("box", "cc_id", "h_start", "h_tip")))).transform(cut)
    then = _union(_organ_flags(copy, links, at_nodes(incoming(edges)))).groupBy(F.col("box").alias("case")).agg(F.count("*").alias("n"))
    before = flags.where(~F.col("reason").isin(*OF_BOX)).join(trees.withColumnRenamed("cc_id", "a"), ["box", "a"]).groupBy("box", "tree").agg(F.count("*").alias("n"))
    before = touched.join(before, ["box", "tree"]).groupBy("case").agg(F.sum("n").alias("n"))

    # Flags of the box: the other trees' rows and the copies' rows. Ends are few values, so they are counted.
    rooted = frame.join(trees, ["box", "cc_id"])
    old = _ends(rooted, "tree").groupBy("box", "tree", "end").agg(F.count("*").alias("n")).transform(cut)
    all_of = cases.select("box", "case").join(old.groupBy("box", "end").agg(F.sum("n").alias("n")), "box").select("case", "end", "n")
    gone = touched.join(old, ["box", "tree"]).select("case", "end", (-F.col("n")).alias("n"))
    come = _ends(copy).groupBy(F.col("box").alias("case"), "end").agg(F.count("*").alias("n"))
    late = _late(_union([all_of, gone, come]).groupBy("case", "end").agg(F.sum("n").alias("n")).where("n > 0"))
    pairs = _rates(rooted, typical, "tree").transform(cut)
    rest = cases.select("box", "case").join(pairs, "box").join(touched, ["box", "case", "tree"], "left_anti")
    weird = _weird(named(rest.drop("tree")).unionByName(_rates(copy, typical))).groupBy(F.col("box").alias("case")).agg(F.count("*").alias("n"))
    now = flags.where(F.col("reason").isin(*OF_BOX)).groupBy("box").agg(F.count("*").alias("now"))

    falls = _union([before, *(df.select("case", (-F.col("n")).alias("n")) for df in (then, late, weird))]).groupBy("case").agg(F.sum("n").alias("n"))
    rows = cases.join(now, "box", "left").join(falls, "case", "left")
    return rows.select("box", "src", "dst", "other", (F.coalesce("now", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("gain"))


def _late(ends: DataFrame) -> DataFrame:
    """The number of ends that final_time_outlier flags, of ends (case, end) that occur n times."""
    by = Window.partitionBy("case")
    half = lambda value: F.percentile(value, F.lit(0.5), F.col("n")).over(by)
    rows = ends.withColumn("median", half(F.col("end"))).withColumn("of", F.sum("n").over(by)).where("of > 3")
    rows = rows.withColumns({"low": half(F.when(F.col("end") <= F.col("median"), F.col("end"))), "high": half(F.when(F.col("end") >= F.col("median"), F.col("end")))})
    return rows.where(deviations(F.col("end")) > 3).groupBy("case").agg(F.sum("n").alias("n"))


def greedy_repair(forest: DataFrame, times: DataFrame, edges: DataFrame, typical: float, most_rounds: int = 10, most: int = 1 << 15) -> tuple[DataFrame, DataFrame]:
    """The forest after up to most_rounds rounds, in each of which every box follows its proposal of the largest gain over 0 (then of most pixels downstream, then the
    least), and what was done: box, round, src, dst, other and gain.

    Boxes of at most `most` nodes and as many edges go through their rounds inside a task. The others' rounds are joins over tables; a box that follows none has ended there: its
    rows are set aside, so a round costs what is still open.
    """
    gone = forest.select("box", "cc_id")
    odd = forest.where("parent is not null").select("box", F.col("parent").alias("cc_id")).join(gone, ["box", "cc_id"], "left_anti").select("box").unionByName(gone.join(times, ["box", "cc_id"], "left_anti").select("box"))
    large = _union([df.groupBy("box").agg(F.count("*").alias("n")).where(F.col("n") > most).select("box") for df in (forest, edges)] + [odd]).distinct().transform(cut)
    inside = repairs_inside(forest.join(large, "box", "left_anti"), times, edges, typical, most_rounds).transform(cut)
    names = ["box", "round", "src", "dst", "other", "gain"]
    last = inside.groupBy("box", F.col("dst").alias("cc_id")).agg(F.max_by(F.struct("other", "fx", "fy"), "round").alias("m"))
    now = {"parent": "other", "fx": "fx", "fy": "fy"}
    moved = forest.join(large, "box", "left_anti").join(last, ["box", "cc_id"], "left")
    after = moved.select(*(F.when(F.col("m").isNotNull(), F.col(f"m.{now[c]}")).otherwise(F.col(c)).cast(forest.schema[c].dataType).alias(c) if c in now else F.col(c) for c in forest.columns))
    if large.isEmpty():
        return after, inside.select(*names)
    forest, times, edges = (df.join(large, "box", "left_semi").transform(cut) for df in (forest, times, edges))
    left, done = _repairs_over_tables(forest, times, edges, typical, most_rounds)
    return after.unionByName(left), inside.select(*names).unionByName(done)


def _repairs_over_tables(forest: DataFrame, times: DataFrame, edges: DataFrame, typical: float, most_rounds: int) -> tuple[DataFrame, DataFrame]:
    done, ended = None, forest.limit(0)
    for k in range(1, most_rounds + 1):
        frame, flags = flag_forest(forest, times, _links(forest, edges), edges, typical)
        gains = what_if_gain(forest, times, edges, rewire_candidates(frame, edges, flags), typical, (frame, flags)).where("gain > 0")
        sized = gains.join(subtree_totals(forest).select("box", F.col("cc_id").alias("dst"), "px"), ["box", "dst"])
        first = F.row_number().over(Window.partitionBy("box").orderBy(F.desc("gain"), F.desc("px"), "dst", "other"))
        best = sized.withColumn("n", first).where("n = 1").select("box", F.lit(k).alias("round"), "src", "dst", "other", "gain").transform(cut)
        done = best if done is None else done.unionByName(best)
        if best.isEmpty():
            break
        going = best.select("box").distinct()
        ended = ended.unionByName(forest.join(going, "box", "left_anti"))
        times, edges = (df.join(going, "box", "left_semi").transform(cut) for df in (times, edges))
        forest = rewired(forest.join(going, "box", "left_semi"), edges, best).transform(cut)
    return ended.unionByName(forest), done
