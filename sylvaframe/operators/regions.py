"""Connected components of date maps, their attributes, adjacency and the edges between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.functions import scalars as C
from sylvaframe.operators.cut import cut
from sylvaframe.operators.graph import component_labels
from sylvaframe.operators.groups import tiled, whole_groups
from sylvaframe.operators.nearest import nearest
from sylvaframe.operators.raster import dilate_erode
from sylvaframe.operators.timebase import mad_double_sided


def side_pairs(pixels: DataFrame, extra: list[str]) -> DataFrame:
    """Pairs of 4-neighbours: each pixel (p) with the one to its right and the one below (q)."""
    moves = F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    p = pixels.select("box", F.col("x").alias("px"), F.col("y").alias("py"), *(F.col(c).alias(f"p_{c}") for c in extra), F.explode(moves).alias("m"))
    p = p.withColumn("qx", F.col("px") + F.col("m.dx")).withColumn("qy", F.col("py") + F.col("m.dy")).drop("m")
    q = pixels.select("box", F.col("x").alias("qx"), F.col("y").alias("qy"), *(F.col(c).alias(f"q_{c}") for c in extra))
    return p.join(q, ["box", "qx", "qy"])


def _pieces(rows: pa.Table, group: np.ndarray) -> pa.Table:
    """Each pixel with the place of the first pixel, in reading order, of its region inside its tile."""
    x, y, day = (rows.column(c).to_numpy() for c in ("x", "y", "day"))
    x, y = x.astype(np.int64), y.astype(np.int64)

    def beside(order: np.ndarray, line: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of one date that follow each other on a line."""
        a, b = order[:-1], order[1:]
        met = (group[a] == group[b]) & (line[a] == line[b]) & (along[b] - along[a] <= 1) & (day[a] == day[b])
        return a[met], b[met]

    reading = np.lexsort((x, y, group))
    pairs = beside(reading, y, x), beside(np.lexsort((y, x, group)), x, y)
    rank = np.empty(len(reading), np.int64)
    rank[reading] = np.arange(len(reading))
    a, b = (rank[np.concatenate([p[i] for p in pairs])] for i in (0, 1))
    label = np.arange(len(reading))
    while True:
        new, least = label.copy(), np.minimum(label[a], label[b])
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    first = reading[label[rank]]
    return rows.drop_columns(["tx", "ty"]).append_column("piece", pa.array(y[first] * (1 << 20) + x[first]))


def connected_components(dates: DataFrame, tile: int = 128) -> DataFrame:
    """box, x, y, day, cc_id: 4-connected regions of one date (not 0), numbered by their first pixel in reading order.

    Tiles find their regions by themselves; only regions that meet another one of their date over a tile's border are joined in rounds.
    """
    pixels = dates.where("day > 0").select("box", "x", "y", "day").dropna(subset=["box", "x", "y"])
    at = lambda c: F.floor(F.col(c) / tile)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pixels.schema) + ", piece long"
    found = cut(whole_groups(pixels.withColumns({"tx": at("x"), "ty": at("y")}), ["box", "tx", "ty"], _pieces, schema))
    first = lambda c: F.pmod(F.col(c), F.lit(tile)) == 0
    last = lambda c: F.pmod(F.col(c), F.lit(tile)) == tile - 1
    rim = found.where(first("x") | last("x") | first("y") | last("y"))
    across = side_pairs(rim, ["day", "piece"]).where("p_day = q_day and p_piece <> q_piece")
    links = cut(across.select("box", F.col("p_piece").alias("a"), F.col("q_piece").alias("b")).distinct())
    if links.isEmpty():
        labels = found.withColumn("label", F.col("piece"))
    else:
        joined = component_labels(links.select("box", F.col("a").alias("node")).unionByName(links.select("box", F.col("b").alias("node"))), links)
        labels = found.join(joined.withColumnRenamed("node", "piece"), ["box", "piece"], "left").withColumn("label", F.coalesce("label", "piece"))
    number = labels.select("box", "label").distinct().withColumn("cc_id", F.row_number().over(Window.partitionBy("box").orderBy("label")).cast("long"))
    return labels.join(number, ["box", "label"]).select("box", "x", "y", "day", "cc_id")


def component_attributes(labelled: DataFrame) -> DataFrame:
    """Date, size, bounding box and centre (by whole division) of each component."""
    return labelled.groupBy("box", "cc_id").agg(
        F.min("day").alias("day"), F.count("*").alias("n_px"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"),
        F.floor(F.sum("x") / F.count("*")).alias("cx"), F.floor(F.sum("y") / F.count("*")).alias("cy"),
    )


def component_size_filter(labelled: DataFrame, least: int) -> DataFrame:
    big = labelled.groupBy("box", "cc_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return labelled.join(big, ["box", "cc_id"], "left_semi")


def component_central_pixel(labelled: DataFrame, attributes: DataFrame) -> DataFrame:
    """The mean place of a component where the four pixels around it belong to it, else its pixel nearest to the centre by whole division, the first in (x, y) of equals."""
    d2 = F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2))
    rows = labelled.join(attributes.select("box", "cc_id", "cx", "cy"), ["box", "cc_id"])
    near = rows.groupBy("box", "cc_id").agg(F.min(F.struct(d2.alias("d2"), "x", "y")).alias("p"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    corners = F.array_distinct(F.array(*(F.struct(fx("mx").cast("int").alias("x"), fy("my").cast("int").alias("y")) for fx in (F.floor, F.ceil) for fy in (F.floor, F.ceil))))
    probes = near.select("box", "cc_id", F.explode(corners).alias("c")).select("box", "cc_id", "c.x", "c.y")
    missing = probes.join(labelled.select("box", "cc_id", "x", "y"), ["box", "cc_id", "x", "y"], "left_anti").select("box", "cc_id").distinct().withColumn("gap", F.lit(True))
    found = near.join(missing, ["box", "cc_id"], "left")
    pick = lambda pixel, mean: F.when(F.col("gap"), F.col(pixel).cast("double")).otherwise(F.col(mean))
    return found.select("box", "cc_id", pick("p.x", "mx").alias("x"), pick("p.y", "my").alias("y"))


def component_times(attributes: DataFrame, hours: DataFrame) -> DataFrame:
    """Tip hour (of observation day - 1), start hour (of the one before, if any) and their mean."""
    tip = hours.select((F.col("i") + 1).alias("day"), F.col("h").alias("h_tip"))
    start = hours.select((F.col("i") + 2).alias("day"), F.col("h").alias("h_start"))
    both = attributes.join(tip, "day").join(start, "day", "left").withColumn("h_start", F.coalesce("h_start", "h_tip"))
    return both.select("box", "cc_id", "h_start", ((F.col("h_start") + F.col("h_tip")) / 2).alias("h_mid"), "h_tip")


def enclosed_components(dates: DataFrame, labelled: DataFrame, width: int, height: int) -> DataFrame:
    """Components off the border whose outer 4-neighbours are all there, have one other date and no background."""
    moves = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    around = labelled.select("box", "cc_id", F.col("day").alias("own"), "x", "y", F.explode(moves).alias("m"))
    around = around.withColumn("x", F.col("x") + F.col("m.dx")).withColumn("y", F.col("y") + F.col("m.dy"))
    seen = around.join(dates.select("box", "x", "y", "day"), ["box", "x", "y"], "left").fillna({"day": 0})
    outer = seen.where("day <> own").groupBy("box", "cc_id").agg(F.min("day").alias("least"), F.count_distinct("day").alias("n"))
    return outer.where("least > 0 and n = 1").select("box", "cc_id")


def pixel_membership(points: DataFrame, labelled: DataFrame) -> DataFrame:
    """Points (box, x, y) that lie in a component."""
    return points.join(labelled, ["box", "x", "y"], "left_semi")


def fuse_components(attributes: DataFrame, group: Column) -> DataFrame:
    """Attributes of unions of components."""
    own = attributes.withColumn("grp", group).groupBy("box", "grp")
    return own.agg(F.sum("n_px").alias("n_px"), F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"), F.count("*").alias("n"))


EPS = 1e-6


def surface_growth_rate(n_px: Column, start: Column, tip: Column, typical: float) -> Column:
    """Pixels an hour, over `typical` hours where the start is the tip."""
    return n_px / F.when(tip == start, typical).otherwise(tip - start + EPS)


def rounded_rate(n_px: Column, start: Column, tip: Column) -> Column:
    """Whole pixels an hour; without a duration it is about infinite."""
    return F.floor(n_px / F.when(tip == start, EPS).otherwise(tip - start) + 0.5)


def timed_edges(edges: DataFrame, times: DataFrame) -> DataFrame:
    """Edges with the hours of both components: s_start, s_mid, s_tip, t_start, t_mid and t_tip (times: component_times)."""
    side = lambda name, p: times.select("box", F.col("cc_id").alias(name), *(F.col(f"h_{h}").alias(f"{p}_{h}") for h in ("start", "mid", "tip")))
    return edges.join(side("src", "s"), ["box", "src"]).join(side("dst", "t"), ["box", "dst"])


def nearest_component(points: DataFrame, attributes: DataFrame, point_id: str) -> DataFrame:
    """For each point (box, point_id, px, py) the component of its box with the nearest centre, the least id of equals."""
    things = attributes.select("box", "cc_id", F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    return nearest(points, things, ["box"], [point_id], ["cc_id"]).select("box", point_id, "cc_id", "d2")


def max_label_per_date(attributes: DataFrame) -> DataFrame:
    return attributes.groupBy("box", "day").agg(F.max("cc_id").alias("max_label"))


def component_order_x(attributes: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("box").orderBy("cx", "cc_id"))
    return attributes.select("box", "cc_id", rank.alias("place"))


def bbox_candidates(attributes: DataFrame, cell: int = 16) -> DataFrame:
    """Pairs of components of a box whose bounding boxes overlap or touch; boxes meet in the grid cells that both reach."""
    cells = lambda a, b, more: F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) + more) / cell))
    spread = attributes.select("box", "cc_id", "xmin", "xmax", "ymin", "ymax", F.explode(cells("xmin", "xmax", 1)).alias("gx")).withColumn("gy", F.explode(cells("ymin", "ymax", 1)))
    a = spread.select("box", "gx", "gy", *(F.col(c).alias(f"a_{c}") for c in ("cc_id", "xmin", "xmax", "ymin", "ymax")))
    b = spread.select("box", "gx", "gy", *(F.col(c).alias(f"b_{c}") for c in ("cc_id", "xmin", "xmax", "ymin", "ymax")))
    touch = "a_cc_id < b_cc_id and a_xmin <= b_xmax + 1 and b_xmin <= a_xmax + 1 and a_ymin <= b_ymax + 1 and b_ymin <= a_ymax + 1"
    return a.join(b, ["box", "gx", "gy"]).where(touch).select("box", F.col("a_cc_id").alias("a"), F.col("b_cc_id").alias("b")).distinct()


def facets(labelled: DataFrame) -> DataFrame:
    """box, src (of the earlier date), dst, n_facets and their mean place, for components of different dates that share a side."""
    pairs = side_pairs(labelled.select("box", "x", "y", "day", "cc_id"), ["day", "cc_id"]).where("p_day <> q_day")
    first = F.col("p_day") < F.col("q_day")
    sides = pairs.select(
        "box", F.when(first, F.col("p_cc_id")).otherwise(F.col("q_cc_id")).alias("src"), F.when(first, F.col("q_cc_id")).otherwise(F.col("p_cc_id")).alias("dst"),
        ((F.col("px") + F.col("qx")) / 2).alias("fx"), ((F.col("py") + F.col("qy")) / 2).alias("fy"),
    )
    return sides.groupBy("box", "src", "dst").agg(F.count("*").alias("n_facets"), F.avg("fx").alias("fx"), F.avg("fy").alias("fy"))


def adjacency_edges(found: DataFrame, attributes: DataFrame) -> DataFrame:
    """Facets with the dates, sizes and centres of both components."""
    side = lambda name, p: attributes.select("box", F.col("cc_id").alias(name), F.col("day").alias(f"day_{p}"), F.col("n_px").alias(f"n_{p}"), F.col("cx").alias(f"{p}x"), F.col("cy").alias(f"{p}y"))
    return found.join(side("src", "s"), ["box", "src"]).join(side("dst", "t"), ["box", "dst"])


def degrees(attributes: DataFrame, edges: DataFrame) -> DataFrame:
    """box, cc_id, n_out and n_in."""
    outs = edges.groupBy("box", F.col("src").alias("cc_id")).agg(F.count("*").alias("n_out"))
    ins = edges.groupBy("box", F.col("dst").alias("cc_id")).agg(F.count("*").alias("n_in"))
    return attributes.select("box", "cc_id").join(outs, ["box", "cc_id"], "left").join(ins, ["box", "cc_id"], "left").fillna({"n_out": 0, "n_in": 0})


def drop_late_isolated_starts(attributes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components without an incoming edge whose nearest successor is more than one date later, or that have none, and why."""
    ahead = edges.groupBy("box", F.col("src").alias("cc_id")).agg(F.min(F.col("day_t") - F.col("day_s")).alias("gap"))
    alone = attributes.join(edges.select("box", F.col("dst").alias("cc_id")), ["box", "cc_id"], "left_anti").join(ahead, ["box", "cc_id"], "left")
    why = F.when(F.col("gap").isNull(), "no successor").when(F.col("gap") > 1, "late successor")
    return alone.select("box", "cc_id", why.alias("reason")).where("reason is not null")


def _rounded(side: str) -> Column:
    return rounded_rate(F.col(f"n_{side}"), F.col(f"{side}_start"), F.col(f"{side}_tip"))


def exclude_fuzzy_dead_ends(attributes: DataFrame, edges: DataFrame, ratio: float = 10.0) -> DataFrame:
    """Leaves with one parent that has more children and grows over `ratio` times as fast, by whole pixels an hour; edges: timed_edges."""
    n = degrees(attributes, edges)
    leaf = n.where("n_out = 0 and n_in = 1").select("box", F.col("cc_id").alias("dst"))
    forks = n.where("n_out > 1").select("box", F.col("cc_id").alias("src"))
    found = edges.join(leaf, ["box", "dst"]).join(forks, ["box", "src"]).where(_rounded("s") > ratio * _rounded("t"))
    return found.select("box", F.col("dst").alias("cc_id"), F.lit("DEAD_END_FUZZY_SURFACE").alias("reason"))


def exclude_tiny_starts(attributes: DataFrame, edges: DataFrame, ratio: float = 10.0) -> DataFrame:
    """Starts with a single successor that grows over `ratio` times as fast, by whole pixels an hour; edges: timed_edges."""
    start = degrees(attributes, edges).where("n_in = 0 and n_out = 1").select("box", F.col("cc_id").alias("src"))
    found = edges.join(start, ["box", "src"]).where(_rounded("t") > ratio * _rounded("s"))
    return found.select("box", F.col("src").alias("cc_id"), F.lit("START_VERY_SMALL_RELATIVE_TO_SUCCESSOR").alias("reason"))


def extremity_flag(attributes: DataFrame, active: DataFrame) -> DataFrame:
    """Components without an active parent or without an active child."""
    n = degrees(attributes, active)
    return n.select("box", "cc_id", ((F.col("n_in") == 0) | (F.col("n_out") == 0)).alias("is_extremity"))


def set_out(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """Edges without those at an excluded component (box, cc_id)."""
    kept = edges.join(excluded.select("box", F.col("cc_id").alias("src")), ["box", "src"], "left_anti")
    return kept.join(excluded.select("box", F.col("cc_id").alias("dst")), ["box", "dst"], "left_anti")


def activate_unique_links(edges: DataFrame) -> DataFrame:
    n = lambda side: F.count("*").over(Window.partitionBy("box", side))
    return edges.withColumn("n_out", n("src")).withColumn("n_in", n("dst")).where("n_out = 1 and n_in = 1").drop("n_out", "n_in")


def activate_daily_unique_links(edges: DataFrame, ratio: float = 3.0) -> DataFrame:
    """Edges over one date, the only such ones at both ends, whose rates of growth differ by a ratio at most; edges: timed_edges."""
    rate = lambda p: F.col(f"n_{p}") / (F.col(f"{p}_tip") - F.col(f"{p}_start") + EPS)
    alike = (rate("t") <= ratio * rate("s")) & (rate("s") <= ratio * rate("t"))
    return activate_unique_links(edges.where("day_t = day_s + 1")).where(alike)


def hint_vectors(edges: DataFrame) -> DataFrame:
    """Unit vector and length from the connection to the target's centre; no vector for no length."""
    n = C.distance(F.col("fx"), F.col("fy"), F.col("tx"), F.col("ty"))
    safe = F.nullif(n, F.lit(0.0))
    return edges.select("box", "src", "dst", n.alias("length"), ((F.col("tx") - F.col("fx")) / safe).alias("ux"), ((F.col("ty") - F.col("fy")) / safe).alias("uy"))


def surface_cost(n_s: Column, n_t: Column) -> Column:
    """Relative difference of sizes."""
    return C.similarity_cost(n_s, n_t)


def _turn() -> Column:
    """Orientation of an edge against downwards; a target whose centre is the connection costs most."""
    return F.coalesce(C.orientation_cost(F.lit(0.0), F.lit(1.0), F.col("tx") - F.col("fx"), F.col("ty") - F.col("fy")), F.lit(100.0))


def edge_cost_static(edges: DataFrame) -> DataFrame:
    """Time, twice the orientation against downwards, and the relative size difference; at most 100."""
    cost = C.time_cost(F.col("day_s"), F.col("day_t")) + 2 * _turn() + surface_cost(F.col("n_s"), F.col("n_t"))
    return edges.withColumn("cost", F.least(F.lit(100.0), cost))


def edge_velocity(edges: DataFrame, typical: float) -> DataFrame:
    """Distance from the connection to the target's centre over the hours from its start to its centre, over half of `typical` where they are equal; edges: timed_edges."""
    hours = F.when(F.col("t_mid") == F.col("t_start"), typical / 2).otherwise(F.col("t_mid") - F.col("t_start") + EPS)
    return edges.withColumn("speed", C.distance(F.col("fx"), F.col("fy"), F.col("tx"), F.col("ty")) / hours)


def _log_rates(typical: float) -> tuple[Column, Column]:
    """Logarithms of the source's rate of growth and of its ratio to the target's."""
    rate = lambda p: surface_growth_rate(F.col(f"n_{p}"), F.col(f"{p}_start"), F.col(f"{p}_tip"), typical)
    return F.log(rate("s") + EPS), F.log(rate("s") / (rate("t") + EPS) + EPS)


def speed_samples(edges: DataFrame, active: Column, typical: float) -> DataFrame:
    """A sample for each target: of its cheapest active incoming edge, else of its cheapest incoming edge; edges: timed_edges with a cost.

    Where a component's start is its tip, its growth took half of `typical` here. A speed of 0 counts as 1e-6.
    """
    rate, ratio = _log_rates(typical / 2)
    best = F.min_by(F.struct("src", rate.alias("rate"), ratio.alias("ratio"), F.log(F.greatest("speed", F.lit(EPS))).alias("speed")), F.struct((~active).cast("int"), "cost", "src"))
    rows = edge_velocity(edges, typical).groupBy("box", F.col("dst").alias("id")).agg(best.alias("b"))
    return rows.select("box", "id", "b.src", "b.rate", "b.ratio", "b.speed")


def knn_speed_stats(queries: DataFrame, samples: DataFrame, k: int = 20) -> DataFrame:
    """box, query, and the median, lower and upper median of the speeds of the query's k nearest samples (box, id, rate, ratio, speed) of its box.

    queries: box, query (a struct or an id), rate, ratio. Ties go to the least id; with fewer samples all count.
    """
    points = queries.select("box", "query", F.col("rate").alias("px"), F.col("ratio").alias("py"))
    things = samples.select("box", "id", F.col("rate").alias("tx"), F.col("ratio").alias("ty"))
    near = nearest(points, things, ["box"], ["query"], ["id"], k, digits=9).join(samples.select("box", "id", "speed"), ["box", "id"])
    return mad_double_sided(near, ["box", "query"], F.col("speed"))


def distance_cost(edges: DataFrame, samples: DataFrame, typical: float, k: int = 20) -> DataFrame:
    """box, src, dst and distance_cost: how far an edge's log speed lies from those of the k samples of the most alike growth; edges: timed_edges.

    Edges with `path_length` (null for those that are not hidden) have that length over the hours between the centres.
    """
    rate, ratio = _log_rates(typical)
    speed = edge_velocity(edges, typical)
    if "path_length" in edges.columns:
        hours = F.when(F.col("t_mid") == F.col("s_mid"), typical / 2).otherwise(F.col("t_mid") - F.col("s_mid") + EPS)
        speed = speed.withColumn("speed", F.coalesce(F.col("path_length") / hours, "speed"))
    # Costs depend on the values alone, so equal queries are asked once.
    asked = speed.select("box", "src", "dst", F.struct(F.round(rate, 9).alias("rate"), F.round(ratio, 9).alias("ratio")).alias("query"), F.log(F.col("speed") + EPS).alias("log_speed"))
    queries = asked.select("box", "query").distinct().select("box", "query", "query.rate", "query.ratio")
    stats = knn_speed_stats(queries, samples, k)
    cost = C.mad_cost(F.col("log_speed"), F.col("median"), F.col("low"), F.col("high"))
    return asked.join(stats, ["box", "query"]).select("box", "src", "dst", cost.alias("distance_cost"))


def edge_cost_velocity(edges: DataFrame, samples: DataFrame, typical: float, k: int = 20) -> DataFrame:
    """Time, ten times the connectivity of hidden edges, three times the distance, twice the orientation and the size difference; at most 100, which is also the cost of what has none.

    edges: timed_edges, those of hidden edges with `path` (of components) and `path_length`.
    """
    near = distance_cost(edges, samples, typical, k)
    through = F.when(F.col("path").isNotNull(), C.connectivity_cost(F.col("path"))).otherwise(0.0) if "path" in edges.columns else F.lit(0.0)
    cost = C.time_cost(F.col("day_s"), F.col("day_t")) + 10 * through + 3 * F.col("distance_cost") + 2 * _turn() + surface_cost(F.col("n_s"), F.col("n_t"))
    bad = (F.col("day_s") == 0) | (F.col("day_s") > F.col("day_t")) | (F.col("src") == F.col("dst"))
    full = edges.join(near, ["box", "src", "dst"], "left")
    return full.withColumn("cost", F.when(bad, 100.0).otherwise(F.least(F.lit(100.0), F.coalesce(cost, F.lit(100.0)))))


def hidden_edge_candidates(attributes: DataFrame, edges: DataFrame, most_steps: int | None = None) -> DataFrame:
    """box, src, dst and path: from each component the shortest way, over edges in both directions and through components that are not later, to
    each of the same date and to each later one that the way meets first. Of equal lengths the least path counts.

    Components with at most one edge in and one out start no search. most_steps bounds the length of ways; None searches on until
    nothing new is met. A round joins only the newest ends of ways.
    """
    n = degrees(attributes, edges).where("n_out > 1 or n_in > 1").select("box", "cc_id")
    dates = attributes.where("day > 0").select("box", "cc_id", "day")
    both = edges.select("box", F.col("src").alias("at"), F.col("dst").alias("to")).unionByName(edges.select("box", F.col("dst").alias("at"), F.col("src").alias("to")))
    both = both.join(dates.select("box", F.col("cc_id").alias("to"), F.col("day").alias("to_day")), ["box", "to"]).transform(cut)
    front = dates.join(n, ["box", "cc_id"]).select("box", F.col("cc_id").alias("src"), "day", F.col("cc_id").alias("at"), F.array("cc_id").alias("path")).transform(cut)
    seen = front.select("box", "src", "at")
    found, steps = None, 0
    while most_steps is None or steps < most_steps:
        steps += 1
        ahead = front.join(both, ["box", "at"]).select("box", "src", "day", "to", "to_day", F.concat("path", F.array("to")).alias("path"))
        new = ahead.groupBy("box", "src", "to").agg(F.min("path").alias("path"), F.first("day").alias("day"), F.first("to_day").alias("to_day"))
        new = new.join(seen.withColumnRenamed("at", "to"), ["box", "src", "to"], "left_anti").transform(cut)
        if new.isEmpty():
            break
        ends = new.where("to_day >= day").select("box", "src", F.col("to").alias("dst"), "path")
        found = ends if found is None else found.unionByName(ends)
        seen = seen.unionByName(new.select("box", "src", F.col("to").alias("at"))).transform(cut)
        front = new.where("to_day <= day").select("box", "src", "day", F.col("to").alias("at"), "path")
    return found if found is not None else front.select("box", "src", F.col("at").alias("dst"), "path").limit(0)


def component_path_length(paths: DataFrame, edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """Lengths of ways (box, src, dst, path): from the first centre over the connections between its components to the last centre."""
    key = ["box", "src", "dst"]
    steps = paths.select(*key, F.posexplode("path").alias("i", "at"), F.col("path").alias("p")).withColumn("to", F.get("p", F.col("i") + 1)).drop("p")
    sides = edges.select("box", F.col("src").alias("at"), F.col("dst").alias("to"), "fx", "fy").unionByName(edges.select("box", F.col("dst").alias("at"), F.col("src").alias("to"), "fx", "fy"))
    links = steps.where("to is not null").join(sides, ["box", "at", "to"]).select(*key, (F.col("i") + 1).alias("i"), F.col("fx").alias("x"), F.col("fy").alias("y"))
    centres = attributes.select("box", "cc_id", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"))
    first = paths.select(*key).join(centres.withColumnRenamed("cc_id", "src"), ["box", "src"]).select(*key, F.lit(0).alias("i"), "x", "y")
    last = paths.select(*key, F.size("path").alias("i")).join(centres.withColumnRenamed("cc_id", "dst"), ["box", "dst"]).select(*key, "i", "x", "y")
    order = Window.partitionBy(*key).orderBy("i")
    points = first.unionByName(links).unionByName(last)
    leg = C.distance(F.lag("x").over(order), F.lag("y").over(order), F.col("x"), F.col("y"))
    return points.withColumn("leg", leg).groupBy(*key).agg(F.sum("leg").alias("path_length"))


def organ_neighbours(edges: DataFrame, organ_nodes: DataFrame) -> DataFrame:
    """For each component the components of its own order before and after it along active edges (box, src, dst), the least of several."""
    order = organ_nodes.select("box", "cc_id", "ord")
    same = edges.select("box", "src", "dst").join(order.select("box", F.col("cc_id").alias("src"), F.col("ord").alias("a")), ["box", "src"]).join(order.select("box", F.col("cc_id").alias("dst"), F.col("ord").alias("b")), ["box", "dst"]).where("a = b")
    before = same.groupBy("box", F.col("dst").alias("cc_id")).agg(F.min("src").alias("before"))
    after = same.groupBy("box", F.col("src").alias("cc_id")).agg(F.min("dst").alias("after"))
    return organ_nodes.select("box", "cc_id").join(before, ["box", "cc_id"], "left").join(after, ["box", "cc_id"], "left")


def nearest_edge(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """For each query (box, query, q_day_s, q_day_t, q_sx, q_sy, q_tx, q_ty) the edge with the nearest dates and centres, the least (src, dst) of equals.

    Queries are few: what a user points at. They are sent to the edges, whose minimum is combined before it is shuffled.
    """
    parts = ("day_s", "day_t", "sx", "sy", "tx", "ty")
    d2 = sum(((F.col(c) - F.col(f"q_{c}")) * (F.col(c) - F.col(f"q_{c}")) for c in parts), F.lit(0.0))
    best = edges.join(queries, "box").groupBy("box", "query").agg(F.min(F.struct(F.round(d2, 6).alias("d2"), "src", "dst")).alias("m"))
    return best.select("box", "query", "m.src", "m.dst", "m.d2")


def best_incoming(edges: DataFrame) -> DataFrame:
    """The cheapest edge into each target, the least source of equals."""
    return edges.groupBy("box", "dst").agg(F.min(F.struct("cost", "src")).alias("m")).select("box", "dst", F.col("m.src").alias("src"), F.col("m.cost").alias("cost"))


def best_outgoing(edges: DataFrame) -> DataFrame:
    return edges.groupBy("box", "src").agg(F.min(F.struct("cost", "dst")).alias("m")).select("box", "src", F.col("m.dst").alias("dst"), F.col("m.cost").alias("cost"))


def best_outgoing_by_weight(edges: DataFrame, count: str) -> DataFrame:
    """The child with the largest downstream count, ties by cost and id."""
    m = F.max(F.struct(F.col(count), (-F.col("cost")).alias("c"), (-F.col("dst")).alias("d"))).alias("m")
    return edges.groupBy("box", "src").agg(m).select("box", "src", (-F.col("m.d")).alias("dst"), F.col(f"m.{count}").alias(count))


def parent_or_start(attributes: DataFrame, edges: DataFrame, start: float) -> DataFrame:
    """Each target's cheapest of its parents and a start: nothing couples targets, so that is the least total cost."""
    best = best_incoming(edges).withColumnRenamed("dst", "cc_id")
    both = attributes.select("box", "cc_id").join(best, ["box", "cc_id"], "left")
    takes = F.col("cost") < start
    return both.select("box", "cc_id", F.when(takes, F.col("src")).alias("parent"), F.when(takes, F.col("cost")).otherwise(start).alias("cost"))


def selection_candidates(edges: DataFrame, active: Column) -> DataFrame:
    """Edges without the inactive ones into targets that have an active one."""
    has = F.max(active.cast("int")).over(Window.partitionBy("box", "dst"))
    return edges.withColumn("active", active).withColumn("has", has).where("active or has = 0").drop("has")


def _sides_inside(reach: float):
    """Sides of tiles' own pixels to the right and below, with the distance of what lies outside both components, null where all within reach is inside."""
    r = int(reach) + 1
    along = lambda u: u - 0.5 if u > 0 else -u  # noqa: E731  a pixel at the offset u is met by samples from u - 1/2 up to u

    def run(rows: pa.Table, group: np.ndarray) -> pa.Table:
        x, y, own, day, cc = (rows.column(c).to_numpy() for c in ("x", "y", "own", "day", "cc_id"))
        x, y, names, parts = x.astype(np.int64), y.astype(np.int64), ("at", "src", "dst", "x", "y", "nx", "ny", "outside"), []
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for a, b in zip(edges, edges[1:]):
            px, py = x[a:b] - x[a:b].min() + r + 1, y[a:b] - y[a:b].min() + r + 1
            at = np.full((px.max() + r + 2, py.max() + r + 2), -1)
            at[px, py] = np.arange(b - a)
            label = np.full(at.shape, -1)
            ids = np.unique(cc[a:b], return_inverse=True)[1]
            label[px, py] = ids
            for dx, dy in ((1, 0), (0, 1)):
                q = at[px + dx, py + dy]
                p = np.flatnonzero(own[a:b] & (q >= 0) & (day[a:b] != day[a:b][q]))
                q = q[p]
                least = np.full(len(p), np.inf)
                for i in range(-r, r + 1):
                    for j in range(-r, r + 1):
                        u, v = along(i - dx / 2), along(j - dy / 2)
                        if u <= reach and v <= reach:
                            there = label[px[p] + i, py[p] + j]
                            least[(there != ids[p]) & (there != ids[q]) & (least > np.sqrt(u * u + v * v))] = np.sqrt(u * u + v * v)
                first = day[a:b][p] < day[a:b][q]
                ends = [np.where(first, cc[a:b][m], cc[a:b][n]) for m, n in ((p, q), (q, p))]
                way = np.where(first, 1, -1)
                parts.append((np.full(len(p), a), *ends, x[a:b][p] + dx / 2, y[a:b][p] + dy / 2, way * dx, way * dy, least))
        found = {n: np.concatenate(c) for n, c in zip(names, zip(*parts))}
        outside = found.pop("outside")
        return pa.table({"box": rows.column("box").take(pa.array(found.pop("at"))), **found, "outside": pa.array(outside, mask=np.isinf(outside))})

    return run


def best_facet(labelled: DataFrame, attributes: DataFrame, reach: float = 10.0, tile: int = 128) -> DataFrame:
    """For each two components of different dates that share sides the best side (box, src, dst, x, y, axis: 0 where it is crossed along x, score).

    A side's score is twice the cosine of its normal with the way between the centres, and twice its distance to what lies outside both components, sampled every half pixel
    up to `reach` along x and y (1e8 where all is inside). Equal scores (nine places) go to the least (y, x, axis). Samples are looked up in tiles of pixels with their surroundings, so
    a side is one row however far they reach.
    """
    types = {c: labelled.schema[c].dataType.simpleString() for c in ("box", "cc_id")}
    schema = f"box {types['box']}, src {types['cc_id']}, dst {types['cc_id']}, x double, y double, nx long, ny long, outside double"
    pixels = tiled(labelled.select("box", "x", "y", "day", "cc_id"), tile, (int(reach) + 2, int(reach) + 2))
    sides = whole_groups(pixels, ["box", "tx", "ty"], _sides_inside(reach), schema)
    side = lambda name, p: attributes.select("box", F.col("cc_id").alias(name), F.col("cx").cast("double").alias(f"{p}x"), F.col("cy").cast("double").alias(f"{p}y"))
    rows = sides.join(side("src", "s"), ["box", "src"]).join(side("dst", "t"), ["box", "dst"])
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    turn = F.coalesce((F.col("nx") * dx + F.col("ny") * dy) / F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0))
    score = F.round(2 * turn + 2 * F.coalesce("outside", F.lit(1e8)), 9)
    axis = F.when(F.col("nx") != 0, 0).otherwise(1)
    best = rows.groupBy("box", "src", "dst").agg(F.max(F.struct(score.alias("score"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"), (-axis).alias("axis"))).alias("m"))
    return best.select("box", "src", "dst", (-F.col("m.x")).alias("x"), (-F.col("m.y")).alias("y"), (-F.col("m.axis")).alias("axis"), "m.score")


def _bounded(rows: DataFrame, by: list[str], value: str, classes: int, name: str) -> DataFrame:
    """Rows once for each class whose bound exceeds their value: the bounds are every 1 / classes of the sorted values, the last one is open."""
    own = Window.partitionBy(*by)
    ranked = rows.withColumn("r", F.row_number().over(own.orderBy(value, "id")) - 1).withColumn("total", F.count("*").over(own))
    bound = lambda c: F.max(F.when(F.col("r") == F.floor(F.lit(c) * F.col("total") / classes), F.col(value))).over(own)
    bounds = F.array(*(bound(c) for c in range(1, classes)), F.lit(float("inf")))
    ranked = ranked.withColumn("bounds", bounds)
    return ranked.select(*rows.columns, F.posexplode("bounds").alias(name, f"{name}_below")).where(F.col(value) < F.col(f"{name}_below"))


def binned_speed_stats(samples: DataFrame, classes: int = 7) -> DataFrame:
    """Cells of speeds (box, rate_class, ratio_class, their bounds, n, median, low, high) of samples (box, id, rate, ratio, speed).

    A sample counts in each class whose bound exceeds its rate, and there in each class whose bound exceeds its ratio; bounds are quantiles of what counts.
    """
    by_rate = _bounded(samples.select("box", "id", "rate", "ratio", "speed"), ["box"], "rate", classes, "rate_class")
    cells = _bounded(by_rate, ["box", "rate_class"], "ratio", classes, "ratio_class")
    key = ["box", "rate_class", "rate_class_below", "ratio_class", "ratio_class_below"]
    mid = cells.withColumn("median", F.median("speed").over(Window.partitionBy(*key)))
    v = F.col("speed")
    return mid.groupBy(*key).agg(F.count("*").alias("n"), F.first("median").alias("median"), F.median(F.when(v <= F.col("median"), v)).alias("low"), F.median(F.when(v >= F.col("median"), v)).alias("high"))


def binned_speed_lookup(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """Queries (box, id, rate, ratio) with the cell of the first class above their rate, and in it the first above their ratio. Cells of a box are few (classes squared)."""
    rates = cells.select("box", "rate_class", "rate_class_below").distinct()
    first = queries.join(rates, "box").where("rate < rate_class_below").groupBy("box", "id", "rate", "ratio").agg(F.min("rate_class").alias("rate_class"))
    found = first.join(cells, ["box", "rate_class"]).where("ratio < ratio_class_below").groupBy("box", "id").agg(F.min_by(F.struct("rate_class", "ratio_class", "n", "median", "low", "high"), "ratio_class").alias("c"))
    return found.select("box", "id", "c.*")


def meniscus_mask(image: DataFrame, line: int = 8, join: int = 15, widen: int = 52, grow: int = 3, low: float = 20.0, high: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """Pixels (box, x, y) of the meniscus of an image (box, x, y, v), and of the area of interest: the largest piece of what is left.

    Where closings by upright and by level lines (`line` to both sides) differ by low to high, after a level closing by `join`, lies the meniscus: its largest piece after `widen` to both
    sides along x and 1 along y, grown by `grow` along y.
    """
    across, up = (lambda n: [(k, 0) for k in range(-n, n + 1)]), (lambda n: [(0, k) for k in range(-n, n + 1)])
    closed = lambda rows, element: dilate_erode(dilate_erode(rows, element), element, False)
    rows = cut(image.select("box", F.lit(0).alias("t"), "x", "y", "v"))
    named = lambda rows, name: rows.select("box", "t", "x", "y", F.col("v").alias(name))
    apart = named(closed(rows, up(line)), "a").join(named(closed(rows, across(line)), "b"), ["box", "t", "x", "y"]).select("box", "t", "x", "y", (F.col("a") - F.col("b")).alias("v"))
    mask = closed(apart, across(join)).select("box", "t", "x", "y", F.col("v").between(low, high).cast("int").alias("v"))
    spread_out = cut(dilate_erode(dilate_erode(cut(mask), across(widen)), up(1)))
    band = _largest_piece(spread_out.select("box", "x", "y", F.col("v").alias("day"))).select("box", "x", "y", F.lit(1).alias("hit"))
    marked = image.select("box", "x", "y").join(band, ["box", "x", "y"], "left").select("box", F.lit(0).alias("t"), "x", "y", F.coalesce("hit", F.lit(0)).alias("v"))
    grown = cut(dilate_erode(marked, up(grow)).select("box", "x", "y", "v"))
    return grown.where("v = 1").select("box", "x", "y"), _largest_piece(grown.select("box", "x", "y", (1 - F.col("v")).alias("day")))


def _largest_piece(cells: DataFrame) -> DataFrame:
    """Pixels (box, x, y) of each box's largest component of day 1, the least number of equals."""
    labelled = cut(connected_components(cells).where("day = 1"))
    sizes = labelled.groupBy("box", "cc_id").agg(F.count("*").alias("n"))
    best = sizes.groupBy("box").agg(F.max(F.struct("n", (-F.col("cc_id")).alias("c"))).alias("m")).select("box", (-F.col("m.c")).alias("cc_id"))
    return labelled.join(best, ["box", "cc_id"], "left_semi").select("box", "x", "y")


def pixel_value_map(pixels: DataFrame, mode: str, on_skeleton_only: bool = False) -> DataFrame:
    """box, x, y and value of pixels (way, outer, date, hours, date_out, hours_out): the one that mode names; of all pixels, or of those on a path alone."""
    if mode not in ("way", "outer", "date", "hours", "date_out", "hours_out"):
        raise ValueError(f"no value of pixels is called {mode}")
    rows = pixels.where("outer = 0") if on_skeleton_only else pixels
    return rows.groupBy("box", "x", "y").agg(F.min(mode).alias("value"))
