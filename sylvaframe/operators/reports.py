"""Traits of roots, plants and models, and the reports made of them. Nodes are (model, root, seq, x, y, diameter, th, t), roots (model, root, parent).

Lengths are in the nodes' units; unit_conversion turns them into others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.functions import scalars as C
from sylvaframe.operators.cut import cut
from sylvaframe.operators.graph import along_paths
from sylvaframe.operators.models import first_nodes, plant_time_series
from sylvaframe.operators.traits import ROOT, along, insertion_node, is_exact, last_dates, length_summary, node_geometry, root_length, root_surface_volume, segments


def unit_conversion(pixels: Column, size: float, origin: float = 0.0) -> Column:
    """Lengths in pixels from a ruler's origin, in units of `size` a pixel."""
    return pixels * size + origin


def unit_conversion_back(length: Column, size: float, origin: float = 0.0) -> Column:
    return (length - origin) / size


def root_orders(roots: DataFrame) -> DataFrame:
    """Roots with ord (1 for primaries) and top (the primary that they come from)."""
    forest = roots.select(F.col("model").alias("box"), F.col("root").alias("cc_id"), "parent")
    paths = along_paths(forest).select(F.col("box").alias("model"), F.col("cc_id").alias("root"), (F.col("depth") + 1).alias("ord"), F.col("root").alias("top"))
    return roots.join(paths, ROOT)


def plant_numbers(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots with ord and plant: primaries numbered from 1 by the x of their first node, the others by their primary."""
    number = F.row_number().over(Window.partitionBy("model").orderBy("fx", "root"))
    tops = first_nodes(nodes).join(roots.where("parent is null").select(*ROOT), ROOT).select("model", F.col("root").alias("top"), number.alias("plant"))
    return root_orders(roots).join(tops, ["model", "top"]).select(*ROOT, "parent", "ord", "plant")


def root_selection(numbered: DataFrame, plant: int | None = None, order: int | None = None, laterals: bool = False) -> DataFrame:
    """Roots (plant_numbers) of a plant, of an order, or laterals only."""
    rows = numbered if plant is None else numbered.where(F.col("plant") == plant)
    rows = rows if order is None else rows.where(F.col("ord") == order)
    return rows.where("ord > 1") if laterals else rows


def insertions(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """model, root, parent, at_seq, base, apex, angle and side of each lateral.

    base: distance of its insertion from the parent's base, by 21 steps from the neighbour of the insertion node that is nearer to the first node,
    0 where the insertion node has only one neighbour; apex: what is left of the parent's length, 0 at least. angle: mean of the first three
    directions against the parent's at the insertion node, 0 to pi. side: 1 for left of the insertion node, 2 for right.
    """
    geometry = node_geometry(nodes).select(*ROOT, "seq", F.coalesce("theta", F.lit(0.0)).alias("theta"), F.col("len").isNotNull().alias("has_next"))
    rows = segments(nodes).select(*ROOT, "seq", "x", "y", "c").join(geometry, [*ROOT, "seq"])
    own = rows.where("seq <= 3 and has_next").groupBy(*ROOT).agg(F.avg("theta").alias("ang"))
    beside = lambda move, p: [move(c).over(along()).cast("double").alias(f"{p}{c}") for c in ("x", "y", "c")]
    at = rows.select("model", F.col("root").alias("parent"), F.col("seq").alias("at_seq"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("theta").alias("p_theta"), *beside(F.lag, "l"), *beside(F.lead, "r"))
    found = insertion_node(nodes, roots).drop("d2").join(at, ["model", "parent", "at_seq"]).join(first_nodes(nodes), ROOT).join(own, ROOT, "left")
    found = found.join(root_length(nodes).select("model", F.col("root").alias("parent"), F.col("length").alias("p_length")), ["model", "parent"])
    far = lambda p: C.distance(F.col("fx"), F.col("fy"), F.col(f"{p}x"), F.col(f"{p}y"))
    up = far("l") >= far("r")
    x2, y2, c2 = (F.when(up, F.col(f"r{c}")).otherwise(F.col(f"l{c}")) for c in ("x", "y", "c"))
    step = lambda i: C.distance(x2 + (x2 - F.col("nx")) / 20 * i, y2 + (y2 - F.col("ny")) / 20 * i, F.col("fx"), F.col("fy"))
    least = F.least(F.lit(1000.0), F.array_min(F.transform(F.sequence(F.lit(0), F.lit(20)), step)))
    base = F.when(F.col("lx").isNull() | F.col("rx").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.when(up, c2 - least).otherwise(c2 + least)))
    turn = F.abs(F.col("ang") - F.col("p_theta"))
    return found.withColumn("base", base).select(
        *ROOT, "parent", "at_seq", "base", F.greatest(F.lit(0.0), F.col("p_length") - F.col("base")).alias("apex"),
        F.when(turn > F.pi(), 2 * F.pi() - turn).otherwise(turn).alias("angle"), F.when(F.col("fx") < F.col("nx"), 1).otherwise(2).alias("side"),
    )


def side_of_parent(roots: DataFrame, inserted: DataFrame) -> DataFrame:
    """0 for primaries, 1 for laterals left of their insertion node and 2 for those right of it."""
    return roots.select(*ROOT).join(inserted.select(*ROOT, "side"), ROOT, "left").fillna({"side": 0})


def node_after_attachment(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """For each lateral the node of its parent after the last one, but for the parent's end, that is above its first node; else the parent's first."""
    own = ["model", "parent"]
    steps = nodes.select("model", F.col("root").alias("parent"), "y", F.struct("seq", F.lead("seq").over(along()).alias("next")).alias("step"))
    steps = steps.withColumn("inner", F.when(F.col("step.next").isNotNull() & F.col("y").isNotNull(), F.col("step"))).withColumn("root", F.lit(None).cast(nodes.schema["root"].dataType))
    start = first_nodes(nodes).join(roots.where("parent is not null"), ROOT).select(*own, F.col("fy").alias("y"), "root")
    # One sweep down each parent: a start sees what nodes lie above it, not those at its own height.
    rows = steps.unionByName(start, allowMissingColumns=True).withColumn("node_row", F.col("root").isNull())
    down = Window.partitionBy(*own).orderBy("y", "node_row").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("m", F.max("inner").over(down)).withColumn("first", F.min("step.seq").over(Window.partitionBy(*own)))
    return seen.where("root is not null and first is not null").select(*ROOT, "parent", F.coalesce("m.next", "first").alias("node"))


def first_last_child(inserted: DataFrame) -> DataFrame:
    """Each parent's child with the largest and with the smallest distance to the apex (the least id of equals), and their distances from the base."""
    first, last = F.max(F.struct("apex", (-F.col("root")).alias("r"), "base")).alias("a"), F.min(F.struct("apex", "root", "base")).alias("b")
    rows = inserted.groupBy("model", F.col("parent").alias("root")).agg(first, last, F.count("*").alias("n_child"))
    return rows.select(*ROOT, "n_child", (-F.col("a.r")).alias("first_child"), F.col("a.base").alias("first_base"), F.col("b.root").alias("last_child"), F.col("b.base").alias("last_base"))


def child_density(inserted: DataFrame) -> DataFrame:
    """Children for each unit of length between the first and the last; 0 without a length."""
    dist = F.col("last_base") - F.col("first_base")
    return first_last_child(inserted).select(*ROOT, F.coalesce(F.col("n_child") / F.nullif(dist, F.lit(0.0)), F.lit(0.0)).alias("density"))


def inter_branch(inserted: DataFrame) -> DataFrame:
    """For each lateral the smallest positive distance to a sibling that is farther from the apex; 0 for the farthest."""
    key = ["model", "parent"]
    gaps = inserted.select(*key, "apex").distinct().withColumn("gap", F.lead("apex").over(Window.partitionBy(*key).orderBy("apex")) - F.col("apex"))
    return inserted.join(gaps, [*key, "apex"]).select(*ROOT, "parent", F.coalesce("gap", F.lit(0.0)).alias("inter_branch"))


def children_summary(nodes: DataFrame, roots: DataFrame, inserted: DataFrame) -> DataFrame:
    """Number, total length and mean insertion angle of each root's children, and the children by the y of their first node."""
    sized = root_length(nodes).join(inserted.select(*ROOT, "parent", "angle"), ROOT).join(first_nodes(nodes), ROOT)
    by_y = F.transform(F.array_sort(F.collect_list(F.struct("fy", "root"))), lambda c: c["root"])
    return sized.groupBy("model", F.col("parent").alias("root")).agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.avg("angle").alias("angle"), by_y.alias("children"))


def node_at_length(nodes: DataFrame, at: float) -> DataFrame:
    """Each root's node that is nearest to an arc length, the first of equals."""
    return segments(nodes).groupBy(*ROOT).agg(F.min_by("seq", F.struct(F.round(F.abs(F.col("c") - at), 9), "seq")).alias("seq"))


def mean_diameters(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Mean diameter over all nodes of primaries and of laterals."""
    rows = nodes.join(roots, ROOT)
    of = lambda top: F.avg(F.when(F.col("parent").isNull() == top, F.col("diameter")))
    return rows.groupBy("model").agg(of(True).alias("primary_diameter"), of(False).alias("lateral_diameter"))


def mean_lateral_angle(inserted: DataFrame) -> DataFrame:
    return inserted.groupBy("model").agg(F.avg(F.degrees("angle")).alias("angle"))


def total_lengths_at(nodes: DataFrame, roots: DataFrame, at: float) -> DataFrame:
    """Visible lengths of primaries and of laterals at a time, each root cut to whole units."""
    sized = root_length(nodes, at).join(roots, ROOT)
    of = lambda top: F.sum(F.when(F.col("parent").isNull() == top, F.floor("length")).otherwise(0))
    return sized.groupBy("model").agg(of(True).alias("primaries"), of(False).alias("laterals"))


def plant_lengths_at_t(nodes: DataFrame, roots: DataFrame, at: float) -> DataFrame:
    """Visible length by plant and order."""
    return root_length(nodes, at).join(plant_numbers(nodes, roots), ROOT).groupBy("model", "plant", "ord").agg(F.sum("length").alias("length"))


def primary_depth_series(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Depth under the first node by date (from 0) of each primary, up to the model's last date; dates without a node take the one before, else the next one's."""
    tops = nodes.join(roots.where("parent is null").select(*ROOT), ROOT)
    first = tops.groupBy(*ROOT).agg(F.min_by("y", "seq").alias("y0"))
    day = F.greatest(F.floor("t").cast("int") - 1, F.lit(0)).alias("day")
    seen = tops.where("seq > 1").groupBy(*ROOT, day).agg(F.max_by("y", "seq").alias("y"))
    grid = first.join(last_dates(nodes), "model").select(*ROOT, "y0", F.explode(F.sequence(F.lit(0), F.col("last_date") - 1)).alias("day"))
    by = Window.partitionBy(*ROOT).orderBy("day")
    past, ahead = F.last("depth", ignorenulls=True).over(by), F.last("depth", ignorenulls=True).over(Window.partitionBy(*ROOT).orderBy(F.desc("day")))
    rows = grid.join(seen, [*ROOT, "day"], "left").withColumn("depth", F.col("y") - F.col("y0"))
    return rows.select(*ROOT, "day", F.coalesce(past, ahead).alias("depth"))


def tip_series(nodes: DataFrame) -> DataFrame:
    """y and arc length at the last node of each whole date, the first node not counted; both are 0 at date 0."""
    exact = segments(nodes).where((F.col("seq") > 1) & is_exact(F.col("t")) & (F.rint("t") > 0)).groupBy(*ROOT, F.rint("t").cast("int").alias("day"))
    rows = exact.agg(F.max_by("y", "seq").cast("double").alias("y"), F.max("c").alias("length"))
    zero = nodes.select(*ROOT).distinct().select(*ROOT, F.lit(0).alias("day"), F.lit(0.0).alias("y"), F.lit(0.0).alias("length"))
    return rows.unionByName(zero)


def lateral_speed_depth_series(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Per lateral and rounded date: depth of its last node there against the model's last primary's start, and its speed: the segment's length over the first segment's hours."""
    start = first_nodes(nodes).join(roots.where("parent is null").select(*ROOT), ROOT).groupBy("model").agg(F.max_by("fy", "root").alias("y0"))
    rows = segments(nodes).join(roots.where("parent is not null").select(*ROOT), ROOT)
    hours = F.first(F.col("th1") - F.col("th")).over(along())
    spe = F.last(F.col("len"), ignorenulls=True).over(along()) / F.when(hours <= 0, 1e-6).otherwise(hours)
    days = rows.select(*ROOT, "seq", "y", F.rint("t").cast("int").alias("day"), spe.alias("speed"))
    return days.groupBy(*ROOT, "day").agg(F.max_by("y", "seq").alias("y"), F.max_by("speed", "seq").alias("speed")).join(start, "model").select(*ROOT, "day", (F.col("y0") - F.col("y")).alias("depth"), F.coalesce("speed", F.lit(0.0)).alias("speed"))


def starting_depth(series: DataFrame) -> DataFrame:
    """The first depth of each root's series that is not 0; 0 without one."""
    return series.groupBy(*ROOT).agg(F.coalesce(F.min_by("depth", F.when(F.col("depth") != 0, F.col("day"))), F.lit(0.0)).alias("depth"))


def convex_hull(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Corners of the hull of each root and its children, all nodes but each root's last, at truncated places: model, root, x, y, upper.

    Of each column of points the lowest and the highest stay. Then points that do not stand out from the chord of their neighbours go, all at
    once, as none of them can be a corner, until no round finds any. A side's ends are on both sides.
    """
    inner = segments(nodes).where("x1 is not null").select(*ROOT, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    owner = roots.select(*ROOT, F.col("root").alias("owner")).unionByName(roots.where("parent is not null").select(*ROOT, F.col("parent").alias("owner")))
    columns = inner.join(owner, ROOT).groupBy("model", F.col("owner").alias("root"), "x").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    left = columns.select(*ROOT, "x", F.explode(F.array(F.struct(F.lit(True).alias("upper"), F.col("a").alias("y")), F.struct(F.lit(False).alias("upper"), F.col("b").alias("y")))).alias("p"))
    left = left.select(*ROOT, "x", "p.upper", "p.y").transform(cut)
    side = Window.partitionBy(*ROOT, "upper").orderBy("x")
    while True:
        around = left.select("*", *(f(c).over(side).alias(f"{n}{c}") for f, n in ((F.lag, "l"), (F.lead, "r")) for c in ("x", "y")))
        cross = (F.col("x") - F.col("lx")) * (F.col("ry") - F.col("ly")) - (F.col("y") - F.col("ly")) * (F.col("rx") - F.col("lx"))
        stays = F.col("lx").isNull() | F.col("rx").isNull() | F.when(F.col("upper"), cross > 0).otherwise(cross < 0)
        marked = around.select(*ROOT, "x", "upper", "y", stays.alias("stays")).transform(cut)
        left = marked.where("stays").drop("stays")
        if marked.where("not stays").isEmpty():
            return left


def root_report(nodes: DataFrame, roots: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """One row of 20 columns for each valid root. The hull's area is null, as it is never computed."""
    inserted = insertions(nodes, roots).transform(cut)
    sized = root_length(nodes).join(root_surface_volume(nodes), ROOT, "left").join(nodes.groupBy(*ROOT).agg(F.avg("diameter").alias("diameter")), ROOT)
    rows = root_orders(roots).join(sized, ROOT).join(inserted.select(*ROOT, "base", "angle"), ROOT, "left")
    rows = rows.join(first_last_child(inserted), ROOT, "left").join(child_density(inserted), ROOT, "left")
    name, long = lambda c: F.concat(F.lit("root_"), F.col(c).cast("string")), lambda c: unit_conversion(F.col(c), pixel_size)
    return rows.where("length is not null").select(
        F.col("model").alias("image"), name("root").alias("root_name"), "root", long("length").alias("length"), F.coalesce(F.col("surface"), F.lit(0.0)).alias("surface"), F.coalesce(F.col("volume"), F.lit(0.0)).alias("volume"),
        F.lit(None).cast("double").alias("convexhull_area"), long("diameter").alias("diameter"), F.col("ord").alias("root_order"), F.when(F.col("ord") == 1, "primary").otherwise("lateral").alias("root_ontology"),
        name("parent").alias("parent_name"), F.coalesce(F.col("parent").cast("string"), F.lit("-1")).alias("parent"), F.coalesce(long("base"), F.lit(0.0)).alias("insertion_position"), F.coalesce(F.degrees("angle"), F.lit(0.0)).alias("insertion_angle"),
        F.coalesce("n_child", F.lit(0)).alias("n_child"), F.coalesce("density", F.lit(0.0)).alias("child_density"), "first_child", long("first_base").alias("insertion_first_child"), "last_child", long("last_base").alias("insertion_last_child"),
    )


def node_report(nodes: DataFrame, roots: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """One row of 11 columns for each node, and its place."""
    theta = node_geometry(nodes).select(*ROOT, "seq", F.coalesce("theta", F.lit(0.0)).alias("theta"))
    rows = segments(nodes).join(theta, [*ROOT, "seq"]).join(root_length(nodes), ROOT).join(root_orders(roots), ROOT)
    size = lambda c: unit_conversion(c, pixel_size)
    return rows.select(
        F.col("model").alias("image"), "root", F.concat(F.lit("root_"), F.col("root").cast("string")).alias("root_name"), "seq", size(F.col("x")).alias("x"), size(F.col("y")).alias("y"), "theta", size(F.col("diameter")).alias("diameter"),
        size(F.col("c")).alias("distance_from_base"), size(F.col("length") - F.col("c")).alias("distance_from_apex"), (F.col("ord") - 1).alias("root_order"), F.when(F.col("ord") == 1, "primary").otherwise("lateral").alias("root_ontology"),
    )


def image_report(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of 12 columns for each model."""
    inserted = insertions(nodes, roots).transform(cut)
    counts = roots.groupBy("model").agg(F.count_if(F.col("parent").isNull()).alias("n_primary"), F.count_if(F.col("parent").isNotNull()).alias("n_laterals"))
    dense = child_density(inserted).groupBy("model").agg(F.avg(F.nullif("density", F.lit(0.0))).alias("mean_lat_density"))
    rows = length_summary(nodes, roots).join(counts, "model").join(mean_diameters(nodes, roots), "model").join(dense, "model", "left").join(mean_lateral_angle(inserted), "model", "left")
    return rows.select(
        F.col("model").alias("image"), F.col("total").alias("tot_root_length"), "n_primary", F.col("total_primary").alias("tot_prim_length"), F.col("mean_primary").alias("mean_prim_length"), F.col("primary_diameter").alias("mean_prim_diameter"),
        "mean_lat_density", "n_laterals", F.col("total_lateral").alias("tot_lat_length"), F.col("mean_lateral").alias("mean_lat_length"), F.col("lateral_diameter").alias("mean_lat_diameter"), F.col("angle").alias("mean_lat_angle"),
    )


def root_coordinates(nodes: DataFrame) -> DataFrame:
    """Each root's nodes in order, as one array of places, speeds, diameters and dates. An array holds one root."""
    point = F.struct("seq", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "vx", "vy", "diameter", "t", "th")))
    return nodes.groupBy(*ROOT).agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p.dropFields("seq")).alias("points"))


def known_outliers(plants: DataFrame, listed: DataFrame) -> DataFrame:
    """Plants (model, plant) with whether they are on the list of outliers; repeated entries count once."""
    return plants.join(F.broadcast(listed.select("model", "plant", F.lit(True).alias("is_outlier")).distinct()), ["model", "plant"], "left").fillna({"is_outlier": False})


def model_comparison(predicted: tuple[DataFrame, DataFrame], expert: tuple[DataFrame, DataFrame], outliers: DataFrame, remap: DataFrame) -> DataFrame:
    """Per model and plant: lengths of primary and laterals three dates before the model's last and the number of laterals at the last, predicted and expert.

    Each side is (nodes, roots). Plants are matched by number; remap (model, plant, expert_plant) names those with another number
    on the expert's side, null for none.
    """

    def side(nodes: DataFrame, roots: DataFrame, prefix: str) -> DataFrame:
        number = plant_numbers(nodes, roots).where("ord = 1").select("model", F.col("root").alias("top"), "plant")
        rows = plant_time_series(nodes, roots).withColumnRenamed("plant", "top").join(number, ["model", "top"]).join(last_dates(nodes), "model")
        early, late = F.col("day") == F.col("last_date") - 3, F.col("day") == F.col("last_date")
        pick = lambda when, c: F.max(F.when(when, F.col(c))).alias(f"{prefix}_{c}")
        return rows.groupBy("model", "plant").agg(pick(early, "primary_length"), pick(late, "n_laterals"), pick(early, "lateral_length"))

    ours = side(*predicted, "predicted").join(F.broadcast(remap), ["model", "plant"], "left").withColumn("expert_plant", F.when(F.col("known"), F.col("expert_plant")).otherwise(F.col("plant")))
    theirs = side(*expert, "expert").withColumnRenamed("plant", "expert_plant")
    return known_outliers(ours.join(theirs, ["model", "expert_plant"], "full_outer"), outliers).drop("known")


def lateral_comparison(predicted: tuple[DataFrame, DataFrame], expert: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Five series of both sides in long form: source, series, model, root, day and value (day is null for starting depths)."""

    def side(nodes: DataFrame, roots: DataFrame, source: str) -> DataFrame:
        speeds = lateral_speed_depth_series(nodes, roots)
        tips = tip_series(nodes)
        parts = {"depth": (speeds, "depth"), "speed": (speeds, "speed"), "tip": (tips, "y"), "length": (tips, "length"), "start": (starting_depth(speeds).withColumn("day", F.lit(None).cast("int")), "depth")}
        rows = [df.select(F.lit(source).alias("source"), F.lit(name).alias("series"), *ROOT, "day", F.col(value).cast("double").alias("value")) for name, (df, value) in parts.items()]
        return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).unionByName(rows[4])

    return side(*predicted, "predicted").unionByName(side(*expert, "expert"))
