"""Branches of component graphs: costs and features of laterals, their rejection, and links over gaps.

Components are (box, cc_id, day, hour, n_px, x, y, trunk); links (box, src, dst) join neighbours, the earlier one first. A chain is a run of components
that active links join outside the trunk: (box, start, depth from 0, cc_id, and hidden: whether the link from the one before is hidden).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.functions import scalars as C
from sylvaframe.operators.assignment import EVEN, PENALTY, assigned_links
from sylvaframe.operators.cut import cut
from sylvaframe.operators.groups import halves_up as _halves_up
from sylvaframe.operators.groups import parted, whole_groups
from sylvaframe.operators.graph import component_labels
from sylvaframe.operators.links import alignment_cost, cosine, downwardness
from sylvaframe.operators.timebase import mad_double_sided



def first_order_cost(e: dict[str, Column], last_day: Column | int, hours_of: dict[str, Column], late: bool = False) -> Column:
    """Cost of a link by the likeness of growth rates, the gap of dates and half the way down; more where it leaves the trunk (not by the last day in the late phase).

    e: day_s, day_t, n_s, n_t, sx, sy, tx, ty, trunk_s and trunk_t. hours_of: the hours that dates s and t span.
    """
    unlike = C.similarity_cost(e["n_s"] / hours_of["s"], e["n_t"] / hours_of["t"])
    gap = F.abs(e["day_t"] - e["day_s"])
    leaves = unlike + 0.5 + (F.lit(0) if late else F.lit(last_day) - 1 if isinstance(last_day, int) else last_day - 1)
    stays = unlike + F.when(gap < 2, 0).otherwise(gap - 1) - 0.5 * downwardness(*(e[c].cast("double") for c in ("sx", "sy", "tx", "ty")))
    return F.when(e["day_s"] == 0, -1000.0).when(e["day_s"] > e["day_t"], 10000.0).when(e["trunk_s"] & ~e["trunk_t"], leaves).otherwise(stays)


def second_order_links(comps: DataFrame, weighted: DataFrame, cost: Column) -> DataFrame:
    """Links (box, src, dst, cost) between two components that share a predecessor: from one with several predecessors to another one of at least its date.

    weighted: links with their weight. cost: of the link itself, over columns of both ends with suffixes _s and _t; what the source's best predecessor leads to
    is added. The earliest date has no such links.
    """
    several = weighted.groupBy("box", "dst").agg(F.count("*").alias("n"), F.min_by("src", F.struct("weight", "src")).alias("best")).where("n > 1").select("box", F.col("dst").alias("cc3"), "best")
    pairs = weighted.select("box", "src", F.col("dst").alias("cc3")).join(several, ["box", "cc3"]).join(weighted.select("box", "src", F.col("dst").alias("cc")), ["box", "src"])
    pairs = pairs.where("cc <> cc3").select("box", "cc3", "cc", "best").distinct()
    side = lambda name, suffix: comps.select("box", F.col("cc_id").alias(name), *(F.col(c).alias(f"{c}_{suffix}") for c in ("day", "hour", "n_px", "x", "y", "trunk")))
    rows = pairs.join(side("cc3", "s"), ["box", "cc3"]).join(side("cc", "t"), ["box", "cc"]).join(side("best", "b"), ["box", "best"]).where("day_t >= 2 and day_t >= day_s")
    turn = alignment_cost(*(tuple(F.col(f"{c}_{k}").cast("double") for c in ("x", "y", "hour")) for k in "bst"))
    return rows.select("box", F.col("cc3").alias("src"), F.col("cc").alias("dst"), (cost + F.coalesce(turn, F.lit(0.0))).alias("cost"))


def downstream_counts(comps: DataFrame, links: DataFrame) -> DataFrame:
    """box, cc_id and count: the pixels of a lateral component and of all that follow it, once for each way; the trunk counts nothing.

    A round for each date, from the last one down; it reads the counts of what the date's components link to.
    """
    known = None
    own = cut(comps.where(~F.col("trunk")).select("box", "cc_id", "day", "n_px"))
    steps = cut(links.join(own.select("box", F.col("cc_id").alias("src"), "day"), ["box", "src"]))
    for (day,) in sorted((tuple(r) for r in own.select("day").distinct().collect()), reverse=True):  # as many as there are observations
        rows = own.where(F.col("day") == day).select("box", "cc_id", F.col("n_px").cast("long").alias("count"))
        if known is not None:
            sums = steps.where(F.col("day") == day).join(known.select("box", F.col("cc_id").alias("dst"), "count"), ["box", "dst"]).groupBy("box", F.col("src").alias("cc_id")).agg(F.sum("count").alias("more"))
            rows = rows.join(sums, ["box", "cc_id"], "left").select("box", "cc_id", (F.col("count") + F.coalesce("more", F.lit(0))).alias("count"))
        known = cut(rows if known is None else known.unionByName(rows))
    return known if known is not None else own.select("box", "cc_id", F.col("n_px").cast("long").alias("count"))


def prune_lateral_branches(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Links with whether they stay: of those that leave a lateral component only the one to the largest count (the least dst of equals), the trunk's all."""
    counts = downstream_counts(comps, links)
    rows = links.join(counts.select("box", F.col("cc_id").alias("dst"), "count"), ["box", "dst"], "left").join(comps.select("box", F.col("cc_id").alias("src"), "trunk"), ["box", "src"])
    first = F.row_number().over(Window.partitionBy("box", "src").orderBy(F.desc(F.coalesce("count", F.lit(0))), "dst")) == 1
    return rows.select("box", "src", "dst", (F.col("trunk") | first).alias("active"))


def lateral_features(chains: DataFrame, comps: DataFrame) -> DataFrame:
    """Along each chain: length, days, hours and size since the component before and since the start, and the chain's visible share (null without a length)."""
    along = Window.partitionBy("box", "start").orderBy("depth")
    rows = chains.join(comps.select("box", "cc_id", "day", "hour", "n_px", "x", "y"), ["box", "cc_id"])
    leg = F.coalesce(C.distance(F.col("x"), F.col("y"), F.lag("x").over(along), F.lag("y").over(along)), F.lit(0.0))
    since = lambda c: F.coalesce(F.col(c) - F.lag(c).over(along), F.lit(0))
    rows = rows.withColumns({"length_before": leg, "days_before": since("day"), "hours_before": since("hour")})
    rows = rows.withColumns({n: F.sum(c).over(along) for n, c in (("length", "length_before"), ("days", "days_before"), ("hours", "hours_before"), ("size", "n_px"))})
    whole = Window.partitionBy("box", "start")
    seen = F.sum(F.when(F.col("hidden"), 0.0).otherwise(F.col("length_before"))).over(whole)
    last = F.col("depth") == F.max("depth").over(whole)
    return rows.withColumn("visible", seen / F.nullif(F.sum("length_before").over(whole), F.lit(0.0))).withColumn("last", last)


def lateral_rejection(features: DataFrame, least_y: float, mean_speed: float, least_visible: float = 0.4) -> DataFrame:
    """box, start and the first reason for which a lateral is rejected: hidden, single, high or short (ended before the last date); null if none."""
    ends = features.where("last").join(features.groupBy("box").agg(F.max("day").alias("end")), "box")
    reason = (
        F.when(F.col("visible") < least_visible, "hidden").when(F.col("depth") == 0, "single").when(F.col("y") < least_y, "high")
        .when((F.col("day") < F.col("end")) & (F.col("length") < 3 * mean_speed), "short")
    )
    return ends.select("box", "start", reason.alias("reason"))


def lateral_mad_rejection(features: DataFrame, typical_hours: float, most: float = 25.0) -> DataFrame:
    """box, start and rejected: whether at some step from the second date on, but for the last one, a lateral's length, speed, size or component's size lies `most` upper deviations over
    the median of all laterals of the box at that step."""
    speed = F.col("length") / F.greatest(F.lit(0.7 * typical_hours), F.col("days").cast("double"))
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value")) for n, v in (("length", F.col("length")), ("speed", speed), ("n_px", F.col("n_px")), ("size", F.col("size"))))))
    rows = features.select("box", "start", "last", "days", values.alias("f")).select("box", "start", "last", "days", "f.feature", "f.value")
    key = ["box", "days", "feature"]
    stats = mad_double_sided(rows, key, F.col("value"))
    over = (F.col("value") - F.col("median")) / F.when(F.col("high") == F.col("median"), 1e-8).otherwise(F.col("high") - F.col("median"))
    tested = (F.col("days") >= 2) & ~F.col("last") & (F.col("value") >= F.col("median"))
    return rows.join(stats, key).groupBy("box", "start").agg(F.max(tested & (F.round(over, 9) >= most)).alias("rejected"))


def incident_candidates(features: DataFrame, links: DataFrame, max_speed: float) -> DataFrame:
    """Where a lateral that ends early may run into another one: box, start, cc_id (its last), other (a component of another lateral, a neighbour or a neighbour's neighbour, but not over
    its own) and cost, within 2 * max_speed.

    Pairs are built in grid cells as wide as the reach, so a component with many neighbours makes no more of them than lie near.
    """
    reach = 2 * max_speed
    own = Window.partitionBy("box", "start").orderBy("depth")
    rows = features.withColumns({"px": F.lag("x").over(own), "py": F.lag("y").over(own)}).select("box", "start", "cc_id", "day", "x", "y", "px", "py", "last")
    both = links.select("box", F.col("src").alias("cc_id"), F.col("dst").alias("near")).unionByName(links.select("box", F.col("dst").alias("cc_id"), F.col("src").alias("near")))
    member = features.select("box", F.col("cc_id").alias("near"), F.col("start").alias("near_start"))
    near = both.join(member, ["box", "near"], "left").groupBy("box", "cc_id").agg(F.collect_set(F.struct("near", "near_start")).alias("near"))
    rows = rows.join(near, ["box", "cc_id"], "left")
    ends = rows.where("last").join(features.groupBy("box").agg(F.max("day").alias("end")), "box").where("day < end")
    open_ = F.transform(F.filter(F.coalesce("near", F.array()), lambda n: ~n["near_start"].eqNullSafe(F.col("start"))), lambda n: n["near"])
    ends = ends.select("box", "start", "cc_id", "x", "y", "px", "py", open_.alias("over"))
    cell = lambda c: F.floor(F.col(c) / reach)
    asked = ends.withColumn("gx", F.explode(F.array(*(cell("x") + k for k in (-1, 0, 1))))).withColumn("gy", F.explode(F.array(*(cell("y") + k for k in (-1, 0, 1)))))
    things = rows.select("box", cell("x").alias("gx"), cell("y").alias("gy"), F.col("start").alias("o_start"), F.col("cc_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.transform(F.coalesce("near", F.array()), lambda n: n["near"]).alias("others"))
    pairs = asked.join(things, ["box", "gx", "gy"]).where("start <> o_start").where(C.distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")) <= reach)
    joined = F.array_contains("over", F.col("other")) | F.arrays_overlap("over", "others")
    d = lambda c: F.col(c).cast("double")
    turn = -cosine(d("x") - d("px"), d("y") - d("py"), d("ox") - d("x"), d("oy") - d("y"))
    return pairs.where(joined).select("box", "start", "cc_id", "other", turn.alias("cost"))


def reattach_early_laterals(features: DataFrame, comps: DataFrame, links: DataFrame, mean_speed: float, n_dates: int) -> DataFrame:
    """Links (box, src, dst, hidden) that give laterals of four components or more that start nowhere a source: the neighbour in the trunk of at most their date (the least), or, where
    the lateral is long (a quarter of the dates, and of the way that they allow), the nearest trunk component of at most their date, over a hidden link."""
    n = F.count("*").alias("n")
    ends = features.groupBy("box", "start").agg(n, *(F.min_by(c, "depth").alias(c) for c in ("x", "y", "day")), *(F.max_by(c, "depth").alias(f"e{c}") for c in ("x", "y"))).where("n >= 4")
    trunk = comps.where("trunk and day > 0").select("box", F.col("cc_id").alias("src"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("day").alias("t_day"))
    beside = links.join(trunk, ["box", "src"]).join(ends.select("box", F.col("start").alias("dst"), "day"), ["box", "dst"]).where("t_day <= day").groupBy("box", "dst").agg(F.min("src").alias("src"), F.lit(False).alias("hidden"))
    far = C.distance(F.col("x"), F.col("y"), F.col("ex"), F.col("ey")) > mean_speed * n_dates / 4
    orphans = ends.where(far & (F.col("n") > n_dates / 4)).join(beside.select("box", F.col("dst").alias("start")), ["box", "start"], "left_anti")
    d2 = (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty"))
    nearest = orphans.join(trunk, "box").where("t_day <= day").groupBy("box", F.col("start").alias("dst")).agg(F.min(F.struct(d2.cast("double").alias("d2"), "src")).alias("m"))
    return beside.select("box", "src", "dst", "hidden").unionByName(nearest.select("box", "m.src", "dst", F.lit(True).alias("hidden")))


def chain_ends(features: DataFrame) -> DataFrame:
    """Each chain with its first and last component and up to two components after and before them: n (1 to 3), place, day and hour of each."""
    one = ("cc_id", "x", "y", "day", "hour")
    steps = F.array_sort(F.collect_list(F.struct("depth", *one)))
    rows = features.groupBy("box", "start").agg(steps.alias("s")).withColumn("n", F.least(F.size("s"), F.lit(3)))
    pick = lambda at, name: F.element_at("s", at).alias(name)
    two = F.least(F.size("s"), F.lit(2))
    return rows.select("box", "start", "n", pick(F.lit(1), "first"), pick(two, "second"), pick(F.col("n"), "third"), pick(F.lit(-1), "last"), pick(-two, "before"), pick(-F.col("n"), "before2"))


def hidden_link_score(stops: DataFrame, starts: DataFrame, reach: float, max_speed: float, typical_hours: float, steps: Column | None = None, off: Column | None = None, keep: bool = False) -> DataFrame:
    """box, stop, start and score of pairs of chain ends (see chain_ends) and other chains' starts within reach: the weighted mean of ten criteria, less is better.

    They are: the turns at both ends, the likeness of speeds at both ends to the gap's, the way down, the number of steps (over columns of both sides, 30 by default),
    turn and likeness of speeds across, how far the way leaves the object (`off`), an excess over max_speed, in the order of the list. A link back in time costs PENALTY.
    keep: with steps and off, which do not change when a pair is scored again after a link.
    Pairs are built in grid cells as wide as the reach.
    """
    cell = lambda c: F.floor(c / reach)
    around = lambda c: F.explode(F.array(*(cell(c) + k for k in (-1, 0, 1))))
    left = stops.select("box", F.col("start").alias("of"), F.col("n").alias("n_a"), F.col("last").alias("a"), F.col("before").alias("a1"), F.col("before2").alias("a2")).withColumn("gx", around(F.col("a.x"))).withColumn("gy", around(F.col("a.y")))
    right = starts.select("box", F.col("start").alias("to"), F.col("n").alias("n_b"), F.col("first").alias("b"), F.col("second").alias("b1"), F.col("third").alias("b2")).withColumn("gx", cell(F.col("b.x"))).withColumn("gy", cell(F.col("b.y")))
    g = lambda p, c: F.col(f"{p}.{c}").cast("double")
    span = lambda p, q: C.distance(g(p, "x"), g(p, "y"), g(q, "x"), g(q, "y"))
    rows = left.join(right, ["box", "gx", "gy"]).where(F.col("of") != F.col("to")).where(span("a", "b") <= reach)
    turn = lambda p, q, r, s: cosine(g(q, "x") - g(p, "x"), g(q, "y") - g(p, "y"), g(s, "x") - g(r, "x"), g(s, "y") - g(r, "y"))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    weight = lambda n: F.when(n == 2, 0.5).otherwise(1.0)
    # Hours of the gap: where there are none, the mean of the hours before and after it, else the typical ones.
    wait = g("b", "hour") - g("a", "hour")
    beside = F.when(n_a > 1, g("a", "hour") - g("a1", "hour")).otherwise(0.0) + F.when(n_b > 1, g("b1", "hour") - g("b", "hour")).otherwise(0.0)
    sides = (n_a > 1).cast("int") + (n_b > 1).cast("int")
    gap = F.when(wait != 0, wait).when((sides == 0) | (beside <= 0), typical_hours).otherwise(beside / F.greatest(sides, F.lit(1)))
    speed = span("a", "b") / gap
    own = lambda p, q: F.when(g(q, "hour") > g(p, "hour"), g(q, "hour") - g(p, "hour")).otherwise(typical_hours)
    v_a, v_b = span("a", "a2") / own("a2", "a"), span("b", "b2") / own("b", "b2")
    unlike = lambda u, v: C.similarity_cost(u, v)
    named = {"speed": speed, "v_a": v_a, "v_b": v_b, "turn_a": turn("a2", "a", "a", "b"), "turn_b": turn("a", "b", "b", "b2"), "turn_ab": turn("a2", "a", "b", "b2")}
    # Written before the criteria are added up, which would else be one expression too long to compile.
    rows = cut(rows.drop("gx", "gy").withColumns(named))
    speed, v_a, v_b = F.col("speed"), F.col("v_a"), F.col("v_b")
    days = F.when(g("b", "day") == g("a", "day"), 0.7).otherwise(g("b", "day") - g("a", "day"))
    way = F.abs((F.lit(30.0) if steps is None else steps) - days - 2.5) / 3 + F.when(days < 2, 0.0).otherwise(0.15 * (days - 1))
    alone = (n_a == 1) | (n_b == 1)
    across = F.when(alone, 0.5).when((n_a == 3) & (n_b == 3), 1.0).otherwise(0.75)
    criteria = [
        (F.when(n_a > 1, F.coalesce(2 * (1 - F.col("turn_a")), F.lit(EVEN))).otherwise(EVEN), weight(n_a)),
        (F.when(n_b > 1, F.coalesce(2 * (1 - F.col("turn_b")), F.lit(EVEN))).otherwise(EVEN), weight(n_b)),
        (F.when(n_a > 1, unlike(v_a, speed)).otherwise(EVEN), weight(n_a)),
        (F.when(n_b > 1, unlike(v_b, speed)).otherwise(EVEN), weight(n_b)),
        (1 - 0.5 * downwardness(g("a", "x"), g("a", "y"), g("b", "x"), g("b", "y")), F.lit(1.0)),
        (way, F.lit(1.0)),
        (F.when(alone, EVEN).otherwise(1 - F.col("turn_ab")), across),
        (F.when(alone, EVEN).otherwise(unlike(v_b, v_a)), across),
        (F.lit(EVEN) if off is None else off, F.lit(1.0)),
        (EVEN + F.when(speed > max_speed, 5 * (speed - max_speed) / max_speed).otherwise(0.0), F.lit(1.0)),
    ]
    total = reduce(lambda a, b: a + b, (F.coalesce(value, F.lit(1.0)) * w for value, w in criteria))
    score = total / reduce(lambda a, b: a + b, (w for _, w in criteria))
    back = F.when(g("a", "day") > g("b", "day"), PENALTY).otherwise(score)
    kept = (F.lit(30.0) if steps is None else steps).alias("steps"), (F.lit(EVEN) if off is None else off).alias("off")
    return rows.select("box", F.col("a.cc_id").alias("stop"), F.col("b.cc_id").alias("start"), "of", "to", back.alias("score"), *(kept if keep else ()))


def step_distance(stops: DataFrame, comps: DataFrame, links: DataFrame, mean_speed: float, typical_hours: float, cap: float = 30.0, most_states: int = 1 << 22, most_ways: int = 1 << 18) -> DataFrame:
    """box, stop, cc_id and d: the least number of steps from each stop (box, stop) to the components within a cap.

    A step costs 1 forwards and 2 backwards; into and along the trunk it is free, and out of it costs the distance from where the way entered, over what mean_speed allows
    in the step's hours. A way keeps the lateral component from which it last entered; of equal ways the least counts. Pieces of the trunk are one place each, as moving
    along them is free. Each round moves the states that the last one has lowered. A box of at most most_states pairs of a stop and a component, and most_ways ways, goes
    through its rounds inside a task; the others' rounds are joins over tables.
    """
    trunk = comps.where("trunk and day >= 1").select("box", F.col("cc_id").alias("node"))
    inside = links.join(trunk.withColumnRenamed("node", "src"), ["box", "src"]).join(trunk.withColumnRenamed("node", "dst"), ["box", "dst"])
    pieces = cut(component_labels(trunk, inside.select("box", F.col("src").alias("a"), F.col("dst").alias("b"))))
    own = cut(comps.where("day >= 1").join(pieces.select("box", F.col("node").alias("cc_id"), "label"), ["box", "cc_id"], "left").withColumn("place", F.coalesce("label", "cc_id")))
    at = lambda p: own.select("box", F.col("cc_id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("x", "y", "hour", "trunk", "place")))
    ways = links.select("box", F.col("src").alias("p"), F.col("dst").alias("q"), F.lit(1.0).alias("w")).unionByName(links.select("box", F.col("dst").alias("p"), F.col("src").alias("q"), F.lit(2.0).alias("w")))
    ways = cut(ways.join(at("p"), ["box", "p"]).join(at("q"), ["box", "q"]).where("not (p_trunk and q_trunk)"))
    spots = cut(comps.select("box", F.col("cc_id").alias("lat"), F.col("x").alias("lx"), F.col("y").alias("ly")))
    start = cut(stops.select("box", "stop").distinct().join(own.select("box", F.col("cc_id").alias("stop"), "place"), ["box", "stop"]))
    sizes = own.groupBy("box").agg(F.count("*").alias("n")).join(start.groupBy("box").agg(F.count("*").alias("of")), "box").join(ways.groupBy("box").agg(F.count("*").alias("n_ways")), "box", "left")
    small = cut(sizes.where((F.col("n") * F.col("of") <= most_states) & (F.coalesce("n_ways", F.lit(0)) <= most_ways)).select("box"))
    short = F.col("q_hour") - F.col("p_hour") == 0
    per = mean_speed * F.when(short, 0.7 * typical_hours).otherwise(F.abs(F.col("q_hour") - F.col("p_hour"))) / typical_hours
    whole = _whole_steps(start, own, ways.withColumn("per", per), spots, small, cap)
    start = cut(start.join(small, "box", "left_anti"))
    if start.isEmpty():
        return whole
    known = front = cut(start.withColumn("m", F.struct(F.lit(0.0).alias("d"), F.col("stop").alias("lat"))))
    while not front.isEmpty():
        moved = front.select("box", "stop", F.col("place").alias("p_place"), "m.d", "m.lat").join(ways, ["box", "p_place"]).join(spots, ["box", "lat"])
        hours = F.abs(F.col("q_hour") - F.col("p_hour"))
        out = C.distance(F.col("q_x"), F.col("q_y"), F.col("lx"), F.col("ly")) / (mean_speed * F.when(hours == 0, 0.7 * typical_hours).otherwise(hours) / typical_hours)
        cost = F.when(F.col("q_trunk"), 0.0).when(F.col("p_trunk"), out).otherwise(F.col("w"))
        lat = F.when(F.col("q_trunk"), F.col("p")).otherwise(F.col("q"))
        offers = moved.select("box", "stop", F.col("q_place").alias("place"), F.struct(F.round(F.col("d") + cost, 9).alias("d"), lat.alias("lat")).alias("new")).where(F.col("new.d") <= cap)
        offers = offers.groupBy("box", "stop", "place").agg(F.min("new").alias("new"))
        front = cut(offers.join(known, ["box", "stop", "place"], "left").where("m is null or new < m").select("box", "stop", "place", F.col("new").alias("m")))
        known = cut(known.join(front.select("box", "stop", "place"), ["box", "stop", "place"], "left_anti").unionByName(front))
    return whole.unionByName(known.join(own.select("box", "cc_id", "place"), ["box", "place"]).select("box", "stop", "cc_id", "m.d"))


def _whole_steps(start: DataFrame, own: DataFrame, ways: DataFrame, spots: DataFrame, boxes: DataFrame, cap: float) -> DataFrame:
    """The rounds of step_distance inside a task for each of some boxes, which are small: box, stop, cc_id and d."""
    types = {c: start.schema[c].dataType.simpleString() for c in ("box", "stop")}
    schema = f"box {types['box']}, stop {types['stop']}, cc_id {own.schema['cc_id'].dataType.simpleString()}, d double"
    kinds = {
        "stop": start.select("box", "stop", "place"),
        "own": own.select("box", "cc_id", "place"),
        "way": ways.select("box", "p", "q", "p_place", "q_place", "p_trunk", "q_trunk", "w", "per", *(F.col(c).cast("double").alias(c) for c in ("q_x", "q_y"))),
        "spot": spots.select("box", "lat", *(F.col(c).cast("double").alias(c) for c in ("lx", "ly"))),
    }
    rows, names = None, [*kinds]
    for kind, df in kinds.items():
        part = df.join(boxes, "box", "left_semi").withColumn("kind", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        some = {k: table.filter(pa.array(kind == k)) for k in names}
        of = lambda k, c: some[k].column(c).to_numpy()
        stop, place_of, cc_id, place = of("stop", "stop"), of("stop", "place"), of("own", "cc_id"), of("own", "place")
        places = np.unique(place)
        at = np.argsort(of("spot", "lat"), kind="stable")
        lats, lx, ly = (of("spot", c)[at] for c in ("lat", "lx", "ly"))
        n, m = len(stop), len(places)
        ids = lambda values, known: np.searchsorted(known, values)
        pp, qp, trunk_p, trunk_q = ids(of("way", "p_place"), places), ids(of("way", "q_place"), places), of("way", "p_trunk").astype(bool), of("way", "q_trunk").astype(bool)
        w, per, qx, qy = (of("way", c) for c in ("w", "per", "q_x", "q_y"))
        to = ids(np.where(trunk_q, of("way", "p"), of("way", "q")), lats)
        order = np.argsort(pp, kind="stable")
        first, n_out = np.searchsorted(pp[order], np.arange(m)), np.bincount(pp, minlength=m)
        begin, own_lat, column = ids(place_of, places), ids(stop, lats), ids(place, places)

        def distances(some: slice) -> np.ndarray:
            """A row for each of some stops, a column for each place."""
            begins = begin[some]
            d, lat = np.full(len(begins) * m, np.inf), np.zeros(len(begins) * m, np.int64)
            front = np.arange(len(begins)) * m + begins
            d[front], lat[front] = 0.0, own_lat[some]
            while len(front):
                here = front % m
                k = n_out[here]
                state = np.repeat(front, k)
                way = order[np.repeat(first[here] - (np.cumsum(k) - k), k) + np.arange(len(state))]
                off = lat[state]
                dx, dy = qx[way] - lx[off], qy[way] - ly[off]
                cost = np.where(trunk_q[way], 0.0, np.where(trunk_p[way], np.sqrt(dx * dx + dy * dy) / per[way], w[way]))
                new, key, via = _halves_up(d[state] + cost), state - state % m + qp[way], to[way]
                near = new <= cap
                new, key, via = new[near], key[near], via[near]
                least = np.lexsort((via, new, key))
                least = least[np.flatnonzero(np.diff(key[least], prepend=-1))]
                new, key, via = new[least], key[least], via[least]
                lower = (new < d[key]) | ((new == d[key]) & (via < lat[key]))
                front = key[lower]
                d[front], lat[front] = new[lower], via[lower]
            return d.reshape(-1, m)

        size = max(1, (1 << 20) // max(1, len(pp)))  # stops at once: their ways of a round are about a million at most
        parts = []
        for at in range(0, n, size):
            found = distances(slice(at, at + size))[:, column]
            i, j = np.nonzero(np.isfinite(found))
            parts.append((stop[i + at], cc_id[j], found[i, j]))
        stops, comps, d = (np.concatenate(c) for c in zip(*parts))
        box = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(d), np.int32)), table.column("box").slice(0, 1).combine_chunks()).dictionary_decode()
        return pa.table({"box": box, "stop": stops, "cc_id": comps, "d": d})

    return rows.groupBy("box").applyInArrow(run, schema)


def reconnect_broken_branches(scored: DataFrame, most: float, most_pairs: int = 1 << 20, ends: DataFrame | None = None, max_speed: float | None = None, typical_hours: float | None = None) -> DataFrame:
    """Accepted links (box, of, to, score, round) between chains, from scored pairs (box, of, to, score, and of hidden_link_score's keep: steps and off).

    With the chains' ends (see chain_ends) and the score's limits, ends are assigned to starts in each round so that the sum of scores is the least (a pair that is not given, or not under
    PENALTY, counts as PENALTY), the cheapest assigned pair under `most` is linked (ties by the ids), the pair that would now close a ring is ruled out, and pairs of which a chain has new
    components next to its end or start are scored again. Rounds of a box follow one another, so they run inside a task, which holds the box's pairs; only what hangs together with
    a changed pair is assigned again.

    Scores alone, without ends, can't be renewed: they are followed in rounds of mutual choice.
    In a round each chain's end and each chain's start without a link takes its best pair under `most` (ties by the ids); pairs that choose each other are linked, unless that
    would close a ring, and pairs that a link or a ring rules out are gone. It ends when no pair is left. A box of at most most_pairs pairs goes through its rounds inside a
    task; the others' rounds are joins over tables.
    """
    if ends is not None:
        return assigned_links(scored, most, ends, max_speed, typical_hours)
    pairs = cut(scored.where(F.col("score") < most).select("box", "of", "to", F.round("score", 9).alias("score")))
    small, pairs = parted(pairs, most_pairs)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in small.schema) + ", round int"
    whole = whole_groups(small, ["box"], _reconnected, schema)
    if pairs is None:
        return whole
    pairs = cut(pairs)
    chains = pairs.select("box", F.col("of").alias("chain")).unionByName(pairs.select("box", F.col("to").alias("chain"))).distinct()
    heads = cut(chains.withColumn("head", F.col("chain")))  # the first chain of the run that a chain is in
    taken, number = [], 0
    while not pairs.isEmpty():
        number += 1
        best = lambda side: pairs.groupBy("box", side).agg(F.min(F.struct("score", "of", "to")).alias("m")).select("box", "m.score", "m.of", "m.to")  # noqa: B023, E731
        chosen = best("of").join(best("to"), ["box", "score", "of", "to"])
        links = cut(chosen.join(heads.select("box", F.col("chain").alias("of"), F.col("head").alias("from_head")), ["box", "of"]).withColumn("round", F.lit(number)))
        kept = cut(_without_rings(links, heads))
        taken.append(kept.select("box", "of", "to", "score", "round"))
        heads = cut(_joined_heads(heads, kept))
        left = pairs.join(kept.select("box", "of"), ["box", "of"], "left_anti").join(kept.select("box", "to"), ["box", "to"], "left_anti")
        run = heads.select("box", F.col("chain").alias("of"), F.col("head").alias("ring"))
        pairs = cut(left.join(run, ["box", "of"]).where("ring <> to").drop("ring"))
    return reduce(lambda a, b: a.unionByName(b), [whole, *taken])


def _doubled(up: np.ndarray, held: np.ndarray | None = None):
    """Pointers after more steps than there are, -1 where a way has ended, and the largest held value on it."""
    held = np.zeros(len(up), np.int64) if held is None else held.copy()
    for _ in range(len(up).bit_length() + 1):
        on = up >= 0
        held = np.where(on, np.maximum(held, held[up]), held)
        up = np.where(on, up[up], -1)
        if not (up >= 0).any():
            break
    return up, held


def _reconnected(rows: pa.Table, group: np.ndarray) -> pa.Table:
    """The rounds of reconnect_broken_branches for all boxes of a table at once."""
    names = {c: rows.column(c).to_numpy() for c in ("of", "to", "score")}
    order = np.lexsort((names["to"], names["of"], names["score"]))
    rows, group = rows.take(pa.array(order)), group[order]
    n = len(order)
    ids = np.unique(np.concatenate([names["of"], names["to"]]), return_inverse=True)[1].reshape(2, n)[:, order]
    chain = np.unique(group * (ids.max(initial=0) + 1) + ids, return_inverse=True)[1].reshape(2, n)
    of, to = chain
    head, left, found, number = np.arange(chain.max(initial=-1) + 1), np.arange(n), [], 0
    while len(left):
        number += 1
        first = lambda side: left[np.unique(side[left], return_index=True)[1]]  # noqa: B023, E731  the cheapest pair of each
        chosen = np.intersect1d(first(of), first(to))
        up, dear = np.full(len(head), -1), np.zeros(len(head), np.int64)
        up[to[chosen]], dear[to[chosen]] = head[of[chosen]], chosen
        ring, dearest = _doubled(up, dear)
        kept = np.setdiff1d(chosen, dearest[ring >= 0])
        found.append((kept, np.full(len(kept), number)))
        up = np.arange(len(head))
        up[to[kept]] = head[of[kept]]
        while (up[up] != up).any():
            up = up[up]
        head = up[head]
        linked_of, linked_to = (np.isin(side[left], side[kept]) for side in (of, to))
        left = left[~linked_of & ~linked_to & (head[of[left]] != to[left])]
    at, number = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    return rows.take(pa.array(at)).append_column("round", pa.array(number.astype(np.int32)))


def _without_rings(links: DataFrame, heads: DataFrame) -> DataFrame:
    """Links of a round without those that close a ring of runs: pointers from each joined run to the one before it, doubled, meet themselves on a ring; its dearest link (ties by the ids) goes."""
    step = links.select("box", F.col("to").alias("run"), F.col("from_head").alias("up"), F.struct("score", "of", "to").alias("dear"))
    reach, n = 1, links.count()
    # Runs have one link before and one after them at most: a pointer that is still there after n steps is on a ring, and has seen all of it.
    while reach < n + 1:
        far = step.select("box", F.col("run").alias("up"), F.col("up").alias("far"), F.col("dear").alias("far_dear"))
        step = cut(step.join(far, ["box", "up"]).select("box", "run", F.col("far").alias("up"), F.greatest("dear", "far_dear").alias("dear")))
        if step.isEmpty():
            return links
        reach *= 2
    return links.join(step.select("box", "dear.of", "dear.to").distinct(), ["box", "of", "to"], "left_anti")


def _joined_heads(heads: DataFrame, links: DataFrame) -> DataFrame:
    """Heads after links were added: the head of a joined run is that of the run before it, doubled until none has one before."""
    up = cut(links.select("box", F.col("to").alias("head"), F.col("from_head").alias("up")))
    while True:
        far = up.select("box", F.col("head").alias("up"), F.col("up").alias("far"))
        more = up.join(far, ["box", "up"])
        if more.isEmpty():
            break
        up = cut(up.join(far, ["box", "up"], "left").select("box", "head", F.coalesce("far", "up").alias("up")))
    return heads.join(up, ["box", "head"], "left").select("box", "chain", F.coalesce("up", "head").alias("head"))
