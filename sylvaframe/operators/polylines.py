"""Operators that change or compare polylines of roots, and what lies near them. Nodes are (model, root, seq, x, y, diameter, th, t)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.functions import scalars as C
from sylvaframe.operators.graph import within
from sylvaframe.operators.models import first_nodes
from sylvaframe.operators.nearest import nearest
from sylvaframe.operators.traits import ROOT, along, is_exact, nearest_node, segments

EPS = 1e-6


def back() -> Window:
    return Window.partitionBy(*ROOT).orderBy(F.desc("seq"))


def retime_nodes(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes with dates and hours between exact ones by arc length.

    Of a run of nodes with one whole date only the last is exact. Before that, of a primary's beginning all nodes that a node of date 1
    follows, without a gap, get date 0. Nodes before the first or after the last exact one keep what they have.
    """
    top = nodes.join(roots.where("parent is null").select(*ROOT, F.lit(True).alias("top")), ROOT, "left")
    leads = F.coalesce(F.lead("t").over(along()) == 1, F.lit(False))
    starts = F.coalesce(F.col("top"), F.lit(False)) & (F.sum(F.when(leads, 0).otherwise(1)).over(along()) == 0)
    rows = top.withColumn("starts", starts).withColumn("t", F.when(F.col("starts"), 0.0).otherwise(F.col("t"))).withColumn("th", F.when(F.col("starts"), 0.0).otherwise(F.col("th"))).drop("top", "starts")
    later = F.lead("t").over(along())
    same = F.coalesce(is_exact(later) & (F.rint(later) == F.rint("t")), F.lit(False))
    rows = segments(rows.withColumn("exact", is_exact(F.col("t")) & ~same))
    mark = F.when(F.col("exact"), F.struct("c", "t", "th"))
    rows = rows.withColumn("a", F.last(mark, ignorenulls=True).over(along())).withColumn("b", F.last(mark, ignorenulls=True).over(back()))
    whole = F.col("b.c") - F.col("a.c")
    share = F.when(whole < EPS, 0.5).otherwise((F.col("c") - F.col("a.c")) / whole)
    moves = ~F.col("exact") & F.col("a").isNotNull() & F.col("b").isNotNull()
    at = lambda name: F.when(moves, F.col(f"a.{name}") + share * (F.col(f"b.{name}") - F.col(f"a.{name}"))).otherwise(F.col(name)).alias(name)
    return rows.select(*(at(c) if c in ("t", "th") else c for c in nodes.columns))


def position_at_distance(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query (model, root, q, d) the place, date and hours at an arc length d of its root, clamped to the ends: queries with x, y, t and th.

    Nodes and queries of a root are merged in two sorted passes.
    """
    values = ("x", "y", "t", "th")
    knots = segments(nodes).select(*ROOT, F.col("c").alias("d"), F.lit(1).alias("kind"), "seq", F.struct("c", *(F.col(v).cast("double").alias(v) for v in values)).alias("knot"), F.lit(None).cast(queries.schema["q"].dataType).alias("q"))
    asked = queries.select(*ROOT, F.col("d").cast("double").alias("d"), F.lit(0).alias("kind"), F.lit(0).alias("seq"), F.lit(None).cast(knots.schema["knot"].dataType).alias("knot"), "q")
    up, down = Window.partitionBy(*ROOT).orderBy("d", "kind", "seq"), Window.partitionBy(*ROOT).orderBy(F.desc("d"), F.desc("kind"), F.desc("seq"))
    both = knots.unionByName(asked).withColumn("a", F.last("knot", ignorenulls=True).over(up)).withColumn("b", F.last("knot", ignorenulls=True).over(down)).where("kind = 0")
    share = (F.col("d") - F.col("a.c")) / (F.col("b.c") - F.col("a.c"))
    at = lambda v: F.when(F.col("a").isNull(), F.col(f"b.{v}")).when(F.col("b").isNull(), F.col(f"a.{v}")).otherwise(F.col(f"b.{v}") * share + (1 - share) * F.col(f"a.{v}")).alias(v)
    return both.select(*ROOT, "q", "d", *(at(v) for v in values))


def speed_vectors(nodes: DataFrame, backward: float, forward: float, zero_last: bool = False) -> DataFrame:
    """model, root, seq, vx and vy: from the place `backward` before a node to the one `forward` after it, by arc length, over the hours between.

    Where the place before has a date under 1 the node itself counts; nodes before date 1, and last ones if asked, have none.
    """
    rows = segments(nodes).select(*ROOT, "seq", "x", "y", "t", "th", "c", F.lead("seq").over(along()).isNull().alias("last"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col("c") - backward).alias("d")), F.struct(F.lit(1).alias("side"), (F.col("c") + forward).alias("d"))))
    asked = rows.select(*ROOT, "seq", ends.alias("e")).select(*ROOT, F.struct("seq", "e.side").alias("q"), "e.d")
    found = position_at_distance(nodes, asked).select(*ROOT, "q.seq", "q.side", F.struct("x", "y", "t", "th").alias("p"))
    both = found.groupBy(*ROOT, "seq").agg(F.max(F.when(F.col("side") == 0, F.col("p"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("p"))).alias("b"))
    rows = rows.join(both, [*ROOT, "seq"])
    own = F.col("a.t") < 1
    base = {c: F.when(own, F.col(c)).otherwise(F.col(f"a.{c}")) for c in ("x", "y", "th")}
    hours = F.nullif(F.col("b.th") - base["th"], F.lit(0.0))
    still = (F.col("t") < 1) | (F.col("last") if zero_last else F.lit(False))
    return rows.select(*ROOT, "seq", *(F.when(still, 0.0).otherwise((F.col(f"b.{c}") - base[c]) / hours).alias(f"v{c}") for c in ("x", "y")))


def snap_laterals(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes with the nearest node of the parent, its first not counted, put before each lateral's first, with that one's diameter and dates; numbered anew."""
    laterals = first_nodes(nodes).join(roots.where("parent is not null"), ROOT).select(*ROOT, "parent", F.col("fx").alias("px"), F.col("fy").alias("py"))
    places = nodes.where("seq > 1").select("model", F.col("root").alias("parent"), F.col("seq").alias("at"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    near = nearest(laterals, places, ["model", "parent"], ["root"], ["at"]).select(*ROOT, "parent", "at")
    at = near.join(nodes.select("model", F.col("root").alias("parent"), F.col("seq").alias("at"), "x", "y"), ["model", "parent", "at"])
    new = at.select(*ROOT, "x", "y").join(nodes.where("seq = 1").select(*ROOT, "diameter", "th", "t"), ROOT).withColumn("seq", F.lit(0))
    return nodes.select(*ROOT, "seq", "x", "y", "diameter", "th", "t").unionByName(new).withColumn("seq", F.row_number().over(along()))


def translate_nodes(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Nodes of some roots (model, root, dx, dy) moved."""
    moved = nodes.join(moves, ROOT, "left")
    return moved.select(*((F.col(c) + F.coalesce(f"d{c}", F.lit(0))).alias(c) if c in ("x", "y") else c for c in nodes.columns))


def node_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of a with whether b has one at the same number with the same place, date and diameter; nulls are alike."""
    other = b.select(*ROOT, "seq", F.struct("x", "y", "t", "diameter").alias("o"))
    own = F.struct("x", "y", "t", "diameter")
    return a.select(*ROOT, "seq", own.alias("own")).join(other, [*ROOT, "seq"], "left").select(*ROOT, "seq", F.col("own").eqNullSafe(F.col("o")).alias("equal"))


def node_precedes(pairs: DataFrame) -> DataFrame:
    """Pairs of nodes (model, root_a, seq_a, root_b, seq_b) with whether the first is at or before the second on the same root."""
    return pairs.withColumn("precedes", (F.col("root_a") == F.col("root_b")) & (F.col("seq_a") <= F.col("seq_b")))


def model_validity(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots with whether they have nodes, all at known places, and so a finite length."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    sound = nodes.groupBy(*ROOT).agg(F.bool_and(known("x") & known("y")).alias("sound"))
    return roots.join(sound, ROOT, "left").select(*ROOT, F.coalesce("sound", F.lit(False)).alias("valid"))


def attach_child(roots: DataFrame, changes: DataFrame) -> DataFrame:
    """Roots with new parents of some (model, root, new_parent). A change under the root itself or one of its descendants is left out."""
    forest = roots.select(F.col("model").alias("box"), F.col("root").alias("cc_id"), "parent")
    inside = within(forest, changes.select(F.col("model").alias("box"), F.col("root").alias("anc"), F.col("new_parent").alias("node"))).toDF("model", "root", "new_parent")
    fits = changes.join(inside, ["model", "root", "new_parent"], "left_anti").select(*ROOT, "new_parent", F.lit(True).alias("changed"))
    return roots.join(fits, ROOT, "left").select(*ROOT, F.when(F.col("changed"), F.col("new_parent")).otherwise(F.col("parent")).alias("parent"))


def root_annotations(marks: DataFrame) -> DataFrame:
    """Marks (model, root, line, type, value, position) that stand: of the most distal lateral (MDL) only the last of a root; with the ruler's origin,
    the position of the root's last anchor, taken off the positions of the others."""
    last = F.row_number().over(Window.partitionBy(*ROOT, "type").orderBy(F.desc("line")))
    origin = F.max(F.when(F.col("type") == "ANCHOR", F.struct("line", "position"))).over(Window.partitionBy(*ROOT))
    rows = marks.withColumn("n", last).withColumn("origin", F.coalesce(origin["position"], F.lit(0.0))).where("type <> 'MDL' or n = 1")
    return rows.withColumn("place", F.when(F.col("type") == "ANCHOR", F.col("position")).otherwise(F.col("position") - F.col("origin"))).drop("n", "origin")


def nearest_node_by_order(points: DataFrame, nodes: DataFrame, orders: DataFrame) -> DataFrame:
    """For each point (pid, model, x, y, z, want) the nearest node born by z on a root of the order `want`; orders: model, root, ord."""
    return nearest_node(points, nodes.join(orders.select(*ROOT, "ord"), ROOT), F.col("ord") == F.col("want"))


def nearest_node_by_root(points: DataFrame, nodes: DataFrame, same: bool = True) -> DataFrame:
    """For each point (pid, model, x, y, z, own) the nearest node born by z on the root `own`, or on the other roots."""
    return nearest_node(points, nodes, (F.col("root") == F.col("own")) if same else (F.col("root") != F.col("own")))


def nearest_segment(points: DataFrame, nodes: DataFrame, most: float) -> DataFrame:
    """For each point (pid, model, x, y, z) the segment (root, seq of its first node) with the smallest perpendicular distance under `most`.

    The foot must lie on the segment and one of its ends be born by z. Segments stand in all grid cells, as wide as `most`, that their box with its margin
    meets; a point looks into its own. Ties go to the least (root, seq).
    """
    cell = lambda v: F.floor(v / most)
    rows = segments(nodes).where("x1 is not null")
    reach = lambda a, b: F.sequence(cell(F.least(a, b) - most), cell(F.greatest(a, b) + most))
    placed = rows.select(*ROOT, "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"), F.least("t", "t1").alias("born"), F.explode(reach("x", "x1")).alias("gx"), "y", "y1")
    placed = placed.withColumn("gy", F.explode(reach("y", "y1"))).drop("y", "y1")
    asked = points.select("model", "pid", F.col("x").alias("px"), F.col("y").alias("py"), "z", cell(F.col("x")).alias("gx"), cell(F.col("y")).alias("gy"))
    ux, uy, vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("px") - F.col("ax"), F.col("py") - F.col("ay")
    dot, n2 = ux * vx + uy * vy, ux * ux + uy * uy
    d2 = F.round(F.pow(ux * vy - uy * vx, F.lit(2)) / F.nullif(n2, F.lit(0)), 6)
    pairs = asked.join(placed, ["model", "gx", "gy"]).where((F.col("born") <= F.col("z")) & (dot >= 0) & (dot <= n2)).withColumn("d2", d2).where(F.col("d2") < most * most)
    return pairs.groupBy("model", "pid").agg(F.min(F.struct("d2", "root", "seq")).alias("m")).select("model", "pid", "m.root", "m.seq", "m.d2")


def segment_distance(a0: tuple[Column, Column], a1: tuple[Column, Column], b0: tuple[Column, Column], b1: tuple[Column, Column]) -> Column:
    """A struct of the distance between two segments and the middle of their nearest points (d, x, y): 0 at a crossing, else from one of the ends to the other segment."""

    def foot(p, s0, s1):
        ux, uy = s1[0] - s0[0], s1[1] - s0[1]
        k = F.coalesce(((p[0] - s0[0]) * ux + (p[1] - s0[1]) * uy) / F.nullif(ux * ux + uy * uy, F.lit(0.0)), F.lit(0.0))
        k = F.greatest(F.lit(0.0), F.least(F.lit(1.0), k))
        qx, qy = s0[0] + k * ux, s0[1] + k * uy
        return F.struct(C.distance(p[0], p[1], qx, qy).alias("d"), ((p[0] + qx) / 2).alias("x"), ((p[1] + qy) / 2).alias("y"))

    ux, uy, wx, wy = a1[0] - a0[0], a1[1] - a0[1], b1[0] - b0[0], b1[1] - b0[1]
    cross = F.nullif(ux * wy - uy * wx, F.lit(0.0))
    k, m = ((b0[0] - a0[0]) * wy - (b0[1] - a0[1]) * wx) / cross, ((b0[0] - a0[0]) * uy - (b0[1] - a0[1]) * ux) / cross
    meets = F.coalesce((k >= 0) & (k <= 1) & (m >= 0) & (m <= 1), F.lit(False))
    crossing = F.struct(F.lit(0.0).alias("d"), (a0[0] + k * ux).alias("x"), (a0[1] + k * uy).alias("y"))
    return F.when(meets, crossing).otherwise(F.array_min(F.array(foot(a0, b0, b1), foot(a1, b0, b1), foot(b0, a0, a1), foot(b1, a0, a1))))


def bbox_overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column, within: float) -> Column:
    """Whether two intervals overlap or lie within a distance."""
    return (low_a - within <= high_b) & (low_b - within <= high_a)


def contact_points(nodes: DataFrame, within: float, last: float) -> DataFrame:
    """Places where segments of two roots of a model are within a distance: model, root_a, seq_a, root_b, seq_b (of their later nodes), d, x and y.

    Segments whose later node lies less than twice the distance along its root, or is born after `last`, don't count. Segments meet in the
    grid cells that both reach.
    """
    cell = 8 * within
    rows = segments(nodes).select(*ROOT, "seq", "c", "t", "x", "y", F.lag("x").over(along()).alias("x0"), F.lag("y").over(along()).alias("y0"))
    rows = rows.where(F.col("x0").isNotNull() & (F.col("c") >= 2 * within) & (F.col("t") <= last)).select(*ROOT, "seq", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x", "y")))
    reach = lambda a, b: F.sequence(F.floor((F.least(a, b) - within) / cell), F.floor((F.greatest(a, b) + within) / cell))
    placed = rows.withColumn("gx", F.explode(reach("x0", "x"))).withColumn("gy", F.explode(reach("y0", "y")))
    side = lambda p: placed.select("model", "gx", "gy", *(F.col(c).alias(f"{p}_{c}") for c in ("root", "seq", "x0", "y0", "x", "y")))
    apart = F.lit(True)
    for c in ("x", "y"):
        low, high = (lambda p, f=f: f(f"{p}_{c}0", f"{p}_{c}") for f in (F.least, F.greatest))  # noqa: B023
        apart = apart & bbox_overlap(low("a"), high("a"), low("b"), high("b"), within)
    key = ["model", "a_root", "a_seq", "b_root", "b_seq"]
    pairs = side("a").join(side("b"), ["model", "gx", "gy"]).where("a_root < b_root").where(apart).drop("gx", "gy").dropDuplicates(key)
    at = lambda p, k: (F.col(f"{p}_x{k}"), F.col(f"{p}_y{k}"))
    found = pairs.withColumn("s", segment_distance(at("a", "0"), at("a", ""), at("b", "0"), at("b", ""))).where(F.round("s.d", 9) <= within)
    return found.select("model", *(F.col(f"{p}_{c}").alias(f"{c}_{p}") for p in "ab" for c in ("root", "seq")), "s.d", "s.x", "s.y")


def complexity_count(contacts: DataFrame) -> DataFrame:
    """Number of pairs of roots that touch, and of places, in each model."""
    return contacts.groupBy("model").agg(F.count_distinct("root_a", "root_b").alias("pairs"), F.count("*").alias("places"))
