"""Replay of edit logs: a state machine over the tables of nodes and roots. Round k applies the k-th edit of every model at once.

An edit is (model, action, points): an array of clicked places (x, y, z) with z a date. A click finds the nearest node that is born by z,
the least (root, seq) of equals. An edit that finds nothing or breaks its rules changes nothing. Nodes are (model, root, seq, x, y, diameter, th, t)
with seq from 1 in each root, roots are (model, root, parent). Models are independent, so all work is grouped by model and root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.operators.cut import cut
from sylvaframe.operators.edits import ordered
from sylvaframe.operators.polylines import retime_nodes
from sylvaframe.operators.reports import node_after_attachment
from sylvaframe.operators.traits import ROOT, along, is_exact, segments

#: The actions of a log.
MOVE, REMOVE, MIDDLE, SWITCH, PRIMARY, BRANCH, EXTEND, BACK, TIME = (
    "MOVEPOINT", "REMOVEPOINT", "ADDMIDDLE", "SWITCHPOINT", "CREATEPRIMARY", "CREATEBRANCH", "EXTENDBRANCH", "BACKEXTENDBRANCH", "CHANGETIME",
)
NODES = [*ROOT, "seq", "x", "y", "diameter", "th", "t"]


def edits_of(log: DataFrame) -> DataFrame:
    """model, round, action and points of a log (model, seq, action, point, x, y, z), and the number of the model's edits."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("point", "x", "y", "z"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    rounds = ordered(log).groupBy("model", "round").agg(F.first("action").alias("action"), points.alias("points"))
    return rounds.withColumn("last", F.max("round").over(Window.partitionBy("model")))


def in_order(points: Column) -> Column:
    """Whether dates never fall and never rise by more than one."""
    steps = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: (a["z"] <= b["z"]) & (b["z"] - a["z"] <= 1))
    return (F.size(points) >= 2) & F.forall(steps, lambda ok: F.coalesce(ok, F.lit(False)))


def primary_points(points: Column) -> Column:
    """Points of a new primary: of those of date 1 all but the last go one date down."""
    z = lambda i: points[i]["z"]
    down = lambda i: (i >= 1) & (i < F.size(points) - 2) & F.forall(F.slice(points, 2, i + 1), lambda p: p["z"] == 1)
    date = lambda p, i: F.when((i == 0) & (z(0) == 1) & (z(1) == 1), 0.0).when(down(i), z(0) - 1).otherwise(p["z"])
    return F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), date(p, i).alias("z")))


def with_hits(nodes: DataFrame, roots: DataFrame, edits: DataFrame, precision: float) -> DataFrame:
    """Edits with what their clicks find: nodes a and b (of the first and second point), p (the first one's among primaries) and segment s."""
    exact_before = F.max(F.when(is_exact(F.col("t")), F.col("seq"))).over(along().rowsBetween(Window.unboundedPreceding, -1))
    rows = segments(nodes).withColumn("cut", F.coalesce(exact_before, F.lit(0)) + 1).join(roots.select(*ROOT, F.col("parent").isNull().alias("top")), ROOT, "left")
    clicks = edits.select("model", F.posexplode(F.slice("points", 1, F.when(F.col("action") == SWITCH, 2).otherwise(1))).alias("pid", "p")).select("model", "pid", F.col("p.x").alias("px"), F.col("p.y").alias("py"), "p.z")
    pairs = rows.join(clicks, "model")
    dx, dy, ux, uy = F.col("px") - F.col("x"), F.col("py") - F.col("y"), F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    d2, n2, dot = F.round(dx * dx + dy * dy, 6), ux * ux + uy * uy, ux * dx + uy * dy
    off = F.round((ux * dy - uy * dx) * (ux * dy - uy * dx) / F.nullif(n2, F.lit(0.0)), 6)
    hit = lambda d: F.struct(d.alias("d2"), "root", "seq", "t", "th", "t1", "th1", "cut")
    born, first = F.col("t") <= F.col("z"), F.col("pid") == 0
    near = (off < precision * precision) & (dot >= 0) & (dot <= n2) & (F.least("t", "t1") <= F.col("z"))
    least = lambda when, d, name: F.min(F.when(when, hit(d))).alias(name)
    found = pairs.groupBy("model").agg(
        least(first & born, d2, "a"), least(~first & born, d2, "b"), least(first & born & F.coalesce("top", F.lit(False)), d2, "p"), least(first & F.coalesce(near, F.lit(False)), off, "s"), F.max("root").alias("most")
    )
    return edits.join(found, "model", "left")


def checked(edits: DataFrame) -> DataFrame:
    """The edits that keep their rules."""
    z, n = F.col("points")[0]["z"], F.size("points")
    other = F.floor("a.t") <= F.floor("b.t1")
    rules = {
        MOVE: F.col("a").isNotNull() & (n >= 2),
        REMOVE: F.col("a").isNotNull(),
        MIDDLE: F.col("s").isNotNull() & (n >= 2),
        SWITCH: (n >= 2) & F.col("a.t1").isNotNull() & F.col("b.t1").isNotNull() & other & (F.floor("b.t") <= F.floor("a.t1")),
        PRIMARY: in_order(F.col("points")),
        BRANCH: F.col("p").isNotNull() & in_order(F.col("points")),
        EXTEND: F.col("a.t1").isNull() & (F.col("a.seq") > 1) & (F.col("a.t") == F.when(z < 1, 0.0).otherwise(z)) & in_order(F.col("points")),
        BACK: (F.col("a.seq") == 1) & (F.when(F.col("a.t") == 0, 1.0).otherwise(F.col("a.t")) == z) & in_order(F.reverse("points")),
        TIME: F.col("a").isNotNull() & (n >= 2),
    }
    allowed = F.lit(False)
    for action, rule in rules.items():
        allowed = F.when(F.col("action") == action, F.coalesce(rule, F.lit(False))).otherwise(allowed)
    return edits.where(allowed)


def removed_roots(nodes: DataFrame, roots: DataFrame, edits: DataFrame) -> DataFrame:
    """Roots that go whole with a removed point: laterals of a root with several that stand at or after its cut, and what hangs on them the same way.

    A round for each order of laterals; only models with such an edit take part.
    """
    removals = edits.where(F.col("action") == REMOVE).select("model", F.col("a.root").alias("root"), F.col("a.cut").alias("cut"))
    own_nodes, own_roots = (t.join(removals.select("model"), "model", "left_semi") for t in (nodes, roots))
    several = own_roots.groupBy("model", F.col("parent").alias("root")).agg(F.count("*").alias("n")).where("n > 1").select(*ROOT)
    children = own_roots.where("parent is not null").join(several.withColumnRenamed("root", "parent"), ["model", "parent"], "left_semi").select(*ROOT, "parent")
    after = node_after_attachment(own_nodes, own_roots).select(*ROOT, "node")
    whole = removals.where("cut = 1").select(*ROOT)
    front = children.join(after, ROOT).join(removals.withColumnRenamed("root", "parent"), ["model", "parent"]).where("node >= cut").select(*ROOT)
    gone = whole.unionByName(front)
    while not front.isEmpty():
        front = cut(children.join(front.withColumnRenamed("root", "parent"), ["model", "parent"]).select(*ROOT))
        gone = gone.unionByName(front)
    return gone.distinct()


def apply_edits(nodes: DataFrame, roots: DataFrame, edits: DataFrame, step_hours: float, precision: float, actions: set[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and roots after one edit (model, action, points) of each of some models; the changed roots are retimed. actions: those that may occur."""
    e = cut(checked(with_hits(nodes, roots, edits, precision)))
    is_a = lambda action: F.col("action") == action
    pts, most = F.col("points"), F.col("most") + 1

    # Rows that edits add: a root, a place among its nodes, and the point.
    at = lambda points, place: F.transform(points, lambda p, i: F.struct(place(i).cast("double").alias("place"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("t"), (F.floor(p["z"]) * step_hours).alias("th")))
    share = lambda p: (p["z"] - F.col("s.t")) / F.nullif(F.col("s.t1") - F.col("s.t"), F.lit(0.0))
    rest = F.slice("points", 2, F.size("points") - 1)
    middle = F.transform(rest, lambda p, i: F.struct(
        (F.col("s.seq") + (i + 1) / (F.size("points") + 0.0)).alias("place"), p["x"].alias("x"), p["y"].alias("y"), F.coalesce(F.col("s.t") + (F.col("s.t1") - F.col("s.t")) * share(p), p["z"]).alias("t"),
        F.coalesce(F.col("s.th") + (F.col("s.th1") - F.col("s.th")) * share(p), F.col("s.th")).alias("th"),
    ))
    news = (
        F.when(is_a(MIDDLE), middle).when(is_a(PRIMARY), at(primary_points(pts), lambda i: i)).when(is_a(BRANCH), at(pts, lambda i: i))
        .when(is_a(EXTEND), at(rest, lambda i: F.col("a.seq") + 1 + i)).when(is_a(BACK), at(F.reverse(rest), lambda i: i - F.size("points")))
    )
    root = F.when(is_a(MIDDLE), F.col("s.root")).when(is_a(PRIMARY) | is_a(BRANCH), most).otherwise(F.col("a.root"))
    added = e.select("model", root.alias("root"), F.explode(news).alias("n")).select(*ROOT, "n.*", F.lit(1.0).alias("diameter"), F.lit(True).alias("changed"))
    parent = F.when(is_a(BRANCH), F.col("p.root"))
    new_roots = e.where(is_a(PRIMARY) | is_a(BRANCH)).select("model", most.alias("root"), parent.alias("parent"))

    # Rows that edits change, move to another root, or drop.
    run = F.sum(F.when(F.floor("t") == F.floor(F.lag("t").over(along())), 0).otherwise(1)).over(along())
    rows = nodes.withColumn("run", run).join(e.select("model", "action", "points", "a", "b", "s"), "model", "left")
    ends = {k: rows.where(is_a(SWITCH) & (F.col("root") == F.col(f"{k}.root")) & F.col("seq").isin([F.col(f"{k}.seq"), F.col(f"{k}.seq") + 1])) for k in ("a", "b")}
    runs = ends["a"].groupBy("model").agg(F.min_by("run", "seq").alias("a0"), F.max_by("run", "seq").alias("a1")).join(ends["b"].groupBy("model").agg(F.min_by("run", "seq").alias("b0"), F.max_by("run", "seq").alias("b1")), "model")
    rows = rows.join(runs, "model", "left")
    on = lambda k: F.coalesce(F.col("root") == F.col(f"{k}.root"), F.lit(False))
    clicked = on("a") & (F.col("seq") == F.col("a.seq"))
    tail = lambda k: on(k) & (F.col("seq") > F.col(f"{k}.seq"))
    floored = F.lit(False)
    for k in ("a", "b"):
        floored = floored | (on(k) & (((F.col("seq") <= F.col(f"{k}.seq")) & (F.col("run") == F.col(f"{k}0"))) | ((F.col("seq") > F.col(f"{k}.seq")) & (F.col("run") == F.col(f"{k}1")))))
    same = F.col("a.root") == F.col("b.root")
    looped = is_a(SWITCH) & same & on("a") & (F.col("seq") > F.least("a.seq", "b.seq")) & (F.col("seq") <= F.greatest("a.seq", "b.seq"))
    cut_off = is_a(REMOVE) & on("a") & (F.col("seq") >= F.col("a.cut"))
    rows = rows.where(F.coalesce(~(looped | cut_off), F.lit(True)))
    crossing = is_a(SWITCH) & ~same
    target = F.when(crossing & tail("a"), F.col("b.root")).when(crossing & tail("b"), F.col("a.root")).otherwise(F.col("root"))
    place = F.when(crossing & tail("a"), F.col("b.seq") + F.col("seq") - F.col("a.seq")).when(crossing & tail("b"), F.col("a.seq") + F.col("seq") - F.col("b.seq")).otherwise(F.col("seq"))
    to = lambda c: F.when(is_a(MOVE) & clicked, pts[1][c]).otherwise(F.col(c))
    t = F.when(is_a(TIME) & clicked, pts[1]["z"]).when(is_a(SWITCH) & F.coalesce(floored, F.lit(False)), F.floor("t").cast("double")).otherwise(F.col("t"))
    th = F.when(is_a(TIME) & clicked, pts[1]["z"] * step_hours).when(is_a(BACK) & clicked, F.floor("t") * step_hours).otherwise(F.col("th"))
    changed = F.when(is_a(SWITCH), on("a") | on("b")).when(is_a(MIDDLE), on("s")).otherwise(on("a") & ~is_a(PRIMARY) & ~is_a(BRANCH))
    redated = is_a(TIME) | is_a(SWITCH)
    kept = rows.select("model", target.alias("root"), place.cast("double").alias("place"), to("x").alias("x"), to("y").alias("y"), "diameter", th.alias("th"), t.alias("t"), F.coalesce(changed, F.lit(False)).alias("changed"), F.coalesce(redated & changed, F.lit(False)).alias("redated"))
    every = kept.unionByName(added.withColumn("redated", F.lit(False)))

    # Whole dates that a redated root passes without a node get one, by time.
    by_place = Window.partitionBy(*ROOT).orderBy("place")
    nexts = every.where("redated").withColumns({f"{c}1": F.lead(c).over(by_place) for c in ("x", "y", "t")})
    gaps = nexts.where("ceil(t1) - 1 >= floor(t) + 1").withColumn("day", F.explode(F.sequence(F.floor("t") + 1, F.ceil("t1") - 1)))
    part = (F.col("day") - F.col("t")) / (F.col("t1") - F.col("t"))
    between = lambda c: (F.col(c) + part * (F.col(f"{c}1") - F.col(c))).alias(c)
    flying = gaps.select(*ROOT, (F.col("place") + part / 2).alias("place"), between("x"), between("y"), F.lit(1.0).alias("diameter"), (F.col("day") * step_hours).alias("th"), F.col("day").cast("double").alias("t"), F.lit(True).alias("changed"))
    every = every.drop("redated").unionByName(flying)

    left = roots
    if REMOVE in actions:
        gone = removed_roots(nodes, roots, e)
        every, left = every.join(gone, ROOT, "left_anti"), roots.join(gone, ROOT, "left_anti")
    every = every.withColumn("changed", F.max("changed").over(Window.partitionBy(*ROOT))).withColumn("seq", F.row_number().over(by_place)).drop("place")
    left = left.unionByName(new_roots.select(*(F.col(c).cast(roots.schema[c].dataType) for c in roots.columns)))
    retimed = retime_nodes(every.where("changed").select(*NODES), left)
    return every.where(~F.col("changed")).select(*NODES).unionByName(retimed), left


def _plain(nodes: DataFrame) -> DataFrame:
    return nodes.select(*ROOT, F.col("seq").cast("int").alias("seq"), *(F.col(c).cast("double").alias(c) for c in NODES[3:]))


def edit_replay(nodes: DataFrame, roots: DataFrame, log: DataFrame, step_hours: float, precision: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """Nodes and roots after all edits of a log (model, seq, action, point, x, y, z), in the log's order for each model.

    As many rounds as the longest log has edits. A round works on the models that still have edits; the others' rows stay in the table of
    the round that ended them. A date change takes the new date from its second point.
    """
    edits = cut(edits_of(log))
    lasts = edits.select("model", "last").distinct()
    waiting = lambda df: df.join(lasts, "model", "left").fillna(0, ["last"])
    nodes, roots = cut(waiting(_plain(nodes))), cut(waiting(roots.select(*ROOT, "parent")))
    ended: list[tuple[DataFrame, DataFrame]] = []
    for k, actions in sorted(edits.groupBy("round").agg(F.collect_set("action").alias("actions")).collect()):  # as many rows as rounds
        ended.append(tuple(df.where(F.col("last") == k - 1).drop("last") for df in (nodes, roots)))
        open_nodes, open_roots = (df.where(F.col("last") >= k).drop("last") for df in (nodes, roots))
        changed = apply_edits(open_nodes, open_roots, edits.where(F.col("round") == k).select("model", "action", "points"), step_hours, precision, set(actions))
        nodes, roots = (cut(waiting(df)) for df in changed)
    ended.append(tuple(df.drop("last") for df in (nodes, roots)))
    out_nodes, out_roots = ended[0]
    for n, r in ended[1:]:
        out_nodes, out_roots = out_nodes.unionByName(n), out_roots.unionByName(r)
    return out_nodes, out_roots


def one_edit(action: str):
    """An edit of its own: nodes and roots after the given points (model, points) of each of some models."""

    def edit(nodes: DataFrame, roots: DataFrame, points: DataFrame, step_hours: float, precision: float = 20.0) -> tuple[DataFrame, DataFrame]:
        return apply_edits(_plain(nodes), roots.select(*ROOT, "parent"), points.select("model", F.lit(action).alias("action"), "points"), step_hours, precision, {action})

    return edit


#: Cuts the clicked root from behind its last exact node on, with the laterals that hang there.
edit_remove_point = one_edit(REMOVE)
#: Puts all points but the first into the segment nearest to the first, with dates between its ends'.
edit_add_middle = one_edit(MIDDLE)
#: Swaps what follows two clicked nodes; dates around them go down to whole ones, and passed dates get nodes.
edit_switch = one_edit(SWITCH)
#: A new root of the points.
edit_create_primary = one_edit(PRIMARY)
#: A new lateral of the points, on the primary nearest to the first.
edit_create_branch = one_edit(BRANCH)
#: Appends the points after the first to the root whose last node was clicked.
edit_extend = one_edit(EXTEND)
#: Prepends the points after the first, in reverse, to the root whose first node was clicked.
edit_back_extend = one_edit(BACK)
