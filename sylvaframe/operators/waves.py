"""Waves over pixels in tiles, paths by back pointers, and what of an organ follows from its path.

A wave runs to its end inside each tile in one pass; only tiles whose border was reached anew run again. So there are as many rounds as a
wave crosses tiles, and no task holds more than a tile with its border.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvaframe.functions import scalars as C
from sylvaframe.operators.cut import cut
from sylvaframe.operators.groups import parted, tiled, whole_groups
from sylvaframe.operators.timebase import linear_interpolation

AROUND = tuple((dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy)
STATE = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("f", pa.float64()), ("d", pa.float64()), ("label", pa.int64()), ("moved", pa.bool_())])


def _around(rows: pa.Table, group: np.ndarray) -> np.ndarray:
    """The row of each row's neighbours in its group, in the order of AROUND; -1 where there is none."""
    x, y = (rows.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
    x, y = x - x.min(initial=0) + 1, y - y.min(initial=0) + 1
    high = y.max(initial=0) + 2
    key = (group * (x.max(initial=0) + 2) + x) * high + y
    order = np.argsort(key, kind="stable")
    known = key[order]
    out = np.empty((len(AROUND), len(key)), np.int64)
    for k, (dx, dy) in enumerate(AROUND):
        at = np.minimum(np.searchsorted(known, key + dx * high + dy), len(key) - 1)
        out[k] = np.where(known[at] == key + dx * high + dy, order[at], -1)
    return out


def _in_tile(straight: float, diagonal: float):
    cost = [diagonal if dx and dy else straight for dx, dy in AROUND]

    def run(rows: pa.Table, group: np.ndarray) -> pa.Table:
        own, f = rows.column("own").to_numpy(zero_copy_only=False), rows.column("f").to_numpy()
        d = rows.column("d").fill_null(np.inf).to_numpy().copy()
        label = rows.column("label").fill_null(-1).to_numpy().copy()
        around, before = _around(rows, group), (d.copy(), label.copy())
        around = np.where((around >= 0) & own[around], around, -1)
        front = np.flatnonzero(d < np.inf)
        while len(front):
            # All that the last step has lowered moves on; a pixel takes the least (d, label) that it is offered.
            moved = []
            for k, w in enumerate(cost):
                to = around[k][front]
                at, to = front[to >= 0], to[to >= 0]
                new = d[at] + w * (f[at] + f[to]) / 2
                lower = (new < d[to]) | ((new == d[to]) & (label[at] < label[to]))
                moved.append((to[lower], new[lower], label[at[lower]]))
            to, new, name = (np.concatenate(c) for c in zip(*moved))
            order = np.lexsort((name, new, to))
            first = order[np.flatnonzero(np.diff(to[order], prepend=-1))]
            front = to[first]
            d[front], label[front] = new[first], name[first]
        mine, far = np.flatnonzero(own), d == np.inf
        columns = [*(rows.column(c).take(pa.array(mine)) for c in ("x", "y", "f")), *(pa.array(v[mine], mask=far[mine]) for v in (d, label)), pa.array(((d != before[0]) | (label != before[1]))[mine])]
        out = pa.table(columns, schema=STATE)
        return out.add_column(0, "key", rows.column("key").take(pa.array(mine)))

    return run


def wave(pixels: DataFrame, seeds: DataFrame, by: list[str], straight: float = 1.0, diagonal: float = 2**0.5, factor: Column | None = None, tile: int = 128) -> DataFrame:
    """by, x, y, d and label of the pixels (by, x, y) that a wave reaches from seeds (by, x, y, label): the least (d, label).

    A step to a neighbour costs `straight` or `diagonal`, times the mean of both pixels' factor (over 0).
    """
    key = F.struct(*by).alias("key")
    factor = F.lit(1.0) if factor is None else factor
    tiles = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in ("x", "y")]
    start = seeds.select(key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "label").groupBy("key", "x", "y").agg(F.min("label").cast("long").alias("label"))
    rows = pixels.select(key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), factor.cast("double").alias("f")).dropDuplicates(["key", "x", "y"])
    rows = rows.join(start, ["key", "x", "y"], "left").withColumn("d", F.when(F.col("label").isNotNull(), 0.0))
    state = cut(rows.select("key", "x", "y", "f", "d", "label"))
    schema = f"key {state.schema['key'].dataType.simpleString()}, x long, y long, f double, d double, label long, moved boolean"
    # A tile is told by a neighbour only what was reached there.
    run = lambda rows: whole_groups(rows, ["key", "tx", "ty"], _in_tile(straight, diagonal), schema)
    state = cut(run(tiled(state, tile, lent=F.col("d").isNotNull())).withColumns({c: F.floor(F.col(c[1:]) / tile) for c in ("tx", "ty")}))
    while True:
        lit = tiled(state.where("moved and d is not null").select("key", "x", "y"), tile).where("not own").select("key", "tx", "ty").distinct()
        active = cut(lit.join(state.select("key", "tx", "ty"), ["key", "tx", "ty"], "left_semi"))
        if active.isEmpty():
            return state.where("d is not null").select("key.*", "x", "y", "f", "d", "label")
        asked = tiled(state.select("key", "x", "y", "f", "d", "label"), tile, lent=F.col("d").isNotNull()).join(active, ["key", "tx", "ty"], "left_semi")
        ran = run(asked).withColumns({c: F.floor(F.col(c[1:]) / tile) for c in ("tx", "ty")})
        rest = state.join(active, ["key", "tx", "ty"], "left_anti").withColumn("moved", F.lit(False))
        state = cut(ran.unionByName(rest))


def _pointers(straight: float, diagonal: float):
    cost = [diagonal if dx and dy else straight for dx, dy in AROUND]

    def run(rows: pa.Table, group: np.ndarray) -> pa.Table:
        x, y, f, d = (rows.column(c).to_numpy() for c in ("x", "y", "f", "d"))
        around = _around(rows, group)
        best, at = np.full(len(d), np.inf), np.full(len(d), -1)
        for k in sorted(range(len(AROUND)), key=lambda k: AROUND[k][::-1]):  # the least (y, x) of equals comes first
            j = around[k]
            offer = np.where((j >= 0) & (d[j] < d) & (d > 0), np.round(d[j] + cost[k] * (f + f[j]) / 2, 9), np.inf)
            at, best = np.where(offer < best, j, at), np.minimum(offer, best)
        mine = rows.filter(rows.column("own")).drop_columns(["tx", "ty", "own"])
        own = rows.column("own").to_numpy(zero_copy_only=False)
        px, py = (pa.array(v[at].astype(np.int64)[own], mask=(at < 0)[own]) for v in (x, y))
        return mine.append_column("px", px).append_column("py", py)

    return run


def back_pointers(reached: DataFrame, by: list[str], straight: float = 1.0, diagonal: float = 2**0.5, tile: int = 128) -> DataFrame:
    """Reached pixels with the neighbour (px, py) over which the wave came, null at its seeds; the least (y, x) of equals."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reached.schema) + ", px long, py long"
    return whole_groups(tiled(reached, tile), [*by, "tx", "ty"], _pointers(straight, diagonal), schema)


def _ways_back(rows: pa.Table, group: np.ndarray) -> pa.Table:
    """The pixels on the way from each end (steps 0) over the pointers."""
    x, y, px, py = (rows.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("x", "y", "px", "py"))
    known = rows.column("px").is_valid().to_numpy()
    high = max(y.max(initial=0), py.max(initial=0)) - min(y.min(initial=0), py.min(initial=0)) + 1
    wide = max(x.max(initial=0), px.max(initial=0)) - min(x.min(initial=0), px.min(initial=0)) + 1
    key, to = ((group * wide + a - x.min(initial=0)) * high + b - y.min(initial=0) for a, b in ((x, y), (px, py)))
    order = np.argsort(key, kind="stable")
    at = np.minimum(np.searchsorted(key[order], to), len(key) - 1)
    up = np.where(known & (key[order][at] == to), order[at], -1)
    here, found, steps = np.flatnonzero(rows.column("ends").to_numpy(zero_copy_only=False)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(here):
        steps.append(np.full(len(here), len(found) - 1))
        found.append(here)
        here = up[here][up[here] >= 0]
    return rows.drop_columns(["px", "py", "ends"]).take(pa.array(np.concatenate(found))).append_column("steps", pa.array(np.concatenate(steps)))


def main_pixel_path(pixels: DataFrame, entries: DataFrame, exits: DataFrame, by: list[str], factor: Column | None = None, tile: int = 128, most: int = 1 << 20) -> DataFrame:
    """by, seq (from 0), x, y and distance of the cheapest path over 8-neighbours from each entry (by, x, y) to its exit, with its running length.

    Groups of at most `most` reached pixels follow their pointers inside a task; the others' pointers skip twice as far each round, so a path of n pixels
    takes log n rounds. No row where no path joins the two.
    """
    reached = wave(pixels, entries.withColumn("label", F.lit(0)), by, factor=factor, tile=tile)
    place = [*by, "x", "y"]
    pointed = cut(back_pointers(reached, by, tile=tile).select(*place, "px", "py"))
    small, skip = parted(pointed, most, tuple(by))
    ends = exits.select(*by, *(F.col(c).cast("long").alias(c) for c in ("x", "y"))).distinct()
    kinds = ", ".join(f"`{c}` {pointed.schema[c].dataType.simpleString()}" for c in place)
    asked = small.join(ends.withColumn("ends", F.lit(True)), place, "left").withColumn("ends", F.coalesce("ends", F.lit(False)))
    path = whole_groups(asked, by, _ways_back, kinds + ", steps long")
    if skip is not None:
        path = path.unionByName(_ways_over_tables(skip, ends, by))
    along = Window.partitionBy(*by).orderBy("seq")
    seq = F.max("steps").over(Window.partitionBy(*by)) - F.col("steps")
    rows = path.withColumn("seq", seq)
    leg = F.coalesce(C.distance(F.lag("x").over(along), F.lag("y").over(along), F.col("x"), F.col("y")), F.lit(0.0))
    return rows.withColumn("leg", leg).select(*by, "seq", "x", "y", F.sum("leg").over(along).alias("distance"))


def _ways_over_tables(skip: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """_ways_back by joins: by, x, y and steps."""
    place = [*by, "x", "y"]
    path = cut(ends.select(*place).join(skip.select(*place), place, "left_semi").withColumn("steps", F.lit(0).cast("long")))
    far, step = skip.where("px is not null"), 1
    while True:
        more = cut(path.join(far, place).select(*by, F.col("px").alias("x"), F.col("py").alias("y"), (F.col("steps") + step).alias("steps")))
        if more.isEmpty():
            return path
        path = cut(path.unionByName(more))
        onward = far.select(*by, F.col("x").alias("px"), F.col("y").alias("py"), F.col("px").alias("qx"), F.col("py").alias("qy"))
        far = cut(far.join(onward, [*by, "px", "py"]).select(*place, F.col("qx").alias("px"), F.col("qy").alias("py")))
        step *= 2


def skeleton_attachment(pixels: DataFrame, path: DataFrame, by: list[str], tile: int = 128) -> DataFrame:
    """by, x, y, outer and way: each pixel's distance to the path inside the pixels, and the path's distance at the nearest path pixel (the first of equals)."""
    near = wave(pixels, path.select(*by, "x", "y", F.col("seq").alias("label")), by, tile=tile)
    return near.select(*by, "x", "y", F.col("d").alias("outer"), F.col("label").alias("seq")).join(path.select(*by, "seq", F.col("distance").alias("way")), [*by, "seq"])


def organ_parts(organs: DataFrame, hidden: DataFrame) -> DataFrame:
    """Components of organs (box, cc_id, organ_id, ord, idx) with their part: hidden links (box, cc_id: from its predecessor) cut an organ; inner parts of one component of a primary are left out."""
    along = Window.partitionBy("box", "organ_id").orderBy("idx")
    rows = organs.join(hidden.select("box", "cc_id", F.lit(1).alias("cut")).distinct(), ["box", "cc_id"], "left")
    parted = rows.withColumn("part", F.sum(F.when(F.col("idx") > 0, F.coalesce("cut", F.lit(0))).otherwise(0)).over(along)).drop("cut")
    sized = parted.withColumn("n", F.count("*").over(Window.partitionBy("box", "organ_id", "part"))).withColumn("last_part", F.max("part").over(Window.partitionBy("box", "organ_id")))
    inner = (F.col("ord") == 1) & (F.col("n") == 1) & (F.col("part") > 0) & (F.col("part") < F.col("last_part"))
    return sized.where(~inner).drop("n", "last_part")


def hidden_chains(organs: DataFrame, hidden: DataFrame) -> DataFrame:
    """Runs of components that hidden links join: box, organ_id, first and last index and their number."""
    rows = organs.join(hidden.select("box", "cc_id").distinct(), ["box", "cc_id"], "left_semi").where("idx > 0")
    island = F.col("idx") - F.row_number().over(Window.partitionBy("box", "organ_id").orderBy("idx"))
    return rows.withColumn("island", island).groupBy("box", "organ_id", "island").agg((F.min("idx") - 1).alias("first"), F.max("idx").alias("last"), (F.count("*") + 1).alias("n")).drop("island")


def part_ends(parts: DataFrame, labelled: DataFrame, entries: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entry and exit pixels of each part (box, organ_id, part, x, y).

    A part begins at its first component's entry. It ends at the pixel of its last component that is nearest to the connection (fx, fy of
    links: box, cc_id) of the next part's first one; an organ's last part ends at its last component's pixel that is farthest from the entry inside it.
    """
    own, by = ["box", "organ_id", "part"], Window.partitionBy("box", "organ_id").orderBy("part")
    ends = parts.groupBy(*own).agg(F.min_by("cc_id", "idx").alias("first"), F.max_by("cc_id", "idx").alias("cc_id")).withColumn("next", F.lead("first").over(by))
    starts = ends.join(entries.select("box", F.col("cc_id").alias("first"), "x", "y"), ["box", "first"]).select(*own, "x", "y")
    inner = ends.where("next is not null").join(links.select("box", F.col("cc_id").alias("next"), "fx", "fy"), ["box", "next"]).join(labelled.select("box", "cc_id", "x", "y"), ["box", "cc_id"])
    d2 = F.round((F.col("x") - F.col("fx")) * (F.col("x") - F.col("fx")) + (F.col("y") - F.col("fy")) * (F.col("y") - F.col("fy")), 6)
    nearest = inner.groupBy(*own).agg(F.min(F.struct(d2.alias("d2"), "y", "x")).alias("m")).select(*own, "m.x", "m.y")
    lasts = ends.where("next is null").select(*own, "cc_id")
    mask = labelled.select("box", "cc_id", "x", "y").join(lasts.select("box", "cc_id"), ["box", "cc_id"], "left_semi")
    reached = wave(mask, entries.select("box", "cc_id", "x", "y", F.lit(0).alias("label")), ["box", "cc_id"])
    far = reached.groupBy("box", "cc_id").agg(F.max(F.struct(F.round("d", 9).alias("d"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("m"))
    tips = lasts.join(far, ["box", "cc_id"]).select(*own, (-F.col("m.x")).alias("x"), (-F.col("m.y")).alias("y"))
    return starts, nearest.unionByName(tips)


def organ_ways(paths: DataFrame) -> DataFrame:
    """Path pixels of parts (box, organ_id, part, seq, x, y, distance) with way: the distance from the organ's start, gaps between parts counted straight."""
    own, by = ["box", "organ_id"], Window.partitionBy("box", "organ_id").orderBy("part")
    ends = paths.groupBy(*own, "part").agg(F.max("distance").alias("length"), F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    gap = F.coalesce(C.distance(F.lag("b.x").over(by), F.lag("b.y").over(by), F.col("a.x"), F.col("a.y")) + F.lag("length").over(by), F.lit(0.0))
    offset = ends.withColumn("gap", gap).select(*own, "part", F.sum("gap").over(by).alias("offset"))
    return paths.join(offset, [*own, "part"]).withColumn("way", F.col("distance") + F.col("offset")).drop("offset")


def organ_knots(ways: DataFrame, parts: DataFrame, labelled: DataFrame) -> DataFrame:
    """Dates along organs: box, organ_id, part, seq, way and date.

    An organ starts at the date before its first component's; the last path pixel in a component has its date, but for a part's last component; the end has the last one's.
    """
    own = ["box", "organ_id"]
    on = ways.join(labelled.select("box", "x", "y", "cc_id", "day"), ["box", "x", "y"]).join(parts.select("box", "organ_id", "part", "cc_id", "idx"), [*own, "part", "cc_id"])
    by_part = parts.groupBy(*own, "part").agg(F.max("idx").alias("part_end"))
    lasts = on.groupBy(*own, "part", "idx", "day").agg(F.max(F.struct("way", "seq")).alias("m")).join(by_part, [*own, "part"])
    inner = lasts.where("idx < part_end").select(*own, "part", "m.seq", "m.way", F.col("day").cast("double").alias("date"))
    first = on.groupBy(*own).agg(F.min(F.struct("part", "seq", "way")).alias("a"), F.max(F.struct("part", "seq", "way")).alias("b"))
    dates = parts.join(labelled.select("box", "cc_id", "day").distinct(), ["box", "cc_id"]).groupBy(*own).agg(F.min_by("day", "idx").alias("d0"), F.max_by("day", "idx").alias("d1"))
    ends = first.join(dates, own)
    start = ends.select(*own, "a.part", "a.seq", "a.way", (F.col("d0") - 1).cast("double").alias("date"))
    end = ends.select(*own, "b.part", "b.seq", "b.way", F.col("d1").cast("double").alias("date"))
    return start.unionByName(inner).unionByName(end)


def dated(rows: DataFrame, knots: DataFrame, hours: DataFrame) -> DataFrame:
    """Rows (box, organ_id, way, perhaps outer) with date and hours at their way, and with outer date_out and hours_out at way + outer, between the organ's knots. hours: (date, hours)."""
    own = ["box", "organ_id"]
    timed = knots.join(hours.select(F.col("date").cast("double").alias("date"), "hours"), "date").groupBy(*own, "way").agg(F.max("date").alias("date"), F.max("hours").alias("hours"))
    found = rows
    for suffix, at in (("", F.col("way")), ("_out", F.col("way") + F.col("outer") if "outer" in rows.columns else None)):
        for c in ("date", "hours"):
            if at is not None:
                rows = found.select(*own, at.alias("v"), F.struct(*found.columns).alias("row"))
                found = linear_interpolation(rows, timed.select(*own, F.col("way").alias("x"), F.col(c).cast("double").alias("y")), own).select("row.*", F.col("y").alias(f"{c}{suffix}"))
    return found


def organ_parent_join(organs: DataFrame, forest: DataFrame) -> DataFrame:
    """Organs with the one that holds the component from which they start (null for primaries): box, organ_id, ord and parent."""
    starts = organs.where("cc_id = organ_id").select("box", "cc_id", "organ_id", "ord").join(forest.select("box", "cc_id", F.col("parent").alias("from")), ["box", "cc_id"])
    holders = organs.select("box", F.col("cc_id").alias("from"), F.col("organ_id").alias("parent"))
    return starts.join(holders, ["box", "from"], "left").select("box", "organ_id", "ord", "parent")
