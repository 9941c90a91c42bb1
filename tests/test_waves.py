"""Waves, paths and what follows from them, against plain searches."""

import heapq
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import backtrack, pixels, waves
from sylvaframe.plans import organ_queries as Q
from sylvaframe.plans import registry
from test_iterations import simplified

SF = "/root/testdata/sf0.001"


def blob(rng, size, share):
    """A random mask of one piece: what the first pixel reaches over 8-neighbours."""
    inside = {(x, y) for x in range(size) for y in range(size) if rng.random() < share} | {(0, 0)}
    found, todo = {(0, 0)}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        for p in ((x + dx, y + dy) for dx, dy in waves.AROUND):
            if p in inside and p not in found:
                found.add(p)
                todo.append(p)
    return found


def searched(mask, seeds, factor=lambda p: 1.0, straight=1.0, diagonal=2**0.5):
    best = {p: (0.0, label) for p, label in seeds.items() if p in mask}
    heap = [(d, label, p) for p, (d, label) in best.items()]
    heapq.heapify(heap)
    while heap:
        d, label, p = heapq.heappop(heap)
        if (d, label) != best[p]:
            continue
        for dx, dy in waves.AROUND:
            q = (p[0] + dx, p[1] + dy)
            if q in mask:
                new = (d + (diagonal if dx and dy else straight) * (factor(p) + factor(q)) / 2, label)
                if new < best.get(q, (math.inf, 0)):
                    best[q] = new
                    heapq.heappush(heap, (*new, q))
    return best


@pytest.fixture(scope="module")
def masks(spark):
    rng = random.Random(4)
    found = {k: blob(rng, 26, 0.62) for k in range(4)}
    rows = [(k, x, y, 1 + (x * 7 + y * 3) % 5) for k, m in found.items() for x, y in m]
    return found, spark.createDataFrame(rows, "box long, x int, y int, cost int").cache()


def far(mask):
    return max(mask, key=lambda p: (p[0] + p[1], p))


def test_wave_over_tiles(spark, masks):
    found, table = masks
    seeds = {k: {(0, 0): 5, far(m): 3, (50, 50): 1} for k, m in found.items()}
    rows = spark.createDataFrame([(k, *p, label) for k, s in seeds.items() for p, label in s.items()], "box long, x int, y int, label int")
    for tile in (7, 100):
        got = {(r["box"], r["x"], r["y"]): (r["d"], r["label"]) for r in waves.wave(table, rows, ["box"], factor=F.col("cost"), tile=tile).collect()}
        want = {(k, *p): v for k, m in found.items() for p, v in searched(m, seeds[k], lambda p: 1 + (p[0] * 7 + p[1] * 3) % 5).items()}
        assert got.keys() == want.keys() and all(got[p][0] == pytest.approx(want[p][0]) and got[p][1] == want[p][1] for p in want)
    assert waves.wave(table, rows.limit(0), ["box"]).count() == 0 and waves.wave(table.limit(0), rows, ["box"]).count() == 0


def test_geodesic_distance(spark, masks):
    found, table = masks
    seeds = spark.createDataFrame([(0, 0, 0), (2, 0, 0)], "box long, x int, y int")
    got = {(r["box"], r["x"], r["y"]): r["d"] for r in pixels.geodesic_distance(table, seeds).collect()}
    assert got == {(k, *p): d for k in (0, 2) for p, (d, _) in searched(found[k], {(0, 0): 0}, straight=1000.0, diagonal=1414.0).items()}


def test_main_pixel_path_and_attachment(spark, masks):
    found, table = masks
    entries = spark.createDataFrame([(k, 0, 0) for k in found], "box long, x int, y int")
    exits = spark.createDataFrame([(k, *far(m)) for k, m in found.items()], "box long, x int, y int")
    factor = lambda p: 1 + (p[0] * 7 + p[1] * 3) % 5
    path = waves.main_pixel_path(table, entries, exits, ["box"], F.col("cost"), tile=9).cache()
    lines = defaultdict(list)
    for r in sorted(path.collect(), key=lambda r: (r["box"], r["seq"])):
        lines[r["box"]].append(((r["x"], r["y"]), r["distance"]))
        assert r["seq"] == len(lines[r["box"]]) - 1
    for k, mask in found.items():
        points = [p for p, _ in lines[k]]
        steps = [(1.0 if a[0] == b[0] or a[1] == b[1] else 2**0.5, a, b) for a, b in zip(points, points[1:])]
        assert points[0] == (0, 0) and points[-1] == far(mask) and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for _, a, b in steps)
        assert sum(w * (factor(a) + factor(b)) / 2 for w, a, b in steps) == pytest.approx(searched(mask, {(0, 0): 0}, factor)[far(mask)][0])
        assert [d for _, d in lines[k]] == pytest.approx([sum(w for w, _, _ in steps[:i]) for i in range(len(points))])
    near = {(r["box"], r["x"], r["y"]): (r["outer"], r["way"]) for r in waves.skeleton_attachment(table, path, ["box"], tile=9).collect()}
    for k, mask in found.items():
        want = searched(mask, {p: i for i, (p, _) in enumerate(lines[k])})
        assert len(want) == len(mask)
        for p, (d, i) in want.items():
            assert near[k, *p] == pytest.approx((d, lines[k][i][1]))


def test_organs_become_polylines(spark):
    """Paths run from entry to exit, knots rise along an organ, and dates stay between them."""
    q = registry.queries()
    ends = {(r["box"], r["organ_id"], r["part"], r["kind"]): (r["x"], r["y"]) for r in q["part_ends"](spark, SF).collect()}
    paths = defaultdict(list)
    for r in q["main_pixel_path"](spark, SF).collect():
        paths[r["box"], r["organ_id"], r["part"]].append((r["seq"], (r["x"], r["y"])))
    assert len(paths) == len(ends) / 2
    for key, points in paths.items():
        line = [p for _, p in sorted(points)]
        assert line[0] == ends[*key, "entry"] and line[-1] == ends[*key, "exit"]
    knots = defaultdict(list)
    for r in q["organ_knots"](spark, SF).collect():
        knots[r["box"], r["organ_id"]].append((r["part"], r["seq"], r["way"], r["date"]))
    days = {}
    for r in Q.parts(spark, SF).join(Q.Q.labelled(spark, SF), ["box", "cc_id"]).collect():
        days.setdefault((r["box"], r["organ_id"]), {})[r["idx"]] = r["day"]
    for key, rows in knots.items():
        rows.sort()
        assert [w for *_, w, _ in rows] == sorted(w for *_, w, _ in rows)
        own = days[key]
        assert min(d for *_, d in rows) >= min(own.values()) - 1 and {d for *_, d in rows} >= {own[min(own)] - 1.0, float(own[max(own)])}
    dated = q["pixel_dates"](spark, SF).collect()
    assert len(dated) == Q.pixels(spark, SF).count()
    for r in dated:
        dates = [d for *_, d in knots[r["box"], r["organ_id"]]]
        assert min(dates) <= r["date"] <= max(dates) and abs(r["hours"] - 8 * r["date"]) < 1e-2
    lines = q["organ_polyline"](spark, SF).collect()
    assert {(r["box"], r["organ_id"]) for r in lines} == set(knots) and any(r["hidden"] for r in lines)
    assert sum(r["hidden"] for r in lines) == sum(len({p for p, *_ in rows}) for rows in [[(k[2],) for k in paths if k[:2] == o] for o in knots]) - len(knots)


def plain_way(image, px, py, reach):
    """The cheapest way from (px, 0) to (px, py) in the strip: by distances, then back by the least (cost, y, x)."""
    mask = {p for p in image if abs(p[0] - px) <= reach and 0 <= p[1] <= py}
    cost = lambda p: image[p] + 1
    if (px, py) not in mask:
        return []
    d = searched(mask, {(px, 0): 0}, cost)
    if (px, py) not in d:
        return []
    way = [(px, py)]
    while d[way[-1]][0] > 0:
        x, y = way[-1]
        offers = []
        for dx, dy in waves.AROUND:
            q = (x + dx, y + dy)
            if q in d and d[q][0] < d[x, y][0]:
                offers.append((round(d[q][0] + (2**0.5 if dx and dy else 1.0) * (cost((x, y)) + cost(q)) / 2, 9), q[1], q[0]))
        way.append(min(offers)[:0:-1])
    return way[::-1]


def test_backtracked_primaries_equal_plain_ways(spark):
    rng = random.Random(11)
    image = {(x, y): rng.randrange(9) for x in range(40) for y in range(40) if (x, y) != (7, 0)}
    area = {(x, y) for x, y in image if y >= 4 + x % 3}
    # Ordinary ones, two with one strip, one whose top pixel is missing, one outside the image, one too near, one at the image's edge, one without a place.
    firsts = {1: (12, 33), 2: (12, 33), 3: (20, 25), 4: (7, 30), 5: (90, 30), 6: (25, 5), 7: (39, 38), 8: (None, None), 9: (30, 0), 10: (math.inf, 20)}
    rows = [("a", r, k, None if x is None else float(x + k), None if y is None else float(y + 2 * k), 1.0 + k) for r, (x, y) in firsts.items() for k in range(3)]
    nodes = spark.createDataFrame(rows, "box string, root long, seq int, x double, y double, t double")
    frame = spark.createDataFrame([("a", x, y, v) for (x, y), v in image.items()], "box string, x int, y int, v int")
    got = defaultdict(list)
    for r in backtrack.backtrack_primaries(nodes, frame, frame.where("y >= 4 + x % 3"), reach=3, tolerance=1.0, skip=2).collect():
        got[r["root"]].append((r["seq"], r["x"], r["y"], r["t"], r["added"]))
    for root, (x, y) in firsts.items():
        way = plain_way(image, x, y, 3) if x is not None and x < math.inf else []
        outside = [i for i, p in enumerate(way[:-1]) if p not in area]
        start = (outside[-1] if outside else 0) + 2
        new = []
        if start < len(way) - 2:
            part = way[start:-1]
            line = [part[i] for i in sorted(simplified(part, 1.0, lambda i: False))]
            new = [(float(a), float(b), 0.01 if i else 0.0, True) for i, (a, b) in enumerate(line) if i == 0 or i < len(line) - 2]
        old = [(a, b, t, False) for _, r, _, a, b, t in rows if r == root]
        assert sorted(got[root]) == [(i + 1, *row) for i, row in enumerate(new + old)], root
    assert sum(row[4] for row in got[1]) > 2 and not any(row[4] for k in (4, 5, 6, 8, 9, 10) for row in got[k])
    empty = backtrack.backtrack_primaries(nodes.limit(0), frame, frame, reach=3, tolerance=1.0)
    assert empty.collect() == []
