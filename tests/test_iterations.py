"""Iterative operators on small inputs against plain versions."""

import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import graph, links, nearest, pixels, regions, reports, timebase


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(2)
    rows = []
    for root in range(4):
        x, y = 40 * root, 0
        for seq in range(1, 60):
            x, y = x + rng.randrange(-4, 5), y + rng.randrange(0, 4)
            rows.append((1, root, seq, x, y, 1, seq * 4.0, seq / 6))
    return spark.createDataFrame(rows, "model long, root long, seq int, x long, y long, diameter int, th double, t double").cache()


def simplified(points, tolerance, pinned):
    """Douglas-Peucker: places that stay."""
    kept = sorted({0, len(points) - 1} | {i for i in range(len(points)) if pinned(i)})
    todo = list(zip(kept, kept[1:]))
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        n = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        off = lambda p: abs((bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)) / n if n else ((p[0] - ax) ** 2 + (p[1] - ay) ** 2) ** 0.5  # noqa: B023, E731
        far = max(range(a + 1, b), key=lambda i: (round(off(points[i]), 9), -i), default=None)  # noqa: B023
        if far is not None and round(off(points[far]), 9) > tolerance:
            kept.append(far)
            todo += [(a, far), (far, b)]
    return sorted(kept)


def test_polyline_simplify(nodes):
    rows = defaultdict(dict)
    for r in nodes.collect():
        rows[r["root"]][r["seq"]] = (r["x"], r["y"])
    got = defaultdict(list)
    for r in pixels.polyline_simplify(nodes.select("model", "root", "seq", "x", "y"), ["model", "root"], 1.5, F.col("seq") == 31).collect():
        got[r["root"]].append(r["seq"])
    for root, points in rows.items():
        line = [points[k] for k in sorted(points)]
        assert sorted(got[root]) == [i + 1 for i in simplified(line, 1.5, lambda i: i == 30)]


def hull_side(points, sign):
    chain = []
    for p in sorted(points):
        while len(chain) > 1 and sign * ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) <= 0:
            chain.pop()
        chain.append(p)
    return chain


def test_convex_hull(spark, nodes):
    roots = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 0), (1, 3, 2)], "model long, root long, parent long")
    own = {0: (0, 1, 2), 1: (1,), 2: (2, 3), 3: (3,)}
    inner = [r for r in nodes.collect() if r["seq"] < 59]
    got = defaultdict(set)
    for r in reports.convex_hull(nodes, roots).collect():
        got[r["root"], r["upper"]].add((r["x"], r["y"]))
    for root, members in own.items():
        columns = defaultdict(list)
        for r in inner:
            if r["root"] in members:
                columns[r["x"]].append(r["y"])
        assert got[root, True] == set(hull_side([(x, min(ys)) for x, ys in columns.items()], 1))
        assert got[root, False] == set(hull_side([(x, max(ys)) for x, ys in columns.items()], -1))


def test_geodesic_distance_and_farthest_pixel(spark):
    rng = random.Random(5)
    mask = sorted({(x, y) for x in range(12) for y in range(12) if rng.random() < 0.7} | {(0, 0)})
    best, heap = {(0, 0): 0}, [(0, 0, 0)]
    while heap:
        d, x, y = heapq.heappop(heap)
        for dx, dy in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
            to = (x + dx, y + dy)
            if to in set(mask) and d + (1414 if dx and dy else 1000) < best.get(to, 1 << 30):
                best[to] = d + (1414 if dx and dy else 1000)
                heapq.heappush(heap, (best[to], *to))
    frame = spark.createDataFrame([("b", 1, x, y) for x, y in mask], "box string, cc_id long, x int, y int")
    seed = frame.where("x = 0 and y = 0")
    got = {(r["x"], r["y"]): r["d"] for r in pixels.geodesic_distance(frame, seed).collect()}
    assert got == best
    assert {(r["x"], r["y"]): r["d"] for r in pixels.geodesic_distance(frame, seed, inverted=True).collect()} == {p: max(best.values()) - d for p, d in best.items()}
    far = pixels.farthest_pixel(frame, seed).collect()[0]
    assert best[far["x"], far["y"]] == max(best.values()) == far["d"]
    assert pixels.geodesic_distance(frame, seed.limit(0)).count() == 0


def test_minimum_spanning_tree(spark):
    rng = random.Random(8)
    edges = [("b", a, b, rng.randrange(1, 6) * 1.0) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.2]
    group = list(range(25))
    want = set()
    for _, a, b, cost in sorted(edges, key=lambda e: (e[3], e[1], e[2])):
        if group[a] != group[b]:
            want.add((a, b))
            group = [group[a] if g == group[b] else g for g in group]
    got = links.minimum_spanning_tree(spark.createDataFrame(edges, "box string, src long, dst long, cost double")).collect()
    assert {(r["src"], r["dst"]) for r in got} == want and len(got) == len(want)


def test_hidden_edges_search_until_nothing_is_new(spark):
    comps = spark.createDataFrame([("b", i, d) for i, d in enumerate((3, 1, 2, 3, 5, 4, 2))], "box string, cc_id long, day int")
    edges = spark.createDataFrame([("b", 1, 0), ("b", 1, 2), ("b", 2, 3), ("b", 3, 5), ("b", 0, 4), ("b", 6, 3), ("b", 6, 0)], "box string, src long, dst long")
    got = {(r["src"], r["dst"]): list(r["path"]) for r in regions.hidden_edge_candidates(comps, edges).collect()}
    assert got[0, 3] == [0, 6, 3] and got[0, 4] == [0, 4] and got[0, 5] == [0, 6, 3, 5] and (0, 2) not in got
    assert got[3, 0] == [3, 6, 0] and got[3, 4] == [3, 6, 0, 4] and not any(a in (4, 5) for a, _ in got)


def test_long_chains(spark):
    forest = spark.range(600).select(F.lit("b").alias("box"), F.col("id").alias("cc_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(2).alias("n_px"))
    deep = {r["cc_id"]: (r["depth"], r["root"]) for r in graph.along_paths(forest).collect()}
    assert all(deep[i] == (i, 0) for i in range(600))
    assert {r["cc_id"]: (r["n_nodes"], r["px"]) for r in graph.subtree_totals(forest).collect()} == {i: (600 - i, 2 * (600 - i)) for i in range(600)}


def test_nearest_under_a_condition(spark):
    rng = random.Random(1)
    points = [(g, i, rng.random() * 100, rng.random() * 100, rng.randrange(5)) for g in range(2) for i in range(30)] + [(0, 99, 5000.0, 5000.0, 1), (0, 100, None, 1.0, 1)]
    things = [(g, i, rng.random() * 100, rng.random() * 100, rng.randrange(5)) for g in range(2) for i in range(80)] + [(0, 90, 1.0, 1.0, 2)] * 2
    got = defaultdict(list)
    for r in nearest.nearest(spark.createDataFrame(points, "g long, pid long, px double, py double, a int"), spark.createDataFrame(things, "g long, tid long, tx double, ty double, b int"), ["g"], ["pid"], ["tid"], 3, F.col("a") != F.col("b")).collect():
        got[r["g"], r["pid"]].append((r["n"], r["tid"]))
    for g, i, x, y, a in points:
        best = sorted((round((x - tx) ** 2 + (y - ty) ** 2, 6), t) for h, t, tx, ty, b in things if h == g and a != b)[:3] if x is not None else []
        assert sorted(got[g, i]) == [(n + 1, t) for n, (_, t) in enumerate(best)]


def test_interpolation_ends_and_ties(spark):
    knots = spark.createDataFrame([(1, 10.0, 5.0), (1, 20.0, 7.0), (2, 3.0, 1.0)], "k long, x double, y double")
    values = spark.createDataFrame([(1, v) for v in (0.0, 10.0, 12.5, 20.0, 99.0)] + [(2, 1.0), (2, 9.0), (3, 1.0)], "k long, v double")
    got = {(r["k"], r["v"]): r["y"] for r in timebase.linear_interpolation(values, knots, ["k"]).collect()}
    assert got == {(1, 0.0): 5.0, (1, 10.0): 5.0, (1, 12.5): 5.5, (1, 20.0): 7.0, (1, 99.0): 7.0, (2, 1.0): 1.0, (2, 9.0): 1.0, (3, 1.0): None}


def test_spanning_tree_rounds_work_on_what_is_left(spark, monkeypatch):
    """Of a path whose costs rise and fall, each round joins at most half of the nodes of the one before."""
    nodes, label = [], links.component_labels
    monkeypatch.setattr(links, "component_labels", lambda rows, edges: nodes.append(rows.distinct().count()) or label(rows, edges))
    edges = [("b", k, k + 1, float((k * 7) % 16)) for k in range(32)]
    assert links.minimum_spanning_tree(spark.createDataFrame(edges, "box string, src long, dst long, cost double")).count() == 32
    assert len(nodes) > 1 and all(2 * b <= a for a, b in zip(nodes, nodes[1:]))
