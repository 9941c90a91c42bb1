"""Iterative operators of branches against plain versions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import branches


@pytest.fixture(scope="module")
def graph(spark):
    """Random components of two boxes, and links from earlier to later ones."""
    rng = random.Random(8)
    comps, links = [], []
    for box in ("a", "b"):
        own = [(box, i, 1 + i // 8, (1 + i // 8) * 8.0, rng.randrange(1, 9), rng.randrange(20), rng.randrange(20), rng.random() < 0.25) for i in range(48)]
        comps += own
        links += [(box, p[1], q[1]) for p in own for q in own if p[2] < q[2] <= p[2] + 2 and rng.random() < 0.06]
    table = spark.createDataFrame(comps, "box string, cc_id long, day int, hour double, n_px long, x long, y long, trunk boolean").cache()
    return comps, links, table, spark.createDataFrame(links, "box string, src long, dst long").cache()


def test_prune_lateral_branches(graph):
    comps, links, table, edges = graph
    trunk, size = {c[:2]: c[7] for c in comps}, {c[:2]: c[4] for c in comps}
    after = defaultdict(list)
    for box, s, t in links:
        after[box, s].append(t)
    memo = {}

    def count(box, i):
        if trunk[box, i]:
            return 0
        if (box, i) not in memo:
            memo[box, i] = size[box, i] + sum(count(box, t) for t in after[box, i])
        return memo[box, i]

    want = {(box, s, t): trunk[box, s] or t == min(after[box, s], key=lambda k: (-count(box, k), k)) for box, s, t in links}
    got = {(r["box"], r["src"], r["dst"]): r["active"] for r in branches.prune_lateral_branches(table, edges).collect()}
    assert got == want and not all(want.values())


def plain_steps(comps, links, box, stop, speed, typical, cap):
    """Least (distance, lateral) by component, relaxed until nothing falls."""
    own = {c[1]: c for c in comps if c[0] == box}
    best = {stop: (0.0, stop)}
    while True:
        new = dict(best)
        for b, s, t in links:
            if b != box:
                continue
            for p, q, w in ((s, t, 1.0), (t, s, 2.0)):
                if p not in new:
                    continue
                d, lat = new[p]
                a, c = own[p], own[q]
                hours = abs(c[3] - a[3]) or 0.7 * typical
                if c[7]:
                    offer = (d, lat if a[7] else p)
                elif a[7]:
                    offer = (d + math.hypot(c[5] - own[lat][5], c[6] - own[lat][6]) / (speed * hours / typical), q)
                else:
                    offer = (d + w, q)
                offer = (round(offer[0], 9), offer[1])
                if offer[0] <= cap and (q not in new or offer < new[q]):
                    new[q] = offer
        if new == best:
            return {k: d for k, (d, _) in best.items()}
        best = new


@pytest.mark.parametrize("cap", [3.0, 30.0])
def test_step_distance(spark, graph, cap):
    comps, links, table, edges = graph
    stops = [("a", 3), ("a", 17), ("b", 0), ("b", 30)]
    got = defaultdict(dict)
    for r in branches.step_distance(spark.createDataFrame(stops, "box string, stop long"), table, edges, 4.0, 8.0, cap).collect():
        got[r["box"], r["stop"]][r["cc_id"]] = r["d"]
    for box, stop in stops:
        want = plain_steps(comps, links, box, stop, 4.0, 8.0, cap)
        assert got[box, stop].keys() == want.keys() and all(got[box, stop][k] == pytest.approx(d) for k, d in want.items())


def test_small_boxes_take_no_round_over_tables(spark, graph, monkeypatch):
    """The rounds inside a task and those over tables give the same, and the tables are written a fixed number of times."""
    _, _, table, edges = graph
    stops = spark.createDataFrame([(b, i) for b in "ab" for i in range(0, 31, 3)], "box string, stop long")
    cuts, cut = [], branches.cut
    monkeypatch.setattr(branches, "cut", lambda df: cuts.append(0) or cut(df))
    found = []
    for limits in ({}, {"most_ways": 0}):
        before = len(cuts)
        found.append(sorted(tuple(r) for r in branches.step_distance(stops, table, edges, 4.0, 8.0, 30.0, **limits).collect()))
        found.append(len(cuts) - before)
    inside, few, over, many = found
    assert inside == over and inside and few < 9 < many
    odd = [0.0009765625, 1.2345678905, 29.1234567895, 2.0000000005, 7.25, 0.30000000049999]
    want = spark.createDataFrame([(v,) for v in odd], "v double").select(F.round("v", 9)).collect()
    assert branches._halves_up(np.array(odd)).tolist() == [w[0] for w in want]


def test_reconnect_broken_branches(spark):
    rng = random.Random(9)
    rows = [(box, i, j, rng.randrange(0, 40) / 10) for box in ("a", "b") for i in range(25) for j in range(25) if i != j and rng.random() < 0.3]
    rows += [("c", 1, 2, 0.1), ("c", 2, 3, 0.2), ("c", 3, 1, 0.15), ("c", 2, 4, 0.9), ("d", 1, 2, 0.5), ("d", 2, 1, 0.5)]
    frame = spark.createDataFrame(rows, "box string, of long, to long, score double")
    got = {(r["box"], r["of"], r["to"]) for r in branches.reconnect_broken_branches(frame, 3.5).collect()}
    want, after, before = set(), {}, {}
    for score, box, i, j in sorted((s, b, i, j) for b, i, j, s in rows if s < 3.5):
        end = j
        while (box, end) in after:
            end = after[box, end]
        if (box, i) in after or (box, j) in before or end == i:
            continue
        after[box, i], before[box, j] = j, i
        want.add((box, i, j))
    assert got == want and ("c", 2, 3) not in got and ("c", 2, 4) in got and len([w for w in want if w[0] == "d"]) == 1
    assert branches.reconnect_broken_branches(frame, -1.0).count() == 0
