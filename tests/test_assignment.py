"""Links over gaps by repeated assignment, against a plain version that tries every assignment and scores every pair anew in each round."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import assignment, branches


def test_most_gained_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(200):
        gains = {c: {r: rng.randrange(1, 30) for r in range(5) if rng.random() < 0.6} for c in range(5)}
        got = assignment.most_gained(gains)
        assert len(set(got.values())) == len(got)
        best = max(sum(gains[c].get(r, 0) for c, r in enumerate(p)) for p in itertools.permutations(range(5)))
        assert sum(gains[c][r] for c, r in got.items()) == best


BOXES = "abcdef"


@pytest.fixture(scope="module")
def chains(spark):
    """Short chains in six boxes, many of them of one or two components, and their scored pairs."""
    rng, rows, cc = random.Random(6), [], 0
    for box in BOXES:
        for _ in range(7):
            x, y, day, start = rng.uniform(0, 9), rng.uniform(0, 9), rng.randrange(1, 5), cc
            for depth in range(rng.choice((1, 1, 2, 2, 3, 4))):
                rows.append((box, start, depth, cc, x, y, day, day * 8.0))
                x, y, day, cc = x + rng.uniform(-1, 1), y + rng.uniform(0, 2), day + rng.randrange(2), cc + 1
    features = spark.createDataFrame(rows, "box string, start long, depth int, cc_id long, x double, y double, day int, hour double")
    ends = branches.chain_ends(features).cache()
    apart = F.greatest(F.abs(F.col("a.x") - F.col("b.x")), F.abs(F.col("a.y") - F.col("b.y")))
    return rows, ends, branches.hidden_link_score(ends, ends, 12.0, 0.5, 8.0, steps=apart, keep=True).cache()


def own_way(rows, box, start):
    return [r[4:] for r in sorted(r for r in rows if r[:2] == (box, start))]


def plain(rows, box, scored, most, renew=True):
    pairs = {(r["of"], r["to"]): r for r in scored if r["box"] == box}
    names = sorted({r[1] for r in rows if r[0] == box})
    after, before, links, ruled = {}, {}, [], set()

    def cost(of, to):
        r = pairs.get((of, to))
        if r is None or (of, to) in ruled:
            return 2.0
        behind, ahead = own_way(rows, box, of)[::-1], own_way(rows, box, to)
        if renew:
            c = of
            while c in before:
                c = before[c]
                behind += own_way(rows, box, c)[::-1]
            c = to
            while c in after:
                c = after[c]
                ahead += own_way(rows, box, c)
        return min(2.0, assignment.link_cost(behind[:3], ahead[:3], r["steps"], r["off"], 0.5, 8.0))

    while True:
        left, right = [n for n in names if n not in after], [n for n in names if n not in before]
        costs = {(i, j): cost(i, j) for i in left for j in right}
        best = min((sum(costs[i, j] for i, j in zip(p, right)), p) for p in itertools.permutations(left))[1] if left else ()
        open_ = sorted((costs[i, j], i, j) for i, j in zip(best, right) if costs[i, j] < most)
        if not open_:
            return links
        _, i, j = open_[0]
        links.append((i, j))
        after[i], before[j] = j, i
        tail, head = j, i
        while tail in after:
            tail = after[tail]
        while head in before:
            head = before[head]
        ruled.add((tail, head))


def test_reconnection_assigns_and_scores_again(spark, chains):
    rows, ends, scored = chains
    pairs = scored.collect()
    assert all(abs(assignment.link_cost(own_way(rows, r["box"], r["of"])[::-1][:3], own_way(rows, r["box"], r["to"])[:3], r["steps"], r["off"], 0.5, 8.0) - r["score"]) < 1e-9 for r in pairs)
    got = {}
    for r in branches.reconnect_broken_branches(scored, 1.6, ends=ends, max_speed=0.5, typical_hours=8.0).orderBy("box", "round").collect():
        got.setdefault(r["box"], []).append((r["of"], r["to"]))
    want = {box: plain(rows, box, pairs, 1.6) for box in BOXES}
    assert got == want and all(len(w) > 2 for w in want.values())
    assert any(want[box] != plain(rows, box, pairs, 1.6, renew=False) for box in BOXES)
    mutual = {(r["box"], r["of"], r["to"]) for r in branches.reconnect_broken_branches(scored, 1.6).collect()}
    assert mutual != {(box, *w) for box in BOXES for w in want[box]}
