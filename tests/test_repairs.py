"""Gains of repairs and their rounds against rewiring by plain code, one proposal at a time."""

from collections import defaultdict

import pytest

from sylvaframe.operators import anomalies as A
from sylvaframe.operators import graph as G
from sylvaframe.plans import anomaly_queries as N
from sylvaframe.plans import region_queries as Q

SF = "/root/testdata/sf0.001"


def followed(forest, edges, src, dst, other):
    """Forest rows (by node) with dst under other; the connection is that of the edge between src and other."""
    at = next((e for e in edges if {e["src"], e["dst"]} == {src, other}), None)
    changed = {k: dict(v) for k, v in forest.items()}
    changed[dst] |= {"parent": other, "fx": at["fx"], "fy": at["fy"]}
    return changed


def closes_circle(forest, dst, other):
    while other is not None:
        if other == dst:
            return True
        other = forest[other]["parent"]
    return False


@pytest.fixture(scope="module")
def parts(spark):
    forest, edges, times = Q.forest(spark, SF).cache(), Q.costed(spark, SF).cache(), N.times(spark, SF).cache()
    rows, links = defaultdict(dict), defaultdict(list)
    for r in forest.collect():
        rows[r["box"]][r["cc_id"]] = r.asDict()
    for r in edges.collect():
        links[r["box"]].append(r.asDict())
    return forest, edges, times, rows, links


def level(spark, parts, rows, box):
    """Flags of one box whose forest is given by plain rows."""
    forest, edges, times, _, _ = parts
    frame = spark.createDataFrame([tuple(r[c] for c in forest.columns) for r in rows.values()], forest.schema)
    mine = edges.where(f"box = '{box}'")
    return A.flag_forest(frame, times.where(f"box = '{box}'"), A._links(frame, mine), mine, N.TYPICAL)[1].count()


def test_gain_is_the_fall_of_flags_of_the_rewired_box(spark, parts):
    forest, edges, times, rows, links = parts
    proposals = N.proposals(spark, SF)
    asked = sorted(tuple(r) for r in proposals.select("box", "src", "dst", "other").collect())
    got = {(r["box"], r["src"], r["dst"], r["other"]): r["gain"] for r in A.what_if_gain(forest, times, edges, proposals, N.TYPICAL).collect()}
    assert set(got) == {p for p in asked if not closes_circle(rows[p[0]], p[2], p[3])} and got
    # The least and the largest gain, each flagged again on its own.
    by_gain = sorted(got, key=lambda p: (got[p], p))
    for p in sorted({by_gain[0], by_gain[-1]}):
        box, src, dst, other = p
        assert got[p] == level(spark, parts, rows[box], box) - level(spark, parts, followed(rows[box], links[box], src, dst, other), box), p


def test_rounds_follow_the_largest_gain(spark, parts):
    forest, edges, times, rows, links = parts
    after, done = A.greedy_repair(forest, times, edges, N.TYPICAL, most_rounds=2)
    steps = defaultdict(dict)
    for r in done.collect():
        steps[r["round"]][r["box"]] = (r["src"], r["dst"], r["other"], r["gain"])
    # The first round's choice by plain ranking of all gains.
    gains = A.what_if_gain(forest, times, edges, N.proposals(spark, SF), N.TYPICAL).where("gain > 0").collect()
    px = {(r["box"], r["cc_id"]): r["px"] for r in G.subtree_totals(forest).collect()}
    best = {}
    for r in sorted(gains, key=lambda r: (-r["gain"], -px[r["box"], r["dst"]], r["dst"], r["other"])):
        best.setdefault(r["box"], (r["src"], r["dst"], r["other"], r["gain"]))
    assert steps[1] == best
    plain = {box: dict(v) for box, v in rows.items()}
    for k in sorted(steps):
        assert k == 1 or set(steps[k]) <= set(steps[k - 1])
        for box, (src, dst, other, gain) in steps[k].items():
            assert gain > 0 and not closes_circle(plain[box], dst, other)
            plain[box] = followed(plain[box], links[box], src, dst, other)
    want = sorted((box, n, -1 if r["parent"] is None else r["parent"], r["fx"], r["fy"]) for box, v in plain.items() for n, r in v.items())
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(key(r) for r in after.select("box", "cc_id", "parent", "fx", "fy").collect()) == sorted(key(r) for r in want)
    for box in steps[max(steps)] if steps else ():
        total = sum(s[box][3] for s in steps.values() if box in s)
        assert level(spark, parts, rows[box], box) - level(spark, parts, plain[box], box) == total
