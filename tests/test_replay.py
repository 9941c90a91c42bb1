"""Edits and their replay against a plain replay on lists."""

from collections import Counter, defaultdict

import plain_replay as plain
import pytest

from sylvaframe.operators import replay
from sylvaframe.operators.models import edit_log
from sylvaframe.plans import registry, replay_queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def start(spark):
    """Models, parents and the log's edits."""
    models, parents, edits = defaultdict(lambda: defaultdict(list)), defaultdict(dict), defaultdict(lambda: defaultdict(list))
    for r in Q.nodes(spark, SF).orderBy("model", "root", "seq").collect():
        models[r["model"]][r["root"]].append({k: r[k] for k in ("x", "y", "t", "th")})
    for r in Q.roots(spark, SF).collect():
        parents[r["model"]][r["root"]] = r["parent"]
    for r in edit_log(Q.log_lines(spark, SF)).orderBy("model", "seq", "point").collect():
        edits[r["model"]][r["seq"], r["action"]].append((r["x"], r["y"], r["z"]))
    return models, parents, edits


def copied(start):
    models, parents, edits = start
    return {m: {r: [dict(n) for n in ns] for r, ns in roots.items()} for m, roots in models.items()}, {m: dict(p) for m, p in parents.items()}, edits


def rows_of(models):
    return sorted((m, r, i + 1, *(round(n[k], 2) for k in ("x", "y", "t", "th"))) for m, roots in models.items() for r, ns in roots.items() for i, n in enumerate(ns))


def got(frame):
    return sorted((r["model"], r["root"], r["seq"], *(round(r[k], 2) for k in ("x", "y", "t", "th"))) for r in frame.collect())


def close(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and all(abs(p - q) <= 0.011 for p, q in zip(x[3:], y[3:])) for x, y in zip(a, b))


def test_replay_of_all_actions(spark, start):
    models, parents, edits = copied(start)
    did = Counter()
    for m, own in edits.items():
        for (_, action), points in sorted(own.items()):
            before = repr((models[m], parents[m]))
            plain.apply(models[m], parents[m], action, points)
            did[action] += before != repr((models[m], parents[m]))
    assert set(k for k, n in did.items() if n) == set(Q.ACTIONS) - {""} and did["OTHER"] == 0
    assert close(got(registry.queries()["edit_replay"](spark, SF)), rows_of(models))


def test_switch(spark, start):
    models, parents, _ = copied(start)
    changed = 0
    for r in Q.clicks(spark, SF).collect():
        before = repr(models[r["model"]])
        plain.apply(models[r["model"]], parents[r["model"]], "SWITCHPOINT", [(r["x"], r["y"], r["t"]), (r["x"] + 9, r["y"] + 1, r["t"] + 0.5)])
        changed += before != repr(models[r["model"]])
    assert changed and close(got(registry.queries()["edit_switch"](spark, SF)), rows_of(models))


def test_empty_log_and_empty_model(spark):
    nodes = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 1.0, 24.0, 1.0)], "model long, root long, seq int, x double, y double, diameter double, th double, t double")
    roots = spark.createDataFrame([(1, 1, None)], "model long, root long, parent long")
    log = spark.createDataFrame([], "model long, seq long, action string, point int, x double, y double, z double")
    assert [tuple(r)[:3] for r in replay.edit_replay(nodes, roots, log, 24.0)[0].collect()] == [(1, 1, 1)]
    log = spark.createDataFrame([(2, 1, "CREATEPRIMARY", 0, 1.0, 1.0, 1.0), (2, 1, "CREATEPRIMARY", 1, 1.0, 2.0, 1.0), (1, 1, "REMOVEPOINT", 0, 0.0, 0.0, 1.0)], log.schema)
    left = replay.edit_replay(nodes, roots, log, 24.0)[0].collect()
    assert all(r["model"] == 2 for r in left)
