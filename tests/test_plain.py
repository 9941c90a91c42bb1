"""Queries without SQL, and operators that only small inputs can hold, against plain versions."""

import math
from collections import defaultdict
from pathlib import Path

import plain_replay as plain
import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import edits, regions, traits
from sylvaframe.plans import fixtures as X
from sylvaframe.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    """Nodes by model and root, and the roots' parents."""
    nodes, parents = defaultdict(lambda: defaultdict(list)), defaultdict(dict)
    for r in X.nodes(spark, SF).orderBy("model", "root", "seq").collect():
        nodes[r["model"]][r["root"]].append({"x": float(r["x"]), "y": float(r["y"]), "t": r["t"], "th": r["th"]})
    for r in X.roots(spark, SF).collect():
        parents[r["model"]][r["root"]] = r["parent"]
    return nodes, parents


def copied(nodes):
    return {m: {r: [dict(n) for n in ns] for r, ns in roots.items()} for m, roots in nodes.items()}


def clicked(spark, own, parents):
    """The last click at each node: (model, root, place) with the point."""
    found = {}
    for r in sorted(X.points(spark, SF).collect(), key=lambda r: r["pid"]):
        if hit := plain.nearest(own[r["model"]], parents[r["model"]], (r["x"], r["y"], r["z"])):
            found[r["model"], *hit] = r
    return found


def same(frame, own, columns):
    got = {(r["model"], r["root"], r["seq"]): [r[c] for c in columns] for r in frame.collect()}
    want = {(m, k, i + 1): [n[c] for c in columns] for m, roots in own.items() for k, ns in roots.items() for i, n in enumerate(ns)}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=2e-3), k


def test_edit_move_point(spark, model):
    nodes, parents = model
    own = copied(nodes)
    for (m, r, i), p in clicked(spark, own, parents).items():
        own[m][r][i].update(x=p["x"] + 1, y=p["y"] - 1)
    for m, roots in own.items():
        for r, ns in roots.items():
            plain.retime(ns, parents[m][r] is None)
    same(registry.queries()["edit_move_point"](spark, SF), own, ("x", "y", "t", "th"))


def test_edit_change_time(spark, model):
    nodes, parents = model
    own = copied(nodes)
    for (m, r, i), p in clicked(spark, own, parents).items():
        own[m][r][i]["t"] = float(p["z"])
    for m, roots in own.items():
        for r, ns in roots.items():
            plain.fill_dates(ns)
            for n in ns:
                n["th"] = n["t"] * 24.0
            plain.retime(ns, parents[m][r] is None)
    same(registry.queries()["edit_change_time"](spark, SF), own, ("x", "y", "t"))


def test_resample_model(spark, model):
    own = copied(model[0])
    for roots in own.values():
        for r, ns in list(roots.items()):
            for n in ns:
                n["t"] = n["th"] / 36.0
            plain.fill_dates(ns)
            roots[r] = [n for n in ns if plain.whole(n["t"])]
    same(registry.queries()["resample_model"](spark, SF), own, ("x", "y", "t"))


def test_scan_image_files(spark):
    rows = registry.queries()["scan_image_files"](spark, SF).collect()
    assert rows and all(Path(str(v).removeprefix("file:")).exists() for r in rows for v in r if isinstance(v, str) and "/root/testdata" in v)


def test_outside_distance(spark):
    cells = defaultdict(dict)
    for r in X.cells(spark, SF).collect():
        cells[r["box"]][r["x"], r["y"]] = r["day"]
    for r in registry.queries()["outside_distance"](spark, SF).collect():
        assert cells[r["box"]][r["x"], r["y"]] == 0 and r["d"] >= 1
        # The nearest object lies no nearer than the way through pixels, which costs no less than the larger and no more than both steps.
        gaps = [sorted((abs(x - r["x"]), abs(y - r["y"]))) for (x, y), day in cells[r["box"]].items() if day > 0]
        assert r["d"] >= min(b - a + 1.414 * a for a, b in gaps) - 1e-3


def line_max(image, element, pick):
    return {(x, y): pick(image[p] for dx, dy in element if (p := (x + dx, y + dy)) in image) for x, y in image}


def largest(mask):
    """The largest 4-connected piece, the one that begins first in reading order of equals."""
    left, best = sorted(mask, key=lambda p: (p[1], p[0])), set()
    seen = set()
    for start in left:
        if start in seen:
            continue
        piece, todo = {start}, [start]
        while todo:
            x, y = todo.pop()
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in mask and p not in piece:
                    piece.add(p)
                    todo.append(p)
        seen |= piece
        best = piece if len(piece) > len(best) else best
    return best


def test_meniscus_mask(spark):
    image = {(x, y): 5.0 if y in (6, 7) and 3 < x < 18 else 60.0 + (x * 7 + y * 5) % 9 for x in range(20) for y in range(16)}
    table = spark.createDataFrame([("a", x, y, v) for (x, y), v in image.items()], "box string, x int, y int, v double")
    across, up = (lambda n: [(k, 0) for k in range(-n, n + 1)]), (lambda n: [(0, k) for k in range(-n, n + 1)])
    closed = lambda im, e: line_max(line_max(im, e, max), e, min)
    a, b = closed(image, up(2)), closed(image, across(2))
    mask = {p: int(20 <= v <= 500) for p, v in closed({p: a[p] - b[p] for p in image}, across(2)).items()}
    band = largest({p for p, v in line_max(line_max(mask, across(2), max), up(1), max).items() if v})
    grown = {p for p, v in line_max({p: int(p in band) for p in image}, up(1), max).items() if v}
    got, rest = regions.meniscus_mask(table, line=2, join=2, widen=2, grow=1, low=20.0, high=500.0)
    assert {(r["x"], r["y"]) for r in got.collect()} == grown and 0 < len(grown) < len(image)
    assert {(r["x"], r["y"]) for r in rest.collect()} == largest(set(image) - grown)


def test_pixel_value_map(spark):
    rows = spark.createDataFrame([("a", 1, 1, 0.0, 3.0), ("a", 1, 2, 1.0, 4.0)], "box string, x int, y int, outer double, way double")
    assert [tuple(r) for r in regions.pixel_value_map(rows, "way", True).collect()] == [("a", 1, 1, 3.0)]
    assert regions.pixel_value_map(rows, "outer").count() == 2 and math.isclose(regions.pixel_value_map(rows, "outer").agg(F.sum("value")).first()[0], 1.0)
    with pytest.raises(ValueError):
        regions.pixel_value_map(rows, "colour")
