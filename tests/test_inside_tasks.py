"""Links and ways of small groups are found inside tasks as over tables."""

import random

from pyspark.sql import functions as F

from sylvaframe.operators import branches, waves


def test_rounds_of_links(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(box, i, j, rng.randrange(0, 40) / 10) for box in "abcd" for i in range(25) for j in range(25) if rng.random() < 0.3]
    scored = spark.createDataFrame(rows, "box string, of long, to long, score double")
    cuts, cut = [], branches.cut
    monkeypatch.setattr(branches, "cut", lambda df: cuts.append(0) or cut(df))
    found, n = [], []
    for limits in ({}, {"most_pairs": 0}):
        before = len(cuts)
        df = branches.reconnect_broken_branches(scored, 3.0, **limits)
        found.append((df.schema.simpleString(), sorted(map(tuple, df.collect()))))
        n.append(len(cuts) - before)
    assert found[0] == found[1] and max(r[-1] for r in found[0][1]) > 2
    assert n[0] == 1 < 5 < n[1]


def test_ways_back(spark, monkeypatch):
    rng = random.Random(2)
    pixels = spark.createDataFrame([(g, x, y, rng.randrange(9)) for g in "abc" for x in range(-3, 12) for y in range(14) if rng.random() < 0.8 or (x, y) in ((0, 0), (9, 12))], "g string, x long, y long, v long")
    ends = [spark.createDataFrame([(g, *p) for g in "abc"], "g string, x long, y long") for p in ((0, 0), (9, 12))]
    cuts, cut = [], waves.cut
    monkeypatch.setattr(waves, "cut", lambda df: cuts.append(0) or cut(df))
    found, n = [], []
    for most in (1000, 0):
        before = len(cuts)
        found.append(sorted(map(tuple, waves.main_pixel_path(pixels, *ends, ["g"], factor=F.col("v") + 1, tile=6, most=most).collect())))
        n.append(len(cuts) - before)
    assert found[0] == found[1] and len(found[0]) > 12
    assert n[1] - n[0] > 6
