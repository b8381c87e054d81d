"""Nearest neighbours, block against block, against a plain fold: ties, copies over several blocks, and vectors without a score."""

import math
import random

import pytest

from tidemark.operators import vectors


@pytest.mark.parametrize("known", [1000, 0])
def test_nearest_blocks(spark, monkeypatch, known):
    monkeypatch.setattr(vectors, "KNOWN", known)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "TILE", 2)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(20)] + [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [1.0, 2.0]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)

    def fold(x, y):
        s = 0.0
        for a, b in zip(x, y, strict=True):
            s += a * b
        return s

    def score(x, y):
        if x is None or y is None or len(x) != len(y) or None in x or None in y or not any(x) or not any(y):
            return None
        return fold(x, y) / (math.sqrt(fold(x, x)) * math.sqrt(fold(y, y)))

    asked = [r for r in rows if r[0] is not None and r[0] % 3 == 0]
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in vectors.nearest(df.where("id % 3 = 0"), df, "id", "v", 25).collect()}
    expect = {}
    for q, x in asked:
        all_ = [(score(x, y), i) for i, y in rows if i is not None and i != q]
        for rank, (s, i) in enumerate(sorted(all_, key=lambda p: (p[0] is None, -(p[0] or 0.0), p[1]))[:25], 1):
            expect[q, rank] = (i, s)
    assert got == expect


def test_nearest_makes_no_row_for_each_pair(spark):
    df = spark.range(5000).selectExpr("id", "array(double(id % 7), double(id % 11), 1.0D) AS v")
    plan = vectors.nearest(df.where("id % 100 = 0"), df, "id", "v", 3)._jdf.queryExecution().toString()
    assert "mapInPandas" in plan or "MapInPandas" in plan
    assert vectors.nearest(df.limit(0), df, "id", "v", 3).count() == 0 and vectors.nearest(df, df.limit(0), "id", "v", 3).count() == 0
