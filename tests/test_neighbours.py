"""Neighbours by inverted lists against comparing every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.operators import neighbours


def made(spark, n=1500, d=16, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(12, d))[r.integers(0, 12, n)] + r.normal(size=(n, d)) * 0.6
    x[::3] = x[0]  # a third of all rows are copies
    return x, spark.createDataFrame([(i, v.tolist(), "t") for i, v in enumerate(x)], "id long, e array<double>, cell string")


def brute(x, asked, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = np.round(u @ u[q], 12)
        s[q] = -9
        out[q] = [int(i) for i in np.argsort(-s, kind="stable")[:k]]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query, r.rank)):
        out.setdefault(r.query, []).append(r.neighbour)
    return out


def test_exact_and_recall(spark, monkeypatch):
    x, df = made(spark)
    asked = df.filter("id % 20 = 0")
    want = brute(x, range(0, len(x), 20), 10)
    centres = neighbours.fit_centres(df, "id", "e", cells=24, sample=400)
    assert len(centres) == 24
    monkeypatch.setattr(neighbours, "BLOCK", 100)  # cells of many blocks
    for probes in (1, 3):
        assert lists(neighbours.nearest(asked, df, "id", "e", 10, centres, probes=probes)) == want
    near = lists(neighbours.nearest(asked, df, "id", "e", 10, centres, probes=8, exact=False))
    assert np.mean([len(set(near[q]) & set(w)) / 10 for q, w in want.items()]) >= 0.95


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [-1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    centres = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert lists(neighbours.nearest(df, df, "id", "e", 5, centres, probes=1)) == {1: [2, 3], 2: [1, 3], 3: [2, 1]}
    assert neighbours.nearest(df, df.limit(0), "id", "e").count() == 0
    assert neighbours.nearest(df.limit(0), df, "id", "e", 5, centres).count() == 0


@pytest.mark.parametrize("exact", [True, False])
def test_ids_of_texts(spark, exact):
    x, df = made(spark, 60, 4)
    named = df.select(F.format_string("n%03d", "id").alias("id"), "e")
    got = lists(neighbours.nearest(named, named, "id", "e", 3, probes=99, exact=exact))
    assert got == {f"n{q:03d}": [f"n{i:03d}" for i in w] for q, w in brute(x, range(60), 3).items()}
