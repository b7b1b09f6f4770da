"""Exact top-k against a plain scan in Python integers."""

import math
import random

import numpy as np
import pytest

from folio.llm import topk

MOST = (1 << 63) - 1


def plain(rows, k, every):
    clip = lambda x: max(-MOST - 1, min(MOST, x))
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    q = [(i, v, [clip(math.floor(1024 * x)) for x in v]) for i, v in good]
    out = []
    for i, v, a in q:
        if i % every == 0:
            scores = sorted((-clip(sum(x * y for x, y in zip(a, b))), j) for j, _, b in q if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, rows, k=10, every=10, **options):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, RANK int")
    got = topk.nearest(df, k=k, every=every, **options).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == plain(rows, k, every)


@pytest.mark.parametrize("dims,kind", [(1, "ties"), (7, "plain"), (40, "clusters"), (64, "plain"), (33, "skew")])
def test_vectors(spark, dims, kind):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(500, dims))
    if kind == "ties":
        x = np.round(x * 2) / 2
    if kind == "clusters":
        x = x[rng.integers(0, 9, 500)] + 0.01 * x
    if kind == "skew":
        x *= 0.6 ** np.arange(dims)
    check(spark, [(k, v) for k, v in enumerate(x.tolist())])
    check(spark, [(k, v) for k, v in enumerate(x.tolist())], cell_bytes=4000, k=3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 1.0]), (10, None), (20, [1.0, None]), (30, [nan, 1.0]), (40, [inf, 1.0]), (None, [1.0, 1.0]), (1, []), (50, []), (2, [5.0]), (60, [0.5, 0.25, 0.125]), (3, [-1e-9, 0.0]), (4, [0.0, -0.0])]
    check(spark, rows)
    check(spark, rows, k=2)
    check(spark, [(0, [1.0])])
    check(spark, [])


def test_large_components(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([1e15, -1e15, 9e17, 1e300, -1e300, 3.5, 1e6]) * rng.random() for _ in range(5)]) for k in range(80)]
    check(spark, rows)
    rows = [(k, [rng.choice([2.0**30, -(2.0**30), 2.0**31]) + rng.random() for _ in range(20)]) for k in range(80)]
    check(spark, rows)


def test_common_vector_and_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 16)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "BLOCK", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 9)).astype(np.float32).astype(float)
    x[::3] = x[0]
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    check(spark, rows)
    check(spark, rows, k=400, every=50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.nearest(df, every=10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == plain(rows, 10, 10)
