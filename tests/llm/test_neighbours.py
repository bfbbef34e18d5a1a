"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from palisade.llm.neighbours import nearest


def rows(n=1500, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[n // 3 : 2 * n // 3] = x[0]  # a third are copies
    return [(i, v.tolist(), "x") for i, v in enumerate(x)]


def brute(data, step, k):
    ids = np.array([d[0] for d in data])
    x = np.array([d[1] for d in data], np.float64)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % step == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall_and_scores(spark):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, leaf string").repartition(6)
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, sample=400, leaf=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(data, 50, 10)
    assert got.keys() == want.keys()
    assert all(len(g) == 10 for g in got.values())
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    exact = {d[0]: np.array(d[1], np.float64) for d in data}
    for q, found in got.items():
        assert found == sorted(found, key=lambda r: (r[1], r[0]))
        assert all(abs(s - np.linalg.norm(exact[q] - exact[v])) < 1e-12 for v, s in found)
    copies = [q for q in want if want[q][-1][1] == 0]
    assert copies and all(got[q] == want[q] for q in copies)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (100, [2.0, 2.0, 2.0]), (8, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 7, 0.5)]
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
