import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bornoflow.llm import exact_topk, multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def rows(n=400, d=16, seed=0):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, d)).astype("f4")
    m[n // 2 :] = m[r.integers(0, n // 2, n - n // 2)]  # ties
    m[n // 2 :: 3] += r.normal(size=m[n // 2 :: 3].shape).astype("f4") * 0.05
    out = [(i, [float(x) for x in v], 0, 0.0, 0) for i, v in enumerate(m)]
    nan, inf = float("nan"), float("inf")
    return out + [(1000, None, 0, 0.0, 0), (1100, [nan] * d, 0, 0.0, 0), (1200, [inf] * d, 0, 0.0, 0), (1300, [None] * d, 0, 0.0, 0), (1400, [0.0] * d, 0, 0.0, 0), (1500, [1.0, 2.0], 0, 0.0, 0), (1600, [], 0, 0.0, 0), (None, [1.0] * d, 0, 0.0, 0), (7, [0.5] * d, 0, 0.0, 0), (100, [0.5] * d, 0, 0.0, 0)]


def valid(data, zero):
    good = [(i, np.pad(np.array(v, "f8"), (0, 16 - len(v)))) for i, v, *_ in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [(i, v) for i, v in good if zero or v.any()]


def want(data, step, k, score, zero):
    good = valid(data, zero)
    queries: dict = {}
    for i, v in good:
        if i % step == 0:
            queries[i] = min([tuple(v), queries.get(i, tuple(v))])
    out = []
    for q, u in queries.items():
        best = sorted((-score(np.array(u), v), i) for i, v in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("group", [2048, 3])
def test_exact_topk(spark, group):
    data = rows()
    dot = lambda a, b: int(np.floor(1024 * a) @ np.floor(1024 * b))
    got = exact_topk.search(spark.createDataFrame(data, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0, 10, group)
    assert sorted(map(tuple, got.collect())) == want(data, 50, 10, dot, True)
    few = spark.createDataFrame(data[:4], SCHEMA)
    assert sorted(map(tuple, exact_topk.search(few, F.col("vec_id") % 50 == 0, 10).collect())) == want(data[:4], 50, 10, dot, True)
    assert exact_topk.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_exact_topk_ties_and_large(spark):
    same = [(i, [1.0, 1.0], 0, 0.0, 0) for i in range(500)]
    got = exact_topk.search(spark.createDataFrame(same, SCHEMA), F.col("vec_id") == 100, 10).collect()
    assert [x.vec_id for x in sorted(got, key=lambda x: x["rank"])] == list(range(10))
    large = [(0, [1e30, 1.0], 0, 0.0, 0), (1, [-1e30, 2.0], 0, 0.0, 0), (2, [3.0, 4.0], 0, 0.0, 0)]
    got = exact_topk.search(spark.createDataFrame(large, SCHEMA), F.col("vec_id") == 0, 2).collect()
    assert sorted((x["rank"], x.vec_id) for x in got) == [(1, 2), (2, 1)]


def test_multi_index(spark):
    data = rows(1200)
    cos = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    truth = {}
    for q, r, i, s in want(data, 50, 5, cos, False):
        truth.setdefault(q, {})[i] = s
    got = multi_index.search(spark.createDataFrame(data, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0).collect()
    per = {}
    for x in got:
        per.setdefault(x.query_id, {})[x.vec_id] = x.score
    assert per.keys() == truth.keys() and all(len(v) == 5 for v in per.values())
    assert sum(len(per[q].keys() & truth[q].keys()) for q in truth) >= 0.9 * sum(map(len, truth.values()))
    assert all(abs(s - truth[q][i]) < 1e-12 for q in per for i, s in per[q].items() if i in truth[q])
    few = multi_index.search(spark.createDataFrame(data[:4], SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert [(x.query_id, x["rank"]) for x in few] == [(0, 1), (0, 2), (0, 3)]
    assert multi_index.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_probe_retrieves_every_code_within_the_radius():
    r = np.random.default_rng(4)
    codes = r.integers(0, 2**64, (300, 2), dtype="u8")
    codes[150:] = codes[:150] ^ (np.uint64(1) << r.integers(0, 64, (150, 2), dtype="u8"))
    for radius in (0, 1, 2, 30, 60):
        a, b = multi_index.probe(codes[:40], codes, radius)
        d = np.bitwise_count(codes[:40, None] ^ codes).sum(2)
        assert set(zip(a.tolist(), b.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(d <= radius))))


def test_multi_index_exact_and_beyond_the_sample(spark, monkeypatch):
    """recall=1 finds just what brute force does; a fit on far fewer rows than there are still reaches 0.9."""
    data = rows()
    cosine = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    df = spark.createDataFrame(data, SCHEMA)
    exact = want(data, 50, 5, cosine, False)
    got = sorted(map(tuple, multi_index.search(df, F.col("vec_id") % 50 == 0, 5, recall=1).collect()))
    assert [x[:2] for x in got] == [x[:2] for x in exact] and np.allclose([x[3] for x in got], [x[3] for x in exact], rtol=1e-12)
    monkeypatch.setattr(multi_index, "FIT_ROWS", 60)
    found = {(x.query_id, x.vec_id) for x in multi_index.search(df, F.col("vec_id") % 50 == 0, 5).collect()}
    assert len(found & {(x[0], x[2]) for x in exact}) >= 0.9 * len(exact)
