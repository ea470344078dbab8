from __future__ import annotations

import numpy as np
import pytest

from marlstone.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, score double, rank string"


def _frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v], 0.0, "r") for i, v in zip(ids, vectors)], SCHEMA)


def _brute(x, k=10, every=100):
    out = {}
    for q in range(0, len(x), every):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        out[q] = list(np.lexsort((np.arange(len(x)), d))[: min(k, len(x) - 1)])
    return out


def test_anisotropic_codes_lower_the_parallel_residual():
    x = np.random.default_rng(1).normal(size=(2_000, 16))
    parallel = {}
    for threshold in (0.0, 0.4):
        index = A.fit(x, len(x), threshold=threshold)
        parts = index.split(x - index.mean)
        unit = parts / np.linalg.norm(x - index.mean, axis=1)[:, None, None]
        codes = A._assign(parts, unit, index.books, index.weight)
        r = parts - index.books[np.arange(parts.shape[1])[None], codes]
        parallel[threshold] = (np.einsum("nmw,nmw->n", r, unit) ** 2).mean()
    assert parallel[0.4] < 0.7 * parallel[0.0]


def test_partitions_follow_the_rows():
    x = np.random.default_rng(3).normal(size=(4_000, 8))
    sizes = [len(A.fit(x, n).centres) for n in (100, 10_000, 250_000, 10**9)]
    assert sizes == [2, 25, 125, 250]


@pytest.mark.parametrize("shape", ["spread", "clusters", "hot"])
def test_recall_against_brute_force(spark, shape):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3_000, 24))
    if shape == "clusters":
        x = rng.normal(size=(30, 24))[rng.integers(0, 30, 3_000)] * 3 + x * 0.3
    if shape == "hot":
        x[rng.random(3_000) < 0.35] = x[0]
        x[rng.random(3_000) < 0.2] = x[1] + rng.normal(size=24) * 0.01
    x = x.astype(np.float32).astype(float)
    got = {}
    for r in A.nearest(_frame(spark, x)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    true, hit = _brute(x), 0
    for q, want in true.items():
        found = [got[q][i] for i in range(1, 11)]
        hit += len({v for v, _ in found} & set(want))
        assert found == sorted(found, key=lambda f: (f[1], f[0]))
        for v, s in found:
            assert v != q and abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-12
    assert hit / (10 * len(true)) >= 0.9


def test_few_rows_and_odd_vectors(spark):
    good = [(0, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (2, [0.0, 1.0, 0.0]), (100, [3.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.5])]
    bad = [(3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 0.0, 1.0]), (300, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in good + bad], SCHEMA)
    got = [(r.query_id, r["rank"], r.vec_id) for r in A.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 200), (0, 3, 2), (0, 4, 100), (100, 1, 0), (100, 2, 1), (100, 3, 200), (100, 4, 2), (200, 1, 0), (200, 2, 1), (200, 3, 2), (200, 4, 100)]
    assert A.nearest(df.filter("vec_id > 2 and vec_id < 8")).count() == 0
    assert A.nearest(df.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    assert A.nearest(df.filter("vec_id = 0")).count() == 0
