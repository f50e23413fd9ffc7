import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sluice.llm import topk


def slow(rows, k=5, every=50):
    """Whole-number products of all pairs."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in good:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(k, [float(np.float32(rng.gauss(0, 0.125))) for _ in range(40)]) for k in range(400)]
    rows += [(1000 + k, rows[k % 7][1]) for k in range(60)]  # ties
    rows += [(None, rows[0][1]), (2000, None), (2050, [None] * 40), (2100, [float("nan")] * 40), (2150, [float("inf")] + [0.0] * 39), (2200, [0.0] * 40), (-50, [-1.0] * 40), (2250, []), (2300, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string").repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect())
    assert got == slow(rows)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(0, 500, 5)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect()) == slow(rows)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 256 * 128)]
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id = 0")).count() == 0


def test_repeated_queries_are_answered_each(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == [(0, 1, 3, 65536), (0, 1, 3, 131072)]


def test_huge_components_are_exact(spark):
    rows = [(0, [2.0**70, 1.0]), (50, [0.5, 1.0]), (1, [2.0**70, 5.0]), (2, [2.0**70, 6.0]), (3, [-(2.0**70), 0.0]), (4, [1e307, -1e307]), (5, [1.0, 2.0]), (6, [1e307, 1e308])]
    want = sorted((i, n, j, max(-(2**63), min(2**63 - 1, s))) for i, n, j, s in slow_large(rows))
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4)
    assert sorted(tuple(r) for r in got.collect()) == want


def slow_large(rows, k=4, every=50):
    whole = [(i, [int(Fraction(x) * 256 // 1) for x in v]) for i, v in rows]
    out = []
    for i, v in whole:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("block", [1, 8, 64])
def test_bounds_leave_candidates_out(block):
    """Within the first chunk already, with the same result for any block size."""
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(size=(3000, 64)) * np.exp(-np.arange(64) / 16))
    best = topk.Best(4, 5)
    topk.search(v[:4], np.arange(4), v, np.arange(3000), best, block=block)
    scores = (v[:4] @ v.T).astype(int)
    assert best.found == [sorted((-int(scores[q, i]), i) for i in range(3000) if i != q)[:5] for q in range(4)]
    assert block == 64 or best.products < 0.7 * 4 * 2999 * 64


def test_bounds_save_products_on_the_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    v, ids = np.stack(topk.quantise([r.embedding for r in rows])), np.array([r.vec_id for r in rows])
    take = ids % 50 == 0
    best = topk.Best(int(take.sum()), 5)
    topk.search(v[take], ids[take], v, ids, best)
    assert best.products < 0.95 * take.sum() * (len(v) - 1) * v.shape[1]
