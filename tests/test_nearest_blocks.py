"""The exact search meets packs of documents and blocks of queries, not pairs row by row."""

import numpy as np
import pytest

from marketloom.operators import retrieval

DOCS, ASKS = "id long, embedding array<float>", "query_id string, embedding array<double>"


def test_packs_and_blocks_give_the_exact_order(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PACK_ROWS", 16)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(150, 6)).astype(np.float32)
    vectors[60:120] = vectors[60]  # a large group of copies: all its distances tie
    rows = [(i % 140, v.tolist()) for i, v in enumerate(vectors)]  # ids 0 to 9 stand twice
    asks = [(f"q{i}", v.tolist()) for i, v in enumerate([*vectors[55:65].astype(float), *rng.normal(size=(8, 6))])]
    docs, queries = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*asks, ("none", None)], ASKS)
    out = retrieval.vector_topk(docs, queries, k=4, pivots=5)
    got = sorted((r.query_id, r["rank"], r.id, r.distance) for r in out.collect())
    expected = []
    for name, q in asks:
        away = []
        for i, v in rows:
            total = 0.0
            for x, y in zip(q, v):
                total += (x - y) * (x - y)
            away.append((total, i))
        expected += [(name, n, i, d) for n, (d, i) in enumerate(sorted(away)[:4], 1)]
    assert got == sorted(expected)  # distances to the last bit
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "_pack" in plan
    few = retrieval.vector_topk(docs.limit(2), queries, k=4)
    assert few.count() == 2 * len(asks)


def test_nearest_where_products_round(spark):
    base = np.full((300, 8), 1e6)  # distances far below the rounding of a matrix product
    docs = base + np.arange(300)[::-1, None] * 1e-7
    rows, places, distances = retrieval.nearest(docs, base[:2], 3)
    exact = ((base[:1] - docs) ** 2).sum(1)
    assert rows.tolist() == [0] * 3 + [1] * 3
    assert places[:3].tolist() == np.argsort(exact, kind="stable")[:3].tolist()
    assert distances[:3] == pytest.approx(np.sort(exact)[:3])
    nan = retrieval.nearest(np.array([[np.nan], [1.0], [2.0]]), np.array([[0.0], [np.nan]]), 1)
    assert nan[1].tolist() == [1, 0]
