"""Exact search against brute force at all sizes, with vectors that can't be compared, ties and hot copies."""

import math

import numpy as np
import pytest

from doclake.operators import neighbours as N
from doclake.operators import retrieval as R

Q, C = "qid long, embedding array<float>, note string", "chunk_id string, embedding array<double>, qid int"


def good(v, metric):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and (metric != "cosine" or any(v))


def brute(questions, chunks, k, metric):
    out = []
    for q, a, _ in questions:
        if not good(a, metric):
            continue
        found = []
        for c, b, _ in chunks:
            if good(b, metric) and len(a) == len(b):
                x, y = np.array(a, dtype=np.float32).astype(float), np.array(b, dtype=float)
                d = ((x - y) ** 2).sum() if metric == "l2sq" else 1 - (x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum())
                found.append((round(float(d), 9) + 0.0, c))
        out += [(q, c, d, i + 1) for i, (d, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def rows(spark, n, seed, bad=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 5, (6, 4))
    some = lambda: (centres[rng.integers(6)] + rng.normal(0, 0.3, 4)).round(3).tolist()
    chunks = [(f"c{i}", some(), i) for i in range(n)] + [(f"hot{i}", [1.0, 2.0, 3.0, 4.0], i) for i in range(n // 2)] + [(f"long{i}", [*some(), 1.5], i) for i in range(5)]
    questions = [(i, some(), "x") for i in range(25)] + [(100, [1.0, 2.0, 3.0, 4.0], "x"), (101, [0.5] * 5, "x")]
    if bad:
        unfit = [None, [], [1.0], [float("nan")] * 4, [float("inf"), 1.0, 1.0, 1.0], [None, 1.0, 1.0, 1.0], [0.0] * 4]
        chunks += [(f"bad{i}", v, 0) for i, v in enumerate(unfit)]
        questions += [(200 + i, v, None) for i, v in enumerate(unfit)]
    return questions, chunks, spark.createDataFrame(questions, Q), spark.createDataFrame(chunks, C).repartition(3)


def result(df):
    return sorted((r.qid, r.chunk_id, round(r.distance, 9) + 0.0, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_exact_search_brute_force(spark, metric, monkeypatch):
    questions, chunks, q, c = rows(spark, 120, 3)
    wanted = brute(questions, chunks, 7, metric)
    assert {w[0] for w in wanted} >= {100, 101} and not {w[0] for w in wanted} & {200, 201, 203, 204, 205}
    settings = ((9, 3, 640, 50), (None, 1000, 4 << 20, 1 << 20), (1, 2, 640, 50), (40, 1000, 4 << 20, 1 << 20))
    for cells, bundle, block, distances in settings if metric == "l2sq" else settings[:2]:
        monkeypatch.setattr(N, "BUNDLE", bundle)
        monkeypatch.setattr(N, "BLOCK_BYTES", block)
        monkeypatch.setattr(N, "DISTANCES", distances)
        assert result(R.knn(q, c, 7, metric, cells)) == wanted


def test_more_questions_than_a_bundle_and_less_vectors_than_k(spark, monkeypatch):
    rng = np.random.default_rng(8)
    questions = [(i, rng.normal(size=3).round(2).tolist(), "") for i in range(1100)]
    chunks = [(f"c{i}", rng.normal(size=3).round(1).tolist(), i) for i in range(40)]
    q, c = spark.createDataFrame(questions, Q), spark.createDataFrame(chunks, C)
    for cells in (None, 5):  # on both sides of a bundle of questions
        assert result(R.knn(q, c, 3, cells=cells)) == brute(questions, chunks, 3, "l2sq")
        assert result(R.knn(q.where("qid < 30"), c, 100, cells=cells)) == brute(questions[:30], chunks, 100, "l2sq")
        assert R.knn(q.limit(0), c, 3, cells=cells).count() == R.knn(q, c.limit(0), 3, cells=cells).count() == 0
    with pytest.raises(ValueError):
        R.knn(q, c, 0)
    with pytest.raises(ValueError):
        R.knn(q, c, 1, "dot")


def test_vectors_far_from_the_origin_are_measured_by_value(spark):
    """Where a matrix product alone would round all distances to noise."""
    rng = np.random.default_rng(2)
    base = np.full(4, 1e6)
    chunks = [(f"c{i}", (base + rng.integers(0, 64, 4) / 64).tolist(), i) for i in range(200)]
    questions = [(i, (base + rng.integers(0, 2, 4)).tolist(), "") for i in range(10)]
    q, c = spark.createDataFrame(questions, Q), spark.createDataFrame(chunks, C)
    for cells in (None, 8, 60):
        assert result(R.knn(q, c, 5, cells=cells)) == brute(questions, chunks, 5, "l2sq")
    # No bound is above a distance that it bounds, whatever the offset.
    for shift in (0.0, 1e6, 1e9):
        x = rng.normal(0, 1e-3, (300, 4)) + rng.integers(0, 5, (300, 1)) + shift
        own = N.Cells("l2sq", {4: N._fit(x, 12)}, {})
        cell, far = own.assign(x)
        own.held[4] = [(int(k), int((cell == k).sum()), far[cell == k].min(), far[cell == k].max()) for k in np.unique(cell)]
        ids, _, _, least = own.bounds(x[:50])
        true = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(-1))
        assert all((least[:, j] <= true[:, cell == k].min(axis=1)).all() for j, k in enumerate(ids.tolist()))


def test_approximate_search_reads_few_rows_of_clustered_vectors(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 4, (60, 16))
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(0, 0.5, (6000, 16))
    c = spark.createDataFrame([(f"c{i}", v.tolist(), i) for i, v in enumerate(x)], C)
    q = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x[::50] + rng.normal(0, 0.05, (120, 16)))], Q)
    index = N.build_index(c, cells=60, k=10, recall=0.97)
    exact = {(r.qid, r.chunk_id) for r in N.search(index, q, 10).collect()}
    assert exact == {(r.qid, r.chunk_id) for r in R.knn(q, c, 10).collect()}
    near = {(r.qid, r.chunk_id) for r in N.search(index, q, 10, exact=False).collect()}
    read = [r.n for r in N.rows_read(index, q, 10).collect()]
    assert len(exact & near) >= 0.9 * len(exact) and sum(read) < 0.2 * len(x) * len(read)
