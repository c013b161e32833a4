import math
import random

import numpy as np
import pytest

from rankfold.llm import topk

VECTORS = "vec_id bigint, embedding array<float>, label int, id int, v string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], VECTORS)


def brute(rows, every, k):
    good = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            scores = [(-sum(a * b for a, b in zip(q, c)), j) for m, (j, c) in enumerate(good) if m != n and len(c) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def corpus(seed=0, n=700, dims=6):
    rng = random.Random(seed)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(dims)]) for k in range(n)]
    rows += [(1000 + k, rows[50][1]) for k in range(150)]  # ties
    rows += [(2000, None), (2001, []), (2010, [None] * dims), (2020, [float("nan")] * dims), (2030, [float("inf")] + [0.0] * (dims - 1)), (None, [1.0] * dims)]
    rows += [(2040, [1.0, 2.0]), (2041, [3.0, -1.0]), (2050, [0.0] * dims), (7, rows[7][1])]
    rows += [(60, rows[60][1]), (60, rows[61][1]), (3000, rows[40][1]), (3000, rows[40][1]), (3000, rows[40][1])]  # repeated queries
    return rows


@pytest.mark.parametrize("block, batch", [(8192, 1024), (100, 7)])
def test_equals_brute_force(spark, monkeypatch, block, batch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", batch)
    rows = corpus()
    out = topk.top_k(frame(spark, rows), every=10, k=10)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == brute(rows, 10, 10)


def test_reading_stops_early():
    """On skewed vectors the lists are not read to their ends."""
    rng = np.random.default_rng(0)
    vectors = np.floor(rng.pareto(1.5, size=(20000, 4)) * 1024).astype(np.int64)
    ids = np.arange(20000)
    reads = []
    original = topk._reads
    topk._reads = lambda places, n: reads.append(places.size) or original(places, n)
    try:
        (places, scores), = topk.read_lists(vectors[:1] * 0 + 1, vectors, ids, np.array([-1]), 10)
    finally:
        topk._reads = original
    expected = np.lexsort((ids, -vectors.sum(axis=1)))[:10]
    assert list(places) == list(expected) and sum(reads) < 0.5 * vectors.size


def test_fewer_candidates_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (100, [0.25, 1.0])]
    assert sorted(map(tuple, topk.top_k(frame(spark, rows)).collect())) == brute(rows, 100, 10)
    assert topk.top_k(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, [(1, [1.0])])).count() == 0
