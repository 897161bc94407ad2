from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from evalmill.llm import topk


def brute(rows, k, picks):
    whole = []
    for vec_id, vector, *_ in rows:
        if vec_id is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole.append((vec_id, [math.floor(1024 * x) for x in vector]))
    out = []
    for q, v in whole:
        if picks(q):
            scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in whole if c != q and len(w) == len(v)]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def float32(x):
    import numpy as np

    return float(np.float32(x))


@pytest.fixture
def rows():
    draw = random.Random(1)
    out = [(i, [float32(draw.gauss(0, 0.3)) for _ in range(12)], i) for i in range(400)]
    out += [(400 + i, out[i][1], 0) for i in range(40)]  # ties
    out += [(500, None, 1), (501, [], 1), (502, [None] + [0.5] * 11, 1), (503, [math.nan] * 12, 1), (504, [math.inf] * 12, 1)]
    out += [(None, [0.5] * 12, 1), (600, [0.5] * 5, 1), (610, [0.25] * 5, 1), (620, [0.0] * 12, 1)]
    return out


@pytest.mark.parametrize(("block", "query_block"), [(4096, 512), (64, 4), (7, 3)])
def test_equals_brute_force(spark, rows, block, query_block):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(5)
    found = topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=10, block=block, query_block=query_block)
    assert sorted(map(tuple, found.collect())) == brute(rows, 10, lambda q: q % 20 == 0)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") == 0).collect()))
    assert found == brute([(*r, 0) for r in rows], 10, lambda q: q == 0)


def test_large_components_are_scored_exactly(spark):
    rows = [(i, [1e5 + i, -2e5, 3e4 * i, 7.0]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 10 == 0).collect()))
    assert found == brute(rows, 10, lambda q: q % 10 == 0)


def test_reading_stops_before_the_end():
    import numpy as np

    draw = np.random.default_rng(5)
    vectors = np.floor(1024 * draw.normal(0, 0.1, (3000, 4)))
    lists = topk.SortedLists(np.arange(3000), vectors)
    low, high = lists.bounds(vectors[:5], 300)
    scores = vectors[:5] @ vectors.T
    assert (low <= scores).all() and (scores <= high).all()


def test_empty_tables_and_no_query(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(1, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("vec_id") % 2 == 0).count() == 0
