import math
import random

import numpy as np
from pyspark.sql import functions as F

from guildspark.llm import maxscore


def brute(rows, asks, k):
    """Set of (query_id, rank, vec_id, score) by all pairs, with the integers of whole rows."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in kept:
        if i is not None and asks(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j) for j, v in kept if j != i)
            out |= {(i, n + 1, j, -s) for n, (s, _, j) in enumerate(scored[:k])}
    return out


def found(df, k, **sizes):
    rows = maxscore.top_k(maxscore.quantised(df, "embedding").cache(), F.col("id") % 5 == 0, k, **sizes).collect()
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows}
    assert len(got) == len(rows)
    return got


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, id string")


def test_dense_and_sparse(spark):
    rng = random.Random(1)
    dense = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(150)]
    sparse = [(i, [rng.choice([0, 0, 0, 1, -1, 3]) * rng.random() for _ in range(12)]) for i in range(150)]
    positive = [(i, [abs(x) for x in v]) for i, v in sparse]
    ties = [(i, [float(rng.choice([0, 1])) for _ in range(3)]) for i in range(80)]
    for rows in (dense, sparse, positive, ties):
        for sizes in ({}, {"shard_rows": 40, "block_queries": 11}):
            assert found(frame(spark, rows), 5, **sizes) == brute(rows, lambda i: i % 5 == 0, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, [1.0]), (10, []), (15, None), (20, [1.0, None]), (25, [nan]), (30, [inf, 1.0]), (None, [1.0, 2.0]), (None, None), (-5, [0.5, 0.5, 9.0]), (7, [1.0, 2.0]), (3, [-1.0, -2.0])]
    assert found(frame(spark, rows), 5) == brute(rows, lambda i: i % 5 == 0, 5)
    assert found(frame(spark, rows), 5, shard_rows=1, block_queries=1) == brute(rows, lambda i: i % 5 == 0, 5)
    assert found(frame(spark, rows[:1]), 5) == set()
    assert found(frame(spark, []), 5) == set()


def test_repeated_rows(spark):
    """Equal rows are asked once and found as often as they stand there; rows with the query's id are no candidates."""
    rows = [(0, [1.0]), (0, [1.0]), (0, [2.0]), *[(3, [4.0])] * 3, (4, [3.0])]
    assert found(frame(spark, rows), 3) == {(0, n + 1, 3, 256 * 1024) for n in range(3)} | {(0, n + 1, 3, 512 * 1024) for n in range(3)}
    assert {r[2] for r in found(frame(spark, rows), 4)} == {3, 4}


def test_large_numbers(spark):
    rows = [(0, [1e12, -3e9]), (1, [2e12, 5.0]), (2, [-1e13, 0.0]), (3, [1e-3, 1e12])]
    assert found(frame(spark, rows), 3) == {(0, n + 1, j, max(-(2**63), min(2**63 - 1, s))) for _, n, j, s in ((0, n - 1, j, s) for _, n, j, s in brute(rows, lambda i: i % 5 == 0, 3))}
    vast = [(0, [1e300]), (1, [1e300]), (2, [-1e300]), (3, [1.0])]
    assert [r[2] for r in sorted(found(frame(spark, vast), 3))] == [1, 3, 2]


def test_light_terms_are_probed():
    """Of many weak terms some are non-essential, and leaving them out of the traversal changes nothing."""
    rng = np.random.default_rng(2)
    vectors = rng.integers(0, 4, (400, 20)) * (rng.random((400, 20)) < 0.2)
    vectors[:, 0] *= 40
    shard = maxscore.Postings(list(range(400)), [1] * 400, vectors.tolist(), True)
    for n in range(0, 400, 13):
        scores = vectors @ vectors[n]
        want = [(int(scores[i]), int(i)) for i in np.lexsort((np.arange(400), -scores)) if i != n][:5]
        assert shard.best(vectors[n].tolist(), n, 5) == want
