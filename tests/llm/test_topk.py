"""The pairs of blocks, tiles and thresholds of op4_topk, against every pair in plain Python."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidestep.llm import topk


def brute(rows, is_query, k):
    """{(query's id, its place): [(rank, id, score)]} of rows (id, vector); vectors that are or hold null take no part."""
    kept = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    out = []
    for n, (i, v) in enumerate(kept):
        if is_query(i):
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(kept) if m != n)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in topk.topk_inner(df, **more).collect())


def made(spark, n, dims=64, parts=4):
    """n rows of ids and vectors of -100 to 100."""
    return spark.range(0, n, 1, parts).selectExpr("id AS vec_id", f"transform(sequence(1, {dims}), i -> pmod(xxhash64(id, i), 201) - 100) AS v").localCheckpoint()


def test_vectors_are_not_shuffled_for_pairs(spark):
    df = topk.topk_inner(made(spark, 300), F.col("vec_id") % 50 == 0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(query_row" in plan


def test_many_pairs_end_soon(spark):
    """600 million pairs: the time of a few numpy products, not of a pass over the scores for each term."""
    df = made(spark, 24_500, parts=8)
    began = time.time()
    got = topk.topk_inner(df, F.lit(True)).collect()
    assert time.time() - began < 25
    assert len(got) == 5 * 24_500
    rows = df.orderBy("vec_id").select("v").toPandas()["v"]
    m = np.array(rows.tolist(), np.int64)
    by = {}
    for x in sorted(got, key=lambda x: x.rank):
        by.setdefault(x.query_id, []).append((-x.score, x.vec_id))
    for i in range(0, 24_500, 501):
        s = m @ m[i]
        assert by[i] == sorted((-int(s[j]), j) for j in np.flatnonzero(s >= np.sort(s)[-7]) if j != i)[:5]


@pytest.mark.parametrize("tile", [8, 512])
def test_ties_ragged_empty_and_null_vectors(spark, tile):
    r = np.random.default_rng(4)
    rows = [(int(i), [int(x) for x in r.integers(-2, 3, r.integers(0, 7))]) for i in r.permutation(400)]
    rows += [(int(i), [1, 1]) for i in r.integers(400, 900, 300)] + [(7, [3, 3]), (None, [9, 9]), (901, None), (902, [5, None]), (950, [0]), (1000, [])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    for k in (1, 5, 90):
        assert found(df, is_query=F.col("vec_id") % 50 == 0, k=k, block=100, query_block=9, tile=tile) == brute(rows, lambda i: i % 50 == 0, k)


def test_scores_beyond_float32_and_float64_are_exact(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(240):
        top = (100, 3_000, 1 << 26, 1 << 28)[i % 4]
        rows.append((i, [int(x) for x in r.integers(-top, top + 1, 9)]))
    # Two that float32 and float64 hold for equal.
    rows += [(300, [1 << 28, 1]), (301, [1 << 28, 0]), (302, [1 << 28, 1 << 26]), (303, [4097, 4096]), (304, [4096, 4097])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(2)
    assert found(df, is_query=F.lit(True), k=6, block=50, query_block=40) == brute(rows, lambda i: True, 6)


def test_long_and_wide_vectors(spark):
    """Terms in groups, terms on one side only, and one vector much longer than the others."""
    r = np.random.default_rng(6)
    rows = [(i, [int(x) for x in r.integers(-50, 51, 700) * (r.random(700) < (0.02, 1)[i % 2])]) for i in range(80)] + [(90, [1] * 5000), (91, [0, 7])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(2)
    assert found(df, is_query=F.col("vec_id") % 5 == 0, k=4, cells=20_000) == brute(rows, lambda i: i % 5 == 0, 4)
