import numpy as np
from pyspark.sql import functions as F

from tessellon.llm import queries, topk
from tests.llm.fixtures import SF, table


def brute(rows, is_query, k=20, scale=64):
    ok = [(i, np.floor(scale * np.array(v, np.float64))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(ok):
        if is_query(q):
            scores = [(-int(v @ c), i) for place, (i, c) in enumerate(ok) if place != at and len(c) == len(v)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_query(spark):
    got = sorted(tuple(r) for r in queries.op4_exact_top_k(spark, SF).collect())
    assert got == brute(table("embeddings", "vec_id, embedding"), lambda q: q % 20 == 0)


def test_many_blocks_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=24) * rng.choice([0.1, 1, 4]), 1)]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for components in (1 << 20, 24 * 128):
        got = topk.search(df, F.col("vec_id") % 7 == 0, k=9, rows=64, components=components)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda q: q % 7 == 0, 9)


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [1.0, 1.0]), (20, [0.0, 0.0]), (20, [1.0, 3.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (3, 20):
        got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, k=k).collect())
        assert got == brute(rows, lambda q: q % 20 == 0, k)


def test_small_norms_are_not_sent(spark):
    rows = [(i, [100.0, 0.0, 0.0]) for i in range(64)] + [(i, [0.0, 0.01, 0.02]) for i in range(64, 1000)]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = topk.search(df, F.col("vec_id").isin(0, 1, 2), k=9, rows=64)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda q: q < 3, 9)

def test_awkward(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [None, 1.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (1, [1.0, 2.0]), (2, [0.5]), (3, []), (None, [1.0, 1.0]), (4, [1e9, -1e9]), (4, [1e9, -1e9])]
    df = spark.createDataFrame([(*r, "q", 7, 1) for r in rows], "vec_id long, embedding array<double>, query_id string, score int, dims int")
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0).collect())
    low = 64 * 64_000_000_000 - 128 * 64_000_000_000
    assert got == [(0, 1, 1, 64 * 64 * 5), (0, 2, 4, low), (0, 3, 4, low)]
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
