"""Chance pairs of large sets are told apart before whole sets are stored."""

import random

import numpy as np

from tessellon.llm import ngram_join, scratch
from tests.llm.test_ngram_join import brute


def test_bound_never_exceeds_the_difference():
    rng = np.random.default_rng(7)
    for n, gone, new in [(513, 0, 0), (513, 1, 0), (600, 40, 60), (1020, 30, 10), (1030, 100, 0), (5000, 300, 900), (3000, 3000, 3000)]:
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[gone:], rng.integers(0, 2**63, new).astype(np.uint64)])
        a, b = ngram_join.wide_maps(np.concatenate([x, y]), np.array([0, n, n + len(y)]))
        assert ngram_join.wide_apart(a, b) == ngram_join.wide_apart(b, a) <= gone + new
        assert len(a) * 8 >= n and (len(b) * 8 >= len(y) or len(y) <= 512)
    assert ngram_join.wide_apart(a, b) > 6000 * 20 // 180  # unrelated


def test_sets_are_stored_for_near_pairs_only(spark, monkeypatch):
    rng = random.Random(3)
    passage = [f"p{rng.random()}" for _ in range(500)]
    rows = [(i, " ".join(passage + [f"w{rng.random()}" for _ in range(1000 + i)])) for i in range(40)]
    near = rows[5][1].split()
    near[700:760] = [f"n{rng.random()}" for _ in range(60)]
    rows += [(50, " ".join(near)), (51, rows[5][1] + " tail")]
    stored = {}

    def watched(df, name="step", *, f=scratch.materialize):
        out = f(df, name)
        stored.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", watched)
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, _ = brute(rows, ngram_join.WORDS, ngram_join.PERCENT)
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) == 40
    assert max(stored["pairs"] + stored["cross"]) > 30  # chance pairs that sizes and the small map let through
    assert max(stored["tokens"]) <= 3
