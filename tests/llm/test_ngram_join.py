import random
import re

import numpy as np
import pytest

from tessellon.llm import ngram_join, queries
from tessellon.llm.components import components
from tests.llm.fixtures import awkward, table


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y < x and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[x] for t in sets[y]):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {i: find(i) for i in ids}, {i: sorted(map(len, s)) for i, s in sets.items()}


def check(rows, got, k, percent):
    comp, sizes = brute(rows, k, percent)
    assert {r.doc_id: r.component_id for r in got} == comp
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append(r.n_shingles)
    assert {i: sorted(n) for i, n in seen.items()} == sizes


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 70)])
def test_planted_copies(spark, k, percent):
    rnd = random.Random(k)
    rows, n = [], 0
    for _ in range(60):
        w = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([2, 5, 9, 12, 20, 40, 90, 300]))]
        for _ in range(rnd.choice([1, 2, 6])):
            v = list(w)
            for _ in range(rnd.choice([0, 1, 1, 2, len(v) // 60, len(v) // 25])):
                j = rnd.randrange(len(v))
                v[j : j + rnd.choice([0, 1])] = [f"x{rnd.randrange(9)}"] * rnd.choice([0, 1, 1])
                v = v or ["a"]
            rows.append((rnd.randrange(10**6) * 1000 + n, " ".join(v)))
            n += 1
            if rnd.random() < 0.3:
                w = v  # chains of copies
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, ngram_join.join_components(df, k, percent).collect(), k, percent)


def test_linked_sets_always_share_a_signature():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        plan = [ngram_join.allocate(b, {b.low: n, b.high: n})[1] for b in ngram_join.bands(900, percent) for n in [int(rng.choice([3, 1000, 10**6]))]]
        signer = ngram_join.Signer(plan)
        for _ in range(400):
            n = int(rng.integers(1, 700))
            a = rng.choice(2**60, n + 200, replace=False).astype(np.uint64)
            x = a[:n]
            gone, new = int(rng.integers(0, n // 8 + 2)), int(rng.integers(0, n // 8 + 2))
            y = np.concatenate([x[min(gone, n - 1) :], a[n : n + new]])
            common = n - min(gone, n - 1)
            if 100 * common >= percent * (n + len(y) - common) and not (common == n == len(y)):
                sig, doc = signer.sign(np.concatenate([np.sort(x), np.sort(y)]), np.array([0, n, n + len(y)]))
                assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist()), (n, len(y), common)


def test_query(spark):
    rows = table(columns="doc_id, text", sf="/root/testdata/sf0.001")
    check(rows, queries.op2_ngram_join(spark, "/root/testdata/sf0.001").collect(), 3, 90)


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1070)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_awkward(spark):
    rows = [(9, "one two three four five six seven"), (5, "One two three four five six seven"), (7, None), (6, ""), (4, " \n"), (3, "a b"), (2, "A b"), (2, "zz yy xx ww vv"), (1, "zz yy xx ww vv"), (8, "long " * 60_000), (8, "long " * 60_000)]
    df = awkward(spark, rows)
    check(rows, ngram_join.join_components(df, 3, 90).collect(), 3, 90)
    null = ngram_join.join_components(awkward(spark, [(None, "a b c d"), (1, "a b c d")]), 3, 90).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in null) == [(0, 2, None), (1, 2, 1)]
    assert ngram_join.join_components(df.limit(0), 3, 90).count() == 0


def test_without_drops_exactly_the_given_ids(spark):
    docs = awkward(spark, [(i, str(i)) for i in range(500)] + [(None, "x"), (7, "again")])
    gone = spark.createDataFrame([(i,) for i in range(0, 500, 7)], "doc_id long")
    kept = ngram_join.without(docs, gone)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [i for i in range(500) if i % 7]
    assert kept.filter("doc_id IS NULL").count() == 1
    assert ngram_join.without(docs, gone.limit(0)).count() == 502


def test_shared_signatures_are_those_of_two_different_sets(spark):
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.choice([1, 6, 12]))) for _ in range(300)]
    texts += texts[:40]  # equal sets
    rows = list(enumerate(texts))
    plan = [ngram_join.allocate(b, {b.low: 50, b.high: 50})[1] for b in ngram_join.bands(40, 80)]
    signer = ngram_join.Signer(plan)
    value, bounds = ngram_join.token_sets(texts, 1)
    sig, doc = signer.sign(value, bounds)
    owners = {}
    for s, d in zip(sig.tolist(), doc.tolist(), strict=True):
        owners.setdefault(s, set()).add(frozenset(value[bounds[d] : bounds[d + 1]].tolist()))
    sets = {}
    for d in range(len(texts)):
        sets.setdefault(frozenset(value[bounds[d] : bounds[d + 1]].tolist()), []).append(d)
    alike = spark.createDataFrame([(d,) for ids in sets.values() if len(ids) > 1 for d in ids], "id long")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.sig for r in ngram_join.shared_signatures(df, signer, ngram_join.Bitmap(alike, "id"), 1, "doc_id", "text").collect()}
    assert got == {s for s, o in owners.items() if len(o) > 1}
