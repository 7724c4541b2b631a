import hashlib
import re

import numpy as np

from tessellon.llm import fingerprint, kernels, queries
from tests.llm.fixtures import SF, awkward, table


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_kernels_against_plain_python():
    texts = [x for (x,) in table(columns="text")] + ["", None, "a", "a b c d", "É " * 9, "word " * 300_000]
    value, bounds = kernels.distinct(*kernels.shingles(*kernels.words(texts), 5), len(texts))
    sets = [shingles(t) for t in texts]
    assert np.diff(bounds).tolist() == [len(s) for s in sets]
    known = {}
    for i, s in enumerate(sets):
        for j in range(max(0, i - 3), i):
            a, b = value[bounds[i] : bounds[i + 1]], value[bounds[j] : bounds[j + 1]]
            assert len(np.intersect1d(a, b)) == len(s & sets[j])
    assert not known


def brute(rows):
    """rows: id, text, and the text's hash, by which texts of one id stand."""
    rows = [r[:2] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2] if len(r) > 2 else 0))]
    out = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, nxt = t or "", nxt or ""
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, nxt))
    return out


def test_query(spark):
    got = {r.doc_id: r for r in queries.op7_fingerprint(spark, SF).collect()}
    want = brute(table(columns="doc_id, text"))
    assert len(got) == len(want)
    errors = []
    for i, n, sha, t, e, nxt in want:
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        for near, other in ((r.near_edited, e), (r.near_next, nxt)):
            a, b = shingles(t), shingles(other)
            if len(a | b) > 200:
                errors.append(abs(near - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.03


def test_merge_and_containment():
    whole = " ".join(f"w{i}" for i in range(5000))
    part = " ".join(f"w{i}" for i in range(1000, 1400))
    (f, a), (_, b) = fingerprint.sketches([whole, part])
    assert (fingerprint.parse(f) == a).all()
    assert fingerprint.containment(b, a) == 1.0 and fingerprint.containment(a, b) < 0.2
    assert (fingerprint.merge(a, b) == a).all()


def hashed(spark, rows):
    texts = spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(rows)], "i int, t string")
    h = {r.i: r.h for r in texts.selectExpr("i", "xxhash64(t) AS h").collect()}
    return [(*r, h[i]) for i, r in enumerate(rows)]


def digest(got):
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got))


def test_hot_ids_and_rows_take_many_buckets(spark):
    rows = [(7, f"text number {i} of one id") for i in range(700)] + [(None, f"no id {i % 50}") for i in range(700)] + [(9, "the same row again and again")] * 700 + [(i, f"t {i}") for i in range(100, 200)]
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert digest(got) == sorted((i is not None, i or 0, n, sha) for i, n, sha, *_ in brute(hashed(spark, rows)))
    sizes = fingerprint.in_order(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("bucket").count().collect()
    assert len(sizes) > 16 and max(r["count"] for r in sizes) < 0.2 * len(rows)


def test_sketches_against_plain_python():
    texts = [x for (x,) in table(columns="text")][::3] + ["", "a b", "x " * 40]
    for (_, kept), text in zip(fingerprint.sketches(texts), texts, strict=True):
        value, bounds = kernels.distinct(*kernels.shingles(*kernels.words([text]), 5), 1)
        assert int(bounds[-1]) == len(shingles(text))
        assert kept.tolist() == [int(v) >> 16 for v in value if int(v) >> 16 < int(0.2 * (1 << 48))]
    by_set = {}
    for (print_, _), text in zip(fingerprint.sketches(texts), texts, strict=True):
        assert by_set.setdefault(frozenset(shingles(text)), print_) == print_
    assert len(set(by_set.values())) == len(by_set)


def test_awkward(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()] + [(None, "no id"), (None, None)]
    got = fingerprint.with_next(awkward(spark, rows)).collect()
    rows = hashed(spark, rows)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=key) == sorted([x[:3] for x in brute(rows)], key=key)
    prints = fingerprint.fingerprints(df).collect()
    assert len({r.fingerprint for r in prints if r.doc_id in (1, 8)}) == 1
    assert fingerprint.with_next(df.limit(0)).count() == 0
    one = fingerprint.with_next(awkward(spark, [(1, "only one text here")])).collect()
    assert one[0].near_next == 1.0
