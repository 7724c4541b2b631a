import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessellon.llm import language_id, queries, toxicity
from tests.llm.fixtures import awkward, table

SF = "/root/testdata/sf0.01"


def test_codewords():
    for k in (2, 3, 4, 7, 12, 30):
        m = language_id.codewords(k)
        far = min(np.count_nonzero(m[i] != m[j]) for i in range(k) for j in range(i))
        assert far >= (2 ** (k - 2) if k <= 7 else 10)


def test_a_long_text_has_the_features_of_its_whole():
    text = "Ein Wort, zwei Wörter! " * 40_000
    x, some = language_id.features([text, text[:-1], "", None, "12 !"])
    assert some.tolist() == [True, True, False, False, False]
    parts, _ = language_id.features([text[: 23 * 100]])
    assert float(x[0] @ parts[0]) > 0.999


def test_language_query(spark):
    langs = dict(table(columns="doc_id, lang", sf=SF))
    rows = queries.op1_language_id(spark, SF).collect()
    assert len(rows) == len(langs)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if r.held_out}
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_languages(spark):
    rows = [(i, "der die das und nicht ein Haus") for i in range(20)] + [(i, "the and of to in a house") for i in range(20, 40)]
    train = spark.createDataFrame([(i, t, "de" if i < 20 else "en") for i, t in rows] + [(90, "", "en"), (91, None, "de"), (None, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    df = awkward(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "das Haus"), (4, "das Haus"), (None, "the house")])
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language_id.predict(df, model).collect())
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de")]
    assert language_id.predict(df.limit(0), model).count() == 0
    none = language_id.predict(df, language_id.fit(train.limit(0))).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in none)
    one = language_id.predict(df, language_id.fit(train.filter("lang = 'en'"))).collect()
    assert {r.lang_pred for r in one} == {"en", "und"}


def test_toxicity_query(spark):
    toxic = dict(table("labels", "doc_id, toxic", sf=SF))
    rows = queries.op6_toxicity(spark, SF).collect()
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([p == 0 for p, y in held if y == 0]) > 0.95
    assert np.mean([p == 1 for p, y in held if y == 1]) > 0.6
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_risk_is_corrected_by_the_prior():
    rng = np.random.default_rng(0)
    toxic = rng.random(4000) < 0.3
    x = np.stack([(rng.random(4000) < np.where(toxic, 0.9, 0.02)), rng.random(4000) < 0.5], 1).astype(np.float32)
    positive = np.zeros(4000, bool)
    positive[np.flatnonzero(toxic)[:400]] = True
    w, b = toxicity.train(x, positive, 0.3)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.mean((p > 0.5) == toxic) > 0.93


def test_awkward_toxicity(spark):
    rows = [(i, "you vile scumbag person") for i in range(40)] + [(i, f"a kind word number {i}") for i in range(40, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(400)] + [(500, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    df = awkward(spark, [(1, None), (2, ""), (3, "so you vile scumbag person"), (4, "a kind word"), (4, "a kind word"), (5, "kind " * 50_000)])
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert got[3] > 0.7 > got[4] and got[1] == got[2] < 0.5 and toxicity.score(df, model).count() == 6
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.score(df, toxicity.fit(docs, labels.limit(0))).agg({"score": "max"}).first()[0] < 0.01
    assert toxicity.score(df, toxicity.fit(docs.limit(0), labels)).count() == 6
    kept = toxicity.score(df, model, keep=True)
    assert kept.columns == [*df.columns, "__toxic_score"]


def hashes(spark, rows):
    """Spark's hash of (id, text) for each row of (id, text)."""
    df = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "n int, doc_id long, text string")
    return [r.h for r in df.selectExpr("n", "xxhash64(doc_id, text) AS h").orderBy("n").collect()]


def grams(text):
    """Counts of hashed character 1- to 3-grams, without arrays."""
    letters = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " ")
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            h = n
            for c in letters[i : i + n]:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            out[(h * 0x9E3779B97F4A7C15 % 2**64) >> 51] += 1
    size = sum(out.values()) ** 0.5
    return {k: v**0.5 / size for k, v in out.items()} if letters.strip() else {}


def dot(a, b):
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def test_language_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(i, t, lang) for i, t, lang in table(columns="doc_id, text, lang", sf=sf)]
    learn = {}
    for (i, t, lang), h in zip(rows, hashes(spark, [r[:2] for r in rows]), strict=True):
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and re.search(r"[^\W\d_]", t or ""):
            learn[lang, h] = t
    languages = sorted({k for k, _ in learn})
    use = [(k, learn[k, h]) for k, h in sorted(learn)]
    assert 2 <= len(languages) <= 7 and max(Counter(k for k, _ in use).values()) <= 500
    # Exhaustive codewords: the first language has ones only, the others count in binary.
    bits = 2 ** (len(languages) - 1) - 1
    code = [[1] * bits] + [[1 - 2 * ((b + 1) >> (len(languages) - 1 - i) & 1) for b in range(bits)] for i in range(1, len(languages))]
    x = [grams(t) for _, t in use]
    y = np.array([code[languages.index(k)] for k, _ in use], float)
    inverse = np.linalg.inv(np.array([[dot(a, b) for b in x] for a in x]) + language_id.RIDGE * np.eye(len(x)))
    alpha = inverse @ y
    right = np.clip(y * (y - alpha / np.diag(inverse)[:, None]), 0, 1)
    weight = np.array([right[[k == lang for k, _ in use]].mean(0) + 1e-3 for lang in languages])
    weight /= weight.sum(1, keepdims=True)
    got = {r.doc_id: r for r in queries.op1_language_id(spark, sf).collect()}
    for i, t, _ in rows:
        f = grams(t)
        if not f:
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        out = np.array([dot(f, a) for a in x]) @ alpha
        loss = [sum(w * max(0.0, 1 - c * v) for w, c, v in zip(weight[k], code[k], out, strict=True)) for k in range(len(languages))]
        near = sorted(range(len(languages)), key=lambda k: (loss[k], k))
        score = 1 / sum(np.exp(-language_id.SHARPNESS * (v - loss[near[0]])) for v in loss)
        assert abs(got[i].score - score) < 1e-3
        assert got[i].lang_pred == languages[near[0]] or abs(loss[near[0]] - loss[near[1]]) < 1e-3


def word_marks(text):
    """Words and beginnings of 3 to 8 bytes: those that are there, and those that are there often."""
    lowered = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", lowered)
    n = Counter(("word", w) for w in words) + Counter(("begins", w[:k]) for w in words for k in range(3, 9) if len(w) >= k)
    rate = sum(n.values()) // (toxicity.LONGEST - toxicity.SHORTEST + 2)
    return set(n), {f for f, c in n.items() if c >= 2 and c * toxicity.OFTEN >= rate}


def test_toxicity_query_against_plain_python(spark):
    sf = SF
    rows = table(columns="doc_id, text", sf=sf)
    readable = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    label = {i: y for i, y in table("labels", "doc_id, toxic", sf=sf) if readable(i) and y is not None}
    prior = min(max(sum(y == 1 for y in label.values()) / len(label), 1e-4), 0.9)
    once = {h: (i, t) for (i, t), h in zip(rows, hashes(spark, rows), strict=True) if readable(i)}
    assert len(once) <= toxicity.UNLABELLED
    marks = [word_marks(t) for _, t in once.values()]
    p = [k for k, (i, _) in enumerate(once.values()) if label.get(i) == 1]
    counts = Counter(f for k in p for f in marks[k][0])
    common = {f for f, n in counts.items() if n >= max(2, int(0.004 * len(p)))}
    assert len(common) <= toxicity.CANDIDATES
    sets = [{(f, 0) for f in there & common} | {(f, 1) for f in often & common} for there, often in marks]
    samples = [sets[k] for k in p] + sets  # the confirmed are unlabelled rows as well
    n_p, n_u = len(p), len(sets)
    a, b = Counter(f for s in samples[:n_p] for f in s), Counter(f for s in sets for f in s)
    ent = lambda k, n, q: k * np.log(max(k, 1e-9) / max(n * q, 1e-9)) + (n - k) * np.log(max(n - k, 1e-9) / max(n * (1 - q), 1e-9))
    gain = {f: 2 * (ent(a[f], n_p, (a[f] + b[f]) / (n_p + n_u)) + ent(b[f], n_u, (a[f] + b[f]) / (n_p + n_u))) for f in a if a[f] * n_u > b[f] * n_p}
    chosen = [f for f, g in gain.items() if g >= 2 * np.log(2 * len(common)) + 4]
    assert 0 < len(chosen) <= toxicity.FEATURES
    x = np.array([[f in s for f in chosen] for s in samples], float)
    xp, xu = x[:n_p], x[n_p:]
    w, bias = np.zeros(len(chosen)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, 401):
        zp, zu = xp @ w + bias, xu @ w + bias
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        up, uu = ((prior * (sp - 1) - prior * sp) / n_p, su / n_u) if negative >= 0 else (prior * sp / n_p, -su / n_u)
        grad = np.append(up @ xp + uu @ xu + 2e-4 * w, up.sum() + uu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, sf).collect()}
    for i, t in rows:
        there, often = word_marks(t)
        s = {(f, 0) for f in there} | {(f, 1) for f in often}
        z = bias + sum(wf for f, wf in zip(chosen, w, strict=True) if f in s)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-z)), abs=5e-3)


def test_hot_and_null_ids_are_drawn_by_text(spark):
    rows = [(None if i % 2 else 0, f"der die das und nicht ein Haus {'abcdefghij'[i % 10]}{i}", "de") for i in range(6000)]
    rows += [(0, "the and of to in a house", "en")] * 4000 + [(5, f"the and of to in a house number {i}", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.languages == ["de", "en"]
    ask = spark.createDataFrame([(1, "das Haus und die"), (2, "in a house and the")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predict(ask, model).orderBy("doc_id").collect()] == ["de", "en"]
    few = language_id.fit(df, per_language=50, max_rows=60)
    assert few.languages == ["de", "en"]


def test_toxic_hot_and_null_ids(spark):
    rows = [(0, f"you vile scumbag person {i}") for i in range(500)] + [(i, f"a kind word number {i}") for i in range(1, 400)] + [(None, "a kind word without id")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 1)] + [(i, 0) for i in range(1, 400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, positives=50, unlabelled=200)
    scores = model.score(["so you vile scumbag person", "a kind word"])
    assert scores[0] > scores[1]
    words = spark.createDataFrame([(f"d{i}", t) for i, t in rows], "doc_id string, text string")
    named = spark.createDataFrame([("d0", 1), ("d1", 0)], "doc_id string, toxic int")
    assert toxicity.score(words, toxicity.fit(words, named, positives=50)).count() == len(rows)
