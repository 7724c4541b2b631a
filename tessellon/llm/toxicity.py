"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on words and word beginnings (3 to 8 bytes, hashed) is trained in numpy from confirmed toxic texts and
unlabelled ones. The risk of the unlabelled as negatives is corrected by the class prior: pi * R_p(+) +
max(0, R_u(-) - pi * R_p(-)); where the corrected part turns negative, the step goes the other way, so that the
classifier doesn't take the toxic texts among the unlabelled for clean ones.

The fit reads at most `positives` toxic texts and `unlabelled` others, those with the least hashes of (id, text), where
rows that repeat both count once, and at most FEATURES features; the prior is the toxic share of the rows whose label may
be read. Scoring reads every whole text; very long ones go through the kernels in chunks.

Defined results: null is an empty text; empty texts have the score of no features; without any confirmed toxic text all
scores are the prior (0 without labels); an id with several labels is toxic if one of them says so; null ids have no label
and are unlabelled; ties among features go by hash; repeated rows are scored each; other columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm import kernels
from tessellon.llm.scratch import materialize, small_batches

POSITIVES = 1500
UNLABELLED = 3000
CANDIDATES = 50_000
FEATURES = 2048
LONGEST = 8
SHORTEST = 3
OFTEN = 300
THRESHOLD = 0.7


def word_features(texts) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, text index) of every word and word beginning, with repeats."""
    data, _ = kernels.buffers(texts)
    whole, first, begin, end = kernels.words(texts, spans=True)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    value, at = [kernels.mix(whole + np.uint64(1))], [doc]
    acc = np.zeros(len(begin), np.uint64)
    lower = kernels._LOWER
    for n in range(1, LONGEST + 1):
        ok = end - begin >= n
        acc, begin, end, doc = acc[ok], begin[ok], end[ok], doc[ok]
        acc = acc * np.uint64(0x100000001B3) + lower[data[begin + n - 1]] + np.uint64(1)
        if n >= SHORTEST:
            value.append(kernels.mix(acc * np.uint64(16) + np.uint64(n)))
            at.append(doc)
    return np.concatenate(value), np.concatenate(at)


class Known:
    """Finds which of a set of feature hashes occur, through a bitmap first."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.map = np.zeros(1 << 20, bool)
        self.map[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text index, feature), in order. Feature k: hash k is there; k + number of hashes: it is there at least
        twice and once in OFTEN words."""
        value, doc = word_features(texts)
        words = np.bincount(doc, minlength=len(texts)) // (LONGEST - SHORTEST + 2) if len(doc) else np.zeros(len(texts), int)
        hit = self.map[(value >> np.uint64(44)).astype(np.int64)]
        value, doc = value[hit], doc[hit]
        k = np.minimum(np.searchsorted(self.sorted, value), max(len(self.sorted) - 1, 0))
        same = self.sorted[k] == value if len(self.sorted) else np.zeros(len(value), bool)
        both, n = np.unique(doc[same] * (1 << 32) + self.order[k[same]], return_counts=True)
        often = both[(n >= 2) & (n * OFTEN >= words[both >> 32])] + len(self.sorted)
        both = np.sort(np.concatenate([both, often]))
        return both >> 32, both & 0xFFFFFFFF


def train(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of the non-negative risk with the logistic loss, by Adam over all rows."""
    xp, xu = x[positive], x[~positive]
    if not len(xu):
        xu = xp[:0]
    w, b = np.zeros(x.shape[1] + 1), np.log(prior / (1 - prior))
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        negative = np.logaddexp(0, zu).mean() if len(zu) else 0.0
        corrected = negative - prior * np.logaddexp(0, zp).mean()
        gp, gu = sig(zp) / len(zp), sig(zu) / max(len(zu), 1)
        down = (sig(zp) - 1) / len(zp) * prior  # the confirmed as positives
        if corrected >= 0:
            cp, cu = down - prior * gp, gu
        else:
            cp, cu = prior * gp, -gu
        grad = np.append(cp @ xp + cu @ xu + decay * w[:-1], cp.sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


class Model:
    """Weights by feature hash."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.known, self.weights, self.bias = Known(hashes), weights, bias

    def score(self, texts) -> np.ndarray:
        doc, k = self.known.find(texts)
        z = np.bincount(doc, self.weights[k], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model:
    """docs: doc_id, text, the rows that may be learned from; labels: doc_id, toxic, likewise."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    n, toxic = known.agg(F.count("toxic"), F.count_if(F.col("toxic") == 1)).first()
    if not n:
        return none
    prior = min(max(toxic / n, 1e-4), 0.9)
    base = float(np.log(prior / (1 - prior)))
    if not toxic:
        return none
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("at"))
    share = lambda most, n: min(1.0, 2 * most / max(n, 1) + 40 / max(n, 1)) * (1 << 40)
    near = lambda k: F.pmod(F.xxhash64("at", F.lit(k)), F.lit(1 << 40))

    def drawn(hashes: DataFrame, most: int, k: int) -> DataFrame:
        """At most `most` of the distinct hashes; which, depends on them alone. Few more than that are ranked."""
        hashes = materialize(hashes.distinct(), "hashes")
        few = hashes.filter(near(k) < share(most, hashes.count()))
        return materialize(few.orderBy(near(k), "at").limit(most), "drawn")

    marked = known.filter("toxic = 1").select("doc_id").distinct()
    confirmed = drawn(rows.select("doc_id", "at").join(marked, "doc_id", "left_semi").select("at"), positives, 5)
    others = drawn(rows.select("at"), unlabelled, 6)
    both = confirmed.withColumn("p", F.lit(True)).join(others.withColumn("u", F.lit(True)), "at", "full")
    both = materialize(both.select("at", F.coalesce("p", F.lit(False)).alias("p"), F.coalesce("u", F.lit(False)).alias("u")), "both")
    # At most positives + unlabelled hashes are broadcast; copies meet before the shuffle.
    sample = rows.join(F.broadcast(both), "at").groupBy("at", "p", "u").agg(F.first("text").alias("text"))
    sample = materialize(sample.select("p", "u", "text"), "sample")
    n_ids = confirmed.count()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                value, doc = word_features(batch.column(0)[s : s + 256])
                value, _ = kernels.distinct(value, doc, 256)
                value, n = np.unique(value, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["f", "n"])

    least = max(2, int(0.004 * n_ids))
    common = sample.filter("p").select("text").mapInArrow(kernels.trimmed(own), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    with small_batches(docs.sparkSession):
        top = common.orderBy(F.desc("n"), "f").limit(CANDIDATES).collect()
    if not top:
        return Model(np.zeros(0, np.uint64), np.zeros(0), base)
    hashes = np.array([r["f"] for r in top], np.int64).view(np.uint64)
    finder = Known(hashes)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                doc, k = finder.find(part.column(2))
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                found = [k[at[i] : at[i + 1]].astype(np.uint32).tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["p", "u", "k"])

    with small_batches(docs.sparkSession):
        got = sample.mapInArrow(kernels.trimmed(present), "p boolean, u boolean, k binary").collect()
    got.sort(key=lambda r: (r["p"], r["u"], bytes(r["k"])))
    ones = [(True, np.frombuffer(r["k"], np.uint32)) for r in got if r["p"]] + [(False, np.frombuffer(r["k"], np.uint32)) for r in got if r["u"]]
    p = np.array([x for x, _ in ones])
    count = lambda which: np.bincount(np.concatenate([k for x, k in ones if x == which] or [np.zeros(0, int)]).astype(np.int64), minlength=2 * len(hashes))
    a, b = count(True).astype(float), count(False).astype(float)
    n_p, n_u = p.sum(), max((~p).sum(), 1)
    pooled = (a + b) / (n_p + n_u)
    fit_of = lambda k, n, q: k * np.log(np.maximum(k, 1e-9) / np.maximum(n * q, 1e-9))
    part = lambda k, n: fit_of(k, n, pooled) + fit_of(n - k, n, 1 - pooled)
    gain = np.where(a * n_u > b * n_p, 2 * (part(a, n_p) + part(b, n_u)), 0)  # likelihood ratio of two shares against one
    chosen = np.argsort(-gain, kind="stable")[: min(features, len(gain))]
    sure = gain[chosen] >= 2 * np.log(2 * len(hashes)) + 4  # beyond what chance gives among so many
    chosen = chosen[sure] if sure.any() else chosen[:16]
    place = np.full(2 * len(hashes), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(ones), len(chosen)), np.float32)
    for i, (_, k) in enumerate(ones):
        j = place[k]
        x[i, j[j >= 0]] = 1
    w, b = train(x, p, prior)
    both = np.zeros(2 * len(hashes))
    both[chosen] = w
    used = np.unique(chosen % len(hashes))
    return Model(hashes[used], np.concatenate([both[used], both[used + len(hashes)]]), b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, score) of every document; with keep all columns of docs and __toxic_score. No shuffle."""
    small = docs if keep else docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    text = text_col if keep else "_text"
    names = docs.columns if keep else [id_col]
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([small.schema[c] for c in names]).add("__toxic_score" if keep else "score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                columns = [part.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(part.column(at)))], names=[f.name for f in schema])

    return small.mapInArrow(kernels.trimmed(run), schema)
