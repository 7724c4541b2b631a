"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier a bit is trained on hashed character 1- to 3-grams (regularised least
squares in numpy). A text goes to the language whose codeword has the least weighted loss: the loss of each bit is
weighted by how well that bit's classifier tells that language on rows left out of its fit. A text whose two best
languages are close is flagged as ambiguous.

Up to seven languages have the exhaustive code, more of them random dense codewords with the largest least distance found.
The fit reads at most `per_language` rows a language and MAX_ROWS in all, those with the least hashes of (id, text), where
rows that repeat both count once; the prediction reads every whole text, long ones in slices.

Defined results: null texts and texts without a letter are `und` with score 0 and are not learned from; with no row to
learn from, all are `und`; repeated rows are predicted each; a null id is never held out; of equally near codewords the
first language by name is taken, and the text is ambiguous; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm import kernels
from tessellon.llm.scratch import materialize, small_batches

BUCKETS = 8192
PER_LANGUAGE = 500
MAX_ROWS = 4000
SLICE = 1 << 19
RIDGE = 0.05
SHARPNESS = 6.0
AMBIGUOUS = 0.1
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit length: roots of n-gram counts, whether a text has a letter). Non-letters are one blank each run."""
    letter, out, some = _letters(), np.zeros((len(texts), BUCKETS), np.float32), np.zeros(len(texts), bool)
    lowered = [(t or "").lower() for t in texts]
    s = 0
    while s < len(texts):
        e, size = s, 0
        while e < len(texts) and (e == s or size + len(lowered[e]) < SLICE):
            size += len(lowered[e])
            e += 1
        code = np.frombuffer((" ".join(lowered[s:e]) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(e - s), [len(t) + 1 for t in lowered[s:e]])
        counts = np.zeros((e - s) * BUCKETS, np.float32)
        for a in range(0, len(code), SLICE):  # a longer text goes in slices
            c, d = code[max(0, a - 2) : a + SLICE], doc[max(0, a - 2) : a + SLICE]
            c = np.where(letter[c], c, np.uint32(32)).astype(np.uint64)
            some[s + np.unique(d[c != 32])] = True
            keep = np.ones(len(c), bool)
            keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (d[1:] != d[:-1])
            c, d = c[keep], d[keep]
            lead = int(np.count_nonzero(keep[: min(2, a)])) if a else 0
            for n in (1, 2, 3):
                if len(c) < n:
                    continue
                h = np.full(len(c) - n + 1, n, np.uint64)
                for i in range(n):
                    h = h * np.uint64(0x100000001B3) + c[i : len(c) - n + 1 + i]
                h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)
                same = d[n - 1 :] == d[: len(d) - n + 1]
                same[: max(0, lead - n + 1)] = False
                at = d[n - 1 :][same] * BUCKETS + h[same].astype(np.int64)
                if len(at):
                    counts += np.bincount(at, minlength=len(counts)).astype(np.float32)
        x = np.sqrt(counts).reshape(e - s, BUCKETS)
        out[s:e] = x / np.maximum(np.sqrt(np.square(x).sum(1, keepdims=True)), 1e-9)
        s = e
    return out, some


def codewords(k: int) -> np.ndarray:
    """k x bits of -1 and 1."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 7:
        bits = np.arange(1, 2 ** (k - 1))
        rest = (bits[None, :] >> np.arange(k - 2, -1, -1)[:, None]) & 1
        return np.concatenate([np.ones((1, len(bits))), 1 - 2.0 * rest])
    best, rng, n = None, np.random.default_rng(7), int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (k, n))
        gram = m @ m.T - 2 * n * np.eye(k)
        far = (n - gram.max()) / 2
        if (np.abs(m.sum(0)) < k).all() and (best is None or far > best[0]):
            best = (far, m)
    return best[1]


class Codes:
    """The fitted classifiers and the decoding of their outputs."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        self.code = codewords(len(self.languages))
        y = self.code[[self.languages.index(v) for v in labels]] if labels else np.zeros((0, 0))
        self.w, self.weight = np.zeros((BUCKETS, self.code.shape[1]), np.float32), np.ones_like(self.code)
        if y.size:
            gram = (x @ x.T).astype(np.float64) + RIDGE * np.eye(len(x))
            inverse = np.linalg.inv(gram)
            alpha = inverse @ y
            self.w = (x.T @ alpha.astype(np.float32)).astype(np.float32)
            left_out = y - alpha / np.diag(inverse)[:, None]
            right = np.clip(y * left_out, 0, 1)
            of = np.array([self.languages.index(v) for v in labels])
            self.weight = np.stack([right[of == i].mean(0) for i in range(len(self.languages))]) + 1e-3
            self.weight /= self.weight.sum(1, keepdims=True)

    def decode(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, score, margin to the next) of the classifiers' outputs f, n x bits."""
        if len(self.languages) == 1:
            return np.zeros(len(f), int), np.ones(len(f)), np.ones(len(f))
        loss = np.maximum(0, 1 - self.code[None] * f[:, None, :])
        d = (self.weight[None] * loss).sum(2)
        order = np.argsort(d, 1, kind="stable")
        two = np.take_along_axis(d, order[:, :2], 1)
        p = np.exp(-SHARPNESS * (d - two[:, :1]))
        return order[:, 0], 1 / p.sum(1), two[:, 1] - two[:, 0]


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> Codes:
    """rows: doc_id, text, lang. Per language, the rows with the least hashes of (doc_id, text) are learned from.

    However often an id, a null id or a text repeats, at most max_rows rows (or one a language) come to the driver: distinct
    hashes are drawn and ranked before any text is read.
    """
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.xxhash64("doc_id", "text").alias("at"), "text")
    sizes = {r["lang"]: r["count"] for r in rows.select("lang", "at").distinct().groupBy("lang").count().collect()}
    if not sizes:
        return Codes(np.zeros((0, BUCKETS), np.float32), [])
    most = max(1, min(per_language, max_rows // len(sizes)))
    # Twice the share, and some, leaves enough in all but vanishing cases; the rank then takes as many as asked.
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, 2 * most / n + 40 / n))])
    drawn = rows.filter(F.pmod("at", F.lit(1 << 40)) < share[F.col("lang")] * (1 << 40)).select("lang", "at").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    drawn = materialize(drawn.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank"), "drawn")
    picked = rows.join(F.broadcast(drawn), ["lang", "at"], "left_semi")  # at most max_rows rows, or one a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                x, some = features(part.column(2).to_pylist())
                index = [np.flatnonzero(r).astype(np.uint16) for r in x]
                value = [x[i, k].astype(np.float32).tobytes() for i, k in enumerate(index)]
                data = [part.column(0), part.column(1), pa.array(some), pa.array([k.tobytes() for k in index]), pa.array(value)]
                yield pa.RecordBatch.from_arrays(data, names=["lang", "at", "some", "index", "value"])

    found = picked.mapInArrow(kernels.trimmed(run), "lang string, at long, some boolean, index binary, value binary").filter("some")
    found = found.groupBy("lang", "at").agg(F.min("index").alias("index"), F.min("value").alias("value"))  # copies are alike
    with small_batches(rows.sparkSession):
        use = sorted(found.collect(), key=lambda r: (r["lang"], r["at"]))
    x = np.zeros((len(use), BUCKETS), np.float32)
    for i, r in enumerate(use):
        x[i, np.frombuffer(r["index"], np.uint16)] = np.frombuffer(r["value"], np.float32)
    return Codes(x, [r["lang"] for r in use])


def predict(docs: DataFrame, model: Codes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, margin, ambiguous) of every document; no shuffle."""
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = small.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                x, some = features(part.column(1).to_pylist())
                if not model.languages:
                    some[:] = False
                    best, score, margin = np.zeros(len(x), int), np.zeros(len(x)), np.zeros(len(x))
                else:
                    best, score, margin = model.decode(x @ model.w)
                names = [model.languages[b] if ok else "und" for b, ok in zip(best, some, strict=True)]
                score, margin = np.where(some, score, 0.0), np.where(some, margin, 0.0)
                data = [part.column(0), pa.array(names, pa.string()), pa.array(score.astype(float)), pa.array(margin.astype(float)), pa.array(margin < AMBIGUOUS)]
                yield pa.RecordBatch.from_arrays(data, names=[id_col, "lang_pred", "score", "margin", "ambiguous"])

    return small.mapInArrow(kernels.trimmed(run), f"`{id_col}` {id_type}, lang_pred string, score double, margin double, ambiguous boolean")


def held_out(n: int, rest: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n, is rest."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n == rest, F.lit(False))
