"""Document fingerprints by a threshold-scaled sketch: every shingle hash below a fixed fraction of the range is kept.

What is kept depends on the hash alone, so sketches of parts merge by union, and the containment of a short text in a long
one can be estimated. A fingerprint reads ``count.digest.sketch``: the number of distinct shingles, a digest of all of
them, and the kept 48-bit hashes in order, six bytes each, in base 64. Shingles are five words, A-Z lower-cased.

Defined results: null is an empty text, which has no shingle; fewer than five words are one shingle; very long texts are
fingerprinted whole, their words in chunks. Two fingerprints with no kept hash are alike (1.0) if their counts and digests are
equal and unlike (0.0) otherwise. Rows in order: by id, null ids first, then by the text's 64-bit hash, then by their place
in the table, so that rows of one id, and copies of one row, can be dealt to several tasks. Repeated rows each get their own
next row. Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessellon.llm import kernels

WORDS = 5
FRACTION = 0.2


def sketches(texts, k: int = WORDS, fraction: float = FRACTION) -> list[tuple[str, np.ndarray]]:
    """(fingerprint, kept hashes) of each text."""
    n = len(texts)
    value, bounds = kernels.distinct(*kernels.shingles(*kernels.words(texts), k), n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernels.mix(value), dtype=np.uint64)])
    digest = total[bounds[1:]] - total[bounds[:-1]]
    short = value >> np.uint64(16)
    keep = short < np.uint64(int(fraction * (1 << 48)))
    kept = short[keep]
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[bounds]
    raw = kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    out = []
    for i in range(n):
        s, e = int(at[i]), int(at[i + 1])
        text = f"{bounds[i + 1] - bounds[i]}.{int(digest[i]):016x}.{base64.b64encode(raw[6 * s : 6 * e]).decode()}"
        out.append((text, kept[s:e]))
    return out


def parse(fingerprint: str) -> np.ndarray:
    """The kept hashes of a fingerprint."""
    raw = np.frombuffer(base64.b64decode(fingerprint.split(".")[2]), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").ravel().astype(np.uint64)


def containment(part: np.ndarray, whole: np.ndarray) -> float:
    """Estimated share of part's shingles that whole has; 0 for an empty sketch."""
    return len(np.intersect1d(part, whole, True)) / len(part) if len(part) else 0.0


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if a[0] == b[0]:
        return 1.0
    common = len(np.intersect1d(a[1], b[1], True))
    union = len(a[1]) + len(b[1]) - common
    return common / union if union else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """(id, fingerprint) of every document; no shuffle."""
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = small.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [x[0] for x in sketches(batch.column(1), k, fraction)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=[id_col, "fingerprint"])

    return small.mapInArrow(kernels.trimmed(run), f"`{id_col}` {id_type}, fingerprint string")


#: Keys that the driver gets for each bucket, on average, to find the buckets' bounds.
SAMPLED = 32


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, flag, id, h, v, text): buckets are ranges of (id, h: hash of the text, v: hash of the place in the table); each also
    holds the row that follows it (flag 1; 2: the first row after the last).

    One shuffle of the texts, dealt by bucket; only one row a bucket goes twice. Bounds come from a sample of keys whose size
    is a parameter, so a hot id, many null ids or a hot row take as many buckets as their share asks for. docs is read three
    times and must have the same rows in the same places each time, as a table has.
    """
    v = F.xxhash64(F.monotonically_increasing_id())  # a bijection: no two rows share it
    small = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), v.alias("v")).withColumn("h", F.xxhash64("text"))
    n = max(16, 4 * int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = small.select("id", "h", "v")
    share = min(1.0, SAMPLED * n / max(1, keys.count()))
    known = lambda pdf: (pdf["id"].isna().to_numpy() ^ True, pdf["id"].fillna(0).to_numpy(np.int64), pdf["h"].to_numpy(np.int64), pdf["v"].to_numpy(np.int64))
    sample = known(keys.filter(F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30)).toPandas().astype({"id": "Int64"}))
    ordered = np.lexsort(sample[::-1])
    picks = ordered[np.unique(np.linspace(0, len(ordered) - 1, n + 1).astype(int)[1:-1])] if len(ordered) else ordered
    bounds = [c[picks] for c in sample]

    def places(id_: pd.Series, h: pd.Series, v_: pd.Series) -> np.ndarray:
        """How many bounds stand at each key or before it."""
        own = known(pd.DataFrame({"id": id_.astype("Int64"), "h": h, "v": v_}))
        both = [np.concatenate([b, o]) for b, o in zip(bounds, own, strict=True)]
        order = np.lexsort([np.arange(len(both[0])), *both[::-1]])  # a bound before its equal
        seen = np.cumsum(order < len(picks))
        out = np.zeros(len(order), np.int32)
        out[order] = seen
        return out[len(picks) :]

    @F.pandas_udf(IntegerType())
    def bucket(id_: pd.Series, h: pd.Series, v_: pd.Series) -> pd.Series:
        return pd.Series(places(id_, h, v_))

    least = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "h", "v")).alias("least")
    first = {r["b"]: (r["least"]["id"], r["least"]["h"], r["least"]["v"]) for r in keys.groupBy(bucket("id", "h", "v").alias("b")).agg(least).collect()}
    there = sorted(first)
    before = {first[b][2]: (there[i - 1], 2 if i == 0 else 1) for i, b in enumerate(there)}  # by v of a bucket's first row
    goals = ArrayType(StructType([StructField("bucket", IntegerType()), StructField("flag", IntegerType())]))

    @F.pandas_udf(goals)
    def targets(id_: pd.Series, h: pd.Series, v_: pd.Series) -> pd.Series:
        own = places(id_, h, v_).tolist()
        more = [before.get(x) for x in v_.tolist()]
        return pd.Series([[{"bucket": b, "flag": 0}] + ([{"bucket": m[0], "flag": m[1]}] if m else []) for b, m in zip(own, more, strict=True)])

    dealt = small.select("id", "h", "v", "text", F.explode(targets("id", "h", "v")).alias("t")).select("t.bucket", "t.flag", "id", "h", "v", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "flag", F.col("id").asc_nulls_first(), "h", "v")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Each document's fingerprint, that of its text with the last half replaced by the next one's beginning, and how alike its
    fingerprint is to that and to the next document's."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, flag, id, text, sketch) of the row before
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                bucket, flag, ids = (part.column(i).to_pylist() for i in range(3))
                texts = part.column(5).to_pylist()
                rows = list(zip(bucket, flag, ids, texts, sketches(texts, k, fraction), strict=True))
                pairs = [(a, b) for a, b in zip(([last] if last else []) + rows[:-1], rows if last else rows[1:], strict=True) if not a[1]]
                last = rows[-1] if rows else last
                edited = []
                for a, b in pairs:
                    half = len(a[3]) // 2
                    edited.append(a[3][: len(a[3]) - half] + b[3][:half])
                new = sketches(edited, k, fraction)
                out = [[], [], [], [], [], [], []]
                for (a, b), text, e in zip(pairs, edited, new, strict=True):
                    row = (a[2], len(a[3]), hashlib.sha256(text.encode()).hexdigest(), a[4][0], e[0], likeness(a[4], e), likeness(a[4], b[4]))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    schema = f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = in_order(docs, id_col, text_col).mapInArrow(kernels.trimmed(run), schema)
    return out.withColumn(id_col, F.col(id_col).cast(id_type))
