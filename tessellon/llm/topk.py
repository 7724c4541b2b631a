"""Exact top-k search by columnar branch and bound.

Vectors lie in vertical blocks (dimensions x vectors). Inner products are accumulated some dimensions at a time; what
the remaining dimensions can still add is at most the product of the remaining norms (Cauchy-Schwarz), so candidates
whose bound falls under a query's k-th best score so far are dropped, and the block is compacted to the survivors:
first to the columns that some query still wants, and once few are left to (query, candidate) pairs.

Bounds cross tasks: candidates lie in blocks by falling norm, and each query first meets the block of the largest norms.
Its k-th best score there is where every task starts from, and a candidate block whose largest norm can't reach it for
any query of a group isn't sent to that group at all. Groups of queries and units of candidates hold COMPONENTS numbers
at most, so a table is copied once for each so many queries, not for each block. Nothing is broadcast by hand.

Components are floor(scale * x); sums are exact while dims * max|q| * max|x| < 2**53, else Python integers are used.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do null ids; a query
meets vectors of its own length only; ties go to the smaller id. Rows are told apart by their place in the table: each row
is a candidate for every query row but itself, also where ids or vectors repeat, and rows of one id are queries each.
Scores beyond 64 bits become the largest or smallest long. Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm import kernels
from tessellon.llm.scratch import materialize

ROWS = 1024
STEP = 16
#: Numbers in a group of queries or a unit of candidates, at most; with 64 dimensions, 131,072 vectors.
COMPONENTS = 8 << 20


def _remaining(m: np.ndarray) -> np.ndarray:
    """(dims + 1) x n: norm of each column from a dimension on."""
    tail = np.zeros((len(m) + 1, m.shape[1]))
    tail[:-1] = np.sqrt(np.cumsum(np.square(m[::-1]), axis=0))[::-1]
    return tail * (1 + 1e-12)


def _top(m: np.ndarray) -> float:
    return float(np.abs(m).max(initial=0))


class TopK:
    """The best k of each query of one block. places: tell rows apart. tau: scores that the k-th best reaches at least."""

    def __init__(self, places: np.ndarray, vectors: np.ndarray, k: int, tau: np.ndarray | None = None, step: int = STEP):
        self.places, self.q, self.k, self.step = places, vectors, k, step
        self.tail = _remaining(vectors)
        self.tau = np.full(len(places), -np.inf) if tau is None else tau.copy()
        self.best = np.zeros((0, 4), np.int64)  # query, place, id, score

    def _take(self, query: np.ndarray, places: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        keep = (places != self.places[query]) & (score >= self.tau[query])
        rows = np.concatenate([self.best, np.stack([query[keep], places[keep], ids[keep], score[keep]], 1)])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 2], ~rows[:, 3], rows[:, 0]))]  # ~ turns the order of longs around
        at = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
        self.best = rows[at < self.k]
        last = rows[at == self.k - 1]
        self.tau[last[:, 0]] = np.maximum(self.tau[last[:, 0]], last[:, 3])

    def add(self, places: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """One candidate block, x: dims x vectors."""
        if len(x) * _top(self.q) * _top(x) >= 2**53:
            return self._exact(places, ids, x)
        dims, (tail, q) = len(x), (_remaining(x), self.q)
        rows, cols = np.arange(len(self.places)), np.arange(len(ids))
        part, d = np.zeros((len(rows), len(cols))), 0
        while d < dims:
            e = min(dims, d + self.step)
            part = part + q[d:e][:, rows].T @ x[d:e][:, cols]
            d = e
            alive = part + self.tail[d][rows, None] * tail[d][None, cols] + 1e-6 >= self.tau[rows, None]
            n = np.count_nonzero(alive)
            if n * 8 < alive.size or d == dims:
                i, j = np.nonzero(alive)
                return self._pairs(rows[i], cols[j], part[i, j], d, places, ids, x, tail)
            r, c = alive.any(1), alive.any(0)
            if np.count_nonzero(r) * np.count_nonzero(c) < 0.7 * alive.size:
                part, rows, cols = part[np.ix_(r, c)], rows[r], cols[c]

    def _pairs(self, i: np.ndarray, j: np.ndarray, part: np.ndarray, d: int, places: np.ndarray, ids: np.ndarray, x: np.ndarray, tail: np.ndarray) -> None:
        while d < len(x) and len(i):
            e = min(len(x), d + self.step)
            part = part + np.einsum("ij,ij->j", self.q[d:e][:, i], x[d:e][:, j])
            d = e
            keep = part + self.tail[d][i] * tail[d][j] + 1e-6 >= self.tau[i]
            i, j, part = i[keep], j[keep], part[keep]
        self._take(i, places[j], ids[j], np.rint(part).astype(np.int64))

    def _exact(self, places: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Beyond exact float sums: Python integers, one query at a time."""
        xs = [[int(v) for v in col] for col in x.T]
        for i in range(len(self.places)):
            q = [int(v) for v in self.q[:, i]]
            score = np.array([max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=True)))) for c in xs], np.int64)
            self._take(np.full(len(ids), i), places, ids, score)


def blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """(block, dims, norm, places, ids, m): vectors (place, id, dims, norm, v) in stored blocks by falling norm."""
    n = vectors.count()
    order = [F.col("dims"), F.desc("norm"), F.col("place")]
    ranged = vectors.repartitionByRange(max(1, -(-n // (4 * rows))), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple] = []  # (places, ids, norms, vectors x dims) of one number of dimensions

        def block() -> pa.RecordBatch:
            places, ids, norms, m = (np.concatenate(x) for x in zip(*have, strict=True))
            kind = next((t for t in (np.int8, np.int16, np.int32) if _top(m) <= np.iinfo(t).max), np.float64)
            data = [[m.shape[1]], [float(norms.max())], [places.astype("<i8").tobytes()], [ids.astype("<i8").tobytes()], [np.dtype(kind).str], [np.ascontiguousarray(m.T).astype(kind).tobytes()]]
            have.clear()
            return pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, (pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.string(), pa.binary()), strict=True)], names=["dims", "norm", "places", "ids", "kind", "m"])

        for batch in batches:
            place, own, dims, norm = (batch.column(i).to_numpy() for i in range(4))
            v = batch.column(4).flatten().to_numpy()
            first = np.cumsum(dims) - dims
            s = 0
            while s < len(dims):
                if have and have[0][3].shape[1] != dims[s]:
                    yield block()
                e = s + int(np.searchsorted(dims[s:], dims[s], "right"))
                e = min(e, s + rows - sum(len(h[0]) for h in have))
                have.append((place[s:e], own[s:e], norm[s:e], v[first[s] : first[e - 1] + dims[s]].reshape(e - s, dims[s]).copy()))
                if sum(len(h[0]) for h in have) >= rows:
                    yield block()
                s = e
        if have:
            yield block()

    out = ranged.select("place", "id", "dims", "norm", "v").mapInArrow(kernels.trimmed(run), "dims int, norm double, places binary, ids binary, kind string, m binary")
    return materialize(out.withColumn("block", F.monotonically_increasing_id()), name)


def _read(places: bytes, ids: bytes, kind: str, m: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = np.frombuffer(places, "<i8")
    return p, np.frombuffer(ids, "<i8"), np.frombuffer(m, kind).reshape(-1, len(p)).astype(np.float64)


def seeded(queries: DataFrame, cand: DataFrame, k: int) -> DataFrame:
    """Stored query blocks with tau, the k-th best score of each query among the candidates of the largest norms, and need: a
    candidate of a smaller norm can't reach it for any query of the block."""
    whole = F.struct("places", "ids", "kind", "m")
    first = cand.groupBy("dims").agg(F.max_by(whole, F.struct("norm", -F.col("block"))).alias("seed"))
    both = queries.join(first, "dims").select(*queries.columns, "seed.places", "seed.ids", "seed.kind", "seed.m")
    names = ["dims", "block", "places", "ids", "kind", "m", "tau", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = dict(zip(names, row[:6], strict=False))
                places, _, m = _read(q["places"], q["ids"], q["kind"], q["m"])
                seed_places, seed_ids, x = _read(*row[6:])
                own = TopK(places, m, k)
                if len(m) * _top(m) * _top(x) < 2**53:
                    own.add(seed_places, seed_ids, x)
                norm = own.tail[0]
                need = np.where(own.tau > 0, own.tau / np.maximum(norm, 1e-300), 0).min(initial=np.inf) * (1 - 1e-9)
                data = [*row[:6], own.tau.astype("<f8").tobytes(), float(need)]
                types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([d], t) for d, t in zip(data, types, strict=True)], names=names)

    out = both.toDF("dims", "block", "places", "ids", "kind", "m", "sp", "si", "sk", "sm")
    return materialize(out.mapInArrow(kernels.trimmed(run), "dims int, block long, places binary, ids binary, kind string, m binary, tau binary, need double"), "seeded")


def search(table: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = ROWS, components: int = COMPONENTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k best. is_query: over id_col."""
    ok = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = lambda y: F.when(F.abs(y) >= 2.0**53, y).otherwise(F.floor(y).cast("double"))
    x = table.filter(ok).select(
        F.monotonically_increasing_id().alias("place"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.size(vector_col).alias("dims"), F.transform(vector_col, lambda v: whole(v.cast("double") * scale)).alias("v"),
    )
    x = materialize(x.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v))), "vectors")
    sizes = x.groupBy("dims").agg(F.count("*").alias("n"), F.count_if("is_query").alias("n_query"))
    tasks = 2 * table.sparkSession.sparkContext.defaultParallelism
    # So many units as the numbers ask for, and more while there are idle tasks and four blocks for each.
    spread = F.least(F.lit(tasks), F.ceil(F.col("n") / (4 * rows)))
    parts = sizes.select("dims", F.greatest(spread, F.ceil(F.col("n") * F.col("dims") / components)).cast("int").alias("units"), F.greatest(F.lit(1), F.ceil(F.col("n_query") * F.col("dims") / components)).cast("int").alias("groups"))
    parts = materialize(parts, "parts")

    cand = blocks(x, rows, "candidates")
    quer = seeded(blocks(x.filter("is_query"), rows, "queries").select("dims", "block", "places", "ids", "kind", "m"), cand, k)
    dealt = lambda by: F.pmod(F.xxhash64("block"), F.col(by)).cast("int")
    quer = quer.join(parts, "dims").withColumn("group", dealt("groups"))
    needs = materialize(quer.groupBy("dims", "group").agg(F.min("need").alias("least")), "needs")
    cand = cand.join(parts, "dims").withColumn("unit", dealt("units")).join(needs, "dims").filter("norm >= least")
    quer = quer.withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 5), np.int64)]
        for r in q.itertuples() if len(c) else ():
            places, ids, m = _read(r.places, r.ids, r.kind, r.m)
            own = TopK(places, m, k, np.frombuffer(r.tau, "<f8"))
            for s in c.sort_values("norm", ascending=False).itertuples():
                if (s.norm * own.tail[0] * (1 + 1e-9) + 1e-6 >= own.tau).any():
                    own.add(*_read(s.places, s.ids, s.kind, s.m))
            i = own.best[:, 0]
            found.append(np.stack([places[i], ids[i], *own.best[:, 1:].T], 1))
        return pd.DataFrame(np.concatenate(found), columns=["place", "query_id", "other", "vec_id", "score"])

    key, block = ["dims", "group", "unit"], ["places", "ids", "kind", "m"]
    left = quer.select(*key, *block, "tau").groupBy(*key)
    met = left.cogroup(cand.select(*key, *block, "norm").groupBy(*key)).applyInPandas(meet, "place long, query_id long, other long, vec_id long, score long")
    best = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id", "other")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.place, c.vec_id, c.place AS other, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.place <> c.place AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id, other)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
