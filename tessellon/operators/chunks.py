"""Digests of files too large for one row: files are read as ranges, each range is hashed on its own, and the ranges' digests
are folded in order. The ranges of a file go to many tasks; what meets in one place is 16 or 24 bytes a range."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessellon.functions import jvm, kernels


def ranges(files: DataFrame, size: int = kernels.ED2K_CHUNK) -> DataFrame:
    """(path, length, idx, start, n) of ranges of files: path, length. An empty file has one empty range."""
    last = F.greatest(F.ceil(F.col("length") / size).cast("long") - 1, F.lit(0))
    out = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("idx")).withColumn("start", F.col("idx") * size)
    return out.withColumn("n", F.least(F.lit(size).cast("long"), F.col("length") - F.col("start")))


def read_ranges(rows: DataFrame) -> DataFrame:
    """rows with content, read from a folder that all executors share; ranges are dealt over the tasks."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, content binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                with open(row.path.removeprefix("file://"), "rb") as f:
                    os.lseek(f.fileno(), row.start, os.SEEK_SET)
                    yield pd.DataFrame([(*row, f.read(row.n))], columns=[*batch.columns, "content"])

    return rows.repartition("path", "idx").mapInPandas(run, schema)


def _each(name: str, many) -> Callable:
    """A digest of a column: in the JVM where there is one, else by a kernel."""
    if jvm.available():
        return lambda c: jvm.of_content(F.col(c) if isinstance(c, str) else c, name)

    @F.pandas_udf(BinaryType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(many([bytes(v) for v in x]), dtype=object)

    return run


def _folded(parts: DataFrame) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.hex("part").alias("h")))), lambda p: p["h"]), "")


def ed2k(parts: DataFrame) -> DataFrame:
    """(path, red, blue) from ranges of ED2K's chunk size: path, length, idx, content."""
    md4 = _each("MD4", kernels.md4)
    one = parts.select("path", "length", "idx", md4("content").alias("part"))
    both = one.groupBy("path", "length").agg(F.unhex(_folded(one)).alias("all"), F.min_by("part", "idx").alias("first"))
    whole = (F.col("length") % kernels.ED2K_CHUNK == 0) & (F.col("length") > 0)
    many = F.col("length") > kernels.ED2K_CHUNK
    tail = F.when(whole, F.unhex(F.lit(kernels.md4([b""])[0].hex()))).otherwise(F.lit(b""))
    red = F.when(many | whole, md4(F.concat("all", tail))).otherwise(F.col("first"))
    blue = F.when(whole, F.when(many, md4(F.col("all"))).otherwise(F.col("first")))
    return both.select("path", red.alias("red"), blue.alias("blue"))


def tth(parts: DataFrame, size: int) -> DataFrame:
    """(path, tth) from ranges of a size that is 1024 times a power of two: each range is a whole subtree."""
    if size & (size - 1) or size < 1024:
        raise ValueError("ranges must be 1024 times a power of two")
    one = parts.select("path", "idx", _each("TTH", kernels.tth)("content").alias("part"))
    both = one.groupBy("path").agg(F.unhex(_folded(one)).alias("all"))

    @F.pandas_udf(BinaryType())
    def fold(x: pd.Series) -> pd.Series:
        out = []
        for v in x:
            level = [bytes(v)[i : i + 24] for i in range(0, len(v), 24)]
            while len(level) > 1:
                level = kernels.tiger([b"\1" + level[k] + level[k + 1] for k in range(0, len(level) - 1, 2)]) + level[len(level) // 2 * 2 :]
            out.append(level[0])
        return pd.Series(out, dtype=object)

    return both.select("path", fold("all").alias("tth"))
