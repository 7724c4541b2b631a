"""Files as rows: listing, reading, and streams of nothing for measuring."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, length long, ord long"


def walk(entries: Iterable[str], recursive: bool = True) -> tuple[list[tuple[str, int, int]], list[str]]:
    """((path, length, order) of files, entries that aren't there): explicit files first as given, then folders depth first,
    names in the order of their bytes; links are followed. Empty files are listed too."""
    files, missing, folders, seen = [], [], [], set()
    for e in entries:
        (files if os.path.isfile(e) else folders if os.path.isdir(e) else missing).append(e)

    def go(folder: str) -> None:
        real = os.path.realpath(folder)
        if real in seen:
            return
        seen.add(real)
        inside = sorted(os.scandir(folder), key=lambda x: os.fsencode(x.name))
        files.extend(x.path for x in inside if x.is_file())
        if recursive:
            for x in inside:
                if x.is_dir():
                    go(x.path)

    for f in folders:
        go(f)
    return [(p, os.path.getsize(p), i) for i, p in enumerate(files)], missing


def listed(spark: SparkSession, entries: Iterable[str], recursive: bool = True) -> DataFrame:
    """The files of a folder that the driver sees, as rows."""
    return spark.createDataFrame(walk(entries, recursive)[0], FILES)


def read(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """(path, length, content) of the files in any store that Spark reads; files without bytes are not in it, see with_empty()."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    r = r.option("pathGlobFilter", glob) if glob else r
    return r.load(path).select("path", "length", "content")


def literal(path: str) -> str:
    """A path of the driver's as Spark reads it, where brackets and the like stand for themselves."""
    return ("file://" if path.startswith("/") else "") + re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def with_empty(contents: DataFrame, files: DataFrame) -> DataFrame:
    """Rows for the listed files that reading left out, with no bytes."""
    plain = contents.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    empty = files.filter("length = 0").select("path", "length", F.lit(b"").alias("content"))
    return plain.filter("length > 0").unionByName(empty)


def arguments(path: str, rest: list[str] = ()) -> list[str]:
    """One argument a line of a file; blank lines and // comments aside; then the rest."""
    with open(path, encoding="utf-8") as f:
        lines = [x.rstrip("\r\n") for x in f]
    return [x for x in lines if x.strip() and not x.lstrip().startswith("//")] + list(rest)


def null_streams(spark: SparkSession, count: int, length: int) -> DataFrame:
    """(tag, length) of streams of zero bytes; their content is made where it is read."""
    return spark.range(count).select(F.concat(F.lit("NULL"), F.col("id").cast("string")).alias("tag"), F.lit(length).cast("long").alias("length"))


def zeros(length: DataFrame) -> DataFrame:
    """content of null streams, for digests."""
    return length.withColumn("content", F.repeat(F.lit("\0"), F.col("length").cast("int")).cast("binary"))
