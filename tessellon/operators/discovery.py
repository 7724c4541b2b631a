"""Which files are processed, in which share of the work, and what is logged about them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extension_filter(path: Column, setting: str) -> Column:
    """`avi,mkv` accepts paths that end so, `-avi,mkv` those that don't; nothing accepts all, a lone minus none."""
    allow = not setting.startswith("-")
    items = [x.strip().lower() for x in setting.lstrip("-").split(",") if x.strip()]
    if not items:
        return F.lit(allow)
    hit = F.lit(False)
    for x in items:
        hit = hit | F.endswith(F.lower(path), F.lit(x))
    return hit if allow else ~hit


def without_logged(files: DataFrame, log: DataFrame, path_col: str = "path", log_col: str = "value") -> DataFrame:
    """Files whose exact path is in no line of the log (carriage returns aside)."""
    done = log.select(F.regexp_replace(F.col(log_col).cast("string"), r"\r$", "").alias("_done"))
    return files.join(done, F.col(path_col).cast("string") == F.col("_done"), "left_anti")


def partition_of(path: Column, prefixes: list[str]) -> Column:
    """Number of the first prefix that the path's text starts with; all others are the last partition."""
    out = F.lit(len(prefixes))
    for i, p in reversed(list(enumerate(prefixes))):
        out = F.when(F.startswith(path, F.lit(p)), F.lit(i)).otherwise(out)
    return out


def totals(files: DataFrame, length: str, *by: str) -> DataFrame:
    """Files and bytes, in all or by group."""
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.sum(length).alias("bytes"))


def crc_missing(path: Column, crc_hex: Column, pattern: str = r"(?i)${CRC32}") -> Column:
    """Whether the pattern, with the digest in it, is found nowhere in the path. A pattern without meaning is never missed."""
    try:
        re.compile(pattern.replace("${CRC32}", "0"))
    except re.error:
        return F.lit(False)
    if pattern == r"(?i)${CRC32}":
        return ~F.contains(F.upper(path), F.upper(crc_hex))  # no regular expression for each row
    return ~F.regexp_like(path, F.replace(F.lit(pattern), F.lit("${CRC32}"), F.upper(crc_hex)))


def crc_error_lines(files: DataFrame, path: str, crc_hex: str, pattern: str = r"(?i)${CRC32}") -> DataFrame:
    """`<digest> <path>` of the files whose path lacks the digest."""
    return files.filter(crc_missing(F.col(path), F.col(crc_hex), pattern)).select(F.concat_ws(" ", F.upper(crc_hex), path).alias("line"))


def extension_differs(extension: Column, suggested: Column) -> Column:
    """Whether an extension (with its dot) isn't among the suggested ones, separated by blanks."""
    own = F.lower(F.regexp_replace(extension, r"^\.", ""))
    return ~F.exists(F.split(F.lower(F.coalesce(suggested, F.lit(""))), " "), lambda x: (x == own) & (x != ""))


def extension_lines(files: DataFrame, path: str, extension: str, suggested: str) -> DataFrame:
    """`ext => suggested<TAB>path` of the files whose extension differs; `unknown` where nothing is suggested."""
    should = F.when(F.coalesce(F.col(suggested), F.lit("")) == "", "unknown").otherwise(F.col(suggested))
    line = F.concat(F.regexp_replace(extension, r"^\.", ""), F.lit(" => "), should, F.lit("\t"), F.col(path))
    return files.filter(extension_differs(F.col(extension), F.col(suggested))).select(line.alias("line"))
