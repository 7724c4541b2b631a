"""Subtitle files that hold several streams or times: VobSub index files, scripts in a track's private data."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

# Fixed patterns of index files.
_TAG = re.compile(r"(?m)^([^#\r\n]+?):[ ]?([^\r\n]+)")
_ID = re.compile(r"([^,]+), index: (.+)")
_ALT = re.compile(r"alt: ([^\r\n]+)")


def index_streams(text: str) -> list[tuple[int, str, int]]:
    """(index, language, subtitles) of a VobSub index file, by its name or else its code; nothing where an id is malformed."""
    text = text.replace("\0", "#")
    tags, out = list(_TAG.finditer(text)), []
    for i, m in enumerate(tags):
        if m[1].strip() == "timestamp" and out:
            out[-1][2] += 1
        elif m[1].strip() == "id":
            found = _ID.search(m[2])
            if not found or not re.fullmatch(r"\s*[+-]?[0-9]+\s*", found[2]):
                return []
            part = text[m.start() : tags[i + 1].start() if i + 1 < len(tags) else len(text)]
            alt = _ALT.search(part)
            out.append([int(found[2]), alt[1] if alt else found[1], 0])
    return [tuple(x) for x in out]


def script_times(private: bytes) -> list[int]:
    """Nanoseconds at which the lines of a script's events start, by the column that its format line names."""
    text = private.decode("utf-8", "replace")
    _, found, rest = text.partition("[Events]")
    _, named, rest = rest.partition("Format:")
    columns, ended, lines = rest.partition("\n")
    names = columns.replace(" ", "").rstrip("\r").split(",")
    if not found or not named or not ended or "Start" not in names:
        return []
    out, at = [], names.index("Start")
    for line in re.split(r"[\r\n]+", lines):
        parts = line.split(",", len(names) - 1)
        pieces = parts[at].strip().split(":") if len(parts) > at else []
        try:
            if len(pieces) == 3:
                h, m, s = map(float, pieces)
                out.append(int(((h * 60 + m) * 60 + s) * 1000 * 1_000_000))
        except ValueError:
            continue
    return out


def index_rows(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """(path, ord, index, language, subtitles) of the streams of index files that hold a subtitle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, *s) for p, t in zip(batch["p"], batch["t"], strict=True) for i, s in enumerate(index_streams(t or "")) if s[2]]
            yield pd.DataFrame(rows, columns=["path", "ord", "index", "language", "subtitles"])

    return files.selectExpr(f"`{path}` AS p", f"`{text}` AS t").mapInPandas(run, "path string, ord int, index int, language string, subtitles long")


STREAMS = "array<struct<ord: bigint, index: int, language: string>>"


@F.pandas_udf(ArrayType(StructType([StructField("ord", LongType()), StructField("index", IntegerType()), StructField("language", StringType())])))
def index_column(text: pd.Series) -> pd.Series:
    """The streams of an index file that hold a subtitle, with their place; null for null."""
    found = lambda t: [{"ord": i, "index": n, "language": name} for i, (n, name, many) in enumerate(index_streams(t)) if many]
    return text.map(lambda t: None if t is None else found(t))
