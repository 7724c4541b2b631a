"""Text of files: decoding by byte-order mark, lines, cleaning of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD_BYTES = 10 << 20
LONGEST_LINE = 1024


def decoded(content: Column) -> Column:
    """UTF-8 or UTF-16 by its byte-order mark, else UTF-8; what isn't valid is replaced."""
    hexed = F.hex(F.substring(content, 1, 3))
    skip = lambda n: F.substring(content, F.lit(n + 1), F.length(content))
    return (
        F.when(hexed == "EFBBBF", F.make_valid_utf8(skip(3).cast("string")))
        .when(hexed.startswith("FFFE"), F.decode(skip(2), "UTF-16LE"))
        .when(hexed.startswith("FEFF"), F.decode(skip(2), "UTF-16BE"))
        .otherwise(F.make_valid_utf8(content.cast("string")))
    )


def head(content: Column) -> Column:
    """What format detection looks at."""
    return F.substring(content, 1, HEAD_BYTES)


def read_lines(text: Column, longest: int = LONGEST_LINE) -> Column:
    """Non-empty lines, ended by CR or LF, up to the first that is longer than `longest`."""
    lines = F.array_remove(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n"), "")  # one character is split without a pattern
    too_long = F.array_position(F.transform(lines, lambda x: F.length(x) > longest), True)
    return F.when(too_long == 0, lines).otherwise(F.slice(lines, F.lit(1), (too_long - 1).cast("int")))


def digits_only(c: Column) -> Column:
    """Without what isn't a digit, a point or a minus."""
    return F.regexp_replace(c, r"[^0-9.\-]", "")


def first_part(c: Column) -> Column:
    """Up to the first of \\ / |."""
    return F.split(c, r"[\\/|]")[0]


def non_default(c: Column) -> Column:
    """Null for numbers that are all zeros, points and commas."""
    return F.when(~c.rlike(r"^[0.,]*$"), c)


def timestamp_ns(c: Column) -> Column:
    """hh:mm:ss.mmm as nanoseconds; null unless there are four numbers."""
    p = F.split(c, r"[:.]")
    n = lambda i: F.try_element_at(p, F.lit(i + 1)).try_cast("long")
    return F.when(F.size(p) == 4, ((n(0) * 3600 + n(1) * 60 + n(2)) * 1000 + n(3)) * 1_000_000)


def ass_time_ms(c: Column) -> Column:
    """h:mm:ss.ff as milliseconds; null unless there are three parts."""
    p = F.split(F.trim(c), ":")
    n = lambda i: F.try_element_at(p, F.lit(i + 1)).try_cast("double")
    return F.when(F.size(p) == 3, F.round((n(0) * 3600 + n(1) * 60 + n(2)) * 1000).cast("long"))
