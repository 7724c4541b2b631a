"""Values as text: numbers, times, spans of time, flags, XML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stereo modes by bit.
STEREO_MODES = {0: "Mono", 1: "LeftRight", 2: "TopBottom", 3: "Checkboard", 4: "RowInterleaved", 5: "ColumnInterleaved", 6: "FrameAlternating", 7: "AnaGlyph", 8: "CyanRed", 9: "GreenMagenta", 30: "Reversed", 31: "Other"}


def format_double(x: Column, huge: float = 1e15) -> Column:
    """Whole numbers without a point up to 1e15; tiny ones and those from huge on as 1.5E-07; otherwise the shortest decimal.

    With a huge above 1e15, whole numbers from 1e15 on have the fraction .0.
    """
    text = x.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).cast("int")
    scientific = F.concat(mantissa, F.when(power < 0, "E-").otherwise("E+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    sign, digits = F.when(x < 0, "-").otherwise(""), F.regexp_replace(mantissa, r"[-.]", "")
    long = F.rpad(digits, F.greatest(F.length(digits), power + 2), F.lit("0"))
    moved = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).otherwise(F.concat(F.substring(long, F.lit(1), power + 1), F.lit("."), F.substring(long, power + 2, F.length(long))))
    plain = F.when(text.contains("E"), F.concat(sign, moved)).otherwise(text)
    return (
        F.when(F.isnan(x), "NaN")
        .when(x == float("inf"), "Infinity")
        .when(x == float("-inf"), "-Infinity")
        .when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("string"))
        .when(F.abs(x) >= huge, scientific)
        .when(F.abs(x) < 1e-4, scientific)
        .otherwise(plain)
    )


def format_datetime(seconds: Column) -> Column:
    """Unix seconds as MM/dd/yyyy HH:mm:ss, rounded down, in UTC."""
    days, rest = F.floor(F.floor(seconds) / 86400).cast("int"), F.pmod(F.floor(seconds), F.lit(86400))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "MM/dd/yyyy")
    return F.concat(date, F.format_string(" %02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60))


def format_timespan(seconds: Column) -> Column:
    """[-][d.]hh:mm:ss[.fffffff] in units of 100 ns, halves away from zero; not a number is no time."""
    ticks = F.round(F.abs(F.when(F.isnan(seconds), F.lit(0.0)).otherwise(seconds)) * 1e7).cast("long")
    whole, part = F.floor(ticks / F.lit(10_000_000)), ticks % 10_000_000
    day = F.floor(whole / 86400)
    return F.concat(
        F.when((seconds < 0) & (ticks > 0), "-").otherwise(""),
        F.when(day > 0, F.concat(day.cast("string"), F.lit("."))).otherwise(""),
        F.format_string("%02d:%02d:%02d", F.floor(whole / 3600) % 24, F.floor(whole / 60) % 60, whole % 60),
        F.when(part > 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 7, "0"))).otherwise(""),
    )


def format_dhms(seconds: Column) -> Column:
    """d.hh:mm:ss, negative times as none."""
    s = F.greatest(F.floor(seconds), F.lit(0))
    return F.format_string("%d.%02d:%02d:%02d", F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)


def flag_names(bits: Column, names: dict[int, str], none: str = "Invalid") -> Column:
    """Names of the set bits, the lowest first."""
    own = bits.cast("long")
    text = F.concat_ws(", ", *[F.when(own.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(n)) for i, n in names.items()])
    return F.when(text == "", none).otherwise(text)


def xml_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attribute(c: Column) -> Column:
    return F.replace(xml_text(c), F.lit('"'), F.lit("&quot;"))


def sensitive(session: str, value: Column) -> Column:
    """A salted hash in place of a personal value."""
    return F.upper(F.sha2(F.concat(F.lit(session), value), 512))
