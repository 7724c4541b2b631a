"""What kind of file some bytes are, by magic bytes and by rules about text; Spark expressions only.

All rules are evaluated in one projection over the head of the content; a rule about lines looks at them only where the text
holds a character sequence that no match can lack. A type whose magic is a longer text than the content
but begins like it makes the content undecided, and undecided content has no type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.functions import text as T

# Magic bytes and section names.
MAGIC = {
    "7z": [b"7z\xbc\xaf'\x1c"],
    "zip": [b"PK\x03\x04", b"PK00PK"],
    "rar": [b"Rar!"],
    "ra": [b".ra\xfd"],
    "flac": [b"fLaC"],
    "avi": [b"RIFF"],
    "vtt": [b"\xfe\xffWEBVTT", b"WEBVTT"],
    "fsb": [b"FanSubber v"],
    "s2k": [b"// translated by Sami2Sasami"],
}
SECTIONS = ["[BEGIN]", "[INFORMATION]", "[TITLE]", "[AUTHOR]", "[SOURCE]", "[PRG]", "[FILEPATH]", "[DELAY]", "[CD TRACK]", "[COMMENT]", "[END INFORMATION]", "[SUBTITLE]", "[COLF]", "[STYLE]", "[SIZE]", "[FONT]"]
SRT = r"(?U)^(\d{1,4} ?: ?\d{1,4} ?: ?\d{1,4} ?[,:.] ?\d{1,4}) ?--> ?(\d{1,4} ?: ?\d{1,4} ?: ?\d{1,4} ?[,:.] ?\d{1,4})"
LRC = r"(?U)\[\d\d:\d\d\.\d\d\].*"
TMP = r"(?U)^\d\d:\d\d:\d\d(\.\d)?:.*"
PJS = r'(?U)^\s*\d*,\s*\d*,".*"'
JS = r"(?U)^\d*:\d*:\d*\.\d*\s*\d*:\d*:\d*\.\d*.*"
TTS = r"(?U)^\d*:\d*:\d*\.\d*,\d*:\d*:\d*\.\d*,.*"
MICRODVD = r"(?U)^\{\d*\}\{\d*\}.*$"
FANSUBBER = r"FanSubber v[0-9]+(\.[0-9]+)?"
#: In the order of the registry.
KINDS = ["srt", "ssa", "idx", "smi", "7z", "zip", "rar", "ra", "flac", "lrc", "avi", "sub", "tmp", "pjs", "vtt", "js", "rt", "smil", "tts", "xss", "zeg", "sup", "fsb", "s2k"]


def _count(lines: Column, f) -> Column:
    return F.size(F.filter(lines, f))


def _ratio(hits: Column, of: Column, least: float) -> Column:
    return (hits > 0) & (hits.cast("double") >= of * F.lit(least))


def _begins(first: Column, kind: str) -> Column:
    out = F.lit(False)
    for m in MAGIC[kind]:
        out = out | F.startswith(first, F.lit(m))
    return out


def _undecided(first: Column) -> Column:
    out = F.octet_length(first) == 0
    for m in sum(MAGIC.values(), []):
        out = out | ((F.octet_length(first) < len(m)) & F.startswith(F.lit(m), first))
    return out


def _script(start: Column, length: Column) -> Column:
    """ass or ssa: the character after v4 near ` styles]`, or after v4.00 (v3) near `scripttype:`."""
    at = F.instr(start, " styles]")
    low = F.greatest(at - 4, F.lit(1))
    window = F.substring(start, low, F.lit(10))
    near = lambda v: F.when((at > 0) & (F.instr(window, v) > 0), low + F.instr(window, v) + 1)
    kind = F.instr(start, "scripttype:")
    named = F.substring(start, F.greatest(kind, F.lit(1)), F.lit(20))
    typed = lambda v: F.when((kind > 0) & (F.instr(named, v) > 0), kind + F.instr(named, v) + 4)
    place = F.coalesce(near("v4"), near("v3"), typed("v4.00"), typed("v3.00"))
    return F.when(place.isNotNull() & (place + 1 <= length), F.when(F.substring(start, place, F.lit(1)) == "+", "ass").otherwise("ssa"))


def _pjs(lines: Column) -> Column:
    """Lines are put together until one ends the quotation."""
    zero = F.struct(F.lit("").alias("buf"), F.lit(0).alias("i"), F.lit(0).alias("hits"))

    def step(a: Column, line: Column) -> Column:
        both = F.concat(a["buf"], line)
        ends = ~F.contains(line, F.lit(',"')) | F.endswith(line, F.lit('"'))
        return F.struct(F.when(ends, "").otherwise(both).alias("buf"), (a["i"] + ends.cast("int")).alias("i"), (a["hits"] + (ends & both.rlike(PJS)).cast("int")).alias("hits"))

    return F.aggregate(lines, zero, step, lambda a: _ratio(a["hits"], a["i"], 0.8))


def _js(lines: Column, low: Column) -> Column:
    """Lines that start a timed row, and those that a backslash continues."""
    zero = F.struct(F.lit(False).alias("more"), F.lit(0).alias("i"), F.lit(0).alias("hits"))

    def step(a: Column, line: Column) -> Column:
        starts, goes_on = line.rlike(JS), F.endswith(line, F.lit("\\"))
        return F.struct(((starts | a["more"]) & goes_on).alias("more"), (a["i"] + 1).alias("i"), (a["hits"] + (starts | a["more"]).cast("int")).alias("hits"))

    own = F.filter(lines, lambda x: ~F.startswith(x, F.lit("#")))
    named = F.exists(low, lambda x: F.contains(x, F.lit("jaco")))
    share = lambda a: F.coalesce(F.try_divide(a["hits"].cast("double"), a["i"]), F.lit(0.0))
    return F.aggregate(own, zero, step, lambda a: (a["hits"] > 0) & ((share(a) > 0.8) | ((share(a) > 0.5) & named)))


def _tts(lines: Column) -> Column:
    own = F.filter(F.transform(lines, F.trim), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    hits = _count(own, lambda x: x.rlike(TTS))
    prose = lambda x: F.length(F.regexp_replace(x, r"[^\p{IsAlphabetic}\s\p{Punct}]", "")) > F.length(x) * F.lit(0.8)
    return (hits > 0) & _ratio(hits, hits + _count(own, lambda x: ~x.rlike(TTS) & ~prose(x)), 0.8)


def _rules(first: Column, text: Column, start: Column, lines: Column, low: Column, length: Column) -> dict[str, Column]:
    """first: bytes; start: the text's beginning in lower case; low: lines in lower case."""
    line = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    small = length <= T.HEAD_BYTES
    has = lambda *xs: F.greatest(F.lit(False), *[F.contains(text, F.lit(x)) for x in xs])
    every_has = lambda *xs: F.least(F.lit(True), *[F.contains(text, F.lit(x)) for x in xs])
    timed = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("-->")) & x.rlike(SRT)), True)
    other = F.array_position(F.transform(low, lambda x: F.contains(x, F.lit("webvtt"))), True)
    tags = F.filter(low, lambda x: F.startswith(x, F.lit("<")))
    trimmed = F.slice(F.filter(F.transform(lines, F.trim), lambda x: x != ""), 1, 21)
    upper = F.upper(F.substring(text, 1, 1024))
    viewer = sum((F.contains(upper, F.lit(s)).cast("int") for s in SECTIONS), F.lit(0)) >= 5
    dvd = every_has("{", "}{") & small & (F.size(trimmed) > 4) & (_count(trimmed, lambda x: x.rlike(MICRODVD)) > F.size(trimmed) * F.lit(0.8))
    every = F.transform(F.split(text, "\n"), F.lower)
    begins = lambda x, *ws: sum((F.startswith(x, F.lit(w)).cast("int") for w in ws), F.lit(0)) > 0
    score = 10 * _count(every, lambda x: begins(x, "region", "style", "note")) + _count(every, lambda x: begins(x, "-->"))
    out = {k: _begins(first, k) for k in MAGIC}
    return out | {
        "srt": small & has("-->") & (timed > 0) & ((other == 0) | (other > timed)),
        "ssa": ~F.startswith(first, F.lit(b"\x1a\x45\xdf\xa3")) & (F.contains(start, F.lit("styles]")) | F.contains(start, F.lit("scripttype:"))) & _script(start, length).isNotNull(),
        "idx": small & F.contains(line, F.lit("VobSub index file, v")),
        "smi": F.contains(F.substring(start, 1, 10), F.lit("<sami>")),
        "lrc": every_has("[", ":", ".") & _ratio(_count(lines, lambda x: F.contains(x, F.lit("[")) & x.rlike(LRC)), F.size(lines), 0.8),
        "avi": out["avi"] & (F.substring(first, F.lit(9), F.lit(8)) == F.lit(b"AVI LIST")),
        "sub": (has("[") & viewer) | dvd,
        "tmp": has(":") & _ratio(_count(lines, lambda x: F.contains(x, F.lit(":")) & x.rlike(TMP)), F.size(lines), 0.8),
        "pjs": has(',"') & _pjs(lines),
        "vtt": out["vtt"] & (score > 10),
        "js": every_has(":", ".") & _js(lines, low),
        "rt": has("<") & (F.size(tags) >= 10) & _ratio(_count(tags, lambda x: begins(x, "<window", "<time begin")), F.size(tags), 0.6),
        "smil": has("<") & F.exists(low, lambda x: F.startswith(F.trim(x), F.lit("<smil>"))),
        "tts": every_has(":", ".", ",") & _tts(lines),
        "xss": F.contains(start, F.lit("script=xombiesub")),
        "zeg": F.contains(start, F.lit("% zerog")),
        "sup": F.startswith(first, F.lit(b"PG")) & (F.substring(first, F.lit(11), F.lit(2)) == F.lit(b"\x16\x00")),
        "fsb": out["fsb"] & line.rlike(FANSUBBER),
    }


def detect(df: DataFrame, content: str, length: str | None = None, keep: list[str] | None = None, kinds: list[str] = KINDS) -> DataFrame:
    """keep (all columns else), candidates (kinds whose rules hold, in the registry's order) and suggested_ext (of one: its
    extension; of several: zip, 7z or rar if among them, else all, separated by blanks; none: null)."""
    keep = keep if keep is not None else df.columns
    size = F.col(length) if length else F.octet_length(content)
    body = F.col(content).cast("binary")
    base = df.select(*keep, F.substring(body, 1, 32).alias("_x"), T.decoded(T.head(body)).alias("_t"), size.cast("long").alias("_n"))
    base = base.withColumn("_s", F.lower(F.substring("_t", 1, 2048))).withColumn("_l", T.read_lines(F.col("_t"))).withColumn("_low", F.transform("_l", F.lower))
    rules = _rules(F.col("_x"), F.col("_t"), F.col("_s"), F.col("_l"), F.col("_low"), F.col("_n"))
    found = F.array_compact(F.array(*[F.when(rules[k], F.lit(k)) for k in kinds]))
    script = _script(F.col("_s"), F.col("_n"))
    out = base.withColumn("candidates", F.when(~_undecided(F.col("_x")), found).otherwise(F.array().cast("array<string>")))
    names = F.transform("candidates", lambda k: F.when(k == "ssa", script).otherwise(k))
    won = F.lit(None).cast("string")
    for k in ("rar", "7z", "zip"):
        won = F.when(F.array_contains("candidates", k), k).otherwise(won)
    joined = F.when(F.size("candidates") > 0, F.array_join(names, " "))
    out = out.withColumn("suggested_ext", F.when(F.size("candidates") == 1, joined).otherwise(F.coalesce(won, joined)))
    return out.select(*keep, "candidates", "suggested_ext")
