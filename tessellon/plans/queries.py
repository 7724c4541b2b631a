"""The queries of the library's own operators over the driver's tables; oracle.py has the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.functions import bases, digests, paths, render, text
from tessellon.operators import discovery, formats, merge, stats
from tessellon.sources import samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", F.hex(digests.DIGESTS[name](F.col("text"))).alias("digest"))

    return run


#: Digests of whole texts; of these SQL has md5, sha1 and sha256.
for _n in digests.DIGESTS:
    if _n not in ("ED2K", "ED2K2", "CRC32", "CRC32C"):
        QUERIES["hash_" + _n.lower().replace("-", "_")] = _digest(_n)


@query("hash_ed2k")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", digests.ed2k(F.col("text")).alias("d"))
    return d.select("doc_id", F.hex("d.red").alias("digest"), F.hex("d.blue").alias("ed2k2"))


def _order_key() -> Column:
    return F.col("o_orderkey").cast("string")


@query("hash_crc32")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(digests.crc32(_order_key())).alias("digest"))


@query("hash_crc32c")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(digests.DIGESTS["CRC32C"](_order_key())).alias("digest"))


MULTI = ["MD5", "SHA1", "SHA2-256"]


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *digests.digests(F.col("text"), MULTI))


@query("multi_hash")
def multi_hash(spark, sf_dir):
    return _wide(spark, sf_dir).select("doc_id", *[F.hex(f"`{n}`").alias(n.lower().replace("-", "_")) for n in MULTI])


@query("print_hashes_long")
def _(spark, sf_dir):
    rows = digests.long_form(_wide(spark, sf_dir), ["doc_id"], MULTI)
    return rows.select("doc_id", "name", F.concat_ws(" => ", "name", F.hex("digest")).alias("line"))


@query("base_convert")
def _(spark, sf_dir):
    n = F.crc32(_order_key().cast("binary"))
    each = F.array(*[F.struct(F.lit(b).alias("base"), bases.number_in_base(n, b, 4).alias("rendered")) for b in bases.ALPHABETS])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(each).alias("e")).select("o_orderkey", "e.base", "e.rendered")


@query("discover_ext_allow")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(discovery.extension_filter(F.col("url"), "#top,/,ref=x")).select("page_id", "url")


@query("discover_ext_deny")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(discovery.extension_filter(F.col("url"), "-#TOP,ref=x")).select("page_id", "url")


@query("discover_skip_log")
def _(spark, sf_dir):
    log = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("value"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    return discovery.without_logged(files, log).select("doc_id")


PREFIXES = ["https://m.", "https://blog.", "https://", "http://th"]


@query("discover_partition")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", discovery.partition_of(F.col("url"), PREFIXES).alias("part"))


@query("discovery_totals")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.octet_length("text").cast("long").alias("n"))
    return discovery.totals(docs, "n", "source")


@query("path_parts")
def _(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", paths.file_name(url).alias("file_name"), paths.directory_name(url).alias("dir"), paths.stem(url).alias("stem"), paths.extension(url).alias("ext"))


PATTERN = "/library/${FileNameWithoutExtension}/[${Hash-MD5-16-LC}]${Nothing}${FileExtension}"


def _expanded() -> Column:
    url = F.col("url")
    return paths.expand(PATTERN, paths.file_tokens(url), {"MD5": digests.DIGESTS["MD5"](url)})


@query("placeholder_expand")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", _expanded().alias("expanded"))


@query("move_plan")
def _(spark, sf_dir):
    to = paths.destination(F.col("url"), _expanded(), [("/library/", "/shelf/"), ("?", "_")], keep_name=True)
    return table(spark, sf_dir, "pages").filter(paths.moves(F.col("url"), to)).select("page_id", F.col("url").alias("path"), to.alias("destination"))


@query("crc32_error_log")
def _(spark, sf_dir):
    crc = F.hex(digests.crc32(_order_key()))
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.lit("00000000")).otherwise(F.lower(crc))
    files = table(spark, sf_dir, "orders").select(crc.alias("crc"), F.concat(F.lit("/orders/"), _order_key(), F.lit(" ["), shown, F.lit("].txt")).alias("path"))
    return discovery.crc_error_lines(files, "path", "crc")


@query("extension_difference")
def _(spark, sf_dir):
    i = F.col("page_id")
    ext = F.element_at(F.array(*map(F.lit, [".mkv", ".AVI", ".txt", ""])), (i % 4 + 1).cast("int"))
    should = F.element_at(F.array(*map(F.lit, ["mkv mka", "avi", ""])), (i % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select("url", ext.alias("ext"), should.alias("suggested"))
    return discovery.extension_lines(files, "url", "ext", "suggested")


@query("text_read_lines")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.read_lines(F.col("text"))).cast("long").alias("n_lines"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), ns.alias("timecode_ns"), F.lit(1).alias("frames"), F.length("props").cast("long").alias("size"), F.col("event_id").alias("ord"))


@query("track_stats")
def _(spark, sf_dir):
    s = stats.track_stats(_samples(spark, sf_dir), ["track"])
    return s.select("track", "track_length", "track_size", "sample_count", "average_bitrate", "average_sample_rate")


@query("track_minmax_rate")
def _(spark, sf_dir):
    return stats.track_stats(_samples(spark, sf_dir), ["track"]).select("track", "min_sample_rate", "max_sample_rate")


@query("track_histogram")
def _(spark, sf_dir):
    return stats.histogram(_samples(spark, sf_dir), ["track"]).select("track", "rate", "count", F.col("first").cast("long").alias("first"))


@query("track_dominant_rate")
def _(spark, sf_dir):
    return stats.dominant_rate(stats.histogram(_samples(spark, sf_dir), ["track"]), ["track"])


@query("track_rate_deviation")
def _(spark, sf_dir):
    d = stats.rate_deviation(stats.histogram(_samples(spark, sf_dir), ["track"]), ["track"])
    return d.select("track", F.round("rate_deviation", 9).alias("rate_deviation"))


@query("track_index")
def _(spark, sf_dir):
    rows = stats.running_index(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], bucket=F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return rows.select("event_id", "event_type", F.col("idx").cast("long").alias("idx"))


@query("cluster_timecode_asof")
def _(spark, sf_dir):
    rows = stats.last_marker(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("ts"), "cluster_ts")
    return rows.select("event_id", "cluster_ts")


@query("composite_first_wins")
def _(spark, sf_dir):
    def items(name: str, p: str) -> DataFrame:
        pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
        rows = F.explode(F.array(pair("name", F.col(f"{p}_name")), pair("cents", F.round(F.col(f"{p}_acctbal") * 100).cast("long")), pair(f"{name}_key", F.col(f"{p}_{name[:4]}key")))).alias("i")
        return table(spark, sf_dir, name).select(F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_{name[:4]}key").alias("ord"), rows).select("nation", "ord", "i.key", F.lit("String").alias("type"), "i.value")

    both = merge.unite([("supplier", items("supplier", "s")), ("customer", items("customer", "c"))])
    return merge.first_wins(both, ["nation"]).select("nation", "key", "value", "provider")


@query("provider_union")
def _(spark, sf_dir):
    pair = lambda *cs: F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in cs])).alias("i")
    parts = [(t, table(spark, sf_dir, t).select("doc_id", pair(*cs)).select("doc_id", "i.key", "i.value")) for t, cs in (("documents", ["lang", "source"]), ("labels", ["quality", "toxic"]))]
    return merge.unite(parts).select("doc_id", "provider", "provider_rank", "key", "value")


@query("largest_tags")
def _(spark, sf_dir):
    return merge.largest(table(spark, sf_dir, "documents"), ["source"], "n_chars", "doc_id", ["doc_id", "lang"]).select("source", "doc_id", "lang", "n_chars")


@query("fmt_f64")
def _(spark, sf_dir):
    """The value, and a number of up to seventeen digits, some of them tiny or huge; powers from 1e16 on, as in its SQL."""
    i = F.col("event_id").cast("double")
    full = F.element_at(F.array(i / 1048576, -i / 3e9, i * 12345.0625, F.lit(0.000123456789012345) + i / 64, i * 1e9 + 0.25, (i + 1) / 1e7), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", render.format_double(F.col("value"), huge=1e16).alias("rendered"), render.format_double(full, huge=1e16).alias("full_digits"))


@query("fmt_timespan")
def _(spark, sf_dir):
    i = F.col("event_id")
    seconds = ((i * 7919 % 200000) - 1000).cast("double") + (i % 4).cast("double") * F.lit(0.25)
    return table(spark, sf_dir, "events").select("event_id", render.format_timespan(seconds).alias("rendered"))


@query("fmt_datetime")
def _(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select("event_id", render.format_datetime(seconds).alias("rendered"))


@query("flag_names")
def _(spark, sf_dir):
    bits = (F.col("l_orderkey") * 37 + F.col("l_linenumber")) % 1024
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", render.flag_names(bits, render.STEREO_MODES).alias("names"))


@query("xml_report")
def _(spark, sf_dir):
    """One report for each region: its nations as nodes with their keys and comments, from items of two providers."""
    from tessellon.operators import reports

    n = table(spark, sf_dir, "nation")
    text = lambda c: F.col(c).cast("string")
    item = lambda i, key, kind, v: F.struct(F.lit(i).cast("long").alias("ord"), F.lit(key).alias("key"), F.lit(kind).alias("type"), v.alias("text"))

    def rows(provider: str, rank: int, *items: Column) -> DataFrame:
        node = F.concat(F.lit("/Nations/Nation:"), text("n_nationkey"))
        own = n.join(table(spark, sf_dir, "region"), n["n_regionkey"] == F.col("r_regionkey")).select(F.col("r_name").alias("path"), node.alias("node"), "n_nationkey", F.explode(F.array(*items)).alias("i"))
        order = F.col("n_nationkey") * 10 + F.col("i.ord")
        return own.select("path", F.lit(provider).alias("provider"), F.lit(rank).alias("provider_rank"), F.lit("Nations").alias("root_type"), "node", order.alias("ord"), "i.key", "i.type", F.lit("Dimensionsless").alias("unit"), "i.text", F.lit(None).cast("array<string>").alias("parts"))

    top = table(spark, sf_dir, "region").select(F.col("r_name").alias("path"), F.lit("keys").alias("provider"), F.lit(0).alias("provider_rank"), F.lit("Nations").alias("root_type"), F.lit("/Nations").alias("node"), F.lit(-1).cast("long").alias("ord"), F.lit("").alias("key"), F.lit("").alias("type"), F.lit("").alias("unit"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("parts"))
    keys = rows("keys", 0, item(0, "Id", "Int64", text("n_nationkey")), item(1, "Name", "String", F.concat(F.col("n_name"), F.lit(" <&>"))))
    more = rows("more", 1, item(0, "Id", "Int64", F.lit("not the first")), item(2, "Full name", "String", F.lower("n_name")))
    files = table(spark, sf_dir, "region").select(F.col("r_name").alias("path"), F.col("r_regionkey").cast("long").alias("length"))
    return reports.complete(top.unionByName(keys).unionByName(more), files)


@query("hash_crc32c_texts")
def _(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.hex(digests.DIGESTS["CRC32C"](F.col("text"))).alias("digest"))


@query("null_stream")
def _(spark, sf_dir):
    from tessellon.sources import files

    made = files.zeros(files.null_streams(spark, 3, 8 << 20))
    return made.select("tag", "length", F.octet_length("content").cast("long").alias("bytes"), F.hex(digests.DIGESTS["MD5"](F.col("content"))).alias("md5"))


@query("format_detect_documents")
def _(spark, sf_dir):
    return formats.detect(table(spark, sf_dir, "documents"), "text", keep=["doc_id"]).select("doc_id", "suggested_ext")


@query("format_detect_pages")
def _(spark, sf_dir):
    return formats.detect(table(spark, sf_dir, "pages"), "html", keep=["page_id"]).select("page_id", "suggested_ext")


def _subtitles() -> Column:
    """A small file for each event: of timed lines in one of four formats, or JSON."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    i, kind = F.col("event_id"), F.col("event_type")
    h, m, s = two(i % 24), two(i % 60), two(i % 59)
    word = F.col("props")
    return (
        F.when(kind == "view", F.concat(F.repeat(F.concat(F.lit("["), m, F.lit(":"), s, F.lit(".50] "), word, F.lit("\n")), 5), F.lit("end")))
        .when(kind == "click", F.repeat(F.concat(F.lit("{"), i.cast("string"), F.lit("}{"), (i + 20).cast("string"), F.lit("}"), word, F.lit("\r\n")), 6))
        .when(kind == "error", F.repeat(F.concat(h, F.lit(":"), m, F.lit(":"), s, F.lit(":"), word, F.lit("\n")), 5))
        .when(kind == "purchase", F.concat(F.lit("1\n"), h, F.lit(":"), m, F.lit(":"), s, F.lit(",000 --> "), h, F.lit(":"), m, F.lit(":59,999\n"), word, F.lit("\n\n")))
        .otherwise(word)
    )


@query("format_detect_subtitles")
def _(spark, sf_dir):
    made = table(spark, sf_dir, "events").select("event_id", _subtitles().alias("content"))
    return formats.detect(made, "content", keep=["event_id"]).select("event_id", "suggested_ext")


#: Small texts of many kinds, near misses among them; @ stands for a number.
TEXTS = [
    "1\n00:00:01,000 --> 00:00:0@,000\nhi\n",
    "webvtt\n1\n00:00:01,000 --> 00:00:0@,000\nhi\n",
    "WEBVTT\n\nNOTE a@\nSTYLE\nb\n\n00:01.000 --> 00:02.000\nhi",
    "WEBVTT\n\nregion\n",
    "[Script Info]\nScriptType: v4.00+\n[V4+ Styles]\n",
    "[Script Info]\nScriptType: v4.00\nx@",
    "[V4 Styles]\nFormat: @",
    "# VobSub index file, v7 (do not modify this line!)\nid: en, index: @",
    "<SAMI>\n<HEAD>@",
    "PK00PK@",
    "Rar!@",
    "fLaC@",
    "[00:0@.50] a\n[00:02.00] b\n[00:03.00] c\n",
    "[00:01.50] a\nb\nc @\n",
    "RIFF----AVI LIST@",
    "RIFF----WAVEfmt @",
    "[BEGIN]\n[INFORMATION]\n[TITLE]x@\n[AUTHOR]\n[SOURCE]\n[PRG]\n",
    "{1}{2}a\n{3}{4}b\n{5}{6}c\n{7}{8}d\n{9}{@}e\n",
    "00:00:01:a\n00:00:02:b@\n00:00:03.5:c\n",
    '1, 2,"a@"\n 3, 4,"b\nmore"\n5,6,"c"\n',
    "#JACOsub\n0:00:01.00 0:00:02.00 a@\n0:00:03.00 0:00:04.00 b \\\ngoes on\nother\n",
    "<window>\n" + "<time begin='@'>\n" * 10 + "<br/>\n",
    "<window>\n<time begin='@'>\n",
    "<xml>\n  <SMIL>@\n",
    "00:00:01.0,00:00:02.0,a@\n00:00:03.0,00:00:04.0,b\n# note\nplain words here\n",
    "x script=XombieSub @",
    "% Zerog @",
    "FanSubber v1.2@\nx",
    "FanSubber vX",
    "// translated by Sami2Sasami@",
    "plain text @",
    "PK",
    "",
]


@query("format_detect_texts")
def _(spark, sf_dir):
    i = F.col("event_id")
    content = F.replace(F.get(F.lit(TEXTS), (i % len(TEXTS)).cast("int")), F.lit("@"), (i % 10).cast("string"))
    made = table(spark, sf_dir, "events").select("event_id", content.alias("content"))
    return formats.detect(made, "content", keep=["event_id"]).select("event_id", "suggested_ext")


def _parsed(kind: str, keys: list[str], make: Callable) -> Query:
    """Items of a media file for each nation, made from its row and parsed like any other file."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tessellon.operators import providers

        def files(batches):
            for b in batches:
                yield pd.DataFrame({"path": b["n_name"], "content": [make(int(k), n) for k, n in zip(b["n_nationkey"], b["n_name"], strict=True)]})

        made = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(files, "path string, content binary")
        return providers.items(made).filter(F.col("key").isin(keys)).select("path", "node", "key", "text")

    return run


QUERIES["mkv_parse"] = _parsed("mkv", ["Duration", "WritingApp", "PixelDimensions", "StatedSampleRate", "SampleCount", "Title", "Size", "Bitrate"], lambda k, n: samples.mkv_of(k, n, 640 + k, 480, [(250 * i, 10 * (k + 1)) for i in range(k + 2)]))
QUERIES["mp4_parse"] = _parsed("mp4", ["Duration", "PixelDimensions", "Id", "ContainerCodecId", "Language"], lambda k, n: samples.mp4_of(k + 1, 320 + k, 240, 1000, 500 * k + 250))
QUERIES["ogg_parse"] = _parsed("ogg", ["SampleCount", "Title", "StatedSampleRate", "Duration", "Size", "Bitrate"], lambda k, n: samples.ogg_of(k + 1, n, 48000, [100 + k] * (10 * (k + 1))))


@query("report_structure")
def _(spark, sf_dir):
    """The structure of a Matroska file for each nation; for every fifth, of a file that is none."""
    from tessellon.operators import reports

    def files(batches):
        for b in batches:
            make = lambda k, n: b"no media " * 9 if k % 5 == 4 else samples.mkv_of(k, n, 640 + k, 480, [(250 * i, 10) for i in range(k + 2)])
            yield pd.DataFrame({"path": b["n_name"], "content": [make(int(k), n) for k, n in zip(b["n_nationkey"], b["n_name"], strict=True)]})

    made = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(files, "path string, content binary")
    return reports.of_contents("Matroska", made)


@query("throughput_average")
def _(spark, sf_dir):
    """Exponential averages of bytes by user over the order of events, to nine places."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.length("props").alias("n"), F.lit(60.0).alias("s"))
    out = stats.averages(rows, ["user_id"], ["ts", "event_id"], "n", "s", bucket=F.date_trunc("day", F.col("ts").cast("timestamp")))
    return out.select("user_id", *[F.round(f"average_{m}", 9).alias(f"average_{m}") for m in (1, 5, 15)])


@query("text_decode")
def _(spark, sf_dir):
    """Whole texts written as bytes in four ways, with and without a byte-order mark, and read again."""
    t, way = F.col("text"), F.col("doc_id") % 4
    marked = lambda mark, c: F.concat(F.lit(mark), c)
    raw = F.when(way == 0, t.cast("binary")).when(way == 1, marked(b"\xef\xbb\xbf", t.cast("binary"))).when(way == 2, marked(b"\xff\xfe", F.encode(t, "UTF-16LE"))).otherwise(marked(b"\xfe\xff", F.encode(t, "UTF-16BE")))
    return table(spark, sf_dir, "documents").select("doc_id", text.decoded(text.head(raw)).alias("decoded"))


@query("text_numbers")
def _(spark, sf_dir):
    said = F.concat(F.lit("ca. "), F.col("p_retailprice").cast("string"), F.lit(" fps / "), F.col("p_size").cast("string"), F.lit("|x"))
    zero = F.when(F.col("p_partkey") % 3 == 0, "0.000,0").otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.digits_only(F.col("p_name")).alias("digits"), text.first_part(said).alias("first"), text.non_default(zero).alias("non_default"))


@query("time_parse")
def _(spark, sf_dir):
    """Times of chapters and of scripts; -1 for malformed ones."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    i = F.col("event_id")
    chapter = F.concat_ws(":", two(i % 24), two(i % 60), F.when(i % 7 == 0, "9").otherwise(F.concat(two(i % 59), F.lit("."), F.lpad((i % 1000).cast("string"), 3, "0"))))
    script = F.concat_ws(":", (i % 10).cast("string"), two(i % 60), F.when(i % 5 != 0, F.concat(two(i % 59), F.lit("."), two(i % 100))))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(text.timestamp_ns(chapter), F.lit(-1)).alias("ns"), F.coalesce(text.ass_time_ms(script), F.lit(-1)).alias("ms"))


@query("fmt_dhms")
def _(spark, sf_dir):
    seconds = (F.col("event_id") * 7919 % 400000 - 1000).cast("double") + 0.5
    return table(spark, sf_dir, "events").select("event_id", render.format_dhms(seconds).alias("rendered"))


@query("xml_escape")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(render.xml_text(F.col("html"))).alias("text_md5"), F.md5(render.xml_attribute(F.col("html"))).alias("attribute_md5"))


@query("personal_hash")
def _(spark, sf_dir):
    """Personal values hidden behind a salted hash: the same value, the same hash. SQL has no SHA-512; how many differ, it can tell."""
    hidden = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), render.sensitive("salt", F.col("c_name")).alias("h"))
    return hidden.groupBy("nation").agg(F.countDistinct("h").alias("values"), F.min(F.length("h")).cast("long").alias("digits"))


@query("provider_condense")
def _(spark, sf_dir):
    """Which tables share a language among a source's documents, in the order in which they come."""
    docs = table(spark, sf_dir, "documents")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    both = merge.unite([("labelled", known.select("source", F.col("lang").alias("root_type"))), ("all", docs.select("source", F.col("lang").alias("root_type")))])
    out = merge.condensed(both, ["source"])
    return out.select("source", "root_type", F.array_join("providers", ",").alias("providers"))
