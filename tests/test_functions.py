import math

from pyspark.sql import functions as F

from tessellon.functions import paths, render, text
from tessellon.operators import discovery, formats, merge, stats


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'binary' if isinstance(v, bytes) else 'long'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_numbers(spark):
    for x, want in [(24.0, "24"), (-0.0, "0"), (1.5e-7, "1.5E-07"), (23.976, "23.976"), (0.0005, "0.0005"), (1e15, "1E+15"), (2.5e20, "2.5E+20"), (float("nan"), "NaN"), (float("-inf"), "-Infinity"), (0.1, "0.1"), (0.000123456789012345, "0.000123456789012345"), (-0.00015, "-0.00015"), (12345678.125, "12345678.125"), (-98765432109876.25, "-98765432109876.25"), (99999999.5, "99999999.5")]:
        assert one(spark, render.format_double(F.col("x")), x=x) == want


def test_times(spark):
    for x, want in [(0.0, "00:00:00"), (90000.0, "1.01:00:00"), (-1.5, "-00:00:01.5000000"), (3.96, "00:00:03.9600000"), (float("nan"), "00:00:00")]:
        assert one(spark, render.format_timespan(F.col("x")), x=x) == want
    assert one(spark, render.format_datetime(F.col("x")), x=978307200.5) == "01/01/2001 00:00:00"
    assert one(spark, render.format_datetime(F.col("x")), x=-0.5) == "12/31/1969 23:59:59"
    assert one(spark, render.format_dhms(F.col("x")), x=90061.0) == "1.01:01:01"
    assert one(spark, render.flag_names(F.col("x"), render.STEREO_MODES), x=(1 << 31) + 3) == "Mono, LeftRight, Other"
    assert one(spark, render.flag_names(F.col("x"), render.STEREO_MODES), x=0) == "Invalid"


def test_paths(spark):
    p = F.col("p")
    for path, parts in {"/a/b.c/x.tar.gz": ("x.tar.gz", "/a/b.c", "x.tar", ".gz"), ".bashrc": (".bashrc", "", "", ".bashrc"), "d/name.": ("name.", "d", "name", "."), "d/.": (".", "d", ".", ""), "/x": ("x", "", "x", "")}.items():
        assert one(spark, F.struct(paths.file_name(p), paths.directory_name(p), paths.stem(p), paths.extension(p)), p=path) == parts
    assert paths.full_path("a/../b/./c", "/w") == "/w/b/c"


def test_placeholders(spark):
    p = F.col("p")
    tokens = paths.file_tokens(p, F.lit(7)) | {"SuggestedExtension": F.lit("mkv")}
    hashes = {"CRC32": F.unhex(F.lit("CBF43926")), "SHA2-256": F.unhex(F.lit("00FF"))}
    path = "/data/anime/Show - 01 [ABCD1234].avi"
    for pattern, want in [
        ("${FileNameWithoutExtension} [${Hash-CRC32-16-LC}].${SuggestedExtensionX}", "Show - 01 [ABCD1234] [cbf43926].mkv"),
        ("${Hash-CRC32-10-OC}|${FileSize}|${Unknown}|", "3421780262|7||"),
        ("${Hash-SHA2-256-16-UC}", "00FF"),
    ]:
        assert one(spark, paths.expand(pattern, tokens, hashes), p=path) == want
    assert one(spark, paths.expand("${Hash-SHA2-256-16-UC}", tokens, hashes, strict=True), p=path) == ""
    to = F.lit("/new/other.mkv")
    assert one(spark, paths.destination(p, to, [("new", "old")]), p=path) == "/old/other.mkv"
    assert one(spark, paths.destination(p, to, keep_directory=True), p=path) == "/data/anime/other.mkv"
    assert one(spark, paths.destination(p, to, keep_name=True), p=path) == "/new/Show - 01 [ABCD1234].avi"


def test_text(spark):
    t = F.col("t")
    assert one(spark, text.read_lines(t), t="a\r\n\n b\n" + "x" * 1025 + "\nc") == ["a", " b"]
    for raw, want in [(b"\xef\xbb\xbfh\xc3\xa9", "hé"), (b"\xff\xfeh\0\xe9\0", "hé"), (b"\xfe\xff\0h\0\xe9", "hé"), (b"h\xffi", "h�i")]:
        assert one(spark, text.decoded(t), t=raw) == want
    assert one(spark, text.timestamp_ns(t), t="01:02:03.004") == 3723004000000
    assert one(spark, text.timestamp_ns(t), t="1:2:3") is None
    assert one(spark, text.ass_time_ms(t), t="0:00:01.50") == 1500
    assert one(spark, text.non_default(t), t="0.0") is None and one(spark, text.first_part(t), t="24 / 25") == "24 "


def test_discovery(spark):
    files = spark.createDataFrame([("/a.mkv",), ("/b.avi",), ("/sub/c.MKV",)], "path string")
    keep = lambda s: sorted(r.path for r in files.filter(discovery.extension_filter(F.col("path"), s)).collect())
    assert keep(".mkv") == ["/a.mkv", "/sub/c.MKV"] and keep("-.avi") == ["/a.mkv", "/sub/c.MKV"] and len(keep("")) == 3 and keep("-") == []
    log = spark.createDataFrame([("/a.mkv\r",)], "value string")
    assert discovery.without_logged(files, log).count() == 2
    lines = spark.createDataFrame([("good [352441C2].txt", "352441C2"), ("bad [DEADBEEF].txt", "352441C2")], "path string, crc string")
    assert [r.line for r in discovery.crc_error_lines(lines, "path", "crc").collect()] == ["352441C2 bad [DEADBEEF].txt"]
    assert [r.line for r in discovery.crc_error_lines(lines, "path", "crc", r"(?i)\[${CRC32}\]").collect()] == ["352441C2 bad [DEADBEEF].txt"]
    assert discovery.crc_error_lines(lines, "path", "crc", "(").count() == 0


def test_track(spark):
    rows = [(1, i * 40_000_000, 1, 1000, i) for i in range(100)]
    df = spark.createDataFrame(rows, "track long, timecode_ns long, frames int, size long, ord long")
    s = stats.track_stats(df, ["track"]).first()
    assert (s.track_length, s.track_size, s.sample_count, s.min_sample_rate, s.max_sample_rate) == (3.96, 100_000, 100, 25.0, 25.0)
    assert [(r.rate, r["count"]) for r in stats.histogram(df, ["track"]).collect()] == [(25.0, 99)]


def ring(rows):
    """A plain loop over the last three rates."""
    low = high = None
    last = []
    for (t0, f0), (t1, _) in zip(rows, rows[1:], strict=False):
        r = float("inf") if t1 == t0 else 1e9 * f0 / (t1 - t0)
        r1 = last[-1] if last else r
        r2 = last[-2] if len(last) > 1 else 0.0
        d = (r1 + r2 / 2) * 0.1
        if abs(r - r1) < d and abs(r - r2) < d and r != float("inf"):
            low, high = min(r, low or r), max(r, high or r)
        last.append(r)
    return low, high


def test_stable_rates_against_a_loop(spark):
    import random

    rnd, rows, want = random.Random(3), [], {}
    for k in range(60):
        t, series = 0, []
        for _ in range(rnd.randint(1, 30)):
            series.append((t, 1))
            t += rnd.choice([0, 40, 40, 40, 41, 80]) * 10**6
        want[k] = ring(series)
        rows += [(k, a, b, 10, i) for i, (a, b) in enumerate(series)]
    df = spark.createDataFrame(rows, "track long, timecode_ns long, frames int, size long, ord long")
    got = {r.track: (r.min_sample_rate, r.max_sample_rate) for r in stats.track_stats(df, ["track"]).collect()}
    assert got == want


def test_first_wins(spark):
    a = spark.createDataFrame([("f", "Duration", "Double", "1", 0), ("f", "Duration", "TimeSpan", "2", 1), ("f", "Duration", "Double", "3", 2)], "path string, key string, type string, value string, ord long")
    b = spark.createDataFrame([("f", "Duration", "Double", "9", 0), ("f", "Size", "Int64", "8", 1)], a.schema)
    got = sorted((r.key, r.type, r.value, r.provider) for r in merge.first_wins(merge.unite([("A", a), ("B", b)]), ["path"]).collect())
    assert got == [("Duration", "Double", "1", "A"), ("Duration", "TimeSpan", "2", "A"), ("Size", "Int64", "8", "B")]


FORMATS = {
    b"1\n00:00:01,000 --> 00:00:02,000\nhi\n": "srt",
    b"PK\x03\x04" + b"x" * 60: "zip",
    b"Rar!" + b"\x1a" * 60: "rar",
    b"7z\xbc\xaf\x27\x1c" + b"\0" * 60: "7z",
    b"[V4+ Styles]\nFormat: Name\n" + b" " * 40: "ass",
    b"[V4 Styles]\nFormat: Name\n" + b" " * 40: "ssa",
    b"fLaC" + b"\0" * 60: "flac",
    b"RIFF\0\0\0\0AVI LIST" + b"\0" * 40: "avi",
    b"RIFF\0\0\0\0WAVEfmt " + b"\0" * 40: None,
    bytes((i * 7919) % 251 for i in range(4096)): None,
    b"[00:01.50] la\n" * 5: "lrc",
    b"{1}{20}text\n" * 6: "sub",
    b"00:00:01:text\n" * 5: "tmp",
    b'1, 2,"say"\n' * 5: "pjs",
    b"<window>\n" * 12: "rt",
    b"<SMIL>\n": "smil",
    b"<sami>\n": "smi",
    b"x\nscript=xombiesub\n": "xss",
    b"% ZeroG\n": "zeg",
    b"PG" + b"\0" * 8 + b"\x16\0" + b"\0" * 30: "sup",
    b"FanSubber v1.2\n" + b"x" * 30: "fsb",
    b"// translated by Sami2Sasami\n": "s2k",
    b"# VobSub index file, v7\n": "idx",
    b"0:00:01.00,0:00:02.00,hi\n" * 5: "tts",
    b"0:00:01.00 0:00:02.00 hi\n" * 5: "js",
    b"WEBVTT\nSTYLE\nNOTE x\n": "vtt",
    b".ra\xfd" + b"\0" * 40: "ra",
    b"PK\x03": None,
    b"": None,
}


def test_formats(spark):
    rows = [(i, c) for i, c in enumerate(FORMATS)]
    df = spark.createDataFrame(rows, "id long, content binary")
    got = {r.id: r.suggested_ext for r in formats.detect(df, "content").collect()}
    assert [got[i] for i, _ in rows] == list(FORMATS.values())


def test_buckets_change_nothing(spark):
    rows = spark.range(4000).selectExpr("id % 3 AS k", "(id * 7919) % 4001 AS t", "CAST(id % 50 AS DOUBLE) AS v", "CAST(1 + id % 9 AS DOUBLE) AS s")
    one = stats.running_index(rows, ["k"], ["t"]).orderBy("k", "t").collect()
    assert stats.running_index(rows, ["k"], ["t"], bucket=F.floor(F.col("t") / 100)).orderBy("k", "t").collect() == one
    plain = {}
    for r in sorted(rows.collect(), key=lambda r: r.t):
        plain[r.k] = plain.get(r.k, 0.0) + (r.v - plain.get(r.k, 0.0)) * (1 - math.exp(-r.s / 300))
    for bucket in (None, F.floor(F.col("t") / 100)):
        got = {r.k: r.average_5 for r in stats.averages(rows, ["k"], ["t"], "v", "s", bucket=bucket).collect()}
        assert all(abs(got[k] - x) < 1e-9 for k, x in plain.items())
    assert [r.e for r in rows.limit(1).select(F.explode(F.array(stats.eta(F.lit(10), F.lit(30), F.lit(4.0)), stats.eta(F.lit(30), F.lit(20), F.lit(4.0)))).alias("e")).collect()] == [5.0, 0.0]
