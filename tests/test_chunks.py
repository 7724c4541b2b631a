import pytest

from tessellon.functions import kernels
from tessellon.operators import chunks, formats, providers, reports, subtitles


def test_ranges_give_the_digests_of_the_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kernels, "ED2K_CHUNK", 3000)
    data = {"a": b"", "b": b"x" * 10, "c": bytes(range(250)) * 12, "d": b"y" * 6000, "e": b"z" * 7001}
    for k, v in data.items():
        (tmp_path / k).write_bytes(v)
    files = spark.createDataFrame([(str(tmp_path / k), len(v)) for k, v in data.items()], "path string, length long")
    got = {r.path[-1]: (bytes(r.red), r.blue and bytes(r.blue)) for r in chunks.ed2k(chunks.read_ranges(chunks.ranges(files, 3000))).collect()}
    assert got == dict(zip(data, kernels.ed2k(list(data.values())), strict=True))
    got = {r.path[-1]: bytes(r.tth) for r in chunks.tth(chunks.read_ranges(chunks.ranges(files, 2048)), 2048).collect()}
    assert got == dict(zip(data, kernels.tth(list(data.values())), strict=True))
    with pytest.raises(ValueError):
        chunks.tth(files, 3000)


INDEX = "# VobSub index file, v7\nid: en, index: 0\n# alt: English\ntimestamp: 00:00:01:000, filepos: 0\ntimestamp: 00:00:02:000, filepos: 9\nid: de, index: 1\nid: fr, index: 2\ntimestamp: 00:00:03:000, filepos: 9\n"


def test_subtitles(spark):
    assert subtitles.index_streams(INDEX) == [(0, "English", 2), (1, "de", 0), (2, "fr", 1)]
    assert subtitles.index_streams("id: en, index: x\n") == []
    files = spark.createDataFrame([("a.idx", INDEX), ("b", None)], "path string, text string")
    assert [(r["index"], r.language) for r in subtitles.index_rows(files).collect()] == [(0, "English"), (2, "fr")]
    script = b"[Script Info]\n[Events]\nFormat: Layer, Start, End, Text\r\nDialogue: 0,0:00:01.50,0:00:02.00,a,b\nDialogue: 0,bad,x,y\n"
    assert subtitles.script_times(script) == [1_500_000_000] and subtitles.script_times(b"nothing") == []


def test_format_items(spark):
    files = spark.createDataFrame([("a", bytearray(b"PK\x03\x04" + b"x" * 60)), ("b", bytearray(b"1\n00:00:01,000 --> 00:00:02,000\nhi\n"))], "path string, content binary")
    rows = sorted((r.path, r.node, r.key, r.text) for r in providers.format_items(formats.detect(files, "content", keep=["path"])).collect())
    assert ("a", "/MediaProvider", "FileTypeIdentifier", "compression/zip") in rows and ("b", "/MediaProvider/SubtitleStream:0", "ContainerCodecId", "text/srt") in rows


def test_errors():
    text = reports.error_report("ReadError", "now", "no <file>", {"Path": ("/home/jo", True), "Size": ("7", False)}, "s")
    assert "/home/jo" not in text and "Hidden(" in text and "no &lt;file&gt;" in text
    assert "/home/jo" in reports.error_report("ReadError", "now", "", {"Path": ("/home/jo", True)}, "s", personal=True)
