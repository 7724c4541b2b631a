import os

import pytest

from tessellon.operators import reports
from tessellon.plans import process
from tessellon.plans.settings import Help, Settings, parse
from tessellon.sources import files, sinks
from tessellon.streaming import incremental
from tessellon.sources import samples as media


@pytest.fixture
def tree(tmp_path):
    for name, data in {"a.mkv": media.mkv(), "b.avi": b"abc", "sub/c.mkv": b"x" * 100, "sub/deeper/d.mkv": b"", "good [352441C2].txt": b"abc", "bad [DEADBEEF].txt": b"abc", "subs.srt": b"1\n00:00:01,000 --> 00:00:02,000\nhi\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_listing(spark, tree):
    found, missing = files.walk([tree, "/nowhere", f"{tree}/b.avi"])
    names = [os.path.relpath(p, tree) for p, _, _ in found]
    assert names == ["b.avi", "a.mkv", "b.avi", "bad [DEADBEEF].txt", "good [352441C2].txt", "subs.srt", "sub/c.mkv", "sub/deeper/d.mkv"]
    assert missing == ["/nowhere"] and len(files.walk([tree], False)[0]) == 5


def test_run(spark, tree):
    s = Settings(recursive=True, consumers=["ED2K", "CRC32", "MKV"], crc32_error=f"{tree}/crc.log", extension_difference_path=f"{tree}/ext.log", move_pattern="${DirectoryName}/final_${Hash-CRC32-16-UC}${FileExtension}")
    done = process.process(spark, [tree], s)
    hashes = {(os.path.basename(r.path), r.name): r.digest.hex().upper() for r in done.hashes.collect()}
    assert hashes["b.avi", "CRC32"] == "352441C2" and hashes["d.mkv", "ED2K"] == "31D6CFE0D16AE931B73C59D7E0C089C0"
    logs = {os.path.basename(k): [r.line for r in v.collect()] for k, v in process.side_logs(done, s).items()}
    assert any(x.endswith("bad [DEADBEEF].txt") for x in logs["crc.log"]) and not any("good" in x for x in logs["crc.log"])
    assert any(x.startswith("txt => unknown") for x in logs["ext.log"]) and not any("subs.srt" in x or "a.mkv" in x for x in logs["ext.log"])
    reports = {os.path.basename(r.path): r.xml for r in done.report.collect()}
    assert "<CRC32 p=\"HashProvider\"" in reports["b.avi"] and "<VideoStream>" in reports["a.mkv"] and len(reports) == 7
    plan = [(r.path, r.destination) for r in process.move_plan(done, s).collect()]
    own = [p for p in plan if p[0].endswith("b.avi")]
    assert own == [(f"{tree}/b.avi", f"{tree}/final_352441C2.avi")]
    lines, failed = sinks.move(own, f"{tree}/move.log")
    assert os.path.exists(f"{tree}/final_352441C2.avi") and lines == [f"{tree}/b.avi => {tree}/final_352441C2.avi"] and not failed
    sinks.append_lines(f"{tree}/done.log", [p for p, _, _ in files.walk([tree])[0] if not p.endswith("c.mkv")])
    rest = process.discovered(spark, files.listed(spark, [tree]), Settings(done_log_path=f"{tree}/done.log", with_extensions="mkv"))
    assert [os.path.basename(r.path) for r in rest.collect()] == ["c.mkv"]


def test_reports_are_appended(spark, tree):
    rows = spark.createDataFrame([("x.xml", "a", "<A />"), ("x.xml", "b", "<B />"), ("d/y.xml", "c", "<C />")], "file string, path string, xml string")
    assert sinks.write_reports(rows, f"{tree}/out", "P") == 2
    assert open(f"{tree}/out/x.xml").read() == "P\n<A />\n\nP\n<B />\n\n"
    assert sinks.copy(f"{tree}/b.avi", f"{tree}/copies").endswith("copies/b.avi")


def test_incremental(spark, tree, tmp_path_factory):
    work = tmp_path_factory.mktemp("stream")
    for _ in range(2):
        incremental.digest_new(spark, tree, ["MD5"], f"{work}/out", f"{work}/cp").awaitTermination()
    first = spark.read.parquet(f"{work}/out").count()
    with open(f"{tree}/new.bin", "wb") as f:
        f.write(b"new")
    incremental.digest_new(spark, tree, ["MD5"], f"{work}/out", f"{work}/cp").awaitTermination()
    rows = spark.read.parquet(f"{work}/out").collect()
    assert first == 6 and len(rows) == 7 and len({r.path for r in rows}) == 7


def test_arguments(tmp_path):
    s, paths = parse(["-R", "--Cons=CRC32,md5", "--FileMove.Mode=PlaceholderInline", "--Concurrent=6:/a,2;/b,3", "--printhashes", "README", "file.mkv"])
    assert s.recursive and s.consumers == ["CRC32", "md5"] and s.move_mode == "PlaceholderInline" and s.print_hashes and paths == ["file.mkv"]
    assert s.partitions() == (6, [("/a", 2), ("/b", 3)])
    assert parse(["--Replacements=a=b;c=d"])[0].replaced() == [("a", "b"), ("c", "d")]
    for bad in (["--Nothing"], ["-R=1"], ["--Recursive=maybe"], ["--Consumers"]):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(Help):
        parse(["--help"])
    (tmp_path / "args").write_text("// note\n\n--Recursive\n")
    assert files.arguments(str(tmp_path / "args"), ["x"]) == ["--Recursive", "x"]
    assert Settings(done_log_path="L", skip_log_path=["l", "k"]).logs() == (["l", "k"], ["L"])


def test_a_whole_run(spark, tree, tmp_path_factory):
    work = str(tmp_path_factory.mktemp("work"))
    out = str(tmp_path_factory.mktemp("out"))
    s = Settings(recursive=True, consumers=["MD5", "MKV", f"CPY:{out}/copies"], crc32_error=f"{out}/crc.log", extension_difference_path=f"{out}/ext.log", processed_log_path=[f"{out}/seen.log"], done_log_path=f"{out}/done.log")
    s.reports, s.report_directory, s.report_file_name, s.report_content_prefix = ["complete", "Matroska"], f"{out}/reports", "${FileNameWithoutExtension}_${Hash-CRC32-16-LC}.${ReportName}.${ReportFileExtension}", "# ${FileName}"
    s.print_hashes = s.print_reports = s.print_discovered_files = True
    open(f"{out}/done.log", "w").close()
    done = process.execute(spark, [tree, "/nowhere"], s, work)
    assert (done.files, done.failed) == (7, 0) and "Filediscovery: Path not found: /nowhere" in done.lines and "Accepted files: 7" in done.lines
    assert any("CRC32 => 352441C2" in x for x in done.lines) and any(x.startswith("<FileInfo>") for x in done.lines) and any(x.startswith("Accepted file: ") for x in done.lines)
    crc = open(f"{out}/crc.log").read()
    assert "bad [DEADBEEF].txt" in crc and "good" not in crc
    ext = open(f"{out}/ext.log").read()
    assert "txt => unknown\t" in ext and "subs.srt" not in ext and "a.mkv" not in ext
    report = open(f"{out}/reports/b_352441c2.Complete.xml").read()
    assert report.startswith("# b.avi\n<FileInfo>") and "<Size>3</Size>" in report and report.rstrip().endswith("</FileInfo>")
    assert "<EbmlHeader>" in open([f"{out}/reports/{x}" for x in os.listdir(f"{out}/reports") if x.startswith("a_") and "Matroska" in x][0]).read()
    for log in ("done.log", "seen.log"):
        assert len(open(f"{out}/{log}").read().splitlines()) == 7
    assert open(f"{out}/copies/a.mkv", "rb").read() == media.mkv() and len([x for x in os.listdir(f"{out}/copies") if not x.startswith(".")]) == 7
    assert done.consumers["MD5"] == done.bytes > 0 and done.lines[-1].startswith("7/7 Files | ") and done.lines[-1].endswith(" MiB/s")
    again = process.execute(spark, [tree], Settings(recursive=True, consumers=["CRC32"], done_log_path=f"{out}/done.log"), work)
    assert again.files == 0


def test_a_file_that_cannot_be_read_or_copied_is_an_error_row(spark, tree, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    open(f"{out}/blocker", "w").close()
    s = Settings(consumers=[f"CPY:{out}/blocker/sub", "CRC32"], save_errors=True, error_directory=f"{out}/errors", include_personal_data=True, processed_log_path=[f"{out}/seen.log"])
    done = process.execute(spark, [f"{tree}/b.avi"], s, out)
    assert (done.files, done.failed) == (0, 1) and any(x.startswith("Error ") for x in done.lines)
    xml = open(f"{out}/errors/{os.listdir(f'{out}/errors')[0]}").read()
    assert "b.avi" in xml and open(f"{out}/seen.log").read() == ""
    listed = spark.createDataFrame([(f"{tree}/b.avi", 3), (f"{tree}/gone", 5)], "path string, length long")
    some = process.run(listed, Settings(consumers=["MD5"]), out)
    assert [r.path for r in some.files.collect()] == [f"{tree}/b.avi"] and "gone" in some.errors.first().error


def test_moves(spark, tree, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    s = Settings(consumers=["CRC32"], move_mode="PlaceholderInline", move_pattern=f"{out}/moved/renamed_${{Hash-CRC32-16-UC}}${{FileExtension}}", replacements="renamed=final", move_log_path=f"{out}/move.log")
    done = process.execute(spark, [f"{tree}/b.avi"], s, out)
    assert done.files == 1 and not os.path.exists(f"{tree}/b.avi") and os.path.exists(f"{out}/moved/final_352441C2.avi")
    assert "b.avi => " in open(f"{out}/move.log").read()
    with open(f"{out}/pattern", "w") as f:
        f.write(f"{out}/elsewhere/${{FileNameWithoutExtension}}_x${{FileExtension}}\n")
    s = Settings(consumers=["CRC32"], move_mode="PlaceholderFile", move_pattern=f"{out}/pattern", disable_file_move=True)
    process.execute(spark, [f"{tree}/subs.srt"], s, out)
    assert os.path.exists(f"{tree}/subs_x.srt") and not os.path.exists(f"{out}/elsewhere")
    for bad, said in ((Settings(move_mode="CSharpScriptInline"), "not supported"), (Settings(move_mode="PlaceholderInline", move_test=True), "cannot enter test mode"), (Settings(skip_log_path=["/nowhere.log"]), "which do not exist"), (Settings(reports=["none"]), "no such report")):
        assert said in process.execute(spark, [tree], bad, out).lines[0]


def test_null_streams(spark, tmp_path):
    done = process.execute(spark, [], Settings(null_stream_test="3:8:2", consumers=["NULL", "CRC32"]), str(tmp_path))
    assert done.lines == ["3/3 Files | 24/24 MiB"]
    assert "cannot be used with reports" in process.execute(spark, [], Settings(null_stream_test="1:1:1", reports=["Complete"]), str(tmp_path)).lines[0]
    row = process.null_run(spark, Settings(null_stream_test="1:1:1", consumers=["CRC32", "TTH"])).first()
    assert row.CRC32.hex() == "a738ea1c"


def test_concurrency_is_capped_by_prefix(spark):
    listed = spark.createDataFrame([(f"/a/{i}", 1, 0) for i in range(40)] + [(f"/b/{i}", 1, 1) for i in range(40)] + [(f"/c/{i}", 1, 2) for i in range(40)], "path string, length long, part int")
    out = process.capped(listed, 6, [2, 1])
    tasks = out.selectExpr("spark_partition_id() AS t", "part").distinct().collect()
    assert out.count() == 120 and {p: sum(r.part == p for r in tasks) for p in range(3)} == {0: 2, 1: 1, 2: 3}


def test_registered_reports(spark, tree, tmp_path):
    reports.register("Sizes", lambda items, files: files.selectExpr("path", "concat('<Size>', length, '</Size>') AS xml"))
    try:
        done = process.execute(spark, [f"{tree}/b.avi"], Settings(reports=["sizes"], print_reports=True), str(tmp_path))
        assert "<Size>3</Size>" in done.lines
    finally:
        del reports.OWN["Sizes"]


def test_streams_of_an_index_file(spark, tree, tmp_path):
    with open(f"{tree}/x.idx", "w") as f:
        f.write("# VobSub index file, v7 (do not modify this line!)\nid: en, index: 0\n# alt: English\ntimestamp: 00:00:01:000, filepos: 0\nid: de, index: 4\nid: fr, index: 5\ntimestamp: 00:00:02:000, filepos: 0\n")
    done = process.process(spark, [f"{tree}/x.idx", f"{tree}/subs.srt"], Settings(consumers=["CRC32"]), str(tmp_path))
    rows = {(os.path.basename(r.path), r.node, r.key): r.text for r in done.items.collect()}
    stream = "/MediaProvider/SubtitleStream:"
    assert rows["x.idx", f"{stream}0", "Language"] == "English" and rows["x.idx", f"{stream}2", "Language"] == "fr" and rows["x.idx", f"{stream}2", "Index"] == "5"
    assert rows["x.idx", f"{stream}0", "ContainerCodecId"] == "text/idx" and ("x.idx", f"{stream}1", "Index") not in rows
    assert rows["subs.srt", f"{stream}0", "ContainerCodecId"] == "text/srt"
