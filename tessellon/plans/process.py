"""A whole run over files: discovery, one read of each file, digests and parsers, merged items, reports, logs, copies, moves.

Each file is read once, as a stream: all digests, a copy and the bytes that the parsers and format rules look at come from that
read. What was found is stored as one table with a row for each file, and everything else is derived from it. A file that can't
be read is a row with an error, tried three times; it doesn't fail the run.
"""

from __future__ import annotations

import datetime
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.functions import digests, jvm, paths
from tessellon.functions import text as T
from tessellon.operators import discovery, formats, merge, providers, reports, subtitles
from tessellon.plans.settings import Settings
from tessellon.sources import files, sinks

#: Consumers that parse; all other names are digests, but CPY:folder, which copies.
PARSERS = {"MP4": "MP4Provider", "MKV": "MatroskaProvider", "OGG": "OggProvider"}
#: Bytes of a file that parsers and structure reports get; larger files are parsed up to there.
PARSED = 1 << 30
TRIES = 3
#: What is computed where no consumers are named.
DEFAULT = ["CRC32", "MD5", "SHA1"]


@dataclass
class Run:
    """What a run found: lazy views of one stored table (or, without a folder to store it in, of the plan that makes it)."""

    files: DataFrame
    hashes: DataFrame
    items: DataFrame
    suggested: DataFrame
    report: DataFrame
    structure: DataFrame
    errors: DataFrame


@dataclass
class Done:
    """What a run did: lines for the terminal, and counts."""

    run: Run | None
    lines: list[str] = field(default_factory=list)
    files: int = 0
    bytes: int = 0
    failed: int = 0
    seconds: float = 0.0
    consumers: dict[str, int] = field(default_factory=dict)  # bytes that each has taken

    def summary(self) -> str:
        rate = self.bytes / (1 << 20) / self.seconds if self.seconds else 0.0
        return f"{self.files}/{self.files + self.failed} Files | {self.bytes / (1 << 20):.0f} MiB | {rate:.1f} MiB/s"


def _wanted(settings: Settings) -> tuple[list[str], list[str], list[str]]:
    """(digests, providers, folders to copy to) that the consumers ask for."""
    wanted = settings.consumers or DEFAULT
    names = [c for c in wanted if c.upper() not in PARSERS and not c.upper().startswith("CPY")]
    if settings.crc32_error and "CRC32" not in [h.upper() for h in names]:
        names.append("CRC32")
    if "ED2K" in [h.upper() for h in names]:
        names.append("ED2K2")
    return digests.selected(names), [PARSERS[c.upper()] for c in wanted if c.upper() in PARSERS], [c[4:] for c in wanted if c.upper().startswith("CPY:")]


def discovered(spark: SparkSession, listed: DataFrame, settings: Settings) -> DataFrame:
    """The listed files that pass the extension filter and are in no log, with their partition; where a cap on concurrent files is
    set, in as many tasks as it allows, and of each prefix in as many as its share."""
    out = listed.filter(discovery.extension_filter(F.col("path"), settings.with_extensions))
    skip, _ = settings.logs()
    for log in skip:
        out = discovery.without_logged(out, spark.read.text(log))
    most, parts = settings.partitions()
    part = discovery.partition_of(F.col("path"), [p for p, _ in parts])
    out = out.withColumn("part", part)
    return out if most <= 1 and not parts else capped(out, most, [n for _, n in parts])


def capped(listed: DataFrame, most: int, shares: list[int]) -> DataFrame:
    """listed (path, part) in at most `most` tasks, the files of part i in shares[i] of them; the rest have what is left, one at
    least. A task takes one file after the other, so no more are read at once."""
    shares = [*shares, max(1, most - sum(shares))]
    first = [sum(shares[:i]) for i in range(len(shares))]
    slot = F.get(F.lit(first), F.col("part")) + F.pmod(F.xxhash64("path"), F.get(F.lit(shares), F.col("part"))).cast("int")
    return listed.withColumn("slot", slot).repartitionById(sum(shares), F.col("slot")).drop("slot")


_FOUND = providers.ITEMS.removeprefix("path string, ").replace(" string", ": string").replace(" int", ": int").replace(" long", ": bigint").replace(" array", ": array")


def _parsed(names: list[str]) -> Column:
    """items of a file's bytes, as an array of structs."""

    @F.pandas_udf(f"array<struct<{_FOUND}>>")
    def run(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(fields, r[1:], strict=True)) for r in providers.rows_of(p, bytes(c or b""), names)] for p, c in zip(path, content, strict=True)], dtype=object)

    fields = [c.split(":")[0] for c in _FOUND.split(", ")]
    return run(F.col("path"), F.col("_parsed"))


def wide(contents: DataFrame, settings: Settings, parallel: bool = False) -> DataFrame:
    """One row for each file: path, length, error, the digests by name, found (items), candidates, suggested_ext, structure.

    contents: (path, length), and content where the bytes are there already; else they are read here, once.
    """
    names, parse, copies = _wanted(settings)
    structure = any(r in reports.STRUCTURES for r in settings.reports)
    own = set(parse) - set(PARSERS.values())
    head = f"HEAD-{PARSED if own else T.HEAD_BYTES}" if own or not (parse or structure) else f"MEDIA-{T.HEAD_BYTES}-{PARSED}"
    if "content" in contents.columns:
        read = contents.select("path", "length", F.lit(None).cast("string").alias("error"), *digests.digests(F.col("content"), names), F.col("content").alias("_parsed"))
    else:
        asked = [*names, head, *(f"CPY|{c}" for c in copies)]
        got = contents.select("path", "length", jvm.of_file(F.col("path"), asked, TRIES, parallel).alias("_got"))
        read = got.select("path", "length", F.get("_got", F.lit(len(asked))).cast("string").alias("error"), *[F.get("_got", F.lit(i)).alias(n) for i, n in enumerate(names)], F.get("_got", F.lit(len(names))).alias("_parsed"))
    if parse:
        read = read.withColumn("found", _parsed(parse))
    else:
        read = read.withColumn("found", F.lit(None).cast(f"array<struct<{_FOUND}>>"))
    if structure:
        for name, make in reports.STRUCTURES.items():
            read = read.withColumn(f"xml_{name}", reports.column(make)(F.col("_parsed")))
    index = F.contains(T.decoded(F.substring("_parsed", 1, 64)), F.lit("VobSub index file, v"))
    read = read.withColumn("idx_streams", subtitles.index_column(F.when(index, T.decoded(T.head(F.col("_parsed"))))))
    keep = [c for c in read.columns if c != "_parsed"]
    return formats.detect(read, "_parsed", "length", keep=keep)


def run(contents: DataFrame, settings: Settings, folder: str | None = None, parallel: bool = False) -> Run:
    """contents: path, length, and content or not. With a folder (shared by all executors) the wide table is stored there.
    parallel: each file is digested by several threads."""
    table = wide(contents, settings, parallel)
    if folder:
        path = f"{folder}/run-{uuid.uuid4().hex}"
        table.write.parquet(path)
        table = contents.sparkSession.read.schema(table.schema).parquet(path)
    names, parse, _ = _wanted(settings)
    long = digests.long_form(table, ["path"], names)
    suggested = table.filter("error IS NULL").select("path", "length", "candidates", "suggested_ext", "idx_streams")
    items = providers.format_items(suggested).unionByName(providers.digest_items(long))
    if parse:
        items = table.select("path", F.explode("found").alias("i")).select("path", "i.*").unionByName(items)
    info = table.filter("error IS NULL").select("path", "length")
    made = [c for c in table.columns if c.startswith("xml_")]
    structure = table.filter("error IS NULL").select("path", F.explode(F.array(*[F.struct(F.lit(c[4:]).alias("report"), F.col(c).alias("xml")) for c in made])).alias("r")).select("path", "r.report", "r.xml") if made else None
    return Run(info, long, items, suggested, reports.complete(items, info), structure, table.filter("error IS NOT NULL").select("path", "length", "error"))


def side_logs(done: Run, settings: Settings) -> dict[str, DataFrame]:
    """Lines for the digest and extension logs, by the log's path."""
    out = {}
    if settings.crc32_error:
        path, _, pattern = settings.crc32_error.partition(",")
        crc = done.hashes.filter("name = 'CRC32'").select("path", F.hex("digest").alias("crc"))
        out[path] = discovery.crc_error_lines(crc, "path", "crc", pattern or r"(?i)${CRC32}")
    if settings.extension_difference_path:
        # The suggestion of the first provider that has one.
        best = merge.first_wins(done.items.filter("key = 'SuggestedFileExtension'"), ["path"])
        both = done.files.join(best.select("path", F.array_join("parts", " ").alias("suggested")), "path", "left")
        out[settings.extension_difference_path] = discovery.extension_lines(both.withColumn("ext", paths.extension(F.col("path"))), "path", "ext", "suggested")
    return out


def _with_hashes(done: Run, settings: Settings) -> tuple[DataFrame, dict[str, Column]]:
    """Files with a column for each asked digest and suggested_ext."""
    names, _, _ = _wanted(settings)
    wide_ = done.hashes.groupBy("path").pivot("name", names).agg(F.first("digest")) if names else done.files.select("path").limit(0)
    both = done.files.join(wide_, "path", "left").join(done.suggested.select("path", "suggested_ext"), "path", "left")
    return both, {n: F.col(f"`{n}`") for n in names}


def _tokens(length: Column) -> dict[str, Column]:
    return paths.file_tokens(F.col("path"), length) | {"SuggestedExtension": F.coalesce(F.concat(F.lit("."), "suggested_ext"), F.lit(""))}


def report_files(done: Run, settings: Settings) -> DataFrame:
    """(path, file, prefix, xml): the chosen reports with the name of the file that each goes to."""
    asked = {r.lower() for r in settings.reports}
    both, hashes = _with_hashes(done, settings)
    parts = [done.report.select("path", F.lit(n).alias("report"), "xml") for n in reports.COMPLETE if n.lower() in asked]
    if done.structure is not None:
        parts += [done.structure.filter(F.lower("report").isin(*asked))]
    parts += [make(done.items, done.files).select("path", F.lit(n).alias("report"), "xml") for n, make in reports.OWN.items() if n.lower() in asked]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    tokens = _tokens(F.col("length")) | {"ReportName": F.col("report"), "ReportFileExtension": F.lit("xml")}
    rows = every.join(both, "path")
    return rows.select("path", paths.expand(settings.report_file_name, tokens, hashes).alias("file"), paths.expand(settings.report_content_prefix, tokens, hashes).alias("prefix"), "xml")


def move_plan(done: Run, settings: Settings) -> DataFrame:
    """(path, destination) of the files that the pattern moves."""
    both, hashes = _with_hashes(done, settings)
    pattern = settings.move_pattern
    if settings.move_mode == "PlaceholderFile":
        with open(pattern, encoding="utf-8") as f:
            pattern = f.read().strip("\r\n")
    expanded = paths.expand(pattern, _tokens(F.col("length")), hashes)
    to = paths.destination(F.col("path"), expanded, settings.replaced(), settings.disable_file_move, settings.disable_file_rename)
    return both.select("path", to.alias("destination")).filter(paths.moves(F.col("path"), F.col("destination")))


def process(spark: SparkSession, entries: list[str], settings: Settings, folder: str | None = None) -> Run:
    """A run over files and folders that the driver lists, of any size, empty ones included. No path is collected."""
    listed = files.walk(entries, settings.recursive)[0]
    found = discovered(spark, spark.createDataFrame(listed, files.FILES), settings)
    if jvm.available(spark):
        return run(found.select("path", "length"), settings, folder, 2 * len(listed) <= spark.sparkContext.defaultParallelism)
    some = [files.literal(e) for e in entries]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(some).select("path", "length", "content")
    return run(files.with_empty(read, found).join(found.select("path"), "path", "left_semi"), settings, folder)


def null_run(spark: SparkSession, settings: Settings) -> DataFrame:
    """(tag, length, digests) of streams of zero bytes: `count:MiB:parallel`."""
    count, mib, parallel = ([int(x) for x in settings.null_stream_test.split(":")] + [1, 1])[:3]
    names, _, _ = _wanted(settings)
    made = files.zeros(files.null_streams(spark, count, mib << 20).repartition(max(1, parallel), "tag"))
    return made.select("tag", "length", *digests.digests(F.col("content"), names))


def _problem(settings: Settings) -> str | None:
    """Why these settings can't be run."""
    if settings.null_stream_test and settings.reports:
        return "NullStreamTest cannot be used with reports"
    if gone := [p for p in settings.skip_log_path if not os.path.exists(p)]:
        return f"SkipLogPath contains file paths which do not exist: {', '.join(gone)}"
    if settings.move_mode not in ("None", "PlaceholderInline", "PlaceholderFile"):
        return f"FileMove.Mode {settings.move_mode} is not supported"
    if settings.move_test and settings.move_mode != "None":
        return "FileMove.Test: cannot enter test mode without a terminal"
    known = {n.lower() for n in (*reports.COMPLETE, *reports.STRUCTURES, *reports.OWN)}
    if unknown := [r for r in settings.reports if r.lower() not in known]:
        return f"no such report: {', '.join(unknown)}"
    return None


def _lines(df: DataFrame) -> Iterator[str]:
    """The single column of df, a partition at a time."""
    return (r[0] for r in df.toLocalIterator())


def _save_errors(rows: DataFrame, settings: Settings, session: str) -> list[str]:
    said = []
    for i, r in enumerate(rows.toLocalIterator()):
        kind, _, message = r.error.partition(": ")
        said.append(f"Error {kind}: {message}")
        if settings.save_errors:
            now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%d %H%M%S.%f")
            xml = reports.error_report("UIException", now, "ConsumingStream", {"FileName": (os.path.basename(r.path), True)}, session, settings.include_personal_data, f"{kind}: {message}")
            os.makedirs(settings.error_directory, exist_ok=True)
            with open(os.path.join(settings.error_directory, f"Error {now} {i}.xml"), "w", encoding="utf-8") as f:
                f.write(xml)
    return said


def execute(spark: SparkSession, entries: list[str], settings: Settings, folder: str) -> Done:
    """Do all that the settings ask: side logs, printed hashes and reports, saved reports and errors, moves, processed logs.

    folder: where the run's table is stored, in a store that all executors share. Report, log and error folders are paths
    that the driver and, for reports, the executors share. Lines for the terminal are returned.
    """
    done, began = Done(None), time.monotonic()
    if problem := _problem(settings):
        done.lines.append(problem)
        return done
    if settings.null_stream_test:
        table = null_run(spark, settings)
        done.files, done.bytes = table.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        done.lines.append(f"{done.files}/{done.files} Files | {done.bytes >> 20}/{done.bytes >> 20} MiB")
        return done
    for path in files.walk(entries, settings.recursive)[1]:
        done.lines.append(f"Filediscovery: Path not found: {path}")
    if settings.print_discovered_files:
        done.lines += [f"Accepted file: {p}" for p in _lines(discovered(spark, files.listed(spark, entries, settings.recursive), settings).select("path"))]
    got = done.run = process(spark, entries, settings, folder)
    done.files, done.bytes = got.files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    done.lines.append(f"Accepted files: {done.files + got.errors.count()}")
    errors = _save_errors(got.errors, settings, uuid.uuid4().hex)
    done.lines += errors
    done.failed = len(errors)
    for path, lines in side_logs(got, settings).items():
        sinks.append_lines(path, _lines(lines))
    if settings.print_hashes:
        name = paths.file_name(F.col("path"))
        done.lines += _lines(got.hashes.select("path", F.col("name").alias("n"), F.concat(name, F.lit(" "), "name", F.lit(" => "), F.hex("digest")).alias("line")).orderBy("path", "n").select("line"))
    good = got.files.select("path")
    if settings.reports:
        rows = report_files(got, settings)
        if settings.print_reports:
            done.lines += _lines(rows.orderBy("path").select("xml"))
        if settings.report_directory:
            bad = sinks.save_reports(rows, settings.report_directory)
            done.lines += [f"Error IOException: {e}" for _, e in bad]
            good = good.filter(~F.col("path").isin([p for p, _ in bad])) if bad else good
    if settings.move_mode != "None":
        moved = sinks.move_all(move_plan(got, settings), folder)
        if settings.move_log_path:
            sinks.append_lines(settings.move_log_path, _lines(moved.filter("error IS NULL").select(F.concat("path", F.lit(" => "), "destination"))))
        done.lines += [f"Error IOException: {e}" for e in _lines(moved.filter("error IS NOT NULL").select("error"))]
        good = good.join(moved.filter("error IS NOT NULL").select("path"), "path", "left_anti")
    for log in settings.logs()[1]:
        sinks.append_lines(log, _lines(good))
    done.consumers = {c: done.bytes for c in settings.consumers or DEFAULT}
    done.seconds = time.monotonic() - began
    done.lines.append(done.summary())
    return done
