"""Where results go: line logs, reports, copies and moves of files."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_lines(path: str, lines: Iterable[str]) -> None:
    """Add lines to a log of the driver's, one after the other; without lines it is only made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(x + "\n" for x in lines)


def write_lines(lines: DataFrame, folder: str, column: str = "line") -> None:
    """A log of any size, as text files of a folder."""
    lines.select(F.col(column).cast("string").alias("value")).write.mode("append").text(folder)


def write_reports(reports: DataFrame, folder: str, prefix: str = "") -> int:
    """Each row's xml is appended to the file it names in `file`; rows of a file are written by one task, in order of path.
    Returns the number of files. The folder must be one that all executors share."""

    def save(rows):
        made = 0
        last = None
        for r in sorted(rows, key=lambda r: (r["file"], r["path"])):
            target = os.path.join(folder, r["file"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "a", encoding="utf-8") as f:
                f.write((prefix + "\n" if prefix else "") + r["xml"] + "\n\n")
            made += r["file"] != last
            last = r["file"]
        yield made

    return sum(reports.select("file", "path", "xml").repartition("file").rdd.mapPartitions(save).collect())


def save_reports(reports: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Rows (path, file, prefix, xml) appended to the files they name, those of a file by one task in order of path; the rows that
    failed, with why. The folder must be one that all executors share."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = []
        for b in batches:
            for r in b.itertuples():
                try:
                    target = os.path.join(folder, r.file)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(target, "a", encoding="utf-8") as f:
                        f.write((r.prefix + "\n" if r.prefix else "") + r.xml + "\n\n")
                except OSError as e:
                    failed.append((r.path, str(e)))
        yield pd.DataFrame(failed, columns=["path", "error"], dtype=object)

    dealt = reports.select("path", "file", "prefix", "xml").repartition("file").sortWithinPartitions("file", "path")
    return [tuple(r) for r in dealt.mapInPandas(save, "path string, error string").collect()]


def move_all(plan: DataFrame, folder: str) -> DataFrame:
    """Carry out a plan (path, destination) on the executors, which must see the files, once: (path, destination, error), stored
    in folder. An existing target is an error; of files with one target, one is moved."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = []
            for old, new in zip(b["path"], b["destination"], strict=True):
                _, failed = move([(old, new)])
                # A task that is run again finds its own files moved.
                errors.append(failed[0][1] if failed and (os.path.exists(old) or not os.path.exists(new)) else None)
            yield pd.DataFrame({"path": b["path"], "destination": b["destination"], "error": pd.Series(errors, dtype=object)})

    out = f"{folder}/moves-{uuid.uuid4().hex}"
    plan.repartition("destination").mapInPandas(go, "path string, destination string, error string").write.parquet(out)
    return plan.sparkSession.read.parquet(out)


def copy(path: str, folder: str) -> str:
    """A copy under the same name; an older one is replaced only once the new one is whole."""
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, os.path.basename(path))
    shutil.copyfile(path, target + ".part")
    os.replace(target + ".part", target)
    return target


def move(plan: list[tuple[str, str]], log: str | None = None, test: bool = False) -> tuple[list[str], list[tuple[str, str]]]:
    """Carry out a small plan of (from, to) on the driver: (log lines, failures). An existing target is a failure."""
    lines, failed = [], []
    for old, new in plan:
        try:
            if os.path.exists(new):
                raise FileExistsError(new)
            if not test:
                os.makedirs(os.path.dirname(os.path.abspath(new)), exist_ok=True)
                shutil.move(old, new)
            lines.append(f"{old} => {new}")
        except OSError as e:
            failed.append((old, str(e)))
    if log and lines and not test:
        append_lines(log, lines)
    return lines, failed
