"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tessellon.llm import kernels

#: In each thread, the tables that it has made and that are still there.
_HERE = threading.local()
_OWN: list[str] = []
#: Bytes that go to a Python worker at once, at most (a longer row goes alone).
BATCH = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def root(spark: SparkSession) -> str:
    """The shared folder; a folder of this machine only where the session names none and has no other machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tessellon-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def _bytes(size: str) -> int:
    """Spark's notation of sizes; -1 and the like are without limit."""
    digits = size.strip().lower().rstrip("b").rstrip("kmgt")
    unit = size.strip().lower().rstrip("b")[len(digits) :]
    n = int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    return n if n > 0 else 1 << 62


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH) -> Iterator[None]:
    """Within it, Arrow batches have `most` bytes at most; then the session has its own setting again."""
    named = spark.conf.get(_BATCH_KEY, None)  # None where the session only has the default
    try:
        now = named or spark.conf.get(_BATCH_KEY)
    except Exception:  # a Spark without this setting
        now = str(most)
    if _bytes(now) <= most:
        yield
        return
    spark.conf.set(_BATCH_KEY, str(most))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_KEY) if named is None else spark.conf.set(_BATCH_KEY, named)


def _tables() -> list[str]:
    if not hasattr(_HERE, "tables"):
        _HERE.tables = []
    return _HERE.tables


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{root(df.sparkSession)}/tessellon-{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    _tables().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def made() -> list[str]:
    """This thread's tables that are there now."""
    return list(_tables())


def release(spark: SparkSession, *kept: DataFrame, only: list[str]) -> None:
    """Delete those of this thread's tables in only that no frame in kept reads.

    Call it once all else that reads them is stored.
    """
    read = {f.split("/tessellon-", 1)[1].split("/", 1)[0] for df in kept for f in df.inputFiles() if "/tessellon-" in f}
    for path in made():
        if path in only and path.rsplit("/tessellon-", 1)[1] not in read:
            _tables().remove(path)
            _delete(spark, path)
    gc.collect()
    kernels.give_back()  # bitmaps and samples that the driver no longer needs


def release_since(spark: SparkSession, before: list[str], *kept: DataFrame) -> None:
    """Delete this thread's tables that were not among made() before and that no frame in kept reads."""
    release(spark, *kept, only=[t for t in made() if t not in before])
