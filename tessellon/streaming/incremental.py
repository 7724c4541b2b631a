"""Incremental runs: files that came since the last run, once each, by Structured Streaming's own record of what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessellon.functions import digests

CONTENT = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    """(path, length, content) of files as they come, so many at a time."""
    reader = spark.readStream.format("binaryFile").schema(CONTENT).option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder).select("path", "length", "content")


def run_new(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give all that is there and not done yet to handle(batch, number), then stop. The checkpoint is the done log: a batch that
    failed comes again with the same number and the same files."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def digest_new(spark: SparkSession, folder: str, names: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Digests of new files, appended to a Parquet table of (path, name, digest, batch)."""
    chosen = digests.selected(names)

    def handle(batch: DataFrame, number: int) -> None:
        wide = batch.select("path", *digests.digests(F.col("content"), chosen))
        digests.long_form(wide, ["path"], chosen).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return run_new(new_files(spark, folder), handle, checkpoint)


def throughput(progress: DataFrame, time: str = "ts", size: str = "bytes", late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Files and bytes by window of event time, with a bound on how late rows may come."""
    windows = progress.withWatermark(time, late).groupBy(F.window(time, window))
    return windows.agg(F.count("*").alias("files"), F.sum(size).alias("bytes")).select("window.start", "window.end", "files", "bytes")
