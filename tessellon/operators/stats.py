"""Statistics of timed samples by track: one window over each track's samples, then aggregations.

Samples have a time in nanoseconds, a number of frames and a size; ties of time keep their order number. The rate of a
pair of neighbours is 1e9 * frames of the first / time between; it is infinite where no time passes, and such a rate
still counts as a neighbour of others, but not in the histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INFINITE = float("inf")


def rates(samples: DataFrame, keys: list[str], time: str = "timecode_ns", frames: str = "frames", order: str = "ord") -> DataFrame:
    """samples with rate, and r1, r2: the rates one and two pairs before. Before the first pair r1 is the rate itself, r2 is 0."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    gap, before = F.col(time) - F.lag(time).over(w), F.lag(frames).over(w)
    value = F.when(gap == 0, F.when(before == 0, F.lit(float("nan"))).otherwise(F.lit(INFINITE))).otherwise(F.lit(1e9) * before / gap)
    out = samples.withColumn("_n", F.row_number().over(w)).withColumn("rate", F.when(F.col("_n") > 1, value))
    out = out.withColumn("r1", F.when(F.col("_n") == 2, F.col("rate")).otherwise(F.lag("rate", 1).over(w)))
    return out.withColumn("r2", F.when(F.col("_n") <= 3, F.lit(0.0)).otherwise(F.lag("rate", 2).over(w)))


def finite(rate: Column) -> Column:
    return rate.isNotNull() & ~F.isnan(rate) & (F.abs(rate) != INFINITE)


def stable(rate: Column, r1: Column, r2: Column) -> Column:
    """Whether a rate is close to the two before it."""
    near = (r1 + r2 / 2) * 0.1
    return finite(rate) & (F.abs(rate - r1) < near) & (F.abs(rate - r2) < near)


def track_stats(samples: DataFrame, keys: list[str], time: str = "timecode_ns", frames: str = "frames", size: str = "size", order: str = "ord", private_size: str | None = None) -> DataFrame:
    """Length, size, frames, average rates and the extremes of stable rates of each track."""
    r = rates(samples, keys, time, frames, order)
    ok = stable(F.col("rate"), F.col("r1"), F.col("r2"))
    extra = F.coalesce(F.max(private_size), F.lit(0)) if private_size else F.lit(0)
    out = r.groupBy(*keys).agg(
        ((F.max(time) - F.min(time)) / F.lit(1_000_000)).alias("_ms"),
        (F.sum(size) + extra).cast("long").alias("track_size"),
        F.sum(frames).cast("long").alias("sample_count"),
        F.min(F.when(ok, F.col("rate"))).alias("min_sample_rate"),
        F.max(F.when(ok, F.col("rate"))).alias("max_sample_rate"),
    )
    ms = F.floor("_ms")
    length = ms / F.lit(1000.0)
    some = lambda n: (n != 0) & (ms != 0)
    return out.select(
        *keys,
        length.alias("track_length"),
        "track_size",
        "sample_count",
        F.when(some(F.col("track_size")), F.try_divide(F.col("track_size") * F.lit(8.0), length)).alias("average_bitrate"),
        F.when(some(F.col("sample_count")), F.try_divide(F.col("sample_count").cast("double"), length)).alias("average_sample_rate"),
        "min_sample_rate",
        "max_sample_rate",
    )


def histogram(samples: DataFrame, keys: list[str], time: str = "timecode_ns", frames: str = "frames", order: str = "ord") -> DataFrame:
    """(keys, rate, count, first): how often each finite rate occurs, and at which pair it is first seen."""
    r = rates(samples, keys, time, frames, order).filter(finite(F.col("rate")))
    return r.groupBy(*keys, "rate").agg(F.count("*").alias("count"), F.min("_n").alias("first"))


def dominant_rate(bins: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent rate; of equals the one seen last."""
    return bins.groupBy(*keys).agg(F.max_by("rate", F.struct("count", "first")).alias("dominant_rate"))


def rate_deviation(bins: DataFrame, keys: list[str]) -> DataFrame:
    """The root of sum(r^2) / n - (sum(r) / n)^2, the sums over distinct rates and n over all pairs, as the reports have it;
    weighted_deviation is the standard deviation of all rates."""
    n, r = F.sum("count"), F.col("rate")
    mean = F.sum(r) / n
    weighted = F.sum(r * F.col("count")) / n
    variance = F.sum(r * r) / n - mean * mean
    true = F.sum(r * r * F.col("count")) / n - weighted * weighted
    root = lambda v: F.when(v >= 0, F.sqrt(v)).otherwise(F.lit(float("nan")))
    return bins.groupBy(*keys).agg(root(variance).alias("rate_deviation"), F.sqrt(F.greatest(true, F.lit(0.0))).alias("weighted_deviation"))


def running_index(rows: DataFrame, keys: list[str], order: list[str], name: str = "idx", bucket: Column | None = None) -> DataFrame:
    """Place of a row among those of its keys, from 0.

    bucket: any function of a row that doesn't fall along the order, such as its day. With it, a hot key's rows are ordered in as
    many tasks as it has buckets, and places start from the counts of the buckets before; without it, a key is one task's.
    """
    if bucket is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    both = rows.withColumn("__bucket", bucket)
    sizes = both.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    own = both.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)) - 1)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "__bucket"]]
    joined = own.alias("a").join(sizes.alias("b"), [*same], "left")
    return joined.select(*[f"a.{c}" for c in rows.columns if c != name], (F.col(f"a.{name}") + F.col("b.__before")).alias(name))


def last_marker(rows: DataFrame, keys: list[str], order: list[str], marker: Column, value: Column, name: str) -> DataFrame:
    """The value of the latest marker row up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(marker, value), ignorenulls=True).over(w))


def scaled_timecode(block: Column, cluster: Column, segment_scale: Column, track_scale: Column) -> Column:
    """Nanoseconds of a block, at least 0; the segment's scale is 1,000,000 where it isn't stated."""
    return F.greatest(F.lit(0), ((block + cluster) * F.coalesce(track_scale, F.lit(1.0)) * F.coalesce(segment_scale, F.lit(1_000_000))).cast("long"))


def averages(samples: DataFrame, keys: list[str], order: list[str], value: str, seconds: str, minutes: tuple[int, ...] = (1, 5, 15), bucket: Column | None = None) -> DataFrame:
    """Exponential averages of a throughput, one column for each time constant.

    A step takes the average to its value by 1 - exp(-s / T), so a value's share in the end is that, times exp(-(time after it) / T):
    a sum over rows that needs only the time up to each row. bucket: as for running_index(); a hot key is then many tasks'.
    """
    part, s = [*keys, *(["__bucket"] if bucket is not None else [])], F.col(seconds).cast("double")
    rows = samples if bucket is None else samples.withColumn("__bucket", bucket)
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum(s).over(Window.partitionBy(*part)) - F.sum(s).over(w)
    rows = rows.withColumn("__after", after)
    share = lambda m: F.col(value).cast("double") * (1 - F.exp(-s / (60.0 * m))) * F.exp(-F.col("__after") / (60.0 * m))
    sums = rows.groupBy(*part).agg(F.sum(s).alias("__s"), *[F.sum(share(m)).alias(f"average_{m}") for m in minutes])
    if bucket is None:
        return sums.drop("__s")
    later = F.sum("__s").over(Window.partitionBy(*keys).orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("__later", F.coalesce(later, F.lit(0.0)))
    return sums.groupBy(*keys).agg(*[F.sum(F.col(f"average_{m}") * F.exp(-F.col("__later") / (60.0 * m))).alias(f"average_{m}") for m in minutes])


def eta(done: Column, total: Column, rate: Column) -> Column:
    """Seconds that the rest takes at a rate; null without one."""
    return F.when(rate > 0, F.greatest(total - done, F.lit(0)) / rate)
