"""Findings of several providers merged into one table: rows (keys, provider, rank, order, key, type, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unite(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """The rows of all providers, each with its provider's name and rank: the earlier in the list wins."""
    named = [df.withColumn("provider", F.lit(name)).withColumn("provider_rank", F.lit(i)) for i, (name, df) in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def first_wins(items: DataFrame, keys: list[str], by: list[str] = ["key", "type"], order: list[str] = ["provider_rank", "ord"]) -> DataFrame:  # noqa: B006
    """Of the items of a node with the same key and type the first one. As a node's whole path is among the keys, nested
    nodes merge in the same pass. min_by aggregates before the shuffle, so a hot node sends one row a task."""
    rest = [c for c in items.columns if c not in keys + by]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return items.groupBy(*keys, *by).agg(best).select(*keys, *by, "_b.*").select(*items.columns)


def condensed(items: DataFrame, keys: list[str], root_type: str = "root_type") -> DataFrame:
    """Which providers of a file share a root type, in the order in which they come first."""
    one = items.groupBy(*keys, root_type).agg(F.array_sort(F.collect_set(F.struct("provider_rank", "provider"))).alias("_p"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_p")[0]["provider_rank"]))
    return one.select(*keys, root_type, F.col("_p.provider").alias("providers"), place.alias("place"))


def largest(rows: DataFrame, keys: list[str], size: str, order: str, value: list[str]) -> DataFrame:
    """The row of the largest size; of equals the last."""
    best = F.max_by(F.struct(*value), F.struct(size, order)).alias("_b")
    return rows.groupBy(*keys).agg(best, F.max(size).alias(size)).select(*keys, size, "_b.*")
