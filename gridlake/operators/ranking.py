"""Positions over everything, without a window that has no partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) among the rows of its keys, or among all rows where keys is empty.

    Rows are dealt out by ranges of keys and order and sorted there; how many rows of its keys lie in earlier ranges is
    added to a row's place in its range.  Only those counts, one for each range and key, meet in a window; without keys
    they are one for each range.  Rows that are equal in order take their places in any order.
    """
    by = [*(F.col(k) for k in keys), *order]
    ranged = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_range").alias("_of"), "_before", "_first")
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    place = (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name)
    return ranged.join(counts, same).select(*(c for c in df.columns if c != name), place)


def dense_numbers(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the place of its value among the distinct values in order: dense_rank over everything.  Null comes first."""
    places = numbered(df.select(F.col(value).alias("_value")).distinct(), [], [F.col("_value")], name)
    return df.join(places, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
