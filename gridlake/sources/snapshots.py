"""Tables with the data semantics of upsert, deletion, audit and forward-only heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """K9, A4: one row for each key, the last in order (nulls count as first)."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def heads(snapshots: DataFrame, scope: str, at: str, snapshot: str) -> DataFrame:
    """The newest snapshot of each scope; one written late never moves the head back."""
    return snapshots.groupBy(scope).agg(F.max_by(snapshot, F.struct(at, snapshot)).alias("head"), F.max(at).alias("head_at"))


def audit(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each inserted, deleted or changed key, with both states as JSON."""
    pack = lambda df, name: df.select(*keys, F.to_json(F.struct(*sorted(df.columns))).alias(name))
    both = pack(old, "before").join(pack(new, "after"), keys, "full_outer")
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("operation", kind)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows but those of the deleted keys."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")
