"""Stored collections: a table partitioned by collection, of which a change rewrites only the partitions that it touches (S6,
S14-S17).

Changes are worked out into a table beside the stored one, checked, and then put over the partitions that they touch by
Spark's dynamic partition overwrite; partitions that lose all their rows are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..session import cut, shared_dir

#: The column that names a row's collection.
COLLECTION = "collection"


def store(df: DataFrame, folder: str) -> None:
    """Write rows as collections; the folder must be new."""
    df.repartition(COLLECTION).write.mode("errorifexists").partitionBy(COLLECTION).parquet(folder)


def scan(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """The rows of all or of some collections; only their partitions are read."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    rows = rows.withColumn(COLLECTION, F.col(COLLECTION).cast("string"))
    return rows if names is None else rows.where(F.col(COLLECTION).isin(*names) if names else F.lit(False))


def _delete(spark: SparkSession, folder: str, names: list[str]) -> None:
    quoted = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{COLLECTION}={quoted.escapePathName(name)}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rewrite(spark: SparkSession, folder: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
    """Put change(rows) in place of the rows of the touched collections (a column collection): the number of collections
    written.  change sees the stored rows of those collections, and may return rows of them and of new ones.

    What is touched is found by a join on the partition column, so that Spark prunes partitions by it.
    """
    touched = touched.select(COLLECTION).distinct()
    before = scan(spark, folder).join(touched, COLLECTION, "left_semi")
    draft = f"{shared_dir(spark)}/collections-{uuid.uuid4().hex}"
    names = [f.name for f in before.schema]
    change(before).select(*names).repartition(COLLECTION).write.partitionBy(COLLECTION).parquet(draft)
    after = spark.read.schema(before.schema).parquet(draft)
    kept = after.select(COLLECTION).distinct()
    emptied = before.select(COLLECTION).distinct().join(kept, COLLECTION, "left_anti")
    emptied = [r[0] for r in emptied.collect()]  # names of collections that go
    written = kept.count()
    if written:
        # a partition of the draft is a few files already: they are put in place as they are
        after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(COLLECTION).parquet(folder)
    _delete(spark, folder, emptied)
    path = spark._jvm.org.apache.hadoop.fs.Path(draft)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return written


def upsert(spark: SparkSession, folder: str, new: DataFrame, keys: list[str]) -> int:
    """New rows replace those of the same collection and keys, and are added where there are none."""
    on = [COLLECTION, *keys]

    def change(rows: DataFrame) -> DataFrame:
        return rows.join(new.select(*on), on, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))

    return rewrite(spark, folder, new, change)


def _named(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{COLLECTION} string")


def rename_company(spark: SparkSession, folder: str, names: list[str], key: str, company: str) -> int:
    """Set the JSON key of meta and the company at the start of text in some collections."""
    return rewrite(spark, folder, _named(spark, names), lambda rows: catalog.renamed_company(rows, key, company))


def delete(spark: SparkSession, folders: list[str], names: list[str]) -> None:
    """Delete some collections of a table and, after it, of those that depend on it: whole partitions, nothing is read."""
    for folder in folders:
        _delete(spark, folder, names)


def compact(spark: SparkSession, folder: str, names: list[str], polluted: Column, key: str, variant: str) -> DataFrame:
    """Remove polluted rows of some collections; the report (n_before, n_removed, n_incomplete) of each."""
    before = scan(spark, folder, names)
    report = cut(catalog.compacted(before, polluted, [COLLECTION], key, variant)[1])
    rewrite(spark, folder, _named(spark, names), lambda rows: catalog.compacted(rows, polluted, [COLLECTION], key, variant)[0])
    return report
