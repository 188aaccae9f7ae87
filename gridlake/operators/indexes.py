"""Listings of stored collections: scopes, counts, details."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scopes(collections: DataFrame, sheets: DataFrame) -> DataFrame:
    """Each collection with the names of its visible sheets in order: (name, sheets).

    collections: name, file_id; sheets: file_id, sheet_index, sheet_name, visible.
    """
    listed = sheets.where("visible").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("sheet_index", "sheet_name"))).alias("s"))
    names = F.coalesce(F.transform("s", lambda x: x["sheet_name"]), F.array().cast("array<string>"))
    return collections.join(listed, "file_id", "left").select("name", names.alias("sheets"))


def listing(collections: DataFrame, rows: DataFrame) -> DataFrame:
    """(name, chunk_count): the count that the metadata states in digits, else that of the rows (collection ...)."""
    stated = F.get_json_object("meta", "$.document_count")
    stated = F.when(stated.rlike("^[0-9]+$"), F.try_to_number(stated, F.lit("9" * 18)).cast("long"))
    known = collections.withColumn("stated", stated)
    # only collections that state nothing are counted
    counted = rows.join(known.where("stated IS NULL").select(F.col("name").alias("collection")), "collection", "left_semi").groupBy("collection").agg(F.count("*").alias("n"))
    out = known.join(counted.withColumnRenamed("collection", "name"), "name", "left")
    return out.select("name", F.coalesce("stated", "n", F.lit(0)).alias("chunk_count"))


def details(collections: DataFrame, rows: DataFrame, sheets: DataFrame, limit: int = 15) -> DataFrame:
    """(name, document_count, sample, sheets, tables): the count of rows, the first of them by id, and the tables that were
    detected in any sheet, one list after the other.

    rows: collection, id, text; sheets: file_id, sheet_index, sheet_name, tables (array).  A sample is cut before it is
    gathered.
    """
    counts = rows.groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("n"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("collection").orderBy("id"))).where(F.col("_n") <= limit)
    sample = first.groupBy(F.col("collection").alias("name")).agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("sample"))
    held = sheets.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("sheet_index", "sheet_name", "tables"))).alias("s"))
    held = held.select("file_id", F.transform("s", lambda x: x["sheet_name"]).alias("sheets"), F.flatten(F.transform("s", lambda x: F.coalesce(x["tables"], F.array().cast(sheets.schema["tables"].dataType)))).alias("tables"))
    out = collections.join(counts, "name", "left").join(sample, "name", "left").join(held, "file_id", "left")
    return out.select("name", F.coalesce("n", F.lit(0)).alias("document_count"), "sample", "sheets", "tables")
