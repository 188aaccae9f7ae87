"""Exact dedup against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, new_path, written


def normalised(text: Column) -> Column:
    """Each run of white space (space, \\t \\n \\v \\f \\r) becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the normalised text in UTF-8, lowercase hex; rows with a null id are left out."""
    text = normalised(F.col(text_col)).cast("binary")
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"))


class DigestIndex:
    """An append-only table (digest, keep_id, batch) of every distinct text seen so far.

    The files are bucketed and sorted by digest, so that the anti-join of a new batch reads them in place: only the
    batch, already reduced to one row for each digest, is shuffled.  The table lies at a path that outlives the
    session; opening that path again goes on from there.  A batch name is taken once, when all its rows are in: a list
    beside the table names the complete batches.  A batch whose append died halfway is completed by ingesting it again;
    ingesting a complete one again adds nothing, and fails if the rows hold texts that the index lacks.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "digest-index")
        self.done = f"{self.path}-complete"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = "digest_index_" + "".join(c if c.isalnum() else "_" for c in self.path.rsplit("/", 1)[-1]).lower()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, rows: DataFrame, batch: str) -> None:
        """Append the digests of rows (doc_id, digest) that the index lacks; the smallest doc_id of the batch stays.

        Of equal texts in different batches the one ingested first stays.  A digest of any number of rows is reduced to
        one before the shuffle.
        """
        tmp = Scratch()
        once = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        known = self.entries().select("digest", F.lit(True).alias("known")).hint("merge")
        # an outer join, as Spark would take an anti-join before the grouping, with every copy of a text
        fresh = once.join(known, "digest", "left").where("known IS NULL").select("digest", "keep_id", F.lit(batch).alias("batch"))
        # written beside the table first: a table cannot be read and appended to in one job
        fresh = tmp.written(fresh, "digest-batch")
        if batch in self.complete():
            more = fresh.limit(1).count()
            tmp.clear()
            if more:
                raise ValueError(f"batch {batch!r} is in the index, without some of these texts")
            return
        fresh.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(self.done)
        tmp.clear()

    def complete(self) -> set[str]:
        """Names of the batches whose rows are all in the index."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.done)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return set()
        return {r["batch"] for r in self.spark.read.schema("batch string").parquet(self.done).collect()}

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, digest) with keep_id (null if the index lacks the digest) and group_size (rows of that digest among the given ones)."""
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        known = written(sizes.join(self.entries().select("digest", "keep_id").hint("merge"), "digest", "left"), "digest-groups")
        # both sides are shuffled for this join, so that a digest of very many rows can be split
        return rows.join(known.hint("merge"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    The documents are ingested as two batches, lower doc_ids first, so the row with the smallest doc_id stays; of texts
    that a given index already has, the row that it names stays.  The batches are named after batch, or after the rows
    themselves, so the same rows may be sent again and other rows are new batches.  Defined cases: null texts count as empty and are equal to each other; repeated rows (the same id and text) count in
    group_size and are each kept or dropped alike; rows with a null id are left out; further columns are ignored; an
    empty table gives an empty table.
    """
    index = index or DigestIndex(docs.sparkSession)
    rows = written(digests(docs, id_col, text_col), "digests")
    middle, n, content = rows.agg(
        F.floor((F.min("doc_id").cast("double") + F.max("doc_id").cast("double")) / 2).cast("long"), F.count("*"), F.sum(F.xxhash64("doc_id", "digest").cast("decimal(20,0)"))
    ).first()
    if middle is not None:
        batch = f"{n}:{content}" if batch is None else batch
        index.ingest(rows.where(F.col("doc_id") <= middle), f"{batch}:lower")
        index.ingest(rows.where(F.col("doc_id") > middle), f"{batch}:upper")
    out = index.lookup(rows)
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
