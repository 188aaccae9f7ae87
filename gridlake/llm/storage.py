"""Tables and files in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset and Spark runs on one machine a local folder is set instead."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: The paths that a Run has given out; empty outside of one.  Each thread has its own.
_run: ContextVar[list[str] | None] = ContextVar("gridlake_run", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    given = _run.get()
    if given is not None:
        given.append(path)
    return path


@contextmanager
def run(spark: SparkSession):
    """What is written inside is deleted at the end, but for tables given to the function that this yields.

    To be used where all that read such tables has been written itself.  Other threads' tables are not touched.
    """
    given, kept = [], set()
    token = _run.set(given)
    try:
        yield lambda df: kept.add(getattr(df, "_gridlake_path", None)) or df
    finally:
        _run.reset(token)
        for path in given:
            if path not in kept:
                remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridlake_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table that written() made, once nothing reads it any more."""
    path = getattr(df, "_gridlake_path", None)
    if path:
        remove(df.sparkSession, path)


class Scratch:
    """The tables that an operator writes on its way; clear() deletes those that its result does not read."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def adopt(self, table: DataFrame) -> DataFrame:
        self.tables.append(table)
        return table

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return self.adopt(written(df, name))

    def clear(self, *keep: DataFrame) -> None:
        for t in self.tables:
            if not any(t is k for k in keep):
                drop(t)
        self.tables = list(keep)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it as long as df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
