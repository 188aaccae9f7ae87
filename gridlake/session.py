"""A session with the settings that the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "gridlake", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and ANSI mode; master and everything else come from the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    }
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset and Spark runs on one machine a local
    folder is set instead."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="gridlake-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows up to which a table is called a short list, and is sent to every task.
SHORT_LIST = 10_000


def short_list(df: DataFrame, most: int = SHORT_LIST) -> DataFrame:
    """df, marked to be broadcast if it has at most so many rows; a longer one is left to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
