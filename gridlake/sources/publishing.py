"""Publishing that survives races and crashes: fresh data paths, versions put once, a log of heads.

A folder holds data/ (one path for each attempt), versions/ (one record for each version, put if absent: the first attempt
at a version wins) and heads/ (numbered records, put if absent; the highest is the current head).  A head is put only by a
version that is later than the head it follows, so the head never moves back.  Whoever dies on the way leaves the old head
as it was, and data that vacuum() removes; publishing the version again goes on from where that one stopped.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class _Store:
    """Small files of a folder, in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf, self.folder = spark._jsc.hadoopConfiguration(), folder.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)
        self.local = self.fs.getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, sub: str) -> list[str]:
        path = self._path(sub)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> dict | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put_if_absent(self, name: str, record: dict) -> bool:
        """Whether the record was put; it appears as a whole or not at all."""
        path = self._path(name)
        draft = self._path(f"{os.path.dirname(name)}/.{uuid.uuid4().hex}")
        self.fs.mkdirs(path.getParent())
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(record).encode()))
        finally:
            stream.close()
        try:
            if self.local:  # a link fails if the name is taken; a local rename would not
                os.link(draft.toUri().getPath(), self._path(name).toUri().getPath())
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.conf)
                context.rename(draft, path, self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            self.fs.delete(draft, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Version:
    """A published version: its name, its place in the order of versions, its data and the rows counted there."""

    version: str
    at: int
    data: str
    rows: int


def _put_data(df: DataFrame, store: _Store) -> tuple[str, int]:
    """The path of freshly written rows, whose count is that of the rows that were read for them."""
    name, seen = f"data/{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(f"{store.folder}/{name}")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{store.folder}/{name}").count()
    if rows != seen.get["rows"]:
        store.delete(name)
        raise RuntimeError(f"{rows} rows were written instead of {seen.get['rows']}")
    return name, rows


def _numbered(names: list[str]) -> int:
    return max((int(n) for n in names if n.isdigit()), default=0)


def head(spark: SparkSession, folder: str) -> Version | None:
    """The current version."""
    store = _Store(spark, folder)
    last = _numbered(store.names("heads"))
    return Version(**store.read(f"heads/{last:020d}")) if last else None


def publish(df: DataFrame, folder: str, version: str, at: int | None = None) -> Version:
    """Publish rows as a version that becomes the head unless a later one is (at: its place in order, by default
    the time).  A version that is there already stays as it is, and is returned: nothing is written over."""
    spark, store = df.sparkSession, _Store(df.sparkSession, folder)
    found = store.read(f"versions/{version}")
    if found is None:
        data, rows = _put_data(df, store)
        mine = Version(version, time.time_ns() if at is None else at, data, rows)
        if store.put_if_absent(f"versions/{version}", asdict(mine)):
            found = asdict(mine)
        else:  # someone else was first
            store.delete(data)
            found = store.read(f"versions/{version}")
    done = Version(**found)
    while True:
        last = _numbered(store.names("heads"))
        now = Version(**store.read(f"heads/{last:020d}")) if last else None
        if now is not None and (now.at, now.version) >= (done.at, done.version):
            return done
        store.put_if_absent(f"heads/{last + 1:020d}", asdict(done))  # fails if another head followed; then look again


def current(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """The rows of the head, or of a version."""
    given = head(spark, folder) if version is None else _Store(spark, folder).read(f"versions/{version}")
    if given is None:
        raise LookupError(f"nothing is published in {folder}" if version is None else f"no version {version} in {folder}")
    data = given.data if isinstance(given, Version) else given["data"]
    return spark.read.parquet(f"{folder.rstrip('/')}/{data}")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """version, at, rows of every published version, and whether it is the head."""
    now = head(spark, folder)
    rows = spark.read.schema("version string, at long, data string, rows long").json(f"{folder.rstrip('/')}/versions")
    return rows.select("version", "at", "rows", (F.col("version") == F.lit(now.version if now else None)).alias("is_head"))


def vacuum(spark: SparkSession, folder: str) -> int:
    """Remove the data of attempts that came to nothing; to be run when nobody publishes.  Returns their number."""
    store = _Store(spark, folder)
    used = {store.read(f"versions/{v}")["data"] for v in store.names("versions") if not v.startswith(".")}
    gone = [n for n in store.names("data") if f"data/{n}" not in used]
    for n in gone:
        store.delete(f"data/{n}")
    return len(gone)
