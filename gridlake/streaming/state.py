"""Streams of states: only changes, stale leases, attempts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir

OUTPUT = "key long, state string, ts timestamp"
#: Groups that a stream's keys are dealt to.  A call of Python for each key would cost milliseconds a key; one group's rows of
#: a batch, and what is kept of its keys, are in memory at a time.
BUCKETS = 4096


def bucketed(stream: DataFrame, *columns: str) -> DataFrame:
    """columns, one of which is key, behind the bucket of the key; rows without a key have a bucket of their own, null."""
    return stream.select(F.when(F.col("key").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).alias("bucket"), *columns)


def in_order(bucket: tuple, frames: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """(key, nanoseconds of ts, columns ...) of a bucket's rows, key by key, by ts and columns."""
    rows = pd.concat(list(frames)).sort_values(["key", "ts", *columns], kind="stable")
    keys = [None] * len(rows) if pd.isna(bucket[0]) else rows["key"].tolist()
    return zip(keys, rows["ts"].to_numpy("datetime64[ns]").view("int64").tolist(), *(rows[c].tolist() for c in columns), strict=True)


def state_changes(stream: DataFrame, terminal: tuple[str, ...] = ()) -> DataFrame:
    """(key, state, ts) of a stream (key, state, ts), one row for each change of a key's state.

    A terminal state is a key's last: what comes after it is not put out.  Late rows are left out.  The state kept is one
    entry for each key, in the row of its bucket.
    """

    def run(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {key: (s, at) for key, s, at in zip(*state.get, strict=True)} if state.exists else {}
        out = []
        for key, at, s in in_order(bucket, frames, "state"):
            last, seen = held.get(key, (None, None))
            if last in terminal or (seen is not None and at < seen):
                continue
            if s != last:
                out.append((key, s, at))
            held[key] = s, at
        state.update((list(held), [s for s, _ in held.values()], [at for _, at in held.values()]))
        if out:
            keys, states, at = zip(*out, strict=True)
            yield pd.DataFrame({"key": keys, "state": states, "ts": np.array(at, "int64").view("datetime64[ns]")})

    return bucketed(stream, "key", "state", "ts").groupBy("bucket").applyInPandasWithState(run, OUTPUT, "keys array<long>, last array<string>, seen array<long>", "append", GroupStateTimeout.NoTimeout)


def latest_states(stream: DataFrame) -> DataFrame:
    """Of the changes put out so far each key's latest, for readers that come late: a running aggregate of one row a key."""
    return stream.groupBy("key").agg(F.max(F.struct("ts", "state")).alias("latest")).select("key", "latest.state", "latest.ts")


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream over all that its source holds now and return what it put out, as a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def state_changes_batch(rows: DataFrame, terminal: tuple[str, ...] = ()) -> DataFrame:
    """T1 over a finished table: the same rows by windows."""
    w = Window.partitionBy("key").orderBy("ts", "state")
    ended = F.max(F.col("state").isin(*terminal).cast("int") if terminal else F.lit(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumns({"before": F.lag("state").over(w), "ended": ended})
    return out.where(~F.col("before").eqNullSafe(F.col("state")) & (F.coalesce("ended", F.lit(0)) == 0)).drop("before", "ended")


def lease_sessions(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """T5: runs of heartbeats with no gap over seconds; a gap makes the lease stale and the next heartbeat a new claim."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    marked = events.withColumn("new", F.when(gap.isNull() | (gap > seconds * 1_000_000), 1).otherwise(0)).withColumn("lease", F.sum("new").over(w))
    return marked.groupBy(key, "lease").agg(F.min(ts).alias("claimed_at"), F.max(ts).alias("last_beat"), F.count("*").alias("beats"))


def lease_age(leases: DataFrame, beat: str, now, ttl: int) -> DataFrame:
    """Age and time left of each lease in seconds, and whether it is stale; a lease without a heartbeat has neither."""
    age = (F.unix_micros(F.lit(now).cast("timestamp") if isinstance(now, str) else now) - F.unix_micros(F.col(beat).cast("timestamp"))) / 1_000_000
    return leases.withColumns({"age": age, "left": F.greatest(F.lit(0.0), ttl - age), "stale": age > ttl})


def attempts(events: DataFrame, key: str, ts: str, failed, most: int = 3) -> DataFrame:
    """T4: the number of each failure of a key, and whether it may be tried again."""
    w = Window.partitionBy(key).orderBy(ts)
    return events.where(failed).withColumn("attempt", F.row_number().over(w)).withColumn("requeued", F.col("attempt") < most)
