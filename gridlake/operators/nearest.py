"""Nearest rows by Hamming distance with multi-index hashing (K2, F8).

Packed bits are cut in m segments.  A row within distance m (s + 1) - 1 of a query has a segment within distance s of the
query's: so rows are listed under the values of their segments once, queries ask for all values within s, and equal ones
join.  A query that has found as many rows as it wants within that distance has found the nearest; the others ask again
with s + 1.  No row and no query is compared with all.

Where the bits are so even that a search by segments would meet a good part of all rows, it is dearer than to look at every
row: then both sides are dealt into blocks, and each pair of blocks yields its nearest.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows from which segments have 16 bits instead of 8: a value then stands for few rows of many.
WIDE = 1 << 14
#: Sampled rows and queries that tell with which s to begin.
_SAMPLE = 1024, 32
#: Share of all rows met by a query's segments from which every row is looked at instead.
MET = 0.002
#: Queries and rows of a block in such a scan, and distances that are held at once.
BLOCK, HELD = (512, 1 << 17), 1 << 22


def distance(a: Column, b: Column) -> Column:
    """Bits that two arrays of packed bits differ in."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _segments(bits: str, dims: int, width: int) -> Column:
    """Array of (segment, value)."""
    low = (1 << width) - 1
    cuts = range(-(-dims // width))
    return F.array(*(F.struct(F.lit(j).alias("segment"), F.shiftrightunsigned(F.element_at(bits, j * width // 64 + 1), j * width % 64).bitwiseAND(F.lit(low)).alias("value")) for j in cuts))


@functools.cache
def masks(width: int, s: int) -> list[int]:
    """All values of so many bits with at most s of them set."""
    return [x for x in range(1 << width) if x.bit_count() <= s]


def _start(queries: DataFrame, rows: DataFrame, depth: int, total: int, m: int) -> int:
    """The s that would do for most of a few queries over a few rows, by the share of rows that are wanted."""
    some = rows.limit(_SAMPLE[0]).select(F.col("bits").alias("b"))
    near = queries.limit(_SAMPLE[1]).select("id", F.col("bits").alias("a")).join(some).select("id", distance(F.col("a"), F.col("b")).alias("d"))
    share = min(1.0, depth / max(total, 1))
    radius = near.groupBy("id").agg(F.percentile_approx("d", F.lit(share)).alias("r")).agg(F.percentile_approx("r", 0.9)).first()[0]
    return max(0, -(-((radius or 0) + 1) // m) - 1)


def _nearest_of_pair(depth: int):
    """The nearest rows of a block for each query of another; of equal distances the smaller ids."""

    def run(table: pa.Table) -> pa.Table:
        q = np.asarray(table["side"].combine_chunks())
        ids, lists = table["id"].to_numpy(), table["bits"].combine_chunks()
        bits = lists.flatten().to_numpy().reshape(len(ids), -1).view(np.uint64)
        order = np.flatnonzero(~q)[np.argsort(ids[~q], kind="stable")]
        rows, ranks = bits[order], np.arange(len(order))
        out = []
        step = max(1, HELD // max(len(order), 1))
        for at in range(0, int(q.sum()) if len(order) else 0, step):
            asked = bits[q][at : at + step]
            far = sum(np.bitwise_count(asked[:, j, None] ^ rows[:, j]).astype(np.int64) for j in range(bits.shape[1]))
            key = far * len(order) + ranks
            k = min(depth, len(order))
            best = np.sort(np.partition(key, k - 1, axis=1)[:, :k], axis=1)
            out.append((np.repeat(ids[q][at : at + step], k), ids[order[best % len(order)]].ravel(), (best // len(order)).ravel()))
        z = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": z[0], "doc_id": z[1], "distance": z[2].astype(np.int32)})

    return run


def _scanned(queries: DataFrame, rows: DataFrame, depth: int, total: int) -> DataFrame:
    """hamming_nearest() by all pairs of blocks."""
    nq, nd = -(-queries.count() // BLOCK[0]) or 1, -(-total // BLOCK[1]) or 1
    side = lambda df, asks, own, own_n, other, other_n: df.select(
        "id", "bits", F.lit(asks).alias("side"), F.pmod(F.xxhash64("id"), F.lit(own_n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other)
    )
    both = side(queries, True, "qb", nq, "db", nd).unionByName(side(rows, False, "db", nd, "qb", nq))
    found = both.groupBy("qb", "db").applyInArrow(_nearest_of_pair(depth), "query_id long, doc_id long, distance int")
    w = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= depth).drop("n")


def hamming_nearest(queries: DataFrame, rows: DataFrame, depth: int, dims: int, width: int | None = None, start: int | None = None) -> DataFrame:
    """The depth nearest rows of each query: query_id, doc_id, distance (ties: the smaller id).

    queries and rows have (id long, bits array<long>, of dims bits).  width is that of the segments, start the first s; by
    default both follow from the numbers of rows; where s is not given, every row may be looked at.
    """
    queries, rows = cut(queries.select("id", "bits")), cut(rows.select("id", "bits"))
    total = rows.count()
    width = width or (8 if total < WIDE else 16)
    m = -(-dims // width)
    index = rows.select("id", F.explode(_segments("bits", dims, width)).alias("x")).select(F.col("id").alias("doc_id"), "x.*")
    s = min(width, _start(queries, rows, depth, total, m) if start is None else start)
    w = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    pending, out = queries, None
    while True:
        if start is None and m * len(masks(width, s)) / (1 << width) > MET:
            rest = _scanned(pending, rows, depth, total)
            return rest if out is None else out.unionByName(rest)
        values = F.array(*map(F.lit, masks(width, s)))
        asked = pending.select(F.col("id").alias("query_id"), F.explode(_segments("bits", dims, width)).alias("x")).select("query_id", "x.segment", F.explode(F.transform(values, lambda v: v.bitwiseXOR(F.col("x.value")).cast("long"))).alias("value"))
        pairs = asked.join(index, ["segment", "value"]).select("query_id", "doc_id").distinct()
        pairs = pairs.join(rows.select(F.col("id").alias("doc_id"), F.col("bits").alias("b")), "doc_id").join(pending.select(F.col("id").alias("query_id"), F.col("bits").alias("a")), "query_id")
        near = pairs.select("query_id", "doc_id", distance(F.col("a"), F.col("b")).alias("distance"))
        near = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= depth)
        proven = m * (s + 1) - 1
        near = cut(near)
        # the last one wanted lies within the proven distance: none can be nearer that was not met
        done = near.groupBy("query_id").agg(F.count("*").alias("found"), F.max("distance").alias("far")).where((F.col("found") >= min(depth, total)) & (F.col("far") <= proven)).select("query_id")
        if s >= width:
            done = queries.select(F.col("id").alias("query_id"))
        got = near.join(done, "query_id", "left_semi").select("query_id", "doc_id", "distance")
        out = got if out is None else out.unionByName(got)
        pending = cut(pending.join(done, F.col("id") == F.col("query_id"), "left_anti"))
        if pending.isEmpty():
            return out
        s += 1
