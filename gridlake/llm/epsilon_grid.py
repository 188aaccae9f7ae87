"""Near duplicates among embeddings by an epsilon grid order join.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so a cosine threshold is a radius epsilon.  Vectors are projected on
the leading principal directions, laid on a grid of cells epsilon wide, and sorted by cell; consecutive vectors form
blocks.  Pairs of blocks whose cells can be within epsilon are joined; inside a pair, sequence intervals are halved
recursively, and intervals whose boxes of projections are farther apart than epsilon are skipped.  Projection on
orthonormal directions never lengthens a distance, so nothing skipped can be a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import LocalForest, connected_components
from .storage import Scratch

#: Vectors of a block, leading directions of the grid, those of them whose cells blocks are joined on, and vectors below
#: which an interval is compared in full.
BLOCK, DIRECTIONS, JOINED, LEAF = 2048, 6, 3, 128


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dim, vector): double components as bytes; vector is null where the row can have no link."""
    for batch in batches:
        labels, v = batch.column(1), batch.column(2)
        size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = v.flatten()
        bad = np.asarray(flat.is_null())
        x = flat.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0  # + 0.0: -0.0 and 0.0 are the same component
        end = np.cumsum(size)
        begin = end - size
        count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[np.append(begin, end[-1:])]) if len(size) else size
        ok = (size > 0) & np.asarray(labels.is_valid()) & (count(bad | ~np.isfinite(x)) == 0) & (count(x != 0) > 0)
        raw, at = x.tobytes(), (begin * 8).tolist()
        out = [raw[a : a + 8 * n] if good else None for a, n, good in zip(at, size.tolist(), ok.tolist(), strict=True)]
        yield pa.record_batch([batch.column(0), labels, pa.array(np.where(ok, size, 0).astype(np.int32)), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "vector"])


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        raw = batch.column(1).to_pylist()
        for d in np.unique(dims).tolist():
            x = _unit([raw[k] for k in np.flatnonzero(dims == d)])
            x = np.column_stack([x, np.ones(len(x))])
            total[d] = total.get(d, 0) + x.T @ x
    for d, m in total.items():
        yield pa.record_batch([pa.array(np.full(m.size, d, np.int32)), pa.array(np.arange(m.size, dtype=np.int64)), pa.array(m.ravel())], names=["dim", "place", "value"])


def _directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """The leading principal directions for each vector length; (length + 1)^2 numbers of each reach the driver."""
    sums = classes.select("dim", "vector").mapInArrow(_moments, "dim int, place long, value double").groupBy("dim", "place").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for d, m in sums.sort_values("place").groupby("dim"):
        m = m["value"].to_numpy().reshape(int(d) + 1, int(d) + 1)
        mean = m[-1, :-1] / m[-1, -1]
        _, axes = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        out[int(d)] = axes[:, ::-1][:, :DIRECTIONS].copy()
    return out


def _cells(axes: dict[int, np.ndarray], epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            raw = batch.column(3).to_pylist()
            cells = np.zeros((len(raw), DIRECTIONS), dtype=np.int32)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                at = np.floor(_unit([raw[k] for k in rows]) @ axes[d] / epsilon)
                cells[rows, : at.shape[1]] = at
            yield pa.record_batch([*batch.columns, *(pa.array(cells[:, k]) for k in range(DIRECTIONS))], names=[*batch.schema.names, *(f"c{k}" for k in range(DIRECTIONS))])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the sorted rows of a partition into blocks of one label and length."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        cells = np.array([r[5:] for r in rows])
        columns = [[rows[0][0]], [rows[0][1]], [rows[0][2]], [cells.min(axis=0).tolist()], [cells.max(axis=0).tolist()], [np.array([r[0] for r in rows]).tobytes()], [np.array([r[4] for r in rows]).tobytes()], [b"".join(r[3] for r in rows)]]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "label", "dim", "lo", "hi", "ids", "weights", "vectors"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (len(held) >= BLOCK or row[1:3] != held[0][1:3]):
                yield block(held)
                held = []
            held.append(row)
    if held:
        yield block(held)


def _join_pair(axes: dict[int, np.ndarray], cosine: float, epsilon: float):
    far = epsilon * epsilon * (1 + 1e-9) + 1e-12

    def run(table: pa.Table) -> pa.Table:
        sides = {r["side"]: r for r in table.to_pylist()}
        a, b = sides.get("a"), sides.get("b")
        own = b is None  # a block with itself
        ids = np.frombuffer(a["ids"] if own else a["ids"] + b["ids"], dtype=np.int64)
        weights = np.frombuffer(a["weights"] if own else a["weights"] + b["weights"], dtype=np.int64)
        n, d = len(a["ids"]) // 8, a["dim"]
        x = _unit([a["vectors"][k * d * 8 : (k + 1) * d * 8] for k in range(n)])
        if not own:
            m = len(b["ids"]) // 8
            x = np.concatenate([x, _unit([b["vectors"][k * d * 8 : (k + 1) * d * 8] for k in range(m)])])
        p = x @ axes[d]
        links = np.zeros(len(ids), dtype=np.int64)
        forest = LocalForest(len(ids))

        def leaf(a0: int, a1: int, b0: int, b1: int) -> None:
            near = x[a0:a1] @ x[b0:b1].T >= cosine
            if a0 == b0:
                np.fill_diagonal(near, False)
            if not near.any():
                return
            links[a0:a1] += near @ weights[b0:b1]
            if a0 != b0:
                links[b0:b1] += weights[a0:a1] @ near
            forest.add(near, np.arange(a0, a1), np.arange(b0, b1))

        def rec(a0: int, a1: int, b0: int, b1: int) -> None:
            gap = np.maximum(0, np.maximum(p[b0:b1].min(axis=0) - p[a0:a1].max(axis=0), p[a0:a1].min(axis=0) - p[b0:b1].max(axis=0)))
            if (gap * gap).sum() > far:
                return
            if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
                leaf(a0, a1, b0, b1)
            elif a0 == b0:
                mid = (a0 + a1) // 2
                rec(a0, mid, a0, mid)
                rec(a0, mid, mid, a1)
                rec(mid, a1, mid, a1)
            elif a1 - a0 >= b1 - b0:
                mid = (a0 + a1) // 2
                rec(a0, mid, b0, b1)
                rec(mid, a1, b0, b1)
            else:
                mid = (b0 + b1) // 2
                rec(a0, a1, b0, mid)
                rec(a0, a1, mid, b1)

        rec(0, n, 0, n) if own else rec(0, n, n, len(ids))
        root = forest.roots()
        got = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.table({"id": ids[got], "links": links[got], "with": ids[root[got]]})

    return run


def embedding_near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept (it is the smallest vec_id of its component).

    Two vectors link when their labels are equal and not null, their lengths are equal, and their cosine in double
    precision is at least the threshold.  Defined cases: vectors that are null, empty, zero, or hold a null or
    non-finite component, and rows with a null label, link with nothing; repeated rows are vectors of their own and
    link with each other; rows with a null id are left out; further columns are ignored.

    Equal vectors are reduced to one with a weight before the join, so a vector repeated any number of times costs one
    comparison.  A pair of blocks yields at most one row for each of its vectors, never its links one by one.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    tmp = Scratch()
    rows = tmp.written(rows.mapInArrow(_valid, "vec_id long, label string, dim int, vector binary"), "vectors")
    valid = rows.where("vector IS NOT NULL")
    classes = tmp.written(valid.groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("weight")), "vector-classes")

    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine))) or 1e-6
    axes = _directions(classes)
    cells = [f"c{k}" for k in range(DIRECTIONS)]
    placed = classes.select("class_id", "label", "dim", "vector", "weight").mapInArrow(
        _cells(axes, epsilon), "class_id long, label string, dim int, vector binary, weight long, " + ", ".join(f"{c} int" for c in cells)
    )
    order = ["label", "dim", *cells, "class_id"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = tmp.written(placed.mapInArrow(_blocks, "block long, label string, dim int, lo array<int>, hi array<int>, ids binary, weights binary, vectors binary"), "grid-blocks")

    # blocks that can be within epsilon: an equi-join on the first cells, then the others; only outlines take part.  A block
    # stands for all cells of its outline there, its partner for theirs and the cells beside them; a pair is taken in the
    # least cell that both stand for
    outline = blocks.select("block", "label", "dim", "lo", "hi")
    x = outline.select("label", "dim", F.col("block").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    y = outline.select("label", "dim", F.col("block").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    wide = max(1, int(np.ceil(2 / epsilon / 16)))  # cells joined as one, so that a block stands for a few of them at most
    for k in range(JOINED):
        x = x.withColumn(f"cell{k}", F.explode(F.sequence(F.floor(F.col("la")[k] / wide), F.floor(F.col("ha")[k] / wide))))
        y = y.withColumn(f"cell{k}", F.explode(F.sequence(F.floor((F.col("lb")[k] - 1) / wide), F.floor((F.col("hb")[k] + 1) / wide))))
    close = " AND ".join(f"la[{k}] <= hb[{k}] + 1 AND lb[{k}] <= ha[{k}] + 1" for k in range(DIRECTIONS))
    least = " AND ".join(f"cell{k} = greatest(floor(la[{k}] / {wide}), floor((lb[{k}] - 1) / {wide}))" for k in range(JOINED))
    pairs = x.join(y, ["label", "dim", *(f"cell{k}" for k in range(JOINED))]).where(f"a <= b AND {least} AND {close}").select("a", "b")
    pairs = tmp.written(pairs.withColumn("pair", F.concat_ws("-", "a", "b")), "block-pairs")

    ends = pairs.select("pair", F.col("a").alias("block"), F.lit("a").alias("side")).unionByName(pairs.where("a <> b").select("pair", F.col("b").alias("block"), F.lit("b").alias("side")))
    found = ends.join(blocks.select("block", "dim", "ids", "weights", "vectors"), "block").groupBy("pair").applyInArrow(_join_pair(axes, cosine, epsilon), "id long, links long, with long")
    found = tmp.written(found, "block-links")

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = tmp.adopt(connected_components(found.where("id <> with"), "id", "with"))
    state = classes.select("class_id", "label", "dim", "vector", "weight").join(counts.withColumnRenamed("id", "class_id"), "class_id", "left").join(comp.withColumnRenamed("node", "class_id"), "class_id", "left")
    state = state.select("label", "dim", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    state = tmp.written(state, "vector-states")
    tmp.clear(rows, state)
    out = valid.join(state, ["label", "dim", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
