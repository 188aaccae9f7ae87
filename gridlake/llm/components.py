"""Connected components of a link table by hooking and pointer jumping, one written table a round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable over links, for every node that a link names.

    Links are undirected; repeated links and links from a node to itself do no harm; links with a null end are left
    out; an empty table gives an empty table.  Each round hooks a node to the smallest label among its neighbours and
    then follows that label once more, so rounds grow with the logarithm of the longest path.  A hub of any degree is
    pre-aggregated before the shuffle and joined with plain equi-joins, which adaptive execution may split.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node"), "cc-labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "c": "cb"}), "b").groupBy("a").agg(F.min("cb").alias("cb"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("c").alias("old"), F.least("c", "cb").alias("c"))
        jumped = hooked.join(labels.select(F.col("node").alias("c"), F.col("c").alias("cc")), "c", "left").select("node", "old", F.least("c", "cc").alias("c"))
        new = written(jumped, "cc-labels")
        moved = new.where("old <> c").limit(1).count()
        drop(labels)
        labels = new
        if not moved:
            drop(both)
            out = labels.select("node", F.col("c").alias("component"))
            out._gridlake_path = labels._gridlake_path
            return out


class LocalForest:
    """Spanning forest of the links inside one block pair, fed with boolean matrices; smallest members are roots."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def add(self, near: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        """near[i, j]: rows[i] and cols[j] are linked.  Labels spread over the matrix; only their tree is linked here."""
        top = len(self.up)
        row, col = rows.copy(), cols.copy()
        while True:
            new_row = np.minimum(row, np.where(near, col, top).min(axis=1))
            new_col = np.minimum(col, np.where(near, new_row[:, None], top).min(axis=0))
            if (new_row == row).all() and (new_col == col).all():
                break
            row, col = new_row, new_col
        for v, c in ((rows, row), (cols, col)):
            for s, t in zip(v[c != v].tolist(), c[c != v].tolist(), strict=True):
                self.link(s, t)

    def roots(self) -> np.ndarray:
        return np.array([self.root(k) for k in range(len(self.up))], dtype=np.int64)
