"""Spreadsheet grids: components, boxes, containment, roles."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import connected, roots
from .ranking import numbered

COMPONENTS = "sheet string, row int, col int, component int"
#: Rows of a strip: cells of a sheet are labelled a strip at a time, then strips are joined where they meet.
STRIP_ROWS = 256
#: How often the strips of boxes double.
DOUBLINGS = 4
#: Bits of a column in a place.
_COLUMN = 20
_BOX = ("min_row", "max_row", "min_col", "max_col", "n_cells")


def _labels(table: pa.Table) -> pa.Table:
    """(sheet, row, col, label) of one strip; cells of one component have the place of its first cell as label."""
    at = np.unique(table["row"].to_numpy().astype(np.int64) << _COLUMN | table["col"].to_numpy().astype(np.int64))
    below = np.searchsorted(at, at + (1 << _COLUMN))
    down = np.flatnonzero((below < len(at)) & (at[np.minimum(below, len(at) - 1)] == at + (1 << _COLUMN)))
    right = np.flatnonzero(at[1:] == at[:-1] + 1)
    a, b = np.concatenate([right, down]), np.concatenate([right + 1, below[down]])
    root = roots(len(at), a, b)
    sheet = pa.array([table["sheet"][0].as_py()] * len(at), pa.string())
    return pa.table({"sheet": sheet, "row": pa.array((at >> _COLUMN).astype(np.int32)), "col": pa.array((at & ((1 << _COLUMN) - 1)).astype(np.int32)), "label": pa.array(at[root])})


def connected_cells(cells: DataFrame) -> DataFrame:
    """C14: (sheet, row, col, component): 4-neighbour components, numbered in a sheet by their first cell in reading order.

    A strip of a sheet's rows is a group, of as many cells as its rows can hold; strips that meet are linked by equal columns,
    and the links joined to components.
    """
    rows = cells.select(F.col("sheet").cast("string").alias("sheet"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    strip = F.floor(F.col("row") / STRIP_ROWS)
    labelled = cut(rows.withColumn("strip", strip).groupBy("sheet", "strip").applyInArrow(_labels, "sheet string, row int, col int, label long"))
    node = F.concat(F.coalesce("sheet", F.lit("")), F.lit("!"), F.col("label").cast("string"))
    edge = F.pmod("row", F.lit(STRIP_ROWS))
    upper = labelled.where(edge == STRIP_ROWS - 1).select("sheet", "col", (F.col("row") + 1).alias("row"), node.alias("a"))
    lower = labelled.where(edge == 0).select("sheet", "col", "row", node.alias("b"))
    joined = connected(upper.join(lower, ["sheet", "col", "row"]).select("a", "b"))
    whole = labelled.withColumn("node", node).join(joined, "node", "left").select("sheet", "row", "col", "label", F.coalesce("root", "node").alias("root"))
    first = whole.groupBy("sheet", "root").agg(F.min("label").alias("first"))
    first = numbered(first, ["sheet"], [F.col("first")], "component").select(F.col("root"), F.col("component").cast("int").alias("component"))
    return whole.join(first, "root").select("sheet", "row", "col", "component")


def bounds(components: DataFrame) -> DataFrame:
    """The envelope of each component."""
    return components.groupBy("sheet", "component").agg(*(f("row").alias(f"{n}_row") for n, f in (("min", F.min), ("max", F.max))), *(f("col").alias(f"{n}_col") for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("n_cells"))


def _closed(r0: np.ndarray, r1: np.ndarray, c0: np.ndarray, c1: np.ndarray, low: int, high: int, gap: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Boxes merged until no two touch in the rows low to high: for each box the number of the one it went into, and those.

    A box is listed under each of its rows there and gap + 1 more: two boxes share such a row when their rows are close
    enough.  There, in order of columns, a box is linked with the one before it that reaches furthest.
    """
    into = np.arange(len(r0))
    while True:
        top = np.maximum(r0, low)
        height = np.minimum(r1 + gap + 1, high) - top + 1
        box = np.repeat(np.arange(len(r0)), height)
        row = top[box] + np.arange(len(box)) - np.repeat(np.cumsum(height) - height, height)
        order = np.lexsort((c0[box], row))
        box, row = box[order], row[order]
        # rows are told apart by steps as wide as all columns, so that the furthest reach starts anew in each
        reach = (row - low) * (c1.max() - c1.min() + 1) + c1[box] - c1.min()
        far = np.maximum.accumulate(np.where(reach == np.maximum.accumulate(reach), np.arange(len(box)), 0))
        before, after = box[far[:-1]], box[1:]
        touch = (row[1:] == row[:-1]) & (c0[after] <= c1[before] + gap + 1)
        if not touch.any():
            return into, [r0, r1, c0, c1]
        _, number = np.unique(roots(len(r0), before[touch], after[touch]), return_inverse=True)
        order = np.argsort(number, kind="stable")
        first = np.flatnonzero(np.diff(number[order], prepend=-1))
        r0, c0 = (np.minimum.reduceat(x[order], first) for x in (r0, c0))
        r1, c1 = (np.maximum.reduceat(x[order], first) for x in (r1, c1))
        into = number[into]


def _strip_of(table: pa.Table, height: int) -> tuple[list[np.ndarray], int, int]:
    low = table["strip"][0].as_py() * height
    return [table[c].to_numpy() for c in _BOX[:4]], low, low + height - 1


def _merged_in_strip(height: int, gap: int):
    """The boxes that begin in a strip, merged there."""

    def run(table: pa.Table) -> pa.Table:
        box, low, high = _strip_of(table, height)
        into, box = _closed(*box, low, high, gap)
        n = np.zeros(len(box[0]), np.int64)
        np.add.at(n, into, table["n_cells"].to_numpy())
        sheet = table["sheet"].take(pa.array(np.zeros(len(n), np.int64)))
        return pa.table({"sheet": sheet} | dict(zip(_BOX, (*box, n), strict=True)))

    return run


def _links_in_strip(height: int, gap: int):
    """(a, b): ids of boxes that become one in a strip, of all that begin in it or reach into it."""

    def run(table: pa.Table) -> pa.Table:
        box, low, high = _strip_of(table, height)
        into, _ = _closed(*box, low, high, gap)
        first = np.unique(into, return_index=True)[1][into]
        other = np.flatnonzero(first != np.arange(len(into)))
        return pa.table({"a": table["id"].take(pa.array(other)), "b": table["id"].take(pa.array(first[other]))})

    return run


def merged_boxes(boxes: DataFrame, gap: int = 1, min_cells: int = 1) -> DataFrame:
    """Boxes of a sheet at most gap apart are merged until nothing changes; small ones are dropped at the end.

    A box that grows meets others one after the other.  Within a strip of rows this is done to its end in one place, first
    for the boxes that begin in it, then for all that reach into it; what became one in any strip becomes the envelope of its
    component.  Strips are twice as high in each round, up to a bound; the rounds end when no two boxes touch.
    """
    schema = f"sheet {boxes.schema['sheet'].dataType.simpleString()}, {', '.join(f'{c} long' for c in _BOX)}"
    now = boxes.select("sheet", *(F.col(c).cast("long").alias(c) for c in _BOX))
    for k in itertools.count():
        height = STRIP_ROWS << min(k, DOUBLINGS)
        strip = lambda row: F.floor(row / height)  # noqa: B023, E731
        begun = now.withColumn("strip", strip(F.col("min_row"))).groupBy("sheet", "strip").applyInArrow(_merged_in_strip(height, gap), schema)
        now = cut(begun.withColumn("id", F.monotonically_increasing_id().cast("string")))
        laid = now.withColumn("strip", F.explode(F.sequence(strip(F.col("min_row")), strip(F.col("max_row") + gap + 1))))
        links = cut(laid.groupBy("sheet", "strip").applyInArrow(_links_in_strip(height, gap), "a string, b string"))
        if links.isEmpty():
            return now.where(F.col("n_cells") >= min_cells).select("sheet", *(F.col(c).cast("int").alias(c) for c in _BOX[:4]), "n_cells")
        joined = connected(links).withColumnRenamed("node", "id")
        grown = now.join(joined, "id", "left").groupBy("sheet", F.coalesce("root", "id").alias("id"))
        now = grown.agg(F.min("min_row").alias("min_row"), F.max("max_row").alias("max_row"), F.min("min_col").alias("min_col"), F.max("max_col").alias("max_col"), F.sum("n_cells").alias("n_cells"))


def stacked_tables(tables: DataFrame, gap: int = 2) -> DataFrame:
    """C17: tables of a sheet with the same columns, at most gap rows apart and without an own header, become one."""
    w = Window.partitionBy("sheet", "min_col", "max_col").orderBy("min_row")
    new = F.when((F.lag("max_row").over(w).isNull()) | F.col("has_header") | (F.col("min_row") - F.lag("max_row").over(w) - 1 > gap), 1).otherwise(0)
    grouped = tables.withColumn("new", new).withColumn("group", F.sum("new").over(w))
    return grouped.groupBy("sheet", "min_col", "max_col", "group").agg(F.min("min_row").alias("min_row"), F.max("max_row").alias("max_row"), F.count("*").alias("n_tables"))


def attached_parents(headers: DataFrame) -> DataFrame:
    """For each header the nearest header above it whose columns contain its own (ties: the narrowest).

    headers: sheet, header_id, row, lo, hi.  A header that holds a child's columns holds the first of them: parents are
    listed under each of their columns (a format bounds those), children under their first one, and joined on that.  The
    list is many times as long as Spark takes it to be, so it is merged and never broadcast.
    """
    up = headers.select("sheet", F.col("header_id").alias("parent_id"), F.col("row").alias("p_row"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"))
    up = up.where("p_lo <= p_hi").withColumn("lo", F.explode(F.sequence("p_lo", "p_hi")))
    pairs = headers.join(up.hint("merge"), ["sheet", "lo"]).where("p_row < row AND p_hi >= hi AND parent_id <> header_id")
    w = Window.partitionBy("sheet", "header_id").orderBy(F.desc("p_row"), F.col("p_hi") - F.col("p_lo"), "parent_id")
    best = pairs.withColumn("n", F.row_number().over(w)).where("n = 1").select("sheet", "header_id", "parent_id")
    return headers.join(best.hint("merge"), ["sheet", "header_id"], "left")


#: Rows and columns of the tiles that a region and its cells are joined by.
TILE = 16, 8


def cells_in_regions(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells with the regions (min_row, max_row, min_col, max_col) of their sheet that hold them.

    Regions are listed under each tile that they touch; a cell meets those of its own tile.  The list is longer than Spark
    takes it to be, so it is not broadcast.
    """
    tile = lambda c, n: F.floor(F.col(c) / n).cast("int")
    laid = regions.where("min_row <= max_row AND min_col <= max_col")
    for name, side, n in (("_row", "row", TILE[0]), ("_col", "col", TILE[1])):
        laid = laid.withColumn(name, F.explode(F.sequence(tile(f"min_{side}", n), tile(f"max_{side}", n))))
    out = cells.withColumns({"_row": tile("row", TILE[0]), "_col": tile("col", TILE[1])}).join(laid.hint("merge"), ["sheet", "_row", "_col"])
    return out.where("row BETWEEN min_row AND max_row AND col BETWEEN min_col AND max_col").drop("_row", "_col")


def occupied(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """Filled cells and all cells of merged ranges (sheet, min_row, max_row, min_col, max_col), each once."""
    rows = merged.withColumn("row", F.explode(F.sequence("min_row", "max_row"))).withColumn("col", F.explode(F.sequence("min_col", "max_col")))
    return cells.select("sheet", "row", "col").union(rows.select("sheet", "row", "col")).distinct()


def unambiguous_majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, null where two share that place."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("n")))).where("r = 1")
    return top.groupBy(key).agg(F.when(F.count("*") == 1, F.first(value)).alias("majority"), F.max("n").alias("n"))


def role_scores(rows: DataFrame, roles: dict[str, tuple[str, ...]], name: str, text: str) -> DataFrame:
    """Role with the most points (a term in the name 4, in the text 1), ties to the first role; confidence to 0.98."""
    score = {r: sum((F.when(F.lower(F.col(name)).contains(t), 4).when(F.lower(F.col(text)).contains(t), 1).otherwise(0) for t in terms), F.lit(0)) for r, terms in roles.items()}
    order = {r: k for k, r in enumerate(roles)}
    best = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-order[r]).alias("o"), F.lit(r).alias("role")) for r, s in score.items())))
    out = rows.withColumn("best", best)
    return out.select(*rows.columns, F.when(F.col("best.score") > 0, F.col("best.role")).otherwise("unknown").alias("role"), F.col("best.score").alias("score"), F.least(F.lit(0.98), 0.55 + 0.1 * F.col("best.score")).alias("confidence"))
