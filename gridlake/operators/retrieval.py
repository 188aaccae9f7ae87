"""Keyword, vector and fused retrieval over cell records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalar as S
from .nearest import hamming_nearest
from .ranking import numbered


def candidate_depth(k: int) -> int:
    """K2: how many quantized candidates are reranked for a result of k."""
    return min(max(C.CANDIDATE_FACTOR * k, C.CANDIDATE_MIN), C.CANDIDATE_MAX)


#: Rows of a block in a vector search.
BLOCK = 4096
#: Queries of a block that are compared at once, so that memory holds their cosines and not those of the block.
AT_ONCE = 256


def _blocks(rows: DataFrame) -> int:
    return 1 + rows.count() // BLOCK


def _matrix(lists: pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of equal length as one array, without a Python object for each component."""
    flat = lists.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(dtype).reshape(len(lists), -1)


def _top_of_pair(k: int):
    """The k best rows of a block for each query of another, by cosine."""

    def run(table: pa.Table) -> pa.Table:
        q = np.asarray(table["side"].combine_chunks().to_numpy(zero_copy_only=False) == "q")
        ids = table["id"].to_numpy()
        x = _matrix(table["v"], np.float64)
        order = np.argsort(ids[~q], kind="stable")
        qi, di, qv, dv = ids[q], ids[~q][order], x[q], x[~q][order]
        out = []
        if len(di):
            norms = np.sqrt((dv * dv).sum(1))
            for at in range(0, len(qi), AT_ONCE):
                some = qv[at : at + AT_ONCE]
                with np.errstate(invalid="ignore", divide="ignore"):
                    cosines = (some @ dv.T) / np.sqrt((some * some).sum(1))[:, None] / norms
                cosines = np.where(np.isfinite(cosines), cosines, -2.0)
                for i in range(len(some)):
                    best = np.argsort(-cosines[i], kind="stable")[:k]
                    out.append((np.full(len(best), qi[at + i]), di[best], cosines[i][best]))
        z = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": z[0].astype(np.int64), "doc_id": z[1].astype(np.int64), "score": z[2]})

    return run


def vector_search(queries: DataFrame, rows: DataFrame, k: int, quantized: bool = False) -> DataFrame:
    """The k nearest rows of each query: query_id, doc_id, score, rank.

    queries and rows have (id long, v array<float>), all vectors of one length.  quantized takes the candidate_depth(k)
    rows that are nearest by the signs' Hamming distance (ties: the smaller id), which multi-index hashing finds, and
    reranks those alone by cosine.  Otherwise every row is looked at, as an exact search must: both sides are dealt into
    blocks by a hash of the id; each pair of blocks yields its k best of each query, and a window over those, blocks x k
    rows a query, ranks them.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    if quantized:
        queries, rows = queries.where("v IS NOT NULL"), rows.where("v IS NOT NULL")
        first = rows.select(F.size("v")).first()
        packed = lambda df: df.select("id", S.sign_bits(F.col("v")).alias("bits"))
        found = hamming_nearest(packed(queries), packed(rows), candidate_depth(k), first[0] if first else 64)
        found = found.join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id").join(rows.select(F.col("id").alias("doc_id"), F.col("v").alias("dv")), "doc_id")
        found = found.select("query_id", "doc_id", S.cosine(F.col("qv"), F.col("dv")).alias("score"))
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    nq, nd = _blocks(queries), _blocks(rows)
    side = lambda df, name, own, own_n, other, other_n: df.select(
        "id", "v", F.lit(name).alias("side"), F.pmod(F.xxhash64("id"), F.lit(own_n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other)
    )
    both = side(queries, "q", "qb", nq, "db", nd).unionByName(side(rows, "d", "db", nd, "qb", nq))
    found = both.groupBy("qb", "db").applyInArrow(_top_of_pair(k), "query_id long, doc_id long, score double")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scoped_or_all(found: DataFrame, in_scope: Column, key: str = "query_id") -> DataFrame:
    """Rows in scope; for queries that have none there, all of their rows."""
    scoped = found.where(in_scope)
    rest = found.join(scoped.select(key).distinct(), key, "left_anti")
    return scoped.withColumn("scoped", F.lit(True)).unionByName(rest.withColumn("scoped", F.lit(False)))


def fuse(branches: list[tuple[DataFrame, float]], cell: list[str], k: int = C.RRF_K, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of branches (query_id, cell columns, rank): cell columns, query_id, score, rank.

    In each branch the best rank of a cell counts; a branch of weight 0 or less is left out; of several queries a
    cell's best score counts (ties: the smaller query_id); equal scores are ordered by the cell columns.
    """
    parts = [df.groupBy("query_id", *cell).agg(F.min("rank").alias("rank")).withColumn("part", F.lit(float(w)) / (k + F.col("rank"))) for df, w in branches if w > 0]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    scored = all_.groupBy("query_id", *cell).agg(F.round(F.sum("part"), 10).alias("score"))
    best = scored.groupBy(*cell).agg(F.max(F.struct("score", (-F.col("query_id")).alias("q"))).alias("best"))
    out = best.select(*cell, (-F.col("best.q")).alias("query_id"), F.col("best.score").alias("score")).orderBy(F.desc("score"), *cell)
    if top:
        out = out.limit(top)
    return numbered(out, [], [F.desc("score"), *map(F.col, cell)]).withColumn("rank", F.col("rank").cast("int"))


def reranked_sparse(hits: DataFrame, top: int) -> DataFrame:
    """Keyword hits ranked anew in each subquery: one for each cell, scores of zero or less count as FLOOR_SCORE.

    hits: subquery, index_id, company, sheet, coord, cell_id, score.  A cell is its coordinate in index, company and
    sheet, or its id where it has none; ties go to the smaller index, then to the smaller cell.
    """
    score = F.when(F.col("score") > 0, F.col("score")).otherwise(C.FLOOR_SCORE)
    return _reranked(hits.withColumn("score", score), top, [F.desc("score"), F.col("index_id"), F.col("cell_id")])


def reranked_dense(hits: DataFrame, top: int) -> DataFrame:
    """C4: vector hits ranked anew in each subquery: the best score of each cell, to 6 digits; ties by index and cell."""
    out = _reranked(hits, top, [F.desc("score"), F.col("index_id"), F.col("cell_id")])
    return out.withColumn("score", F.round("score", 6))


def _reranked(hits: DataFrame, top: int, order: list[Column]) -> DataFrame:
    place = F.coalesce(F.nullif(F.col("coord"), F.lit("")), F.col("cell_id"))
    cell = ["subquery", "index_id", F.coalesce("company", F.lit("")), F.coalesce("sheet", F.lit("")), place]
    best = hits.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).where("_n = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("subquery").orderBy(*order))).where(F.col("rank") <= top).drop("_n")


def prioritized(cells: DataFrame, keys: list[str], rank: str, order: list[Column], limit: int | None) -> DataFrame:
    """K4: of the first candidates of each key (four to eight times as many as asked for, within bounds) all of the best
    alias rank, then cut to the limit: cells that disagree at the best rank stay together.  Without a limit all of them.
    """
    best = F.min(rank).over(Window.partitionBy(*keys))
    if limit is None:
        return cells.withColumn("_best", best).where(F.col(rank) == F.col("_best")).drop("_best")
    depth = max(C.EVIDENCE_MIN, min(C.EVIDENCE_FACTOR * limit, C.EVIDENCE_MAX))
    w = Window.partitionBy(*keys).orderBy(*order)
    out = cells.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= depth)
    out = out.withColumn("_best", best).where(F.col(rank) == F.col("_best"))
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n", "_best")


def capped_blocks(expanded: DataFrame, most: int) -> DataFrame:
    """K7: the first cells of an expansion, by the rank of their hit, then by column: the answer's stated size."""
    order = [F.col("hit_rank"), F.asc_nulls_last("col_index"), F.col("company"), F.col("sheet"), F.col("coord")]
    return expanded.orderBy(*order).limit(most)


def hybrid(sparse: DataFrame, dense: DataFrame, cells: DataFrame, top: int, radius: int, most: int) -> DataFrame:
    """Rerank both branches' hits, fuse them by rank, and expand the rows around the best cells.

    sparse and dense are hits as reranked_sparse() takes them, of a plan's subqueries; cells: company, sheet, coord,
    row_index, col_index.  Returns cells with hit_rank and place, most of them at the most.
    """
    named = lambda df: df.select(F.col("subquery").alias("query_id"), "company", "sheet", "coord", "rank")
    found = fuse([(named(reranked_sparse(sparse, C.TOP_K)), 1.0), (named(reranked_dense(dense, C.TOP_K)), 1.0)], ["company", "sheet", "coord"], top=top)
    hits = found.join(cells.select("company", "sheet", "coord", "row_index"), ["company", "sheet", "coord"])
    return capped_blocks(expand_rows(hits, cells, radius), most)


def expand_rows(hits: DataFrame, cells: DataFrame, radius: int = 0, per_row: int | None = None) -> DataFrame:
    """All cells of the rows around each hit, in the order of the hits, each cell once."""
    near = hits.select("company", "sheet", "rank", F.explode(F.sequence(F.col("row_index") - radius, F.col("row_index") + radius)).alias("row_index"))
    first = near.groupBy("company", "sheet", "row_index").agg(F.min("rank").alias("hit_rank"))
    out = cells.join(first, ["company", "sheet", "row_index"])
    place = F.row_number().over(Window.partitionBy("company", "sheet", "row_index").orderBy(F.asc_nulls_last("col_index"), "coord"))
    out = out.withColumn("place", place)
    return out.where(F.col("place") <= per_row) if per_row else out


def best_variant(documents: DataFrame, keys: list[str], quality: list[Column]) -> DataFrame:
    """One document for each key, the first by quality."""
    w = Window.partitionBy(*keys).orderBy(*quality)
    return documents.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def evidence_of(documents: DataFrame, eligible: DataFrame, keys: list[str], quality: list[Column]) -> DataFrame:
    """Of the documents of a scope those at eligible coordinates, the best one of each."""
    return best_variant(documents.join(eligible.select(*keys).distinct(), keys), keys, quality)


def exact_evidence(cells: DataFrame, wanted: DataFrame, limit: int | None = C.EVIDENCE_MAX) -> DataFrame:
    """Cells that state a metric for a period, for all pairs of wanted at once.

    wanted: metric_id, aliases array, excluded array, period_terms array, kind (fy or ltm).  cells:
    cell_id, company, sheet, coord, row_index, col_index, row_tokens array, column_tokens array (normalised).  A row
    token equal to an alias is better than one that ends with it; rows that end with an excluded alias are out.  Of
    several columns of one row and period those marked LTM are the LTM ones; without a mark the left one is the fiscal
    year, the right one LTM.  Of the first cells of a company and metric (see prioritized()) those of the best alias rank stay, limit of them at most; without a limit all cells of the best alias rank.
    """
    exact = F.array_min(F.filter(F.transform("row_tokens", lambda t: F.array_position("aliases", t)), lambda p: p > 0))
    ends = F.array_min(F.filter(F.transform("aliases", lambda a, i: F.when(F.exists("row_tokens", lambda t: t.endswith(a)), i + 1)), lambda p: p.isNotNull()))
    blocked = F.exists("excluded", lambda a: F.exists("row_tokens", lambda t: t.endswith(a)))
    ltm = F.exists("column_tokens", lambda t: t.isin("ltm", "lasttwelvemonths", "trailingtwelvemonths"))
    # a cell meets what is wanted by an equal term; that it may meet it by several makes no difference to what follows
    asked = wanted.withColumn("_term", F.explode(F.array_distinct("period_terms")))
    seen = cells.withColumn("_term", F.explode(F.array_distinct("column_tokens"))).join(asked, "_term").withColumns({"exact": exact, "ends": ends, "blocked": blocked, "ltm": ltm})
    keys = ["metric_id", "kind", "company", "sheet"]
    at = seen.groupBy(*keys, "coord").agg(F.max("row_index").alias("row_index"), F.max("col_index").alias("col_index"), F.min("exact").alias("exact"), F.min("ends").alias("ends"), F.bool_or("blocked").alias("blocked"), F.bool_or("ltm").alias("ltm"), F.min("cell_id").alias("cell_id"))
    at = at.where("(exact IS NOT NULL OR ends IS NOT NULL) AND NOT blocked")
    row = Window.partitionBy(*keys, "row_index")
    at = at.withColumns({"row_ltm": F.bool_or("ltm").over(row), "repeats": F.count("*").over(row), "left": F.row_number().over(row.orderBy("col_index", "coord")), "right": F.row_number().over(row.orderBy(F.desc("col_index"), F.desc("coord")))})
    fits = F.when(F.col("kind") == "ltm", F.col("ltm") | (~F.col("row_ltm") & (F.col("repeats") > 1) & (F.col("right") == 1))).otherwise(
        ~F.col("ltm") & (F.col("row_ltm") | (F.col("repeats") == 1) | (F.col("left") == 1))
    )
    at = at.where(fits).withColumn("metric_rank", F.coalesce("exact", F.col("ends") + 1000).cast("int"))
    order = [F.col("metric_rank"), F.upper("sheet"), F.upper("coord"), F.col("sheet"), F.col("coord")]
    return prioritized(at, ["metric_id", "kind", "company"], "metric_rank", order, limit).select(*keys, "coord", "cell_id", "metric_rank")


def by_references(cells: DataFrame, references: DataFrame) -> DataFrame:
    """Cells named by (company, sheet, coord), where a null company or sheet of a reference stands for any."""
    found = None
    for on in (["coord"], ["sheet", "coord"], ["company", "coord"], ["company", "sheet", "coord"]):
        given = references
        for c in ("company", "sheet"):
            given = given.where(F.col(c).isNotNull() if c in on else F.col(c).isNull())
        part = cells.join(given.select(*on).distinct(), on, "left_semi").select(*cells.columns)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def header_variants(path: Column) -> Column:
    """The full path, each single header, each prefix and each suffix, first occurrence kept."""
    n = F.size(path)
    steps = F.sequence(F.lit(1), n)
    singles = F.transform(steps, lambda i: F.slice(path, i, F.lit(1)))
    prefixes = F.transform(steps, lambda i: F.slice(path, F.lit(1), i))
    suffixes = F.transform(steps, lambda i: F.slice(path, i, n))
    return F.array_distinct(F.concat(F.array(path), singles, prefixes, suffixes))


def dimension_problems(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Groups (by model and stated dimension) whose vectors do not all have that many components."""
    n = F.size("v")
    out = vectors.groupBy(*keys, "dimension").agg(F.count("*").alias("n"), F.count_if(n != F.col("dimension")).alias("n_wrong"))
    return out.where("n_wrong > 0")


def batched(encoder, dimension: int):
    """A mapInArrow function that encodes texts in batches; encoder takes a list of texts and returns vectors.

    Raises ValueError if a vector has another dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = encoder(batch.column(1).to_pylist())
            if any(len(v) != dimension for v in vectors):
                raise ValueError(f"vectors must have {dimension} components")
            yield pa.record_batch([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "v"])

    return run
