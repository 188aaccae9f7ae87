"""Queries over vectors, texts and cell records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import keyword as N
from ..operators import retrieval as R
from .base import CELLS_SQL, cells, query, table

K = 10
#: Stated queries: vectors whose id is divisible by 20, and three word lists.
WORDS = ((1, ("the", "and", "that")), (2, ("der", "und")), (3, ("la", "de", "que")))

_VEC = """
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
    d AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS dv, label FROM embeddings)
"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rows.where("id % 20 = 0"), rows


@query(f"""
    WITH {_VEC}
    SELECT query_id, doc_id, round(list_cosine_similarity(qv, dv), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(qv, dv) DESC, doc_id)::INT AS rank
    FROM q, d QUALIFY rank <= {K}
""")
def vector_topk_cosine(spark, sf_dir):
    """K2 (exact stage), F7, J7."""
    return R.vector_search(*_vectors(spark, sf_dir), K).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_HAMMING = "list_sum(list_transform(range(1, len(qv) + 1), lambda i: CASE WHEN (qv[i] > 0) <> (dv[i] > 0) THEN 1 ELSE 0 END))"


@query(f"""
    WITH {_VEC}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_HAMMING}, doc_id) AS n FROM q, d QUALIFY n <= {R.candidate_depth(K)})
    SELECT query_id, doc_id, round(list_cosine_similarity(qv, dv), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(qv, dv) DESC, doc_id)::INT AS rank
    FROM c QUALIFY rank <= {K}
""")
def vector_quantized_rerank(spark, sf_dir):
    """K2 (both stages), F8."""
    return R.vector_search(*_vectors(spark, sf_dir), K, quantized=True).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
    WITH {_VEC}, t AS (SELECT query_id, doc_id, label, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(qv, dv) DESC, doc_id)::INT AS rank FROM q, d QUALIFY rank <= {K}),
    s AS (SELECT * FROM t WHERE label = 1)
    SELECT query_id, doc_id, rank, true AS scoped FROM s UNION ALL SELECT query_id, doc_id, rank, false FROM t WHERE query_id NOT IN (SELECT query_id FROM s)
""")
def vector_scope_after_cut(spark, sf_dir):
    """The scope filters what the cut left; queries without any row in scope keep all."""
    found = R.vector_search(*_vectors(spark, sf_dir), K)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return R.scoped_or_all(found.join(labels, "doc_id"), F.col("label") == 1).select("query_id", "doc_id", "rank", "scoped")


_FTS = f"""
    w(query_id, words) AS (VALUES {", ".join(f"({i}, {list(x)})" for i, x in WORDS)}),
    t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
    o AS (SELECT query_id, doc_id, words, ws[p] AS word, p FROM (SELECT query_id, doc_id, words, ws, unnest(range(1, len(ws) + 1)) AS p FROM w, t WHERE list_has_all(ws, words)) WHERE list_contains(words, ws[p])),
    l AS (SELECT query_id, doc_id, p, row_number() OVER d AS n, {", ".join(f"CASE WHEN len(words) >= {k} THEN max(CASE WHEN word = words[{k}] THEN p END) OVER d ELSE p END AS l{k}" for k in (1, 2, 3))}
          FROM o WINDOW d AS (PARTITION BY query_id, doc_id ORDER BY p)),
    e AS (SELECT query_id, doc_id, least(l1, l2, l3) AS b, min(p) AS e, min(n) AS n FROM l WHERE l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL GROUP BY ALL),
    fts AS (SELECT e.query_id, e.doc_id, round(sum(0.1::DOUBLE / (1 + (e.e - e.b) - (e.n - l.n))), 9) AS score FROM e JOIN l ON l.query_id = e.query_id AND l.doc_id = e.doc_id AND l.p = e.b GROUP BY ALL)
"""


def _word_queries(spark):
    return spark.createDataFrame([(i, list(w)) for i, w in WORDS], "query_id int, words array<string>")


@query(f"""
    WITH {_FTS}
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM fts QUALIFY rank <= 100
""")
def fts_and_match(spark, sf_dir):
    """Texts ranked by cover density, over stored postings."""
    return N.match_all(N.postings(table(spark, sf_dir, "documents")), _word_queries(spark), 100)


@query(f"""
    WITH {_FTS}, {_VEC},
    a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fts QUALIFY rank <= 100),
    b AS (SELECT query_id // 20 + 1 AS query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(qv, dv) DESC, doc_id) AS rank FROM q, d QUALIFY rank <= 100),
    u AS (SELECT query_id, doc_id, 1.0 / (60 + min(rank)) AS part FROM a GROUP BY ALL UNION ALL SELECT query_id, doc_id, 1.0 / (60 + min(rank)) FROM b GROUP BY ALL),
    s AS (SELECT query_id, doc_id, round(sum(part), 10) AS score FROM u GROUP BY ALL),
    c AS (SELECT doc_id, max(score) AS score, arg_max(query_id, (score, -query_id)) AS query_id FROM s GROUP BY doc_id)
    SELECT doc_id, query_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM c QUALIFY rank <= 100
""")
def rrf_hybrid(spark, sf_dir):
    """Three stated word queries fused with all vector queries."""
    words = _word_queries(spark)
    sparse = N.match_all(N.occurrences(table(spark, sf_dir, "documents"), words), words, 100)
    queries, rows = _vectors(spark, sf_dir)
    dense = R.vector_search(queries, rows, 100).withColumn("query_id", (F.col("query_id") / 20).cast("int") + 1)
    return R.fuse([(sparse, 1.0), (dense, 1.0)], ["doc_id"], top=100).select("doc_id", "query_id", "score", "rank")


@query(f"""
    WITH {_FTS}, {_VEC},
    places AS (SELECT doc_id, coalesce(lang, 'und') AS company, coalesce(source, '') AS sheet, doc_id // 8 AS row_index, doc_id % 8 AS col_index FROM documents),
    a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fts QUALIFY rank <= 100),
    b AS (SELECT query_id // 20 + 1 AS query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(qv, dv) DESC, doc_id) AS rank FROM q, d WHERE query_id <= 40 QUALIFY rank <= 100),
    ra AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN score > 0 THEN score ELSE 0.05 END DESC, 'd' || doc_id) AS rank FROM a JOIN fts USING (query_id, doc_id) JOIN places USING (doc_id)),
    rb AS (SELECT b.query_id, b.doc_id, row_number() OVER (PARTITION BY b.query_id ORDER BY list_cosine_similarity(qv, dv) DESC, 'd' || b.doc_id) AS rank FROM b JOIN q ON q.query_id = (b.query_id - 1) * 20 JOIN d ON d.doc_id = b.doc_id JOIN places ON places.doc_id = b.doc_id),
    u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS part FROM ra UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM rb),
    s AS (SELECT query_id, doc_id, round(sum(part), 10) AS score FROM u GROUP BY ALL), c AS (SELECT doc_id, max(score) AS score FROM s GROUP BY doc_id),
    k AS (SELECT places.*, row_number() OVER (ORDER BY score DESC, company, sheet, places.doc_id::VARCHAR) AS rank FROM c JOIN places USING (doc_id) QUALIFY rank <= 50),
    n AS (SELECT company, sheet, row_index, min(rank)::INT AS hit_rank FROM k GROUP BY ALL)
    SELECT doc_id, hit_rank FROM places JOIN n USING (company, sheet, row_index) ORDER BY hit_rank, col_index, company, sheet, doc_id::VARCHAR LIMIT 200
""")
def hybrid_documents(spark, sf_dir):
    """A plan of three subqueries, each with words and a vector; keyword and vector search, reranked,
    fused and expanded.  A document is a cell of its language's workbook and its source's sheet, eight to a row."""
    places = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("company"), F.coalesce("source", F.lit("")).alias("sheet"), F.floor(F.col("doc_id") / 8).alias("row_index"), (F.col("doc_id") % 8).alias("col_index"), F.col("doc_id").cast("string").alias("coord"))
    queries, rows = _vectors(spark, sf_dir)
    words = _word_queries(spark)
    sparse = N.match_all(N.occurrences(table(spark, sf_dir, "documents"), words), words, 100)
    dense = R.vector_search(queries.where("id <= 40"), rows, 100).withColumn("query_id", (F.col("query_id") / 20).cast("int") + 1)
    hits = lambda df: df.join(places, "doc_id").select(F.col("query_id").alias("subquery"), F.lit("ix").alias("index_id"), "company", "sheet", "coord", F.concat(F.lit("d"), "coord").alias("cell_id"), "score")
    return R.hybrid(hits(sparse), hits(dense), places, 50, 0, 200).select("doc_id", "hit_rank")


@query(f"""
    WITH {CELLS_SQL}, h AS (SELECT company, sheet, row_index, row_number() OVER (PARTITION BY company ORDER BY value DESC, sheet, coord) AS rank FROM cells QUALIFY rank <= 3),
    f AS (SELECT company, sheet, unnest(range(row_index - 1, row_index + 2)) AS row_index, rank FROM h),
    g AS (SELECT company, sheet, row_index, min(rank)::INT AS hit_rank FROM f GROUP BY ALL)
    SELECT company, sheet, coord, hit_rank, row_number() OVER (PARTITION BY company, sheet, row_index ORDER BY col_index, coord)::INT AS place FROM cells JOIN g USING (company, sheet, row_index) QUALIFY place <= 5
""")
def context_row_expansion(spark, sf_dir):
    """Rows around the three largest cells of each company."""
    from pyspark.sql import Window

    c = cells(spark, sf_dir)
    hits = c.withColumn("rank", F.row_number().over(Window.partitionBy("company").orderBy(F.desc("value"), "sheet", "coord"))).where("rank <= 3")
    return R.expand_rows(hits, c, radius=1, per_row=5).select("company", "sheet", "coord", "hit_rank", "place")


@query(f"""
    WITH {CELLS_SQL}, v AS (SELECT *, unnest(['header_only', 'header_with_value']) AS variant FROM cells)
    SELECT company, sheet, coord, variant FROM (SELECT *, row_number() OVER (PARTITION BY upper(company), sheet, coord ORDER BY CASE WHEN variant = 'header_with_value' AND value > 10000 THEN 0 ELSE 1 END, variant) AS n FROM v) WHERE n = 1
""")
def best_variant_per_cell(spark, sf_dir):
    """A header-only and a valued document for each cell; small values count as unresolved."""
    v = cells(spark, sf_dir).withColumn("variant", F.explode(F.array(F.lit("header_only"), F.lit("header_with_value"))))
    good = F.when((F.col("variant") == "header_with_value") & (F.col("value") > 10000), 0).otherwise(1)
    return R.best_variant(v.withColumn("_company", F.upper("company")), ["_company", "sheet", "coord"], [good, F.col("variant")]).select("company", "sheet", "coord", "variant")


@query(f"""
    WITH {CELLS_SQL}, w(metric_id, aliases, excluded, terms, kind) AS (VALUES ('m1', ['brand11', '1'], ['21'], ['fy1997', 'fy1998'], 'fy'), ('m2', ['brand45', '5'], ['15', '25'], ['fy1997', 'fy1998'], 'ltm')),
    s AS (SELECT w.*, company, sheet, coord, row_index, col_index, regexp_replace(lower(row_header), '[^0-9a-z가-힣]+', '', 'g') AS rt FROM cells, w WHERE list_contains(terms, lower(column_header))),
    m AS (SELECT *, CASE WHEN list_contains(aliases, rt) THEN list_position(aliases, rt) END AS exact, list_min(list_filter(range(1, len(aliases) + 1), lambda i: ends_with(rt, aliases[i]))) AS ends FROM s WHERE len(list_filter(excluded, lambda a: ends_with(rt, a))) = 0),
    p AS (SELECT *, count(*) OVER (PARTITION BY metric_id, company, sheet, row_index) AS repeats, row_number() OVER (PARTITION BY metric_id, company, sheet, row_index ORDER BY col_index, coord) AS l,
                 row_number() OVER (PARTITION BY metric_id, company, sheet, row_index ORDER BY col_index DESC, coord DESC) AS r FROM m WHERE exact IS NOT NULL OR ends IS NOT NULL),
    e AS (SELECT *, coalesce(exact, ends + 1000)::INT AS metric_rank FROM p WHERE (kind = 'ltm' AND repeats > 1 AND r = 1) OR (kind = 'fy' AND (repeats = 1 OR l = 1)))
    SELECT metric_id, kind, company, sheet, coord, metric_rank FROM e QUALIFY metric_rank = min(metric_rank) OVER (PARTITION BY metric_id, kind, company)
""")
def metric_evidence_exact(spark, sf_dir):
    """Of each metric and company all cells that tie at the best alias."""
    c = cells(spark, sf_dir).select("company", "sheet", "coord", "row_index", "col_index", F.concat_ws("!", "company", "sheet", "coord").alias("cell_id"), F.array(S.normalize_token(F.col("row_header"))).alias("row_tokens"), F.array(S.normalize_token(F.col("column_header"))).alias("column_tokens"))
    wanted = spark.createDataFrame(
        [("m1", ["brand11", "1"], ["21"], ["fy1997", "fy1998"], "fy"), ("m2", ["brand45", "5"], ["15", "25"], ["fy1997", "fy1998"], "ltm")],
        "metric_id string, aliases array<string>, excluded array<string>, period_terms array<string>, kind string",
    )
    return R.exact_evidence(c, wanted, limit=None).select("metric_id", "kind", "company", "sheet", "coord", "metric_rank")


@query(f"""
    WITH {CELLS_SQL}, r(company, sheet, coord) AS (VALUES (NULL, NULL, 'G11'), (NULL, 'A', 'G12'), ('FRANCE', NULL, 'G13'), ('NATION_1', 'R', 'G14'), ('NATION_2', NULL, 'H21'))
    SELECT company, sheet, coord, value FROM cells c WHERE EXISTS (SELECT 1 FROM r WHERE r.coord = c.coord AND (r.company IS NULL OR r.company = c.company) AND (r.sheet IS NULL OR r.sheet = c.sheet))
""")
def reference_shapes_semijoin(spark, sf_dir):
    """P8, J4."""
    r = spark.createDataFrame([(None, None, "G11"), (None, "A", "G12"), ("FRANCE", None, "G13"), ("NATION_1", "R", "G14"), ("NATION_2", None, "H21")], "company string, sheet string, coord string")
    return R.by_references(cells(spark, sf_dir).select("company", "sheet", "coord", "value"), r)


@query(f"""
    WITH {CELLS_SQL}, p AS (SELECT DISTINCT company, [company, sheet, row_header] AS path FROM cells),
    v AS (SELECT path, [path] || list_transform(range(1, 4), lambda i: path[i:i]) || list_transform(range(1, 4), lambda i: path[1:i]) || list_transform(range(1, 4), lambda i: path[i:3]) AS vs FROM p)
    SELECT DISTINCT array_to_string(path, '/') AS path, array_to_string(unnest(vs), '/') AS variant FROM v
""")
def header_variants(spark, sf_dir):
    """U6."""
    p = cells(spark, sf_dir).select(F.array("company", "sheet", "row_header").alias("path")).distinct()
    return p.select("path", F.explode(R.header_variants(F.col("path"))).alias("v")).select(F.array_join("path", "/").alias("path"), F.array_join("v", "/").alias("variant")).distinct()


@query("""
    SELECT doc_id, md5(regexp_replace(lower(text), '[^0-9a-z가-힣]+', '', 'g')) AS token_md5, md5(trim(regexp_replace(lower(text), '[^0-9a-z가-힣]+', ' ', 'g'))) AS words_md5 FROM documents
""")
def normalize_tokens(spark, sf_dir):
    """F1, F2."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.normalize_token(F.col("text"))).alias("token_md5"), F.md5(S.normalize_words(F.col("text"))).alias("words_md5"))


@query(f"""
    WITH {CELLS_SQL}, t AS (SELECT company, sheet, coord, text || ' | Cell Value: ' || CASE WHEN value < 20000 THEN '?' WHEN value < 40000 THEN ' n/a ' ELSE coord END AS s FROM cells),
    e AS (SELECT *, trim(regexp_extract(s, 'Cell Value: *([^|\\n]*)$', 1)) AS v FROM t)
    SELECT company, sheet, coord, CASE WHEN lower(trim(v)) NOT IN ('', '?', '-', 'na', 'n/a', 'nm', '#pend', 'none', 'null') THEN v END AS cell_value FROM e
""")
def extract_cell_value(spark, sf_dir):
    """P7, F3."""
    c = cells(spark, sf_dir)
    value = F.when(F.col("value") < 20000, "?").when(F.col("value") < 40000, " n/a ").otherwise(F.col("coord"))
    text = F.concat("text", F.lit(" | Cell Value: "), value)
    return c.select("company", "sheet", "coord", S.resolved_cell_value(text).alias("cell_value"))


@query(f"""
    WITH {CELLS_SQL}
    SELECT coord, row_index, col_index, regexp_extract(column_header, '(19[0-9][0-9]|2[01][0-9][0-9])', 1)::INT AS year, substr(regexp_replace('Q1 ' || column_header, '[^0-9]', '', 'g'), 1, 4)::INT AS digits_year, count(*) AS n FROM cells GROUP BY ALL
""")
def coordinates_and_years(spark, sf_dir):
    """parsed back from the coordinate and the header."""
    c = cells(spark, sf_dir)
    return c.groupBy("coord", S.row_of_coordinate(F.col("coord")).alias("row_index"), S.column_of_coordinate(F.col("coord")).alias("col_index"), S.year_in_label(F.col("column_header")).alias("year"), S.year_of_digits(F.concat(F.lit("Q1 "), "column_header")).alias("digits_year")).agg(F.count("*").alias("n"))
