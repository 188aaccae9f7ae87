"""Queries over documents of cells, profiles of workbooks, hits of retrieval, and upkeep of catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas
from ..functions import scalar as S
from ..operators import catalog as K
from ..operators import cells as X
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import profile as P
from ..operators import retrieval as R
from ..session import cut, shared_dir
from ..sources import snapshots, workbooks
from .base import CELLS_SQL, YEARS_SQL, cells, company_years, query, table

_KEYS = ("company", "sheet", "coord")


@query(f"""
    WITH {CELLS_SQL}, p AS (SELECT company, sheet, coord, [sheet, row_header] AS r, [column_header] AS c FROM cells),
    v AS (SELECT company, sheet, coord, c, unnest([r, r[1:1], r[2:2]]) AS h FROM p),
    w AS (SELECT *, unnest(['header_only', 'header_with_value']) AS variant FROM v)
    SELECT DISTINCT company, sheet, coord, variant, 'Company: ' || company || ' | Sheet: ' || sheet || ' | Row Header: ' || array_to_string(h, ' > ') || ' | Column Header: ' || array_to_string(c, ' > ') || ' | Cell Value: ' || CASE WHEN variant = 'header_only' THEN '?' ELSE coord END AS text FROM w
""")
def cell_documents(spark, sf_dir):
    """All header variants of each cell, without and with its value (its coordinate)."""
    c = cells(spark, sf_dir).select(*_KEYS, F.array("sheet", "row_header").alias("row_path"), F.array("column_header").alias("column_path"), F.col("coord").alias("value"))
    return workbooks.cell_documents(c).select(*_KEYS, "variant", "text")


@query(f"""
    WITH {CELLS_SQL} SELECT company, sheet, coord, sheet || '/' || row_header AS row_path, column_header AS column_path, CASE WHEN value >= 30000 THEN coord END AS cell_value FROM cells
""")
def parsed_cells(spark, sf_dir):
    """the fields of a serialized cell, parsed back; small values are written as unknown."""
    c = cells(spark, sf_dir)
    text = S.serialized_cell(F.col("company"), F.col("sheet"), F.array("sheet", "row_header"), F.array("column_header"), F.when(F.col("value") >= 30000, F.col("coord")))
    got = S.parsed_cell(F.col("t"))
    return c.select("coord", text.alias("t")).select("coord", got["company"].alias("company"), got["sheet"].alias("sheet"), F.array_join(got["row_headers"], "/").alias("row_path"), F.array_join(got["column_headers"], "/").alias("column_path"), got["cell_value"].alias("cell_value"))


@query("""
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Assets/' || p_brand WHEN 1 THEN p_brand WHEN 2 THEN p_brand WHEN 3 THEN p_brand ELSE '' END AS headers FROM part
""")
def account_headers(spark, sf_dir):
    """paths with labels of older documents before the account."""
    k, b = F.col("p_partkey") % 5, F.col("p_brand")
    old = {0: ["Assets"], 1: [" Acme ", "Acme Corporation", "Source: filings", "LTM"], 2: ["Data in USD millions", "Fiscal Year Ended Dec"], 3: ["IBM", "data in thousands"]}
    path = F.array(F.lit("Data in EUR"), F.lit("  "))
    for n, labels in old.items():
        path = F.when(k == n, F.array(*map(F.lit, labels), b)).otherwise(path)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.account_headers(path, F.lit("ACME")), "/").alias("headers"))


def _period_text():
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    y = F.year(d).cast("string")
    return F.when(k == 0, F.concat(F.lit("Period  Ended "), F.date_format(d, "yyyy-MM-dd"))).when(k == 1, F.concat(F.lit("FY "), y)).when(k == 2, F.concat(y, F.lit("A"))).when(k == 3, F.concat(y, F.lit(".02.30 FY2001"))).when(k == 4, F.date_format(d, "yyyy/M/d")).otherwise("no period 12345")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 4) THEN o_orderdate::DATE END AS end_date, CASE WHEN o_orderkey % 6 NOT IN (3, 5) THEN year(o_orderdate)::INT END AS year,
           CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'FY ' || year(o_orderdate) WHEN 2 THEN year(o_orderdate) || 'A' WHEN 4 THEN year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) END AS label,
           year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter FROM orders
""")
def period_labels(spark, sf_dir):
    """periods written in several ways, one of them a date that does not exist."""
    p = S.period_of(_period_text())
    return table(spark, sf_dir, "orders").select("o_orderkey", p["end_date"].alias("end_date"), p["year"].alias("year"), p["label"].alias("label"), S.calendar_quarter(F.col("o_orderdate")).alias("quarter"))


_UNITS = [("Data in ($M)", "USD", "millions"), ("USD billions", "USD", "billions"), ("amounts in EUR thousands", "EUR", "thousands"), ("원화, 천 단위", "KRW", "thousands"), ("pound sterling, ones", "GBP", "ones"), ("musdx", None, None), ("$ bn", "USD", "billions")]


@query(f"""
    WITH u(k, currency, scale) AS (VALUES {", ".join(f"({k}, {repr(c) if c else 'NULL'}, {repr(s) if s else 'NULL'})" for k, (_, c, s) in enumerate(_UNITS))})
    SELECT o_orderkey, currency, scale FROM orders JOIN u ON k = o_orderkey % {len(_UNITS)}
""")
def currency_and_scale(spark, sf_dir):
    """F15."""
    text = F.get(F.array(*(F.lit(t) for t, _, _ in _UNITS)), (F.col("o_orderkey") % len(_UNITS)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.first_pattern(text, S.CURRENCIES).alias("currency"), S.first_pattern(text, S.SCALES).alias("scale"))


def _books(spark, sf_dir):
    """A workbook for each supplier: a title, units, an axis of year ends, marks above its first and last year, and a repeated date."""
    y = cut(company_years(spark, sf_dir).select("company_id", "fiscal_year"))
    ends = y.groupBy("company_id").agg(F.min("fiscal_year").alias("first"), F.max("fiscal_year").alias("last"))
    cell = lambda df, row, col, value: df.select(F.col("company_id").alias("workbook"), F.lit("IS").alias("sheet"), F.lit(row).alias("row"), col.cast("int").alias("col"), value.alias("value"))
    day = F.concat(F.col("fiscal_year").cast("string"), F.lit("-12-31"))
    parts = [
        cell(ends, 2, F.lit(1), F.when(F.col("company_id") % 4 == 0, "Income").otherwise("Data in ($M)")),
        cell(ends, 10, F.lit(1), F.lit("Period Ended")),
        cell(y, 10, F.col("fiscal_year") - 1980, day),
        cell(ends, 8, F.col("first") - 1980, F.lit("Estimates")),
        cell(ends, 7, F.col("last") - 1980, F.lit("LTM")),
        cell(y, 40, F.col("fiscal_year") - 1980, F.lit("1999-12-31")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_BOOKS = f"WITH {YEARS_SQL}, y AS (SELECT company_id, fiscal_year, fiscal_year = min(fiscal_year) OVER w AS est, fiscal_year = max(fiscal_year) OVER w AS ltm FROM years WINDOW w AS (PARTITION BY company_id))"


@query(f"{_BOOKS} SELECT company_id AS workbook, (fiscal_year - 1980)::INT AS col, make_date(fiscal_year, 12, 31) AS end_date, CASE WHEN ltm THEN 'ltm' ELSE 'fy' END AS kind FROM y WHERE NOT est AND company_id IN (SELECT company_id FROM y GROUP BY company_id HAVING count(*) >= 2)")
def period_axes(spark, sf_dir):
    """Forecast columns and rows of one date are out, the last twelve months are told apart."""
    return P.period_axes(_books(spark, sf_dir)).select("workbook", "col", "end_date", "kind")


@query(f"""{_BOOKS}, n AS (SELECT company_id, coalesce(list(fiscal_year ORDER BY fiscal_year) FILTER (WHERE NOT est AND NOT ltm), []) AS fy, coalesce(list(fiscal_year ORDER BY fiscal_year) FILTER (WHERE NOT est AND ltm), []) AS l FROM y GROUP BY company_id)
    SELECT company_id AS workbook, CASE WHEN company_id % 4 <> 0 THEN 'USD' END AS currency, CASE WHEN company_id % 4 <> 0 THEN 'millions' END AS scale, array_to_string(fy, ',') AS fiscal_years, array_to_string(l, ',') AS ltm_years,
           array_to_string(list_filter([CASE WHEN company_id % 4 = 0 THEN 'currency_missing' END, CASE WHEN company_id % 4 = 0 THEN 'amount_scale_missing' END, CASE WHEN len(fy) = 0 THEN 'periods_missing' END], lambda x: x IS NOT NULL), ',') AS issues FROM n""")
def workbook_profile(spark, sf_dir):
    """Currency, scale and periods of each workbook, and what it lacks."""
    p = P.workbook_profile(_books(spark, sf_dir))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return p.select("workbook", "currency", "scale", join("fiscal_years"), join("ltm_years"), join("issues"))


_HITS = "h AS (SELECT l_linenumber AS subquery, 'ix' || l_suppkey AS index_id, l_linestatus AS company, l_returnflag AS sheet, 'c' || l_partkey % 50 AS coord, 'k' || l_orderkey || '-' || l_linenumber AS cell_id, l_extendedprice * (l_discount - 0.05) AS score FROM lineitem)"


def _hits(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_linenumber").alias("subquery"), F.concat(F.lit("ix"), c("l_suppkey").cast("string")).alias("index_id"), c("l_linestatus").alias("company"), c("l_returnflag").alias("sheet"),
        F.concat(F.lit("c"), (c("l_partkey") % 50).cast("string")).alias("coord"), F.concat(F.lit("k"), c("l_orderkey").cast("string"), F.lit("-"), c("l_linenumber").cast("string")).alias("cell_id"), (c("l_extendedprice") * (c("l_discount") - 0.05)).alias("score"),
    )


def _rerank_sql(score, shown):
    return f"""WITH {_HITS}, s AS (SELECT * REPLACE ({score} AS score) FROM h),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY subquery, index_id, company, sheet, coord ORDER BY score DESC, index_id, cell_id) = 1)
        SELECT subquery, cell_id, {shown} AS score, row_number() OVER (PARTITION BY subquery ORDER BY score DESC, index_id, cell_id)::INT AS rank FROM b QUALIFY rank <= 100"""


@query(_rerank_sql("CASE WHEN score > 0 THEN score ELSE 0.05 END", "round(score, 4)"))
def sparse_rerank(spark, sf_dir):
    """Line items as keyword hits; half of their scores are not above zero."""
    return R.reranked_sparse(_hits(spark, sf_dir), 100).select("subquery", "cell_id", F.round("score", 4).alias("score"), "rank")


@query(_rerank_sql("score", "round(score, 4)"))
def dense_rerank(spark, sf_dir):
    """C4: line items as vector hits."""
    return R.reranked_dense(_hits(spark, sf_dir), 100).select("subquery", "cell_id", F.round("score", 4).alias("score"), "rank")


@query(f"""
    WITH {CELLS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY value DESC, company || '!' || coord) AS rank FROM cells QUALIFY rank <= 100),
    d AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row_index, company || '!' || coord) AS rank FROM cells QUALIFY rank <= 100),
    u AS (SELECT sheet AS q, company, sheet, coord, 1.0 / (60 + rank) AS part FROM s UNION ALL SELECT sheet, company, sheet, coord, 1.0 / (60 + rank) FROM d),
    f AS (SELECT company, sheet, coord, round(sum(part), 10) AS score FROM u GROUP BY ALL), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, company, sheet, coord) AS rank FROM f QUALIFY rank <= 50),
    n AS (SELECT company, sheet, row_index, min(rank)::INT AS hit_rank FROM t JOIN cells USING (company, sheet, coord) GROUP BY ALL)
    SELECT company, sheet, coord, hit_rank FROM cells JOIN n USING (company, sheet, row_index) ORDER BY hit_rank, col_index, company, sheet, coord LIMIT 200
""")
def hybrid_retrieval(spark, sf_dir):
    """Two branches of hits for each sheet, reranked, fused, expanded to whole rows, at most 200 cells."""
    c = cut(cells(spark, sf_dir))
    number = F.when(F.col("sheet") == "A", 1).when(F.col("sheet") == "N", 2).otherwise(3)
    hits = lambda score: c.select(number.alias("subquery"), F.lit("ix").alias("index_id"), *_KEYS, F.concat_ws("!", "company", "coord").alias("cell_id"), score.alias("score"))
    return R.hybrid(hits(F.col("value")), hits((-F.col("row_index")).cast("double")), c, 50, 0, 200).select(*_KEYS, "hit_rank")


@query(f"""
    WITH {CELLS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY value DESC, sheet, coord) AS n FROM cells QUALIFY n <= 80),
    b AS (SELECT * FROM a QUALIFY row_index % 5 = min(row_index % 5) OVER (PARTITION BY company))
    SELECT company, sheet, coord FROM b QUALIFY row_number() OVER (PARTITION BY company ORDER BY value DESC, sheet, coord) <= 10
""")
def metric_priority(spark, sf_dir):
    """K4: of each company's 80 first cells those of the best alias (here a rest of the row), ten at most."""
    c = cells(spark, sf_dir).withColumn("alias_rank", F.col("row_index") % 5)
    return R.prioritized(c, ["company"], "alias_rank", [F.desc("value"), F.col("sheet"), F.col("coord")], 10).select(*_KEYS)


@query(f"""
    WITH {CELLS_SQL} SELECT company, sheet, coord, CASE WHEN row_index % 2 = 0 THEN replace(row_header, '#', ' ') || ' ' || column_header ELSE 'total of ' || coord END AS terms FROM cells
""")
def keyword_terms(spark, sf_dir):
    """what is searched of a serialized cell, and of plain words with signs."""
    c = cells(spark, sf_dir)
    text = F.when(F.col("row_index") % 2 == 0, S.serialized_cell(F.col("company"), F.col("sheet"), F.array("row_header"), F.array("column_header"), F.lit("?"))).otherwise(F.concat(F.lit(" total (of) "), "coord", F.lit("!")))
    return c.select(*_KEYS, S.query_terms(text).alias("terms"))


@query(f"""
    WITH {CELLS_SQL} SELECT company, sheet, coord, CASE WHEN company = 'NATION_1' THEN 'Acme' ELSE company END AS named, CASE WHEN company = 'NATION_1' THEN replace(text, 'Company: NATION_1 |', 'Company: Acme |') ELSE text END AS text FROM cells
""")
def company_renamed(spark, sf_dir):
    """One collection's metadata and texts under another company name."""
    c = cells(spark, sf_dir).withColumn("meta", F.to_json(F.struct(F.col("company").alias("company_name"), F.col("coord").alias("cell_id"))))
    mine = F.col("company") == "NATION_1"
    out = K.renamed_company(c.where(mine), "company_name", "Acme").unionByName(c.where(~mine))
    return out.select(*_KEYS, F.get_json_object("meta", "$.company_name").alias("named"), "text")


@query("""
    WITH g AS (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)
    SELECT 'supplier' AS name, count(*) AS n FROM supplier WHERE s_suppkey NOT IN (FROM g) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_suppkey NOT IN (FROM g)
""")
def cascaded_delete(spark, sf_dir):
    """The suppliers of a nation and their line items go."""
    s = table(spark, sf_dir, "supplier")
    kept = K.cascaded({"supplier": (s, ["s_suppkey"]), "lineitem": (table(spark, sf_dir, "lineitem"), ["l_suppkey"])}, s.where("s_nationkey = 3").select("s_suppkey"))
    count = lambda n: kept[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return count("supplier").unionByName(count("lineitem"))


def _variants(spark, sf_dir):
    v = cells(spark, sf_dir).withColumn("variant", F.explode(F.array(F.lit("header_only"), F.lit("header_with_value"))))
    return v.withColumn("cell_id", F.concat_ws("!", *_KEYS))


@query(f"""
    WITH {CELLS_SQL}, v AS (SELECT *, unnest(['header_only', 'header_with_value']) AS variant FROM cells), p AS (SELECT *, (row_index % 10 = 1) OR (variant = 'header_only' AND row_index % 10 = 2) AS bad FROM v),
    k AS (SELECT company, sheet, coord, count(*) FILTER (WHERE NOT bad) AS kept FROM p GROUP BY ALL)
    SELECT company, n_before, n_removed, n_incomplete FROM (SELECT company, count(*) AS n_before, count(*) FILTER (WHERE bad) AS n_removed FROM p GROUP BY company) JOIN (SELECT company, count(*) FILTER (WHERE kept = 1) AS n_incomplete FROM k GROUP BY company) USING (company)
""")
def compaction_report(spark, sf_dir):
    """Documents of some rows are removed, and one variant of some others."""
    r = F.col("row_index") % 10
    return K.compacted(_variants(spark, sf_dir), (r == 1) | ((F.col("variant") == "header_only") & (r == 2)), ["company"], "cell_id", "variant")[1]


@query(f"""
    WITH {CELLS_SQL}, v AS (SELECT *, unnest(['header_only', 'header_with_value']) AS variant FROM cells), h AS (SELECT *, CASE WHEN row_index % 3 > 0 THEN column_header WHEN variant = 'header_with_value' THEN coord END AS period_header FROM v)
    SELECT company, period_header, sheet, coord, variant FROM h WHERE period_header IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company, sheet, period_header ORDER BY CASE WHEN variant = 'header_with_value' THEN 0 ELSE 1 END, coord) = 1
""")
def period_samples(spark, sf_dir):
    """One document for each period header of a company's sheet; some columns have no header but a value."""
    v = _variants(spark, sf_dir).withColumns({"column_header": F.when(F.col("row_index") % 3 > 0, F.concat(F.lit(" "), "column_header")).otherwise("  "), "cell_value": F.col("coord"), "cell_coord": F.col("coord")})
    return K.period_samples(v, ["company", "sheet"]).select("company", "period_header", "sheet", "coord", "variant")


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey)::INT AS number FROM orders QUALIFY number <= 40")
def numbered_claims(spark, sf_dir):
    """The 40 first orders, numbered."""
    q = table(spark, sf_dir, "orders")
    return K.numbered_claims(q, [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")], 40).select(F.col("o_orderkey").alias("id"), "number")


@query(f"""
    WITH {YEARS_SQL}, m AS (SELECT company_id, fiscal_year, CASE WHEN fiscal_year % 4 = 0 THEN NULL ELSE revenue END AS r, operating_income AS o, net_income AS n FROM years),
    u AS (SELECT company_id, fiscal_year, 'operating_margin' AS metric_id, o / r * 100 AS value, r FROM m UNION ALL SELECT company_id, fiscal_year, 'net_margin', n / r * 100, r FROM m)
    SELECT company_id, fiscal_year, metric_id, round(value, 6) AS value, CASE WHEN r IS NULL THEN 'missing' ELSE 'available' END AS status, CASE WHEN r IS NULL THEN metric_id || ':missing' END AS issue FROM u
""")
def recalculated_metrics(spark, sf_dir):
    """Margins recalculated from stored observations; revenue is missing in every fourth year."""
    y = company_years(spark, sf_dir).withColumn("revenue", F.when(F.col("fiscal_year") % 4 != 0, F.col("revenue")))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("metric_id"), F.col(n).alias("value")) for n in ("revenue", "operating_income", "net_income")))).alias("r")
    o = y.select("company_id", "fiscal_year", rows).select("company_id", "fiscal_year", "r.*").withColumn("status", F.when(F.col("value").isNull(), "missing").otherwise("available"))
    return K.recalculated(o, ("operating_margin", "net_margin")).select("company_id", "fiscal_year", "metric_id", F.round("value", 6).alias("value"), "status", "issue")


_ARITHMETIC = "round(abs(p_size - 25) ** 2 / 3, 2) + max(p_size, 10) % 7 - sum(1, 2, p_size) // 4 + min(p_size, 3) - (p_size - 30) % 7"


@query("""
    SELECT p_partkey, round(round(pow(abs(p_size - 25), 2) / 3, 2) + greatest(p_size, 10) % 7 - (3 + p_size) // 4 + least(p_size, 3) - (((p_size - 30) % 7) + 7) % 7, 6)::DOUBLE AS value FROM part
""")
def answer_arithmetic(spark, sf_dir):
    """floor division, remainders of negative numbers, powers and functions."""
    names = {"p_size": F.col("p_size").cast("double")}
    return table(spark, sf_dir, "part").select("p_partkey", F.round(formulas.compiled(_ARITHMETIC, names, answers=True), 6).alias("value"))


@query("""
    SELECT event_id, round(greatest(0, 1 - value / 50), 6)::DOUBLE AS clamped, round(1 - value / 50, 6)::DOUBLE AS plain, CASE WHEN user_id % 3 = 0 THEN user_id::INT END AS guarded, contains(lower(props), 'a_b%') OR contains(lower(event_type), 'ur') AS literal,
           user_id % 4 = 1 AS same, user_id % 2 = 0 AS digest, event_type <> 'error' AS live FROM events
""")
def row_checks(spark, sf_dir):
    """Guards and comparisons of single rows."""
    u = F.col("user_id")
    other = F.when(u % 4 == 1, F.concat(F.lit(" "), F.upper("event_type"))).when(u % 4 == 2, "").otherwise("none")
    digest = F.sha2(F.col("event_type"), 256)
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(S.similarity(F.col("value") / 50), 6).alias("clamped"), F.round(S.similarity(F.col("value") / 50, False), 6).alias("plain"),
        S.guarded_int(F.when(u % 3 == 0, u.cast("string")).otherwise(F.concat(u.cast("string"), F.lit("x")))).alias("guarded"),
        (S.literal_contains(F.col("props"), "A_b%") | S.literal_contains(F.col("event_type"), "UR")).alias("literal"), S.same_name(F.col("event_type"), other).alias("same"),
        S.is_sha256(F.when(u % 2 == 0, digest).otherwise(F.upper(digest))).alias("digest"), S.live(F.when(F.col("event_type") == "error", F.col("ts")), F.col("event_type")).alias("live"),
    )


@query()
def name_uuids(spark, sf_dir):
    """version 5 UUIDs of row numbers; a test compares them with Python's."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.name_uuid("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("s_suppkey").cast("string")).alias("id"))


@query("""
    WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text || ' 2024 x 1999'), '\\s+'), lambda x: true) AS w FROM conversations)
    SELECT conv_id, turn, len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]{4}$')))::INT AS n_periods, len(list_filter(w, lambda x: NOT regexp_matches(x, '^[0-9]{4}$') AND length(x) > 1))::INT AS n_metrics, list_filter(w, lambda x: regexp_matches(x, '^[0-9]{4}$'))[-1]::INT AS last_period FROM t
""")
def plan_signatures(spark, sf_dir):
    """F30."""
    got = E.plan_signature(F.concat("text", F.lit(" 2024 x 1999")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(got["periods"]).alias("n_periods"), F.size(got["metrics"]).alias("n_metrics"), F.element_at(got["periods"], -1).alias("last_period"))


_TEMPLATES, _COMPANIES = ["What was {company}'s revenue?", "How did {company} grow?", "{company} in short", "Debt of {company}"], ["Acme", "Birch", "Cedar"]


@query("""
    WITH s AS (SELECT s_suppkey AS k, [{t}] AS t, [{c}] AS c FROM supplier)
    SELECT k AS s_suppkey, array_to_string(list_transform(range(3), lambda i: replace(t[(k % 4 + i) % 4 + 1], '{{company}}', c[(k // 4 + i) % 3 + 1])), '|') AS picks FROM s
""".format(t=", ".join("'" + x.replace("'", "''") + "'" for x in _TEMPLATES), c=", ".join(map(repr, _COMPANIES))))
def suggestion_picks(spark, sf_dir):
    """suppliers' keys as seeds."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(S.suggestion(_TEMPLATES, _COMPANIES, F.col("s_suppkey")), "|").alias("picks"))


@query("""
    WITH r AS (SELECT p_brand AS sheet, p_partkey AS region, p_size AS r0, p_size + p_partkey % 90 AS r1, p_partkey % 20 AS c0, p_partkey % 20 + 4 AS c1 FROM part), c AS (SELECT DISTINCT p_brand AS sheet, (p_partkey % 130)::INT AS row, (p_size % 24)::INT AS col FROM part)
    SELECT c.sheet, row, col, count(*) AS n, min(region) AS first_region FROM c JOIN r ON c.sheet = r.sheet AND row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 GROUP BY ALL
""")
def region_membership(spark, sf_dir):
    """Regions and cells made from parts."""
    p, k, z = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    regions = p.select(F.col("p_brand").alias("sheet"), k.alias("region"), z.cast("int").alias("min_row"), (z + k % 90).cast("int").alias("max_row"), (k % 20).cast("int").alias("min_col"), (k % 20 + 4).cast("int").alias("max_col"))
    c = p.select(F.col("p_brand").alias("sheet"), (k % 130).cast("int").alias("row"), (z % 24).cast("int").alias("col")).distinct()
    # regions of the same bounds hold the same cells: they are joined once, and counted
    regions = regions.groupBy("sheet", "min_row", "max_row", "min_col", "max_col").agg(F.count("*").alias("same"), F.min("region").alias("region"))
    return X.cells_in_regions(c, regions).groupBy("sheet", "row", "col").agg(F.sum("same").alias("n"), F.min("region").alias("first_region"))


@query("""
    WITH t AS (SELECT p_brand AS sheet, (p_size % 5)::INT AS c0, p_partkey * 4 AS r0, p_partkey * 4 + p_partkey % 3 AS r1, p_partkey % 7 = 0 AS head FROM part),
    g AS (SELECT *, CASE WHEN lag(r1) OVER w IS NULL OR head OR r0 - lag(r1) OVER w - 1 > 90 THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY sheet, c0 ORDER BY r0)), n AS (SELECT *, sum(new) OVER (PARTITION BY sheet, c0 ORDER BY r0) AS grp FROM g)
    SELECT sheet, c0 AS min_col, min(r0) AS min_row, max(r1) AS max_row, count(*) AS n_tables FROM n GROUP BY sheet, c0, grp
""")
def stacked_tables(spark, sf_dir):
    """C17: tables made from parts, up to 90 rows apart."""
    k, c0 = F.col("p_partkey"), (F.col("p_size") % 5).cast("int")
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), c0.alias("min_col"), (c0 + 3).alias("max_col"), (k * 4).alias("min_row"), (k * 4 + k % 3).alias("max_row"), (k % 7 == 0).alias("has_header"))
    return X.stacked_tables(t, gap=90).select("sheet", "min_col", "min_row", "max_row", "n_tables")


@query("""
    WITH m AS (SELECT o_orderkey % 50 AS k, min(o_orderkey) AS a, count(*) AS n FROM orders GROUP BY ALL), o AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer)
    SELECT k, coalesce(m.n::DOUBLE, v) AS v FROM o FULL JOIN m USING (k)
""")
def upserted_rows(spark, sf_dir):
    """Counts of orders replace the balances of the customers of the same number."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 50).alias("k")).agg(F.count("*").cast("double").alias("v"))
    return snapshots.upsert(old, new, ["k"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def known_metrics(spark, sf_dir):
    """Orders of customers of a segment, as observations of metrics that a catalog still has."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("metric_id"))
    return K.known_metrics(o, table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("metric_id"))).select("o_orderkey")


@query("""
    WITH n AS (SELECT p_partkey AS node FROM part UNION ALL SELECT p_partkey FROM part WHERE p_size = 7), e AS (SELECT p_partkey AS source, p_partkey * 2 AS target FROM part)
    SELECT 'duplicate_node' AS problem, node::VARCHAR AS item FROM n GROUP BY node HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unknown_node', target::VARCHAR FROM e WHERE target NOT IN (SELECT node FROM n)
""")
def graph_problems(spark, sf_dir):
    """G1: parts as nodes, some of them twice; edges to doubles that may not exist."""
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").alias("node")).unionByName(p.where("p_size = 7").select(F.col("p_partkey").alias("node")))
    return G.problems(nodes, p.select(F.col("p_partkey").alias("source"), (F.col("p_partkey") * 2).alias("target")))


@query("""
    WITH e AS (SELECT p_partkey AS s, unnest([p_partkey * 2, p_partkey * 3]) AS t, CASE WHEN p_partkey % 4 = 0 THEN 'yes' END AS b FROM part), o AS (SELECT p_partkey AS s, CASE p_size % 5 WHEN 0 THEN 'failed' ELSE 'succeeded' END AS st, CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS took FROM part)
    SELECT t AS node, count(*) FILTER (WHERE st = 'succeeded' AND (b IS NULL OR b = took)) AS n_inputs, CASE WHEN count(*) FILTER (WHERE st = 'succeeded' AND (b IS NULL OR b = took)) > 0 THEN NULL WHEN bool_or(st = 'failed') THEN 'upstream_failed' ELSE 'branch_not_taken' END AS skip_reason FROM e JOIN o USING (s) GROUP BY t
""")
def active_inputs(spark, sf_dir):
    """Parts as nodes that failed or took a branch."""
    p, k, z = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    edges = p.select(k.alias("source"), F.explode(F.array(k * 2, k * 3)).alias("target"), F.when(k % 4 == 0, "yes").alias("branch"))
    return G.active_inputs(edges, p.select(k.alias("node"), F.when(z % 5 == 0, "failed").otherwise("succeeded").alias("status"), F.when(z % 2 == 0, "yes").otherwise("no").alias("branch")))


@query("""
    SELECT label, CASE WHEN label % 3 = 0 THEN 32 ELSE 64 END::INT AS dimension, count(*) AS n, count(*) AS n_wrong FROM embeddings WHERE label % 3 = 0 GROUP BY label
""")
def dimension_problems(spark, sf_dir):
    """Labels as models, of which some state another dimension than their vectors have."""
    v = table(spark, sf_dir, "embeddings").select("label", F.when(F.col("label") % 3 == 0, 32).otherwise(64).alias("dimension"), F.col("embedding").alias("v"))
    return R.dimension_problems(v, ["label"])


@query("""
    SELECT DISTINCT event_type AS sheet, user_id::INT AS row, hour(ts)::INT AS col FROM events
    UNION SELECT 'purchase', r::INT, c::INT FROM range(100, 104) t(r), range(3) u(c)
""")
def occupied_cells(spark, sf_dir):
    """Cells and one merged range."""
    c = table(spark, sf_dir, "events").select(F.col("event_type").alias("sheet"), F.col("user_id").cast("int").alias("row"), F.hour("ts").alias("col"))
    return X.occupied(c, spark.createDataFrame([("purchase", 100, 103, 0, 2)], "sheet string, min_row int, max_row int, min_col int, max_col int"))
