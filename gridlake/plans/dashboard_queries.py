"""Queries over assembled snapshots, listings of stored collections, and workbooks' sheet roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import formulas
from ..functions import scalar as S
from ..operators import dashboards as D
from ..operators import indexes as I
from ..operators import profile as P
from ..operators import retrieval as R
from . import metric_queries
from .base import CELLS_SQL, ORACLE_SQL, YEARS_SQL, cells, company_years, query, table

# -- dashboards ------------------------------------------------------------------------------------------------------

_DASHBOARD_SQL = f"""
    WITH {YEARS_SQL},
    s AS (SELECT company_id, fiscal_year, CASE WHEN fiscal_year = max(fiscal_year) OVER (PARTITION BY company_id) THEN 'ltm' ELSE 'fy' END AS kind, revenue, debts, operating_income, cost,
                 CASE WHEN fiscal_year % 7 <> 0 THEN net_income END AS net_income,
                 CASE WHEN fiscal_year % 5 = 0 THEN 'invalid' WHEN fiscal_year % 3 = 0 THEN 'available' ELSE 'missing' END AS direct,
                 CASE WHEN fiscal_year % 2 = 0 THEN debts * 0.5::DOUBLE END AS short, CASE WHEN company_id % 2 = 0 THEN debts * 0.1::DOUBLE END AS part, CASE WHEN fiscal_year % 4 <> 1 THEN debts * 2 END AS long
          FROM (SELECT *, revenue * 0.02::DOUBLE AS debts FROM years)),
    t AS (SELECT *, CASE WHEN direct <> 'missing' THEN direct WHEN coalesce(short, part, long) IS NOT NULL THEN 'available' ELSE 'missing' END AS debt_status,
                 CASE WHEN direct = 'available' THEN debts WHEN direct = 'missing' AND coalesce(short, part, long) IS NOT NULL THEN coalesce(short, 0) + coalesce(part, 0) + coalesce(long, 0) END AS debt,
                 lag(revenue) OVER (PARTITION BY company_id ORDER BY fiscal_year) AS before FROM s),
    o(company_id, fiscal_year, kind, metric_id, value, status, issue) AS (
        SELECT company_id, fiscal_year, kind, 'total_debt', debt, debt_status, NULL FROM t
        UNION ALL SELECT company_id, fiscal_year, kind, 'current_portion_of_long_term_debt', part, CASE WHEN part IS NULL THEN 'missing' ELSE 'available' END, NULL FROM t
        UNION ALL SELECT company_id, fiscal_year, kind, 'net_margin', net_income / revenue * 100, CASE WHEN net_income IS NULL THEN 'missing' ELSE 'available' END, NULL FROM t
        UNION ALL SELECT company_id, fiscal_year, kind, 'free_cash_flow_margin', operating_income / revenue * 100, 'available', NULL FROM t
        UNION ALL SELECT company_id, fiscal_year, kind, 'net_debt_ratio', (debt - debts / 4) / (revenue * 2) * 100, debt_status, NULL FROM t
        UNION ALL SELECT company_id, fiscal_year, kind, 'revenue_yoy_growth', CASE WHEN kind = 'fy' THEN (revenue / before - 1) * 100 END, CASE WHEN kind = 'ltm' OR before IS NULL THEN 'missing' ELSE 'available' END,
                         CASE WHEN kind = 'ltm' THEN 'comparable_prior_ltm_missing' WHEN before IS NULL THEN 'comparable_prior_period_missing' END FROM t)
"""
_SHOWN = ("total_debt", "current_portion_of_long_term_debt", "net_margin", "free_cash_flow_margin", "net_debt_ratio", "revenue_yoy_growth")
_PRIMARY = ("revenue_yoy_growth", "net_margin", "current_portion_of_long_term_debt")


def _observations(spark, sf_dir):
    """A company's years as its periods, the last of them as its last twelve months; some metrics are not observed in some."""
    y, k = company_years(spark, sf_dir), F.col("fiscal_year")
    last = y.groupBy("company_id").agg(F.max("fiscal_year").alias("last"))
    y = y.join(last, "company_id").withColumn("kind", F.when(k == F.col("last"), "ltm").otherwise("fy")).withColumn("period_id", F.concat_ws("-", "kind", k.cast("string")))
    debts = F.col("revenue") * 0.02
    values = {
        "revenue": F.col("revenue"), "operating_income": F.col("operating_income"), "net_income": F.when(k % 7 != 0, F.col("net_income")), "total_debt": F.when((k % 5 == 0) | (k % 3 == 0), debts),
        "short_term_debt": F.when(k % 2 == 0, debts * 0.5), "current_portion_of_long_term_debt": F.when(F.col("company_id") % 2 == 0, debts * 0.1), "long_term_debt": F.when(k % 4 != 1, debts * 2),
        "cash_and_short_term_investments": debts / 4, "operating_cash_flow": F.col("operating_income") + debts, "capital_expenditure": -debts, "total_assets": F.col("revenue") * 2, "total_liabilities": F.col("cost"),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric_id"), v.alias("value"), F.when((F.lit(m) == "total_debt") & (k % 5 == 0), "invalid").otherwise("available").alias("status")) for m, v in values.items()))).alias("r")
    observed = y.select("company_id", "period_id", rows).select("company_id", "period_id", "r.*").where("value IS NOT NULL")
    return D.dashboard_observations(observed, y.select("company_id", "period_id", "kind", F.col("fiscal_year").alias("position")))


@query(f"{_DASHBOARD_SQL} SELECT company_id, kind || '-' || fiscal_year AS period_id, metric_id, round(value, 6) AS value, status, issue FROM o")
def dashboard_observations(spark, sf_dir):
    """Source and derived metrics and growth of each company in one grid."""
    o = _observations(spark, sf_dir).where(F.col("metric_id").isin(list(_SHOWN)))
    return o.select("company_id", "period_id", "metric_id", F.round("value", 6).alias("value"), "status", "issue")


@query(f"""{_DASHBOARD_SQL}, m AS (SELECT company_id, metric_id, count(*) FILTER (status = 'available') AS n, bool_or(status = 'invalid') AS bad FROM o GROUP BY ALL)
    SELECT company_id, metric_id, CASE WHEN n > 0 THEN 'available' WHEN bad THEN 'invalid' ELSE 'missing' END AS status, n AS n_available FROM m""")
def dashboard_series(spark, sf_dir):
    """The status of each metric's series."""
    return D.series_statuses(_observations(spark, sf_dir).where(F.col("metric_id").isin(list(_SHOWN))))


@query(f"""{_DASHBOARD_SQL}, m AS (SELECT company_id, metric_id FROM o WHERE metric_id IN {_PRIMARY} GROUP BY ALL HAVING count(*) FILTER (status = 'available') = 0),
    i AS (SELECT company_id, string_agg(metric_id, ',' ORDER BY metric_id) AS issues FROM m GROUP BY company_id)
    SELECT company_id, 'snapshot-' || substr(sha256(company_id || ':wh' || company_id % 9 || ':job:1:1'), 1, 24) AS snapshot_id, CASE WHEN issues IS NULL THEN 'ready' ELSE 'partial' END AS status, coalesce(issues, '') AS issues
    FROM (SELECT DISTINCT company_id FROM years) LEFT JOIN i USING (company_id)""")
def dashboard_snapshots(spark, sf_dir):
    """Id, status and issues of each company's snapshot."""
    observations = _observations(spark, sf_dir)
    sources = observations.select("company_id").distinct().select("company_id", F.concat(F.lit("wh"), (F.col("company_id") % 9).cast("string")).alias("workbook_hash"), F.lit("job").alias("job_id"))
    return D.dashboard_snapshots(observations, sources, _PRIMARY).withColumn("issues", F.array_join("issues", ","))


@query()
def exact_margins(spark, sf_dir):
    """margins of each company and year in decimals of 28 digits; a test computes the whole table in Python's decimals."""
    y = company_years(spark, sf_dir)
    money = {c: F.col(c).cast("decimal(18,4)") for c in ("operating_income", "net_income", "revenue")}
    out = y.select("company_id", "fiscal_year", *(formulas.exact(C.FORMULAS[m], money).alias(m) for m in ("operating_margin", "net_margin")), *(v.alias(f"given_{c}") for c, v in money.items()))
    return out.select("company_id", "fiscal_year", "given_operating_income", "given_net_income", "given_revenue", *(F.col(m)["text"].alias(m) for m in ("operating_margin", "net_margin")))


# -- comparison ------------------------------------------------------------------------------------------------------

_REGISTRY_SQL = f"""
    registry AS (
        SELECT company_id, metric_id, fiscal_year, 'E' || dense_rank() OVER (ORDER BY company_id || chr(31) || metric_id || chr(31) || fiscal_year || chr(31) || cell_id) AS evidence_id
        FROM (SELECT company_id, fiscal_year, unnest(['revenue', 'operating_income']) AS metric_id, 'cell-' || fiscal_year % 4 AS cell_id FROM (WITH {YEARS_SQL} SELECT * FROM years)))
"""


def _registry(spark, sf_dir):
    """Revenue and income of each year, each of them named twice."""
    y = company_years(spark, sf_dir).select("company_id", "fiscal_year", F.explode(F.array(F.lit("revenue"), F.lit("operating_income"), F.lit("revenue"))).alias("metric_id"), F.concat(F.lit("cell-"), (F.col("fiscal_year") % 4).cast("string")).alias("cell_id"))
    return D.evidence_registry(y, ["company_id", "metric_id", "fiscal_year", "cell_id"])


@query(f"WITH {_REGISTRY_SQL} SELECT * FROM registry")
def comparison_evidence(spark, sf_dir):
    """C11: evidence ids over all companies, equal evidence once."""
    return _registry(spark, sf_dir).select("company_id", "metric_id", "fiscal_year", "evidence_id").distinct()


@query(f"""
    WITH {_REGISTRY_SQL}, league AS ({ORACLE_SQL["league_rank_change"]}), reasons AS ({ORACLE_SQL["comparison_exclusions"]}),
    e AS (SELECT company_id, string_agg('E' || n, ',' ORDER BY n) AS evidence FROM (SELECT DISTINCT company_id, substr(evidence_id, 2)::BIGINT AS n FROM registry) GROUP BY company_id)
    SELECT s_suppkey AS company_id, rank, previous_rank, coalesce(reasons, '') AS reasons, CASE WHEN rank IS NOT NULL THEN evidence END AS evidence
    FROM supplier LEFT JOIN league ON league.company_id = s_suppkey LEFT JOIN reasons ON reasons.company_id = s_suppkey LEFT JOIN e ON e.company_id = s_suppkey
""")
def comparison_snapshot(spark, sf_dir):
    """C11: every company with ranks or reasons, and its evidence."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"))
    league = metric_queries.league_rank_change(spark, sf_dir).select("company_id", "rank", "previous_rank")
    out = D.comparison_snapshot(s, league, metric_queries.comparison_exclusions(spark, sf_dir), _registry(spark, sf_dir))
    return out.select("company_id", "rank", "previous_rank", F.coalesce("reasons", F.lit("")).alias("reasons"), F.array_join("evidence", ",").alias("evidence"))


@query("SELECT 'comparison-' || substr(sha256(string_agg('s' || s_suppkey, '|' ORDER BY 's' || s_suppkey) || '|v1|f1'), 1, 24) AS id, count(*) AS n FROM supplier")
def comparison_id(spark, sf_dir):
    """The id of a comparison of all companies."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_snapshot_id"))
    return s.agg(D.comparison_id(s, ("v1", "f1")).alias("id"), F.count("*").alias("n"))


# -- stored collections ----------------------------------------------------------------------------------------------

_INDEX_SQL = f"""
    WITH {CELLS_SQL},
    collections AS (SELECT n_name AS name, n_nationkey AS key, CASE WHEN n_nationkey % 3 = 0 THEN (n_nationkey * 1000)::VARCHAR WHEN n_nationkey % 3 = 1 THEN 'many' END AS stated, 'f' || n_nationkey % 20 AS file_id FROM nation),
    sheets AS (SELECT DISTINCT 'f' || n_nationkey % 20 AS file_id, sheet, CASE sheet WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS place FROM cells JOIN nation ON n_name = company)
"""


def _indexes(spark, sf_dir):
    """Nations as collections of their cells; some state a count, some state none that is a number."""
    k = F.col("n_nationkey")
    stated = F.when(k % 3 == 0, (k * 1000).cast("string")).when(k % 3 == 1, "many")
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.to_json(F.struct(stated.alias("document_count"))).alias("meta"), F.concat(F.lit("f"), (k % 20).cast("string")).alias("file_id"))
    c = cells(spark, sf_dir)
    place = F.when(F.col("sheet") == "R", 1).when(F.col("sheet") == "N", 2).otherwise(3)
    sheets = c.join(n, F.col("company") == F.col("name")).groupBy("file_id", "sheet").agg(F.array_sort(F.collect_set("column_header")).alias("tables"))
    sheets = sheets.select("file_id", place.alias("sheet_index"), F.col("sheet").alias("sheet_name"), (F.col("sheet") != "N").alias("visible"), "tables")
    return n, c.select(F.col("company").alias("collection"), F.concat_ws("!", "sheet", "coord").alias("id"), "text"), sheets


@query(f"{_INDEX_SQL} SELECT name, coalesce((SELECT string_agg(sheet, ',' ORDER BY place) FROM sheets s WHERE s.file_id = c.file_id AND sheet <> 'N'), '') AS sheets FROM collections c")
def index_scopes(spark, sf_dir):
    """Collections with their visible sheets in order."""
    n, _, sheets = _indexes(spark, sf_dir)
    return I.scopes(n, sheets).select("name", F.array_join("sheets", ",").alias("sheets"))


@query(f"{_INDEX_SQL} SELECT name, CASE WHEN regexp_full_match(coalesce(stated, ''), '[0-9]+') THEN stated::BIGINT ELSE (SELECT count(*) FROM cells WHERE company = name) END AS chunk_count FROM collections")
def index_listing(spark, sf_dir):
    """Stated counts, and the number of rows where none is stated."""
    n, rows, _ = _indexes(spark, sf_dir)
    return I.listing(n, rows)


@query(f"""{_INDEX_SQL}, heads AS (SELECT file_id, place, list_sort(list(DISTINCT column_header)) AS tables FROM (SELECT 'f' || n_nationkey % 20 AS file_id, CASE sheet WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS place, column_header FROM cells JOIN nation ON n_name = company) GROUP BY ALL),
    flat AS (SELECT file_id, array_to_string(flatten(list(tables ORDER BY place)), ',') AS tables FROM heads GROUP BY file_id)
    SELECT name, (SELECT count(*) FROM cells WHERE company = name) AS document_count,
           (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT sheet || '!' || coord AS id FROM cells WHERE company = name ORDER BY id LIMIT 15)) AS sample,
           (SELECT string_agg(sheet, ',' ORDER BY place) FROM sheets s WHERE s.file_id = c.file_id) AS sheets, (SELECT tables FROM flat f WHERE f.file_id = c.file_id) AS tables FROM collections c
""")
def index_details(spark, sf_dir):
    """Count, sample of fifteen, sheets and flattened tables of each collection."""
    out = I.details(*_indexes(spark, sf_dir))
    return out.select("name", "document_count", F.array_join(F.transform("sample", lambda x: x["id"]), ",").alias("sample"), F.array_join("sheets", ",").alias("sheets"), F.array_join("tables", ",").alias("tables"))


@query(f"""
    WITH {CELLS_SQL}, v AS (SELECT *, unnest(['header_only', 'header_with_value']) AS variant FROM cells), e AS (SELECT company, sheet, coord FROM cells WHERE value > 30000 AND row_index % 10 = 1)
    SELECT v.company, v.sheet, v.coord, variant FROM v JOIN e ON e.company = v.company AND e.sheet = v.sheet AND e.coord = v.coord QUALIFY row_number() OVER (PARTITION BY v.company, v.sheet, v.coord ORDER BY CASE WHEN variant = 'header_with_value' THEN 0 ELSE 1 END, variant) = 1
""")
def eligible_evidence(spark, sf_dir):
    """The documents of a scope joined again with the coordinates that came through, the best one of each."""
    c = cells(spark, sf_dir)
    documents = c.withColumn("variant", F.explode(F.array(F.lit("header_only"), F.lit("header_with_value"))))
    eligible = c.where("value > 30000 AND row_index % 10 = 1").select("company", "sheet", "coord")
    quality = [F.when(F.col("variant") == "header_with_value", 0).otherwise(1), F.col("variant")]
    return R.evidence_of(documents, eligible, ["company", "sheet", "coord"], quality).select("company", "sheet", "coord", "variant")


# -- profiles and coordinates ----------------------------------------------------------------------------------------

_ROLES = {"income": ("fy1995", "a"), "balance": ("brand#1", "r"), "cash": ("n", "brand#5")}


def _points(terms) -> str:
    return " + ".join(f"CASE WHEN contains(lower(sheet), '{t}') THEN 4 WHEN contains(said, '{t}') THEN 1 ELSE 0 END" for t in terms)


@query(f"""
    WITH {CELLS_SQL}, x AS (SELECT company, sheet, string_agg(DISTINCT lower(row_header), ' ') || ' ' || string_agg(DISTINCT lower(column_header), ' ') AS said FROM cells GROUP BY ALL),
    p AS (SELECT company, sheet, {", ".join(f"{_points(t)} AS {r}" for r, t in _ROLES.items())} FROM x),
    r AS (SELECT *, greatest(income, balance, cash) AS best FROM p)
    SELECT company AS workbook, sheet, CASE WHEN best = 0 THEN 'unknown' WHEN income = best THEN 'income' WHEN balance = best THEN 'balance' ELSE 'cash' END AS role, round(least(0.98, 0.55 + 0.1 * best)::DOUBLE, 6) AS confidence FROM r
""")
def profile_sheet_roles(spark, sf_dir):
    """The roles of the sheets in each workbook's profile."""
    c = cells(spark, sf_dir)
    said = c.select(F.col("company").alias("workbook"), "sheet", F.col("row_index").alias("row"), F.col("col_index").alias("col"), F.explode(F.array("row_header", "column_header")).alias("value"))
    out = P.workbook_profile(said, roles=_ROLES)
    return out.select("workbook", F.explode("sheet_roles").alias("r")).select("workbook", "r.sheet", "r.role", F.round("r.confidence", 6).alias("confidence"))


@query("""
    WITH c AS (SELECT (p_partkey * 7 + p_size) % 16384 + 1 AS n, p_partkey FROM part), l AS (SELECT p_partkey, n, (n - 1) // 26 AS b FROM c)
    SELECT p_partkey, n AS column_number, CASE WHEN b > 26 THEN chr((64 + (b - 1) // 26)::INT) ELSE '' END || CASE WHEN b > 0 THEN chr((65 + (b - 1) % 26)::INT) ELSE '' END || chr((65 + (n - 1) % 26)::INT) AS letters, n AS back FROM l
""")
def column_letters(spark, sf_dir):
    """letters of all columns that the format has, and back."""
    n = (F.col("p_partkey") * 7 + F.col("p_size")) % 16384 + 1
    p = table(spark, sf_dir, "part").select("p_partkey", n.alias("column_number")).withColumn("letters", S.column_letters(F.col("column_number")))
    return p.withColumn("back", S.column_of_coordinate(F.concat("letters", F.lit("1"))).cast("long"))
