"""Queries over company catalogs, questions, answers, queues and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import catalog as K
from .base import CELLS_SQL, YEARS_SQL, cells, company_years, query, table

_LEGAL = "('co', 'company', 'corp', 'corporation', 'inc', 'incorporated', 'limited', 'llc', 'ltd', 'plc')"
_TOKENS = "list_filter(regexp_extract_all(lower({0}), '[0-9a-z가-힣]+'), lambda w: w NOT IN " + _LEGAL + ")"


@query(f"""
    WITH n AS (SELECT n_name || CASE n_nationkey % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Co. Ltd' ELSE '' END AS left_name FROM nation),
    m AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'N' || n_nationkey WHEN 1 THEN n_name ELSE lower(n_name) || ' plc' END AS right_name FROM nation),
    a AS (SELECT DISTINCT left_name, {_TOKENS.format("left_name")} AS t FROM n), b AS (SELECT DISTINCT right_name, {_TOKENS.format("right_name")} AS t FROM m),
    x AS (SELECT left_name, array_to_string(t, '') AS lk, array_to_string(list_transform(t, lambda w: w[1]), '') AS la FROM a), y AS (SELECT right_name, array_to_string(t, '') AS rk, array_to_string(list_transform(t, lambda w: w[1]), '') AS ra FROM b)
    SELECT left_name, right_name FROM x, y WHERE lk <> '' AND rk <> '' AND (starts_with(lk, rk) OR starts_with(rk, lk) OR lk = ra OR rk = la)
""")
def company_alias_join(spark, sf_dir):
    """Nations under two spellings."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    left = n.select(F.concat("n_name", F.when(k % 3 == 0, " Inc.").when(k % 3 == 1, " Co. Ltd").otherwise("")).alias("left_name"))
    right = n.select(F.when(k % 4 == 0, F.concat(F.lit("N"), k.cast("string"))).when(k % 4 == 1, F.col("n_name")).otherwise(F.concat(F.lower("n_name"), F.lit(" plc"))).alias("right_name"))
    return K.alias_pairs(left, right)


@query("""
    WITH r AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN substr(s_name, 1, 17) ELSE 'T' || s_suppkey END AS request FROM supplier),
    s AS (SELECT 'ix' || s_suppkey AS index_id, s_name || ' (' || s_nationkey || ')' AS company_name, 'T' || s_suppkey AS ticker, s_name AS base FROM supplier),
    a AS (SELECT DISTINCT index_id, regexp_replace(lower(company_name), '[^0-9a-z가-힣]+', '', 'g') AS company, regexp_replace(lower(unnest([company_name, base, ticker])), '[^0-9a-z가-힣]+', '', 'g') AS key FROM s),
    q AS (SELECT request, regexp_replace(lower(request), '[^0-9a-z가-힣]+', '', 'g') AS k FROM r),
    e AS (SELECT DISTINCT request, index_id FROM q JOIN a ON key = k),
    p AS (SELECT DISTINCT request, index_id, company FROM q JOIN a ON length(key) >= 4 AND length(k) >= 4 AND (starts_with(key, k) OR starts_with(k, key)) WHERE request NOT IN (SELECT request FROM e))
    SELECT request, index_id FROM e UNION ALL SELECT DISTINCT request, index_id FROM p WHERE request IN (SELECT request FROM p GROUP BY request HAVING count(DISTINCT company) = 1)
""")
def scope_resolution(spark, sf_dir):
    """Suppliers asked for by name, by a part of it or by a ticker."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    ticker = F.concat(F.lit("T"), k.cast("string"))
    asked = s.select(F.when(k % 3 == 0, F.col("s_name")).when(k % 3 == 1, F.substring("s_name", 1, 17)).otherwise(ticker).alias("request"))
    scopes = s.select(F.concat(F.lit("ix"), k.cast("string")).alias("index_id"), F.concat("s_name", F.lit(" ("), F.col("s_nationkey").cast("string"), F.lit(")")).alias("company_name"), ticker.alias("ticker"))
    return K.resolved_scopes(asked, scopes)


@query("""
    WITH r AS (SELECT o_orderkey AS subquery, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE 'ix' || o_custkey END AS index_id FROM orders UNION ALL SELECT o_orderkey, 'y' FROM orders WHERE o_orderkey % 13 = 0),
    k AS (SELECT DISTINCT 'ix' || s_suppkey AS index_id FROM supplier),
    c AS (SELECT r.*, k.index_id IS NOT NULL AS known FROM r LEFT JOIN k ON k.index_id = r.index_id),
    o AS (SELECT CASE WHEN count(*) = 1 THEN min(index_id) END AS o FROM k),
    w AS (SELECT *, bool_or(known) OVER (PARTITION BY subquery) AS one_known, bool_and(known) OVER (PARTITION BY subquery) AS all_known FROM c, o)
    SELECT DISTINCT subquery, CASE WHEN NOT one_known AND o IS NOT NULL THEN o ELSE index_id END AS index_id, CASE WHEN all_known THEN 'valid' WHEN one_known THEN 'mixed' WHEN o IS NOT NULL THEN 'repaired' ELSE 'unknown' END AS status FROM w
""")
def route_repair(spark, sf_dir):
    """Orders as subqueries, customers' numbers as indexes."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    routes = o.select(k.alias("subquery"), F.when(k % 11 == 0, "x").otherwise(F.concat(F.lit("ix"), F.col("o_custkey").cast("string"))).alias("index_id"))
    routes = routes.unionByName(o.where("o_orderkey % 13 = 0").select(k.alias("subquery"), F.lit("y").alias("index_id")))
    scopes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("ix"), F.col("s_suppkey").cast("string")).alias("index_id"))
    return K.repaired_routes(routes, scopes)


_METRICS = [("revenue", "Total Revenue", "What is the {metric} for {period}?", False), ("net_income", "Net Income", "State {metric} in {period}.", False), ("net_margin", "Net Margin", "", True)]


@query(f"""
    WITH {YEARS_SQL}, p AS (SELECT company_id, 'fy' AS kind, fiscal_year::VARCHAR AS period_id, 'FY' || fiscal_year AS label FROM years),
    m(metric_id, label_en, template) AS (VALUES {", ".join(str(x[:3]) for x in _METRICS if not x[3])}),
    q AS (SELECT *, 'h' || (company_id % 7) AS wh, 'ix' || company_id AS ix, 'fy-' || period_id AS pid FROM p, m)
    SELECT 'question-' || substr(sha256('job' || chr(0) || company_id || chr(0) || wh || chr(0) || ix || chr(0) || metric_id || chr(0) || pid || chr(0) || '1'), 1, 24) AS question_id, company_id, metric_id, pid AS period_id,
           replace(replace(template, '{{period}}', label), '{{metric}}', label_en) AS question_text, 'queued' AS status, 0::INT AS attempts FROM q
""")
def question_plan(spark, sf_dir):
    """Two source metrics for each supplier and year; the derived metric gets no question."""
    years = company_years(spark, sf_dir).select("company_id", "fiscal_year")
    c = F.col("company_id")
    companies = years.select("company_id").distinct().select("company_id", F.concat(F.lit("h"), (c % 7).cast("string")).alias("workbook_hash"), F.concat(F.lit("ix"), c.cast("string")).alias("index_id"))
    y = F.col("fiscal_year").cast("string")
    periods = years.select("company_id", F.lit("fy").alias("kind"), y.alias("period_id"), F.concat(F.lit("FY"), y).alias("label"))
    return K.question_plan(companies, periods, spark.createDataFrame(_METRICS, "metric_id string, label_en string, template string, derived boolean"), "job")


@query("""
    WITH a AS (SELECT o_custkey AS question_id, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, o_totalprice AS value, o_orderdate AS answered, o_orderkey AS id FROM orders),
    l AS (SELECT question_id, arg_max(value, (answered, id)) AS value FROM a WHERE status = 'completed' GROUP BY question_id)
    SELECT c_custkey AS question_id, value, CASE WHEN value IS NULL THEN 'missing' ELSE 'available' END AS status FROM customer LEFT JOIN l ON question_id = c_custkey
""")
def question_refresh(spark, sf_dir):
    """Customers as questions, their orders as answers."""
    answers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("answered_at"), F.col("o_orderkey").alias("answer_id"))
    return K.answers_or_missing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id")), answers)


@query("""
    SELECT o_custkey AS company_id, arg_max(o_orderkey, (CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END, o_orderdate, o_orderkey)) AS source_id,
           arg_max(o_orderdate, (CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END, o_orderdate, o_orderkey)) AS created_at, count(*) AS n_sources
    FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_custkey
""")
def company_index(spark, sf_dir):
    """Orders as a customer's sources, urgent ones preferred; customers in debt count as removed."""
    sources = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("source_id"), F.col("o_orderdate").alias("created_at"), F.startswith("o_orderpriority", F.lit("1")).alias("preferred"))
    return K.company_index(sources, table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("company_id")))


@query("""
    WITH e AS (SELECT c_custkey AS company_id, c_nationkey AS wh FROM customer),
    s AS (SELECT o_custkey AS company_id, max(o_orderkey) % 3 + min(o_orderkey) % 20 AS built FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
    j AS (SELECT o_custkey AS company_id, arg_max(o_orderkey % 2, o_orderkey) AS odd, arg_max(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY ALL),
    b AS (SELECT e.company_id, wh, built, CASE WHEN odd = 0 THEN wh ELSE -1 END AS tried, CASE WHEN odd IS NULL THEN NULL WHEN st = 'F' THEN 'failed' ELSE 'running' END AS status FROM e LEFT JOIN s USING (company_id) LEFT JOIN j USING (company_id)),
    r AS (SELECT company_id, CASE WHEN status IS NOT NULL AND tried = wh AND status = 'failed' THEN 'failed' WHEN status IS NOT NULL AND tried = wh THEN NULL WHEN built IS NOT NULL THEN 'source_changed' ELSE 'not_created' END AS reason FROM b WHERE built IS NULL OR built <> wh)
    SELECT company_id, reason FROM r WHERE reason IS NOT NULL
""")
def materialization_candidates(spark, sf_dir):
    """Customers as companies, their nation as the workbook, their orders as jobs."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_custkey").alias("company_id")
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_nationkey").cast("long").alias("workbook_hash"))
    built = o.where("o_orderstatus = 'F'").groupBy(key).agg((F.max("o_orderkey") % 3 + F.min("o_orderkey") % 20).alias("workbook_hash"))
    last = o.groupBy(key).agg(F.max_by(F.col("o_orderkey") % 2, "o_orderkey").alias("odd"), F.max_by("o_orderstatus", "o_orderkey").alias("st"))
    jobs = last.join(entries, "company_id").select("company_id", F.when(F.col("odd") == 0, F.col("workbook_hash")).otherwise(-1).alias("workbook_hash"), F.when(F.col("st") == "F", "failed").otherwise("running").alias("status"))
    return K.materialization_candidates(entries, built, jobs)


@query("SELECT s_suppkey AS company_id, s_name AS display_name FROM supplier ORDER BY lower(s_name), s_suppkey LIMIT 30")
def company_cap(spark, sf_dir):
    """K5: the league's 30 companies."""
    return K.capped_companies(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("display_name")))


@query("SELECT o_orderkey AS id FROM orders ORDER BY CASE WHEN o_custkey % 10 = 3 THEN 0 ELSE 1 END, o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 50")
def claim_order(spark, sf_dir):
    """K8: the next 50 orders for worker 3."""
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).cast("string").alias("preferred_worker"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"))
    return K.claim_order(q, "3", 50).select("id")


@query("""
    SELECT o_orderpriority AS phase, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'O') AS queued, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS running,
           sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS tokens FROM orders GROUP BY ALL
""")
def phase_totals(spark, sf_dir):
    """Orders as shards of the phases that their priorities name."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("phase")).agg(F.count("*").alias("total"), F.count_if(s == "F").alias("completed"), F.count_if(s == "O").alias("queued"), F.count_if(~s.isin("F", "O")).alias("running"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("tokens"))


@query(f"""
    WITH {CELLS_SQL}, c AS (SELECT sheet, coord, company AS index_id FROM cells WHERE value > 50000), h AS (SELECT sheet, coord, count(DISTINCT index_id) AS n, min(index_id) AS ix FROM c GROUP BY ALL), a AS (SELECT DISTINCT sheet, coord FROM cells)
    SELECT sheet, coord, coalesce(n, 0) AS n_indexes, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN n = 1 THEN ix END AS index_id FROM a LEFT JOIN h USING (sheet, coord)
""")
def evidence_resolution(spark, sf_dir):
    """Coordinates looked up over all companies' larger cells."""
    c = cells(spark, sf_dir)
    out = K.resolved_evidence(c.select("sheet", "coord").distinct(), c.where("value > 50000").select("sheet", "coord", F.col("company").alias("index_id")), ["sheet", "coord"])
    return out.select("sheet", "coord", "n_indexes", "status", "index_id")


@query("""
    WITH a AS (SELECT o_orderkey, o_custkey % 9 <> 0 AS same, CASE o_orderkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN NULL WHEN 2 THEN 'abc' ELSE '1,234.5' END AS raw, o_custkey % 4 AS ev, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' END AS unit, o_orderkey % 3 AS units FROM orders)
    SELECT o_orderkey, CASE WHEN NOT same THEN 'invalid' WHEN raw IS NULL OR raw = 'N/A' THEN 'missing' WHEN ev = 0 THEN 'invalid' WHEN unit IS NULL AND units = 2 THEN 'ambiguous' WHEN raw = 'abc' THEN 'invalid' ELSE 'available' END AS status,
           coalesce(unit, CASE WHEN units = 1 THEN 'EUR' END) AS unit FROM a
""")
def answer_validation(spark, sf_dir):
    """Answers made from order keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = F.when(k % 5 == 0, "N/A").when(k % 5 == 1, None).when(k % 5 == 2, "abc").otherwise("1,234.5")
    units = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("EUR"))).otherwise(F.array(F.lit("EUR"), F.lit("KRW")))
    a = table(spark, sf_dir, "orders").select("o_orderkey", (c % 9 != 0).alias("same_lineage"), raw.alias("raw_value"), (c % 4).alias("n_evidence"), F.when(k % 2 == 0, "USD").alias("unit"), units.alias("profile_units"))
    return K.validated(a).select("o_orderkey", "status", "unit")


@query(f"""
    WITH {CELLS_SQL}, e AS (SELECT company, sheet, coord FROM cells WHERE value >= 40000), s AS (SELECT company, sheet, coord FROM cells)
    SELECT s.* FROM s SEMI JOIN e USING (company, sheet, coord)
""")
def grounded_statements(spark, sf_dir):
    """A statement for each cell; small cells hold a placeholder."""
    c = cells(spark, sf_dir).withColumn("cell_id", F.concat_ws("!", "company", "sheet", "coord"))
    value = F.when(F.col("value") < 20000, " n/a ").when(F.col("value") < 40000, "?").otherwise(F.col("value").cast("string"))
    return K.grounded(c.select("company", "sheet", "coord", "cell_id"), c.select("cell_id", value.alias("cell_value"))).select("company", "sheet", "coord")


@query("""
    WITH u AS (SELECT o_custkey AS cell, 0 AS part, o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders)
    SELECT cell, part::INT AS part, o_orderkey FROM u QUALIFY row_number() OVER (PARTITION BY cell ORDER BY part, o_orderkey) = 1
""")
def exact_before_generic(spark, sf_dir):
    """Pending orders before all orders, one for each customer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cell"), "o_orderkey", "o_orderstatus")
    return K.first_wins([o.where("o_orderstatus = 'P'"), o], ["cell"], ["o_orderkey"]).select("cell", "part", "o_orderkey")


@query(f"""
    WITH {YEARS_SQL}, r AS (SELECT company_id, sha256(fiscal_year || chr(30) || CAST(revenue::DECIMAL(18,4) AS VARCHAR)) AS h FROM years)
    SELECT company_id, sha256(string_agg(h, chr(30) ORDER BY h)) AS fingerprint FROM r GROUP BY company_id
""")
def source_fingerprint(spark, sf_dir):
    """A17, F32."""
    return K.fingerprint(company_years(spark, sf_dir), "company_id", F.col("fiscal_year"), F.col("revenue").cast("decimal(18,4)"))


@query("""
    SELECT event_id, sha256((event_type || '@' || user_id % 3) || '|' || sha256(props) || '|' || user_id) AS cache_key FROM events
""")
def cache_keys(spark, sf_dir):
    """Events as module runs."""
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", K.cache_key(F.col("event_type"), (u % 3).cast("string"), F.col("props"), u.cast("string")).alias("cache_key"))


@query("""
    WITH c AS (SELECT p_brand AS index_id, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT *, unnest(range(0, (n + 6) // 7)) AS shard FROM c)
    SELECT index_id, shard::INT AS shard, shard * 7 AS start, least((shard + 1) * 7, n) AS stop FROM s
""")
def shard_ranges(spark, sf_dir):
    """Ranges of 7 rows."""
    return K.shard_ranges(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("index_id")).agg(F.count("*").alias("n")), 7)


@query(f"""
    WITH {YEARS_SQL}, a AS (SELECT company_id, fiscal_year, revenue FROM years WHERE net_income > 0), b AS (SELECT company_id, fiscal_year, operating_income FROM years WHERE operating_income > 0)
    SELECT company_id, fiscal_year, revenue, operating_income FROM a JOIN b USING (company_id, fiscal_year) QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) <= 5
""")
def common_years(spark, sf_dir):
    """Years with a net income and years with an operating income."""
    y = company_years(spark, sf_dir)
    return K.common_years(y.where("net_income > 0").select("company_id", "fiscal_year", "revenue"), y.where("operating_income > 0").select("company_id", "fiscal_year", "operating_income"))


@query("""
    WITH RECURSIVE n AS (SELECT p_partkey AS node_id, CASE WHEN p_partkey < 5 THEN NULL ELSE p_partkey // 5 END AS parent_id, p_brand AS name FROM part),
    t(node_id, path, depth) AS (SELECT node_id, name, 0 FROM n WHERE parent_id IS NULL UNION ALL SELECT n.node_id, t.path || ' / ' || n.name, t.depth + 1 FROM t JOIN n ON n.parent_id = t.node_id)
    SELECT node_id, path, depth::INT AS depth FROM t
""")
def header_tree_paths(spark, sf_dir):
    """a tree of part keys, each under a fifth of itself."""
    k = F.col("p_partkey")
    return K.tree_paths(table(spark, sf_dir, "part").select(k.alias("node_id"), F.when(k >= 5, F.floor(k / 5)).alias("parent_id"), F.col("p_brand").alias("name")))


@query("""
    WITH f AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'SPG_Company_KeyStats_' || lpad((s_suppkey % 100)::VARCHAR, 2, '0') || '_ai_amesoft_' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '_rank_recalibrated' ELSE '' END || '.xlsx' ELSE 'report_' || s_suppkey || '.xlsx' END AS file_name FROM supplier)
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'AI Amesoft ' || s_suppkey END AS company_name FROM f
""")
def workbook_identity(spark, sf_dir):
    """file names made from supplier keys."""
    k = F.col("s_suppkey")
    good = F.concat(F.lit("SPG_Company_KeyStats_"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("_ai_amesoft_"), k.cast("string"), F.when(k % 2 == 0, "_rank_recalibrated").otherwise(""), F.lit(".xlsx"))
    name = F.when(k % 3 == 0, good).otherwise(F.concat(F.lit("report_"), k.cast("string"), F.lit(".xlsx")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.workbook_company(name).alias("company_name"))


@query("""
    WITH q AS (SELECT conv_id, turn, lower(text || CASE conv_id % 6 WHEN 0 THEN ' 매출' WHEN 1 THEN ' 이익률' WHEN 2 THEN ' FCF' WHEN 3 THEN ' 부채' ELSE '' END) AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN contains(t, '매출') THEN 'revenue_growth' WHEN contains(t, '마진') OR contains(t, '이익률') THEN 'profitability' WHEN contains(t, '현금흐름') OR contains(t, 'fcf') THEN 'cash_flow' WHEN contains(t, '자산') OR contains(t, '부채') OR contains(t, '자본') THEN 'financial_scale' ELSE 'stability' END AS card FROM q
""")
def card_selection(spark, sf_dir):
    """F38."""
    k = F.col("conv_id") % 6
    text = F.concat("text", F.when(k == 0, " 매출").when(k == 1, " 이익률").when(k == 2, " FCF").when(k == 3, " 부채").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.visualization_card(text).alias("card"))


def _shown(x: str) -> str:
    return f"regexp_replace(format('{{:,.1f}}', round({x}, 1)), '\\.0$', '')"


@query(f"""
    SELECT s_suppkey, CASE WHEN abs(v) >= 1e12 THEN {_shown("v / 1e12")} || '조' WHEN abs(v) >= 1e8 THEN {_shown("v / 1e8")} || '억' WHEN abs(v) >= 1e6 THEN {_shown("v / 1e6")} || '백만' WHEN abs(v) >= 1e3 THEN {_shown("v / 1e3")} || '천' ELSE {_shown("v")} END || '원' AS amount,
           CASE WHEN v < 0 THEN '-' ELSE '' END || CASE s_nationkey % 3 WHEN 0 THEN '$' WHEN 1 THEN '€' ELSE 'CHF ' END || {_shown("abs(v)")} || CASE s_suppkey % 3 WHEN 0 THEN 'K' WHEN 1 THEN 'M' ELSE '' END AS international,
           CASE WHEN round(m, 1) > 0 THEN '+' ELSE '' END || CASE WHEN round(m, 1) = 0 THEN '0' ELSE {_shown("m")} END || '%' AS percent,
           CASE WHEN v < 0 THEN '-' ELSE '' END || CASE s_nationkey % 3 WHEN 0 THEN '$' WHEN 1 THEN 'EUR ' ELSE 'CHF ' END || format('{{:,.0f}}', round(abs(v))) || CASE s_suppkey % 3 WHEN 0 THEN 'K' WHEN 1 THEN 'M' ELSE '' END AS compared,
           CASE WHEN m < 0 THEN floor((m - 5) / 5) * 5 ELSE 0 END::DOUBLE AS lower_bound, CASE WHEN m > 20 THEN ceil((m + 5) / 5) * 5 ELSE 20 END::DOUBLE AS upper_bound
    FROM (SELECT s_suppkey, s_nationkey, s_acctbal * pow(10, s_suppkey % 5 * 2) AS v, s_acctbal / 100 AS m FROM supplier)
""")
def amount_formats(spark, sf_dir):
    """balances at several scales and in several currencies."""
    v = F.col("s_acctbal") * F.pow(F.lit(10.0), F.col("s_suppkey") % 5 * 2)
    low, high = S.axis_bounds(F.col("s_acctbal") / 100, F.col("s_acctbal") / 100)
    n, k = F.col("s_nationkey") % 3, F.col("s_suppkey") % 3
    currency, scale = F.when(n == 0, "USD").when(n == 1, "EUR").otherwise("CHF"), F.when(k == 0, "thousands").when(k == 1, "millions").otherwise("ones")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", S.krw_amount(v).alias("amount"), S.international_amount(v, currency, scale).alias("international"), S.signed_percent(F.col("s_acctbal") / 100).alias("percent"),
        S.comparison_amount(v, currency, scale).alias("compared"), low.alias("lower_bound"), high.alias("upper_bound"),
    )