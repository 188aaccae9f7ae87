"""Queries over observations of metrics and the company league."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalar as S
from ..operators import comparison, metrics
from ..session import cut
from .base import POSITIONS_SQL, YEARS_SQL, company_years, positions, query, table


@query(f"""
    WITH {YEARS_SQL}, e AS (SELECT DISTINCT company_id FROM years), p AS (SELECT DISTINCT fiscal_year FROM years)
    SELECT company_id, fiscal_year, revenue AS value, CASE WHEN revenue IS NULL THEN 'missing' ELSE 'available' END AS status
    FROM e CROSS JOIN p LEFT JOIN years USING (company_id, fiscal_year)
""")
def metric_observation_grid(spark, sf_dir):
    """J11."""
    seen = cut(company_years(spark, sf_dir).select("company_id", "fiscal_year", F.col("revenue").alias("value")))
    return metrics.observation_grid(seen, seen.select("fiscal_year").distinct()).select("company_id", "fiscal_year", "value", "status")


@query(f"""
    WITH {YEARS_SQL}
    SELECT company_id, fiscal_year, operating_income / nullif(revenue, 0) * 100 AS operating_margin, net_income / nullif(revenue, 0) * 100 AS net_margin,
           CASE WHEN revenue = 0 THEN 'not_meaningful' ELSE 'available' END AS operating_margin_status
    FROM years
""")
def derived_margins(spark, sf_dir):
    """F20, C8."""
    out = metrics.derive(metrics.derive(company_years(spark, sf_dir), "operating_margin"), "net_margin")
    return out.select("company_id", "fiscal_year", "operating_margin", "net_margin", "operating_margin_status")


@query(f"""
    WITH {YEARS_SQL}, l AS (SELECT *, lag(revenue) OVER (PARTITION BY company_id ORDER BY fiscal_year) AS prev FROM years)
    SELECT company_id, fiscal_year, (revenue / nullif(prev, 0) - 1) * 100 AS growth,
           CASE WHEN prev IS NULL THEN 'missing' WHEN prev = 0 THEN 'not_meaningful' ELSE 'available' END AS growth_status FROM l
""")
def revenue_yoy_growth(spark, sf_dir):
    """W10, F21."""
    out = metrics.yoy_growth(company_years(spark, sf_dir), value="revenue")
    return out.select("company_id", "fiscal_year", "growth", "growth_status")


@query("""
    WITH d AS (SELECT c_custkey AS company_id,
        CASE WHEN c_acctbal >= 5000 THEN c_acctbal END AS direct, CASE WHEN c_acctbal >= 5000 THEN 'available' WHEN c_acctbal < -900 THEN 'ambiguous' ELSE 'missing' END AS direct_status,
        short_term, current_portion, long_term
      FROM customer LEFT JOIN (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::DECIMAL(18,4) END)::DOUBLE AS short_term,
            sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice::DECIMAL(18,4) END)::DOUBLE AS current_portion,
            sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(18,4) END)::DOUBLE AS long_term FROM orders GROUP BY ALL) ON o_custkey = c_custkey)
    SELECT company_id, CASE WHEN direct_status = 'available' THEN direct WHEN direct_status = 'missing' AND coalesce(short_term, current_portion, long_term) IS NOT NULL
               THEN coalesce(short_term, 0) + coalesce(current_portion, 0) + coalesce(long_term, 0) END AS total_debt,
           CASE WHEN direct_status <> 'missing' THEN direct_status WHEN coalesce(short_term, current_portion, long_term) IS NOT NULL THEN 'available' ELSE 'missing' END AS status FROM d
""")
def total_debt_fallback(spark, sf_dir):
    """customers' balances as direct values, their orders by status as components."""
    price = F.col("o_totalprice").cast("decimal(18,4)")
    parts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*(F.sum(F.when(F.col("o_orderstatus") == s, price)).cast("double").alias(n) for s, n in (("O", "short_term"), ("P", "current_portion"), ("F", "long_term"))))
    c = table(spark, sf_dir, "customer").join(parts, F.col("c_custkey") == F.col("o_custkey"), "left")
    balance = F.col("c_acctbal")
    status = F.when(balance >= 5000, C.AVAILABLE).when(balance < -900, C.AMBIGUOUS).otherwise(C.MISSING)
    value, status = metrics.total_debt(F.when(balance >= 5000, balance), status, F.col("short_term"), F.col("current_portion"), F.col("long_term"))
    return c.select(F.col("c_custkey").alias("company_id"), value.alias("total_debt"), status.alias("status"))


@query("""
    WITH o AS (SELECT o_custkey AS company_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'invalid' WHEN '2-HIGH' THEN 'ambiguous' WHEN '3-MEDIUM' THEN 'missing' WHEN '4-NOT SPECIFIED' THEN 'not_meaningful' ELSE 'available' END AS status FROM orders)
    SELECT company_id, CASE min(CASE status WHEN 'invalid' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'missing' THEN 2 WHEN 'not_meaningful' THEN 3 ELSE 4 END)
        WHEN 0 THEN 'invalid' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'missing' WHEN 3 THEN 'not_meaningful' ELSE 'available' END AS status FROM o GROUP BY company_id
""")
def series_status_precedence(spark, sf_dir):
    """A10."""
    p = F.substring("o_orderpriority", 1, 1)
    status = F.when(p == "1", C.INVALID).when(p == "2", C.AMBIGUOUS).when(p == "3", C.MISSING).when(p == "4", C.NOT_MEANINGFUL).otherwise(C.AVAILABLE)
    return metrics.dominant_status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), status.alias("status")), ["company_id"])


@query("""
    SELECT company_id, fiscal_year, order_id FROM (
        SELECT o_custkey AS company_id, year(o_orderdate)::INT AS fiscal_year, o_orderkey AS order_id,
               row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY quarter(o_orderdate) DESC, o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1
""")
def fy_winner_per_year(spark, sf_dir):
    """W16."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderkey").alias("order_id"), "o_orderdate")
    return metrics.fiscal_winner(o, "company_id", "fiscal_year", [F.quarter("o_orderdate").desc(), F.desc("o_orderdate"), F.desc("order_id")]).select("company_id", "fiscal_year", "order_id")


@query("""
    SELECT company_id, order_id, recency FROM (SELECT o_custkey AS company_id, o_orderkey AS order_id,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS recency FROM orders WHERE o_orderdate <= TIMESTAMP '1999-12-31') WHERE recency <= 5
""")
def current_periods_as_of(spark, sf_dir):
    """J15, W14."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("order_id"), F.struct("o_orderdate", "o_orderkey").alias("end_date"), "o_orderdate")
    o = o.where(F.col("o_orderdate") <= F.lit("1999-12-31").cast("timestamp_ntz"))
    return metrics.current_periods(o, F.struct(F.lit("1999-12-31").cast("timestamp_ntz").alias("o_orderdate"), F.lit(2**62).alias("o_orderkey"))).select("company_id", "order_id", "recency")


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(100.0, {x}))"


def _parts_sql(last: str) -> str:
    growth = f"(CASE WHEN {last}_y > first_y AND first_r > 0 AND {last}_r > 0 THEN pow({last}_r / first_r, 1.0 / ({last}_y - first_y)) - 1 END) * 100"
    margin = f"{last}_i / nullif({last}_r, 0) * 100"
    ratio = "liabilities / nullif(assets, 0) * 100"
    debt = f"net_debt / greatest({last}_r, 1.0) * 100"
    return (
        f"{growth} AS {last}_g, {margin} AS {last}_m, round({_clamp(f'(({growth}) + 10) / 22 * 100')}, 2) AS {last}_gs, round({_clamp(f'(({margin}) + 5) / 20 * 100')}, 2) AS {last}_ms, "
        f"round({_clamp(f'(70 - ({ratio})) / 40 * 100')} * 0.7 + (CASE WHEN {debt} <= 0 THEN 100.0 ELSE {_clamp(f'100 - ({debt}) * 4')} END) * 0.3, 2) AS {last}_ss"
    )


CANDIDATES_SQL = f"""{YEARS_SQL}, {POSITIONS_SQL},
    recent AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) AS n FROM years QUALIFY n <= 5),
    ends AS (SELECT company_id, min(fiscal_year) AS first_y, arg_min(revenue, fiscal_year) AS first_r, max(fiscal_year) AS last_y, arg_max(revenue, fiscal_year) AS last_r,
                    arg_max(operating_income, fiscal_year) AS last_i, max(CASE WHEN n = 2 THEN fiscal_year END) AS prev_y, max(CASE WHEN n = 2 THEN revenue END) AS prev_r,
                    max(CASE WHEN n = 2 THEN operating_income END) AS prev_i, count(*) AS n_years FROM recent GROUP BY company_id),
    parts AS (SELECT *, liabilities / nullif(assets, 0) * 100 AS ratio, {_parts_sql("last")}, {_parts_sql("prev")} FROM ends JOIN positions USING (company_id)),
    candidates AS (SELECT company_id, first_y AS start_year, last_y AS end_year, last_r AS latest_revenue, last_g AS revenue_cagr, last_m AS operating_margin, ratio AS liabilities_to_assets,
                          last_gs AS growth_score, last_ms AS profitability_score, last_ss AS stability_score, round(last_gs * 0.35 + last_ms * 0.35 + last_ss * 0.3, 2) AS composite_score,
                          CASE WHEN n_years >= 3 THEN prev_gs * 0.35 + prev_ms * 0.35 + prev_ss * 0.3 ELSE round(last_gs * 0.35 + last_ms * 0.35 + last_ss * 0.3, 2) END AS historical_score
                   FROM parts WHERE last_gs * 0.35 + last_ms * 0.35 + last_ss * 0.3 IS NOT NULL)"""


def _candidates(spark, sf_dir):
    return comparison.candidates(company_years(spark, sf_dir), positions(spark, sf_dir))


@query(f"""
    WITH {CANDIDATES_SQL}
    SELECT company_id, start_year, end_year, revenue_cagr, operating_margin, growth_score, profitability_score, stability_score, composite_score,
           CASE WHEN composite_score >= 90 THEN 'S' WHEN composite_score >= 75 THEN 'A' WHEN composite_score >= 50 THEN 'B' ELSE 'C' END AS tier FROM candidates
""")
def company_cagr_scores_tiers(spark, sf_dir):
    """W12, F16-F19."""
    return _candidates(spark, sf_dir).select("company_id", "start_year", "end_year", "revenue_cagr", "operating_margin", "growth_score", "profitability_score", "stability_score", "composite_score", "tier")


@query(f"""
    WITH {CANDIDATES_SQL}
    SELECT company_id, composite_score, rank() OVER (ORDER BY composite_score DESC)::INT AS rank, rank() OVER (ORDER BY round(historical_score, 9) DESC)::INT AS previous_rank,
           (rank() OVER (ORDER BY round(historical_score, 9) DESC) - rank() OVER (ORDER BY composite_score DESC))::INT AS rank_change FROM candidates
""")
def league_rank_change(spark, sf_dir):
    """W7, W9, W13."""
    return comparison.ranked(_candidates(spark, sf_dir)).select("company_id", "composite_score", "rank", "previous_rank", "rank_change")


@query(f"""
    WITH {CANDIDATES_SQL}
    SELECT company_id, (end_year + step)::INT AS year, latest_revenue * pow(1 + greatest(-0.12, least(0.3, revenue_cagr / 100)), step) AS revenue,
           latest_revenue * pow(1 + greatest(-0.12, least(0.3, revenue_cagr / 100)), step) * operating_margin / 100 AS operating_income
    FROM candidates, (SELECT unnest([1, 2, 3]) AS step)
""")
def forecast_three_years(spark, sf_dir):
    """W15."""
    return comparison.forecast(_candidates(spark, sf_dir)).select("company_id", "year", "revenue", "operating_income")


@query(f"""
    WITH {CANDIDATES_SQL}, e(bucket, label, lo, hi) AS (VALUES (0, '<-5%', -1e300, -5.0), (1, '-5-5%', -5.0, 5.0), (2, '5-10%', 5.0, 10.0), (3, '10-15%', 10.0, 15.0), (4, '15-20%', 15.0, 20.0), (5, '20-30%', 20.0, 30.0), (6, '30%+', 30.0, 1e300))
    SELECT bucket, label, count(revenue_cagr) AS n FROM e LEFT JOIN candidates ON revenue_cagr >= lo AND revenue_cagr < hi GROUP BY ALL
""")
def half_open_histogram(spark, sf_dir):
    """A8."""
    return comparison.histogram(_candidates(spark, sf_dir), "revenue_cagr", C.CAGR_EDGES)


@query(f"""
    WITH {YEARS_SQL}, {POSITIONS_SQL}, f AS (SELECT company_id, count(*) AS n_years, min(revenue) AS min_revenue FROM years GROUP BY 1)
    SELECT company_id, concat_ws(',', CASE WHEN coalesce(n_years, 0) < 2 THEN 'revenue_years_insufficient' END, CASE WHEN coalesce(min_revenue, 0) <= 0 THEN 'revenue_not_positive' END,
        CASE WHEN assets IS NULL THEN 'assets_missing' END, CASE WHEN assets <= 0 THEN 'assets_not_positive' END, CASE WHEN liabilities IS NULL THEN 'liabilities_missing' END) AS reasons
    FROM positions LEFT JOIN f USING (company_id)
""")
def comparison_exclusions(spark, sf_dir):
    """C11."""
    f = company_years(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("n_years"), F.min("revenue").alias("min_revenue"))
    return comparison.exclusion_reasons(positions(spark, sf_dir).join(f, "company_id", "left"))


@query(f"""
    WITH {YEARS_SQL}, p AS (SELECT DISTINCT fiscal_year FROM years), c AS (SELECT DISTINCT company_id FROM years),
    g AS (SELECT company_id, fiscal_year, operating_income / nullif(revenue, 0) * 100 AS m FROM c CROSS JOIN p LEFT JOIN years USING (company_id, fiscal_year)),
    l AS (SELECT *, lag(m) OVER (PARTITION BY company_id ORDER BY fiscal_year) AS b FROM g)
    SELECT company_id, fiscal_year, m - b AS delta, CASE WHEN m IS NULL THEN 'na' WHEN b IS NULL THEN 'baseline' WHEN m - b >= 2 THEN 'strong-improvement' WHEN m - b >= 0.5 THEN 'improvement'
        WHEN m - b > -0.5 THEN 'stable' WHEN m - b > -2 THEN 'decline' ELSE 'strong-decline' END AS trend FROM l
""")
def health_trend_heatmap(spark, sf_dir):
    """Over the full grid, so a gap makes the next value a baseline."""
    m = cut(metrics.derive(company_years(spark, sf_dir), "operating_margin").select("company_id", "fiscal_year", F.col("operating_margin").alias("value")))
    grid = metrics.observation_grid(m, m.select("fiscal_year").distinct())
    before = F.lag("value").over(Window.partitionBy("company_id").orderBy("fiscal_year"))
    return grid.withColumn("before", before).select("company_id", "fiscal_year", (F.col("value") - F.col("before")).alias("delta"), S.trend_class(F.col("before"), F.col("value")).alias("trend"))


@query(f"""
    WITH {YEARS_SQL}, f AS (SELECT *, first_value(revenue) OVER (PARTITION BY company_id ORDER BY fiscal_year) AS b, last_value(revenue) OVER (PARTITION BY company_id ORDER BY fiscal_year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM years)
    SELECT company_id, fiscal_year, CASE WHEN b = 0 THEN 100.0 ELSE revenue / b * 100 END AS index_value, (e - b) / nullif(abs(b), 0) * 100 AS change FROM f
""")
def indexed_revenue(spark, sf_dir):
    """W12, F24."""
    s = comparison.indexed(company_years(spark, sf_dir))
    w = Window.partitionBy("company_id").orderBy("fiscal_year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return s.select("company_id", "fiscal_year", "index_value", S.percent_change(F.first("revenue").over(w), F.last("revenue").over(w)).alias("change"))


@query(f"""
    WITH {CANDIDATES_SQL}
    SELECT company_id, d.dimension, score, rank() OVER (PARTITION BY dimension ORDER BY score DESC)::INT AS rank
    FROM (SELECT company_id, unnest(['growth', 'profitability', 'stability']) AS dimension, unnest([growth_score, profitability_score, stability_score]) AS score FROM candidates) d
""")
def score_dimension_rank(spark, sf_dir):
    """W8."""
    long = _candidates(spark, sf_dir).selectExpr("company_id", "stack(3, 'growth', growth_score, 'profitability', profitability_score, 'stability', stability_score) AS (dimension, score)")
    return long.withColumn("rank", F.rank().over(Window.partitionBy("dimension").orderBy(F.desc("score"))))


@query(f"""
    WITH {CANDIDATES_SQL}, r AS (SELECT *, (rank() OVER (ORDER BY round(historical_score, 9) DESC) - rank() OVER (ORDER BY composite_score DESC))::INT AS rank_change FROM candidates)
    SELECT (SELECT company_id FROM r ORDER BY composite_score DESC, company_id LIMIT 1) AS leader, (SELECT company_id FROM r ORDER BY rank_change DESC, composite_score DESC, company_id LIMIT 1) AS riser,
           (SELECT avg(round(revenue_cagr, 6)::DECIMAL(18,6))::DOUBLE FROM r) AS average_cagr, (SELECT count(*) FROM r) AS n_companies
""")
def comparison_spotlight(spark, sf_dir):
    """C11, K6: leader, riser and averages."""
    r = comparison.ranked(_candidates(spark, sf_dir))
    return r.agg(
        F.max_by("company_id", F.struct("composite_score", (-F.col("company_id")).alias("i"))).alias("leader"),
        F.max_by("company_id", F.struct("rank_change", "composite_score", (-F.col("company_id")).alias("i"))).alias("riser"),
        F.avg(F.round("revenue_cagr", 6).cast("decimal(18,6)")).cast("double").alias("average_cagr"),
        F.count("*").alias("n_companies"),
    )
