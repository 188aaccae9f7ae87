"""Company comparison: growth, scores, ranks, forecasts, histograms, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalar as S


def series_ends(series: DataFrame, entity: str = "company_id", year: str = "fiscal_year", last: int = 5) -> DataFrame:
    """First, last and last-but-one year of the last years of each series, with revenue and income."""
    recent = series.withColumn("_n", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(year)))).where(F.col("_n") <= last)
    point = F.struct(F.col(year).alias("year"), "revenue", "operating_income")
    return recent.groupBy(entity).agg(
        F.min_by(point, F.col(year)).alias("first"),
        F.max_by(point, F.col(year)).alias("latest"),
        F.max(F.when(F.col("_n") == 2, point)).alias("before"),
        F.count("*").alias("n_years"),
    )


def _cagr(first: Column, last: Column) -> Column:
    span = last["year"] - first["year"]
    return F.when((span > 0) & (first["revenue"] > 0) & (last["revenue"] > 0), F.pow(F.try_divide(last["revenue"], first["revenue"]), F.try_divide(F.lit(1.0), span)) - 1)


def candidates(series: DataFrame, position: DataFrame, entity: str = "company_id") -> DataFrame:
    """Scores of every company with at least two years of positive revenue and a financial position.

    position has liabilities, assets and net_debt by company.  The score of the window that ends a year earlier is not
    rounded, the current one is.
    """
    ends = series_ends(series, entity).join(position, entity)
    first, latest, before = F.col("first"), F.col("latest"), F.col("before")
    ratio = F.try_divide(F.col("liabilities"), F.col("assets")) * 100

    def parts(last: Column) -> dict[str, Column]:
        growth = _cagr(first, last) * 100
        margin = F.try_divide(last["operating_income"], last["revenue"]) * 100
        return {"g": growth, "m": margin, "gs": S.growth_score(growth), "ms": S.profitability_score(margin), "ss": S.stability_score(ratio, F.col("net_debt"), last["revenue"])}

    now, then = parts(latest), parts(before)
    composite = lambda p: p["gs"] * C.GROWTH_WEIGHT + p["ms"] * C.MARGIN_WEIGHT + p["ss"] * C.STABILITY_WEIGHT
    out = ends.select(
        entity,
        first["year"].alias("start_year"),
        latest["year"].alias("end_year"),
        latest["revenue"].alias("latest_revenue"),
        now["g"].alias("revenue_cagr"),
        now["m"].alias("operating_margin"),
        ratio.alias("liabilities_to_assets"),
        now["gs"].alias("growth_score"),
        now["ms"].alias("profitability_score"),
        now["ss"].alias("stability_score"),
        S.rounded(composite(now), 2).alias("composite_score"),
        F.when(F.col("n_years") >= 3, composite(then)).otherwise(S.rounded(composite(now), 2)).alias("historical_score"),
    )
    return out.where(F.col("composite_score").isNotNull()).withColumn("tier", S.tier(F.col("composite_score")))


def ranked(scored: DataFrame, *partition: str) -> DataFrame:
    """Competition ranks now and a year ago, and the change between them.

    The league as a whole is one window; companies are rows of a league table, not of the fact data.
    """
    now = Window.partitionBy(*partition).orderBy(F.desc("composite_score"))
    then = Window.partitionBy(*partition).orderBy(F.desc(S.rounded(F.col("historical_score"), 9)))
    out = scored.withColumns({"rank": F.rank().over(now), "previous_rank": F.rank().over(then)})
    return out.withColumn("rank_change", F.col("previous_rank") - F.col("rank"))


def forecast(scored: DataFrame, years: int = C.FORECAST_YEARS) -> DataFrame:
    """Revenue of the next years at the clamped growth rate, income at the latest margin."""
    rate = F.greatest(F.lit(C.FORECAST_FLOOR), F.least(F.lit(C.FORECAST_CEILING), F.col("revenue_cagr") / 100))
    ahead = scored.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(years)))).withColumn("rate", rate)
    revenue = F.col("latest_revenue") * F.pow(1 + F.col("rate"), F.col("step"))
    return ahead.withColumns({"year": F.col("end_year") + F.col("step"), "revenue": revenue, "operating_income": revenue * F.col("operating_margin") / 100})


def histogram(values: DataFrame, value: str, edges: tuple[int, ...]) -> DataFrame:
    """Counts of half-open buckets with open ends; empty buckets have zero."""
    bounds = [(None, edges[0]), *zip(edges, edges[1:], strict=False), (edges[-1], None)]
    labels = [f"<{edges[0]}%", *(f"{a}-{b}%" for a, b in zip(edges, edges[1:], strict=False)), f"{edges[-1]}%+"]
    bucket = F.lit(len(bounds) - 1)
    for k in range(len(edges) - 1, -1, -1):
        bucket = F.when(F.col(value) < edges[k], k).otherwise(bucket)
    counts = values.where(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    all_ = values.sparkSession.createDataFrame(list(enumerate(labels)), "bucket int, label string")
    return all_.join(counts, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("n"))


def exclusion_reasons(facts: DataFrame, entity: str = "company_id") -> DataFrame:
    """C11: why a company is left out, in fixed order; an empty list means that it is compared."""
    rules = {
        "revenue_years_insufficient": F.coalesce(F.col("n_years"), F.lit(0)) < 2,
        "revenue_not_positive": F.coalesce(F.col("min_revenue"), F.lit(0.0)) <= 0,
        "assets_missing": F.col("assets").isNull(),
        "assets_not_positive": F.col("assets") <= 0,
        "liabilities_missing": F.col("liabilities").isNull(),
    }
    reasons = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))
    return facts.select(entity, F.concat_ws(",", reasons).alias("reasons"))


def indexed(series: DataFrame, entity: str = "company_id", year: str = "fiscal_year", value: str = "revenue") -> DataFrame:
    """The series with its first value as 100; 100 throughout if that is zero."""
    first = F.first(value).over(Window.partitionBy(entity).orderBy(year).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return series.withColumn("index_value", F.when(first == 0, 100.0).otherwise(F.try_divide(F.col(value), first) * 100))
