"""Snapshots assembled from observations: dashboards of a company (C8) and the comparison of companies (C11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.formulas import variables
from .metrics import derive, total_debt
from .ranking import dense_numbers

#: Derived metrics in an order in which each finds its variables.
DERIVED = ("operating_margin", "net_margin", "free_cash_flow", "net_debt", "free_cash_flow_margin", "debt_ratio", "net_debt_ratio")
DEBT_PARTS = ("short_term_debt", "current_portion_of_long_term_debt", "long_term_debt")
GROWTH = "revenue_yoy_growth"


def _sources() -> list[str]:
    named = {v for f in DERIVED for v in variables(C.FORMULAS[f])} - set(DERIVED)
    return sorted(named | {"revenue", "total_debt", *DEBT_PARTS})


def dashboard_observations(observed: DataFrame, periods: DataFrame) -> DataFrame:
    """(company_id, period_id, position, kind, metric_id, value, status, issue) of all metrics in all periods of a company.

    observed: company_id, period_id, metric_id, value, status of source metrics; periods: company_id, period_id, kind (fy or
    ltm), position (their order).  What was not observed is missing.  Total debt falls back on its parts, derived metrics
    take the first status by precedence of their variables, growth compares a fiscal year with the one listed before it; the
    first one, and the last twelve months, have none.
    """
    names = _sources()
    pick = lambda n, c: F.max(F.when(F.col("metric_id") == n, F.col(c)))
    wide = observed.where(F.col("metric_id").isin(names)).groupBy("company_id", "period_id").agg(*(pick(n, "value").alias(n) for n in names), *(pick(n, "status").alias(f"{n}_status") for n in names))
    wide = periods.select("company_id", "period_id", "kind", "position").join(wide, ["company_id", "period_id"], "left")
    wide = wide.withColumns({f"{n}_status": F.coalesce(f"{n}_status", F.lit(C.MISSING)) for n in names})
    wide = wide.withColumns({n: F.when(F.col(f"{n}_status") == C.AVAILABLE, F.col(n)) for n in names})
    value, status = total_debt(F.col("total_debt"), F.col("total_debt_status"), *map(F.col, DEBT_PARTS))
    wide = wide.withColumns({"total_debt": value, "total_debt_status": status})
    for f in DERIVED:
        wide = derive(wide, f)
    # the fiscal years of a company are a short list; its last twelve months have no part in it
    w = Window.partitionBy("company_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("kind") == "fy", F.struct("revenue", "revenue_status")), ignorenulls=True).over(w)
    wide = wide.withColumn("before", before)
    both = F.when(F.col("revenue_status") != C.AVAILABLE, F.col("revenue_status")).otherwise(F.col("before.revenue_status"))
    status = F.when((F.col("kind") == "ltm") | F.col("before").isNull(), C.MISSING).when(both != C.AVAILABLE, both).when(F.col("before.revenue") == 0, C.NOT_MEANINGFUL).otherwise(C.AVAILABLE)
    why = F.when(F.col("kind") == "ltm", "comparable_prior_ltm_missing").when(F.col("before").isNull(), "comparable_prior_period_missing")
    wide = wide.withColumns({f"{GROWTH}_status": status, "why": why}).withColumn(GROWTH, F.when(status == C.AVAILABLE, (F.try_divide("revenue", "before.revenue") - 1) * 100))
    metrics = [*names, *DERIVED, GROWTH]
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric_id"), F.col(m).cast("double").alias("value"), F.col(f"{m}_status").alias("status"), (F.col("why") if m == GROWTH else F.lit(None).cast("string")).alias("issue")) for m in metrics)))
    return wide.select("company_id", "period_id", "position", "kind", rows.alias("r")).select("company_id", "period_id", "position", "kind", "r.*")


def series_statuses(observations: DataFrame) -> DataFrame:
    """(company_id, metric_id, status, n_available): available if any period is, else the first status by precedence."""
    status = F.when(F.bool_or(F.col("status") == C.AVAILABLE), C.AVAILABLE)
    for s in C.STATUS_PRIORITY:
        status = status.when(F.bool_or(F.col("status") == s), s)
    return observations.groupBy("company_id", "metric_id").agg(status.otherwise(C.MISSING).alias("status"), F.count_if(F.col("status") == C.AVAILABLE).alias("n_available"))


def dashboard_snapshots(observations: DataFrame, sources: DataFrame, primary: tuple[str, ...], catalog_version: str = "1", formula_version: str = "1") -> DataFrame:
    """(company_id, snapshot_id, status, issues): partial if a primary metric has no value in any period.

    sources: company_id, workbook_hash, job_id.  The id is that of company, workbook, job and versions.  issues names the
    primary metrics that lack, in order.
    """
    series = series_statuses(observations).where(F.col("metric_id").isin(list(primary)))
    lacks = series.where(F.col("status") != C.AVAILABLE).groupBy("company_id").agg(F.array_sort(F.collect_set("metric_id")).alias("issues"))
    identity = F.concat_ws(":", F.col("company_id").cast("string"), "workbook_hash", "job_id", F.lit(catalog_version), F.lit(formula_version))
    out = sources.join(lacks, "company_id", "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))
    return out.select("company_id", F.concat(F.lit("snapshot-"), F.substring(F.sha2(identity, 256), 1, 24)).alias("snapshot_id"), F.when(F.size("issues") > 0, "partial").otherwise("ready").alias("status"), "issues")


def evidence_registry(evidence: DataFrame, order: list[str]) -> DataFrame:
    """C11: evidence (company_id, metric_id, year, cell_id) with evidence_id: E and the place of its key among the distinct
    keys, in order; equal keys have one id."""
    parts = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))
    return dense_numbers(evidence.withColumn("_key", parts), "_key", "_number").withColumn("evidence_id", F.concat(F.lit("E"), F.col("_number").cast("string"))).drop("_key", "_number")


def comparison_snapshot(companies: DataFrame, league: DataFrame, exclusions: DataFrame, registry: DataFrame) -> DataFrame:
    """C11: one row for each company: its rank and tier or the reasons why it is left out, and the ids of its evidence in order.

    companies: company_id, source_snapshot_id; league: company_id, rank, tier ...; exclusions: company_id, reasons; registry:
    evidence with ids.
    """
    number = F.substring("evidence_id", 2, 20).cast("long")
    held = registry.select("company_id", number.alias("n")).distinct().groupBy("company_id").agg(F.array_sort(F.collect_list("n")).alias("n"))
    ids = held.select("company_id", F.transform("n", lambda n: F.concat(F.lit("E"), n.cast("string"))).alias("evidence"))
    out = companies.join(league, "company_id", "left").join(exclusions, "company_id", "left").join(ids, "company_id", "left")
    return out.withColumn("evidence", F.when(F.col("rank").isNotNull(), F.col("evidence")))


def comparison_id(companies: DataFrame, versions: tuple[str, str]) -> Column:
    """C11: the id of a comparison: the digest of its companies' snapshots in order, and of the versions."""
    return F.concat(F.lit("comparison-"), F.substring(F.sha2(F.concat_ws("|", F.array_join(F.array_sort(F.collect_list("source_snapshot_id")), "|"), *map(F.lit, versions)), 256), 1, 24))
