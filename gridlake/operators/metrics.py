"""Observations of metrics: grid, derived metrics, growth, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.formulas import derived
from ..session import short_list

_RANK = {s: k for k, s in enumerate(C.STATUS_PRIORITY)}


def observation_grid(observed: DataFrame, periods: DataFrame, entity: str = "company_id", period: str = "fiscal_year") -> DataFrame:
    """Every entity of observed in every period; where nothing was observed the status is missing.

    The grid has entities x periods rows by definition; periods that are a short list go to every task.
    """
    grid = observed.select(entity).distinct().crossJoin(short_list(periods.select(period).distinct()))
    full = grid.join(observed, [entity, period], "left")
    return full.withColumn("status", F.coalesce("status", F.lit(C.MISSING)) if "status" in observed.columns else F.when(F.col("value").isNotNull(), C.AVAILABLE).otherwise(C.MISSING))


def status_by_priority(*statuses: Column) -> Column:
    """A10: the first of invalid, ambiguous, missing, not meaningful that occurs, else available."""
    out = F.lit(C.AVAILABLE)
    for s in reversed(C.STATUS_PRIORITY):
        hit = F.lit(False)
        for x in statuses:
            hit = hit | (x == s)
        out = F.when(hit, s).otherwise(out)
    return out


def dominant_status(df: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """A10 over rows: the dominant status of each group."""
    rank = F.coalesce(*(F.when(F.col(status) == s, k) for s, k in _RANK.items()), F.lit(len(_RANK)))
    back = F.element_at(F.array(*map(F.lit, [*C.STATUS_PRIORITY, C.AVAILABLE])), F.col("r") + 1)
    return df.groupBy(*keys).agg(F.min(rank).alias("r")).select(*keys, back.alias("status"))


def derive(wide: DataFrame, formula_id: str) -> DataFrame:
    """value and status of a derived metric from columns of its variables and their *_status columns if any."""
    value, names = derived(formula_id)
    given = [F.col(f"{n}_status") if f"{n}_status" in wide.columns else F.when(F.col(n).isNull(), C.MISSING).otherwise(C.AVAILABLE) for n in names]
    blocked = status_by_priority(*given)
    status = F.when(blocked != C.AVAILABLE, blocked).when(value.isNull(), C.NOT_MEANINGFUL).otherwise(C.AVAILABLE)
    return wide.withColumns({f"{formula_id}_status": status, formula_id: F.when(status == C.AVAILABLE, value)})


def yoy_growth(series: DataFrame, entity: str = "company_id", period: str = "fiscal_year", value: str = "value") -> DataFrame:
    """Growth in percent on the previous listed period (not the previous year); the first has none."""
    w = Window.partitionBy(entity).orderBy(period)
    previous = F.lag(F.struct(F.col(value).alias("v"))).over(w)
    growth = (F.try_divide(F.col(value), F.col("previous.v")) - 1) * 100
    status = (
        F.when(F.col("previous").isNull() | F.col(value).isNull() | F.col("previous.v").isNull(), C.MISSING)
        .when(F.col("previous.v") == 0, C.NOT_MEANINGFUL)
        .otherwise(C.AVAILABLE)
    )
    return series.withColumn("previous", previous).withColumns({"growth": growth, "growth_status": status}).drop("previous")


def total_debt(direct: Column, direct_status: Column, *components: Column) -> tuple[Column, Column]:
    """(value, status): the direct value; if that is missing, the sum of the components present."""
    any_ = F.coalesce(*components).isNotNull()
    parts = sum((F.coalesce(c, F.lit(0.0)) for c in components[1:]), F.coalesce(components[0], F.lit(0.0)))
    value = F.when(direct_status == C.AVAILABLE, direct).when((direct_status == C.MISSING) & any_, parts)
    status = F.when(direct_status != C.MISSING, direct_status).when(any_, C.AVAILABLE).otherwise(C.MISSING)
    return value, status


def current_periods(series: DataFrame, as_of: Column, keep: int = 5, entity: str = "company_id", end: str = "end_date") -> DataFrame:
    """The last periods that end at or before as_of."""
    w = Window.partitionBy(entity).orderBy(F.desc(end))
    return series.where(F.col(end) <= as_of).withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= keep)


def fiscal_winner(periods: DataFrame, entity: str, year: str, order: list[Column]) -> DataFrame:
    """One period for each entity and year, the first in order."""
    w = Window.partitionBy(entity, year).orderBy(*order)
    return periods.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
