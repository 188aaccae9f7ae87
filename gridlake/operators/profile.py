"""What a workbook is about: its periods, currency, scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .cells import role_scores, unambiguous_majority

# Words that mark a row of periods, columns of the last twelve months, and columns of forecasts.
AXIS_WORDS = r"(?i)period\s*(?:ended|end|date)|fiscal\s*year|as\s+of|reporting\s+date|기간|결산일|기준일|iq_period_end"
LTM_WORDS = r"(?i)ltm|last twelve months"
FORECAST_WORDS = r"(?i)estimates?|forecasts?|projections?|fy\s*\+|ntm"
#: Rows above and below a period that mark its column as one of the last twelve months, and above it as a forecast.
LTM_ABOVE, LTM_BELOW, FORECAST_ABOVE = 10, 4, 6


def period_axes(cells: DataFrame, header_cells: DataFrame | None = None, key: str = "workbook") -> DataFrame:
    """(key, sheet, row, col, end_date, year, label, kind) of the periods that head columns.

    cells: key, sheet, row, col, value.  A row is an axis if it has two dates or more and a word for periods; a row that
    repeats one date without such a word has none.  Periods of other rows count only in header_cells.  Columns of
    forecasts are out; kind is ltm where a cell near by in the column says so, else fy.  Marks are listed under the rows
    that they reach and joined by row and column.
    """
    at = [key, "sheet"]
    found = cells.withColumn("p", S.period_of(F.col("value"))).where("p IS NOT NULL").select(*at, "row", "col", "p.*")
    rows = cells.groupBy(*at, "row").agg(F.bool_or(F.col("value").rlike(AXIS_WORDS)).alias("said"))
    count = found.groupBy(*at, "row").agg(F.count("*").alias("n"), F.count_distinct("end_date").alias("dates"))
    kept = found.join(rows, [*at, "row"]).join(count, [*at, "row"]).where("said OR NOT (n >= 2 AND dates = 1)")
    kept = kept.withColumn("axis", F.col("said") & (F.col("dates") >= 2))
    if header_cells is None:
        kept = kept.where("axis")
    else:
        kept = kept.join(header_cells.select(*at, "row", "col").distinct().withColumn("header", F.lit(True)), [*at, "row", "col"], "left").where("axis OR header")

    def near(words: str, above: int, below: int, name: str) -> DataFrame:
        marks = cells.where(F.col("value").rlike(words)).select(*at, "col", F.explode(F.sequence(F.col("row") - below, F.col("row") + above)).alias("row"))
        return marks.distinct().withColumn(name, F.lit(True))

    kept = kept.join(near(FORECAST_WORDS, FORECAST_ABOVE, 0, "forecast"), [*at, "row", "col"], "left_anti")
    kept = kept.join(near(LTM_WORDS, LTM_ABOVE, LTM_BELOW, "ltm"), [*at, "row", "col"], "left")
    return kept.select(*at, "row", "col", "end_date", "year", "label", F.when(F.col("ltm"), "ltm").otherwise("fy").alias("kind"))


def sheet_roles(cells: DataFrame, roles: dict[str, tuple[str, ...]], key: str = "workbook") -> DataFrame:
    """(key, sheet_roles): of each workbook its sheets in order, with role and confidence.

    A sheet's text is what its cells say, of which only the terms that occur are gathered.
    """
    said = cells.select(key, "sheet", F.lower("value").alias("value"))
    terms = sorted({t for words in roles.values() for t in words})
    found = said.groupBy(key, "sheet").agg(*(F.bool_or(F.col("value").contains(t)).alias(f"_{k}") for k, t in enumerate(terms)))
    text = F.concat_ws(" ", *(F.when(F.col(f"_{k}"), F.lit(t)) for k, t in enumerate(terms)))
    scored = role_scores(found.select(key, "sheet", text.alias("_text")), roles, "sheet", "_text")
    each = F.array_sort(F.collect_list(F.struct("sheet", "role", "confidence")))
    return scored.groupBy(key).agg(each.alias("sheet_roles"))


def workbook_profile(cells: DataFrame, key: str = "workbook", roles: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, currency, scale, fiscal_years, ltm_years, status, issues), with roles also sheet_roles.

    Currency and scale are those that most cells name, null on a tie; a profile without one of them is partial.
    """
    named = cells.select(key, S.first_pattern(F.col("value"), S.CURRENCIES).alias("currency"), S.first_pattern(F.col("value"), S.SCALES).alias("scale"))
    most = lambda c: unambiguous_majority(named, key, c).select(key, F.col("majority").alias(c))
    years = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("year"))))
    periods = period_axes(cells, key=key).groupBy(key).agg(years("fy").alias("fiscal_years"), years("ltm").alias("ltm_years"))
    out = cells.select(key).distinct().join(most("currency"), key, "left").join(most("scale"), key, "left").join(periods, key, "left")
    none = F.array().cast("array<int>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("fiscal_years", "ltm_years")})
    lacks = ((F.col("currency").isNull(), "currency_missing"), (F.col("scale").isNull(), "amount_scale_missing"), (F.size("fiscal_years") == 0, "periods_missing"))
    issues = F.array_compact(F.array(*(F.when(c, name) for c, name in lacks)))
    out = out.withColumn("issues", issues).withColumn("status", F.when(F.size("issues") > 0, "partial").otherwise("complete"))
    return out if roles is None else out.join(sheet_roles(cells, roles, key), key, "left")
