"""Tables that the queries start from, and the registry of queries and their SQL.

The given tables are order data, so the operators are shown by analogy: a company is a supplier, a fiscal year the year
of the order date, revenue the discounted price, cost a share of the list price, a cell the revenue of a company's brand in a
year on a sheet named after the return flag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(x):
    """Sums of decimals are the same in any order."""
    return F.sum(x.cast("decimal(18,4)")).cast("double")


def company_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_id, fiscal_year, revenue, cost, tax, operating_income, net_income."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = lines.groupBy(F.col("l_suppkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year")).agg(
        _money(net).alias("revenue"), _money(F.col("l_extendedprice") * 0.8).alias("cost"), _money(net * F.col("l_tax")).alias("tax")
    )
    income = F.col("revenue") - F.col("cost")
    return out.withColumns({"operating_income": income, "net_income": income - F.col("tax")})


YEARS_SQL = """
    years AS (
        SELECT *, revenue - cost AS operating_income, revenue - cost - tax AS net_income FROM (
            SELECT l_suppkey AS company_id, year(o_orderdate)::INT AS fiscal_year,
                   sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS revenue,
                   sum((l_extendedprice * 0.8::DOUBLE)::DECIMAL(18,4))::DOUBLE AS cost,
                   sum((l_extendedprice * (1 - l_discount) * l_tax)::DECIMAL(18,4))::DOUBLE AS tax
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL))
"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_id, liabilities, assets, net_debt: from the account balances of suppliers and their nations' customers."""
    owed = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(_money(F.when(F.col("c_acctbal") < 0, -F.col("c_acctbal")).otherwise(0.0)).alias("liabilities"), _money(F.col("c_acctbal")).alias("assets"))
    s = table(spark, sf_dir, "supplier").join(owed, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    return s.select(F.col("s_suppkey").alias("company_id"), "liabilities", "assets", F.col("s_acctbal").alias("net_debt"))


POSITIONS_SQL = """
    positions AS (
        SELECT s_suppkey AS company_id, liabilities, assets, s_acctbal AS net_debt FROM supplier LEFT JOIN (
            SELECT c_nationkey, sum((CASE WHEN c_acctbal < 0 THEN -c_acctbal ELSE 0 END)::DECIMAL(18,4))::DOUBLE AS liabilities,
                   sum(c_acctbal::DECIMAL(18,4))::DOUBLE AS assets FROM customer GROUP BY ALL) ON s_nationkey = c_nationkey)
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each cell: company, sheet, coordinate, headers, value, text."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    value = _money(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = lines.groupBy(F.col("n_name").alias("company"), F.col("l_returnflag").alias("sheet"), F.col("p_brand").alias("row_header"), F.year("o_orderdate").alias("year")).agg(value.alias("value"))
    row = F.regexp_replace("row_header", "[^0-9]", "").cast("int")
    col = F.col("year") - 1990
    coord = F.concat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), col, F.lit(1)), row.cast("string"))
    text = F.concat(F.lit("Company: "), "company", F.lit(" | Sheet: "), "sheet", F.lit(" | Row: "), "row_header", F.lit(" | Column: FY"), F.col("year").cast("string"))
    return out.select("company", "sheet", coord.alias("coord"), row.alias("row_index"), col.alias("col_index"), "row_header", F.concat(F.lit("FY"), F.col("year").cast("string")).alias("column_header"), "value", text.alias("text"))


CELLS_SQL = """
    cells AS (
        SELECT company, sheet, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', y - 1990, 1) || regexp_replace(row_header, '[^0-9]', '', 'g') AS coord,
               regexp_replace(row_header, '[^0-9]', '', 'g')::INT AS row_index, y - 1990 AS col_index, row_header, 'FY' || y AS column_header, value,
               'Company: ' || company || ' | Sheet: ' || sheet || ' | Row: ' || row_header || ' | Column: FY' || y AS text
        FROM (SELECT n_name AS company, l_returnflag AS sheet, p_brand AS row_header, year(o_orderdate)::INT AS y,
                     sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS value
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
                   JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL))
"""
