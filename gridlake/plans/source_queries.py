"""Queries over workbooks that are written and read back, published versions, and stored collections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import cut, shared_dir
from ..sources import collections, publishing, workbooks
from .base import CELLS_SQL, cells, query, table


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_BOOK_SQL = f"""
    WITH {CELLS_SQL},
    rows AS (SELECT DISTINCT company, sheet, row_index, row_header FROM cells),
    book AS (
        SELECT company || '.xlsx' AS file_name, sheet, coord, round(value * 100)::BIGINT::VARCHAR AS value, NULL AS formula, 'number' AS value_type, row_index FROM cells
        UNION ALL SELECT company || '.xlsx', sheet, 'A' || row_index, row_header, NULL, 'text', row_index FROM rows
        UNION ALL SELECT company || '.xlsx', sheet, 'Z' || row_index, count(*)::VARCHAR, '=COUNT(B' || row_index || ':Y' || row_index || ')', 'number', row_index FROM cells GROUP BY company, sheet, row_index)
"""


def _books(spark, sf_dir) -> str:
    """The cell records as one workbook for each company: labels in column A, a counted total in Z; rows that end in 5 are
    hidden.  Returns the folder."""
    c = cells(spark, sf_dir).withColumn("file_name", F.concat("company", F.lit(".xlsx")))
    keys = [F.col("file_name"), F.col("sheet"), F.col("row_index").alias("row")]
    none = F.lit(None).cast("string")
    shown = F.col("row_index") % 10 != 5
    values = c.select(*keys, F.col("col_index").alias("col"), F.round(F.col("value") * 100).cast("long").cast("string").alias("value"), none.alias("formula"), F.lit("number").alias("value_type"), shown.alias("visible"))
    labels = c.select("file_name", "sheet", "row_index", "row_header").distinct()
    labels = labels.select(*keys, F.lit(1).alias("col"), F.col("row_header").alias("value"), none.alias("formula"), F.lit("text").alias("value_type"), shown.alias("visible"))
    line = F.col("row_index").cast("string")
    totals = c.groupBy("file_name", "sheet", "row_index").agg(F.count("*").cast("string").alias("value"))
    totals = totals.select(*keys, F.lit(26).alias("col"), "value", F.concat(F.lit("=COUNT(B"), line, F.lit(":Y"), line, F.lit(")")).alias("formula"), F.lit("number").alias("value_type"), shown.alias("visible"))
    folder = _folder(spark, "workbooks")
    workbooks.write_workbooks(values.unionByName(labels).unionByName(totals), folder)
    return folder


@query(f"{_BOOK_SQL} SELECT file_name, sheet, coord, value, formula, value_type, row_index % 10 <> 5 AS visible FROM book")
def workbook_cells(spark, sf_dir):
    """Every cell of the workbooks, with formula, type and visibility."""
    return workbooks.read_workbooks(spark, _books(spark, sf_dir)).select("file_name", "sheet", "coord", "value", "formula", "value_type", "visible")


@query(f"{_BOOK_SQL} SELECT file_name, sheet, coord, value FROM book WHERE row_index % 10 <> 5 AND sheet = 'A'")
def workbook_visible_cells(spark, sf_dir):
    """Cells to be seen, with a value, of the sheets of one name; no other sheet is read."""
    c = workbooks.read_workbooks(spark, _books(spark, sf_dir), sheet="A")
    return workbooks.populated(workbooks.visible(c)).select("file_name", "sheet", "coord", "value")


@query(f"{_BOOK_SQL} SELECT file_name, 64 AS digest_length, array_to_string(list_sort(list(DISTINCT sheet)), ',') AS sheets, count(*) AS n_cells, count(*) = max(count(*)) OVER () AND file_name = min(file_name) OVER (PARTITION BY count(*)) AS largest FROM book GROUP BY file_name")
def workbook_catalog(spark, sf_dir):
    """Workbooks with digest and sheets; the largest (of several the first by name) is found by name, then by digest."""
    catalog = cut(workbooks.workbook_catalog(workbooks.read_workbooks(spark, _books(spark, sf_dir))))
    name = catalog.orderBy(F.desc("n_cells"), "file_name").first()["file_name"]
    digest = workbooks.resolve(catalog, file_name=f" {name} ").first()["workbook_hash"]
    found = workbooks.resolve(catalog, workbook_hash=digest).first()["file_name"]
    return catalog.select("file_name", F.length("workbook_hash").alias("digest_length"), F.array_join("sheets", ",").alias("sheets"), "n_cells", (F.col("file_name") == found).alias("largest"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def published_version(spark, sf_dir):
    """Two versions are published one after the other; the second is the current one."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    folder = _folder(spark, "published")
    publishing.publish(s, folder, "1")
    publishing.publish(s.where("s_acctbal > 0"), folder, "2")
    return publishing.current(spark, folder)


@query("""
    SELECT '1' AS version, 100::BIGINT AS at, count(*) AS rows, false AS is_head FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT '2', 300, count(*), true FROM orders UNION ALL SELECT '3', 200, count(*), false FROM orders WHERE o_orderpriority = '2-HIGH'
""")
def published_late(spark, sf_dir):
    """A version that comes late is there but does not become the head; one published again stays as it was."""
    o, folder = table(spark, sf_dir, "orders"), _folder(spark, "published")
    publishing.publish(o.where("o_orderpriority = '1-URGENT'"), folder, "1", 100)
    publishing.publish(o, folder, "2", 300)
    publishing.publish(o.where("o_orderpriority = '2-HIGH'"), folder, "3", 200)
    publishing.publish(o.limit(1), folder, "1", 400)
    return publishing.versions(spark, folder)


def _stored(spark, sf_dir, *columns):
    folder = _folder(spark, "collections")
    rows = cells(spark, sf_dir).select(F.col("company").alias("collection"), "sheet", "coord", *columns)
    collections.store(rows, folder)
    return folder


@query(f"WITH {CELLS_SQL} SELECT company AS collection, sheet, coord, CASE WHEN company IN ('NATION_1', 'NATION_2') AND sheet = 'A' THEN 'new' ELSE row_header END AS row_header FROM cells UNION ALL SELECT DISTINCT 'NATION_X', sheet, 'A1', 'new' FROM cells")
def stored_upsert(spark, sf_dir):
    """Rows of two stored collections are replaced and a third collection is added; the others are not written."""
    c = cut(cells(spark, sf_dir).select(F.col("company").alias("collection"), "sheet", "coord", "row_header"))
    folder = _folder(spark, "collections")
    collections.store(c, folder)
    new = c.where("collection IN ('NATION_1', 'NATION_2') AND sheet = 'A'").select("collection", "sheet", "coord", F.lit("new").alias("row_header"))
    more = c.select(F.lit("NATION_X").alias("collection"), "sheet", F.lit("A1").alias("coord"), F.lit("new").alias("row_header")).distinct()
    collections.upsert(spark, folder, new.unionByName(more), ["sheet", "coord"])
    return collections.scan(spark, folder)


@query(f"WITH {CELLS_SQL} SELECT company AS collection, sheet, coord, CASE WHEN company = 'NATION_1' THEN 'Acme' ELSE company END AS named, CASE WHEN company = 'NATION_1' THEN replace(text, 'Company: NATION_1 |', 'Company: Acme |') ELSE text END AS text FROM cells WHERE company IN ('NATION_1', 'NATION_2')")
def stored_rename(spark, sf_dir):
    """One stored collection is rewritten under another company name; a scan of two collections."""
    meta = F.to_json(F.struct(F.col("company").alias("company_name"), F.col("coord").alias("cell_id"))).alias("meta")
    folder = _stored(spark, sf_dir, meta, "text")
    collections.rename_company(spark, folder, ["NATION_1"], "company_name", "Acme")
    return collections.scan(spark, folder, ["NATION_1", "NATION_2"]).select("collection", "sheet", "coord", F.get_json_object("meta", "$.company_name").alias("named"), "text")


@query(f"WITH {CELLS_SQL} SELECT 'cells' AS name, company AS collection, count(*) AS n FROM cells WHERE company NOT IN ('NATION_1', 'NATION_3') GROUP BY ALL UNION ALL SELECT 'documents', company, 2 * count(*) FROM cells WHERE company NOT IN ('NATION_1', 'NATION_3') GROUP BY ALL")
def stored_cascade(spark, sf_dir):
    """Two collections go from the table of cells and from that of their documents."""
    first, second = _stored(spark, sf_dir, "value"), _folder(spark, "collections")
    variants = collections.scan(spark, first).withColumn("variant", F.explode(F.array(F.lit("header_only"), F.lit("header_with_value"))))
    collections.store(variants, second)
    collections.delete(spark, [first, second], ["NATION_1", "NATION_3"])
    count = lambda name, folder: collections.scan(spark, folder).groupBy(F.lit(name).alias("name"), "collection").agg(F.count("*").alias("n"))
    return count("cells", first).unionByName(count("documents", second))


@query(f"""
    WITH {CELLS_SQL}, v AS (SELECT *, unnest(['header_only', 'header_with_value']) AS variant FROM cells WHERE company IN ('NATION_1', 'NATION_2')),
    p AS (SELECT *, (row_index % 10 = 1) OR (variant = 'header_only' AND row_index % 10 = 2) AS bad FROM v),
    k AS (SELECT company, sheet, coord, count(*) FILTER (WHERE NOT bad) AS kept FROM p GROUP BY ALL)
    SELECT company AS collection, n_before, n_removed, n_incomplete, n_before - n_removed AS n_left FROM (SELECT company, count(*) AS n_before, count(*) FILTER (WHERE bad) AS n_removed FROM p GROUP BY company)
    JOIN (SELECT company, count(*) FILTER (WHERE kept = 1) AS n_incomplete FROM k GROUP BY company) USING (company)
""")
def stored_compaction(spark, sf_dir):
    """Polluted documents of two stored collections are removed; the report, and what a scan finds afterwards."""
    folder = _folder(spark, "collections")
    variants = cells(spark, sf_dir).withColumn("variant", F.explode(F.array(F.lit("header_only"), F.lit("header_with_value"))))
    collections.store(variants.select(F.col("company").alias("collection"), F.concat_ws("!", "sheet", "coord").alias("cell_id"), "row_index", "variant"), folder)
    r = F.col("row_index") % 10
    names = ["NATION_1", "NATION_2"]
    report = collections.compact(spark, folder, names, (r == 1) | ((F.col("variant") == "header_only") & (r == 2)), "cell_id", "variant")
    left = collections.scan(spark, folder, names).groupBy("collection").agg(F.count("*").alias("n_left"))
    return report.join(left, "collection").select("collection", "n_before", "n_removed", "n_incomplete", "n_left")
