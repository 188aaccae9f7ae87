"""Assembled snapshots, listings and roles on stated facts."""

from __future__ import annotations

from gridlake.operators import catalog, dashboards, indexes, profile


def test_dashboard_of_one_company(spark):
    observed = [("c", "fy-1", "revenue", 100.0, "available"), ("c", "fy-2", "revenue", 150.0, "available"), ("c", "fy-3", "revenue", None, "ambiguous"), ("c", "ltm", "revenue", 160.0, "available"), ("c", "fy-4", "revenue", 0.0, "available"),
                ("c", "fy-1", "short_term_debt", 5.0, "available"), ("c", "fy-1", "long_term_debt", 7.0, "available"), ("c", "fy-2", "total_debt", None, "invalid"), ("c", "fy-2", "long_term_debt", 7.0, "available"),
                ("c", "fy-1", "cash_and_short_term_investments", 2.0, "available"), ("c", "fy-1", "total_assets", 40.0, "available"), ("c", "fy-1", "operating_income", 10.0, "available"), ("c", "fy-4", "operating_income", 1.0, "available")]
    periods = [("c", "fy-1", "fy", 1), ("c", "fy-2", "fy", 2), ("c", "fy-3", "fy", 3), ("c", "fy-4", "fy", 4), ("c", "ltm", "ltm", 5), ("d", "fy-1", "fy", 1)]
    o = dashboards.dashboard_observations(
        spark.createDataFrame(observed, "company_id string, period_id string, metric_id string, value double, status string"), spark.createDataFrame(periods, "company_id string, period_id string, kind string, position int")
    )
    got = {(r["company_id"], r["period_id"], r["metric_id"]): (r["value"], r["status"]) for r in o.collect()}
    assert got["c", "fy-1", "total_debt"] == (12.0, "available") and got["c", "fy-2", "total_debt"] == (None, "invalid") and got["d", "fy-1", "total_debt"] == (None, "missing")
    assert got["c", "fy-1", "net_debt"] == (10.0, "available") and got["c", "fy-1", "net_debt_ratio"] == (25.0, "available") and got["c", "fy-2", "net_debt_ratio"][1] == "invalid"
    assert got["c", "fy-1", "operating_margin"] == (10.0, "available") and got["c", "fy-4", "operating_margin"] == (None, "not_meaningful") and got["c", "fy-3", "operating_margin"][1] == "ambiguous"
    growth = {p: got["c", p, "revenue_yoy_growth"] for p in ("fy-1", "fy-2", "fy-3", "fy-4", "ltm")}
    assert growth == {"fy-1": (None, "missing"), "fy-2": (50.0, "available"), "fy-3": (None, "ambiguous"), "fy-4": (None, "ambiguous"), "ltm": (None, "missing")}
    issues = {(r["period_id"], r["issue"]) for r in o.where("company_id = 'c' AND issue IS NOT NULL").collect()}
    assert issues == {("fy-1", "comparable_prior_period_missing"), ("ltm", "comparable_prior_ltm_missing")}
    series = {(r["company_id"], r["metric_id"]): r["status"] for r in dashboards.series_statuses(o).collect()}
    assert series["c", "total_debt"] == "available" and series["c", "total_liabilities"] == "missing" and series["d", "revenue"] == "missing"
    sources = spark.createDataFrame([("c", "w", "j"), ("d", "w", "j")], "company_id string, workbook_hash string, job_id string")
    snapshots = {r["company_id"]: (r["status"], r["issues"]) for r in dashboards.dashboard_snapshots(o, sources, ("revenue", "operating_margin")).collect()}
    assert snapshots == {"c": ("ready", []), "d": ("partial", ["operating_margin", "revenue"])}


def test_listings(spark):
    collections = spark.createDataFrame([("a", '{"document_count":"12"}', "f1"), ("b", '{"document_count":"x"}', "f2"), ("c", None, None), ("d", '{"document_count":7}', "f3")], "name string, meta string, file_id string")
    rows = spark.createDataFrame([("b", f"{k:02}", "t") for k in range(20)] + [("a", "1", "t")], "collection string, id string, text string")
    sheets = spark.createDataFrame([("f2", 2, "Z", True, ["t3"]), ("f2", 1, "Y", False, ["t1", "t2"]), ("f2", 3, "X", True, None)], "file_id string, sheet_index int, sheet_name string, visible boolean, tables array<string>")
    assert {r["name"]: r["chunk_count"] for r in indexes.listing(collections, rows).collect()} == {"a": 12, "b": 20, "c": 0, "d": 7}
    assert {r["name"]: r["sheets"] for r in indexes.scopes(collections, sheets).collect()} == {"a": [], "b": ["Z", "X"], "c": [], "d": []}
    b = {r["name"]: r for r in indexes.details(collections, rows, sheets, 3).collect()}["b"]
    assert (b["document_count"], [s["id"] for s in b["sample"]], b["sheets"], b["tables"]) == (20, ["00", "01", "02"], ["Y", "Z", "X"], ["t1", "t2", "t3"])


def test_evidence_ids(spark):
    rows = spark.createDataFrame([("b", "m", 1, "x"), ("a", "m", None, "x"), ("b", "m", 1, "x"), ("b", "m", 2, "x")], "company_id string, metric_id string, year int, cell_id string")
    got = sorted((r["company_id"], r["year"] or 0, r["evidence_id"]) for r in dashboards.evidence_registry(rows, rows.columns).collect())
    assert got == [("a", 0, "E1"), ("b", 1, "E2"), ("b", 1, "E2"), ("b", 2, "E3")]


def test_fingerprints_are_streamed(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(50)] + [(None, 1)], "k int, v int").repartition(7)
    got = {r["k"]: r["fingerprint"] for r in catalog.fingerprint(rows, "k", rows["v"]).collect()}
    assert len(got) == 4 and got == {r["k"]: r["fingerprint"] for r in catalog.fingerprint(rows.repartition(2), "k", rows["v"]).collect()}
    assert catalog.fingerprint(rows.limit(0), "k", rows["v"]).count() == 0


def test_sheet_roles(spark):
    cells = spark.createDataFrame([("w", "Income Statement", 1, 1, "x"), ("w", "Page 2", 1, 1, "Total assets"), ("w", "Notes", 1, 1, "y")], "workbook string, sheet string, row int, col int, value string")
    roles = {"income": ("income",), "balance": ("assets", "liabilities")}
    got = {r["sheet"]: (r["role"], round(r["confidence"], 2)) for r in profile.sheet_roles(cells, roles).first()["sheet_roles"]}
    assert got == {"Income Statement": ("income", 0.95), "Page 2": ("balance", 0.65), "Notes": ("unknown", 0.55)}
