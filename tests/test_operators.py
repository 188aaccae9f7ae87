"""Facts about single operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from gridlake import constants as C
from gridlake.functions import formulas
from gridlake.functions import scalar as S
from gridlake.operators import cells, comparison, graph, metrics, retrieval
from gridlake.sources import snapshots


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("bad", ["f(x)", "a.b", "a[0]", "a ** b", "a // b", "a if b else c", "True", "", "a +"])
def test_formulas_reject(spark, bad):
    with pytest.raises(formulas.FormulaError):
        formulas.compiled(bad)


def test_formula_variables_and_values(spark):
    assert formulas.variables("net_debt / total_assets * 100") == ["net_debt", "total_assets"]
    df = spark.createDataFrame([(24.0, 120.0), (1.0, 0.0), (None, 5.0)], "free_cash_flow double, revenue double")
    rows = metrics.derive(df, "free_cash_flow_margin").collect()
    assert [(r["free_cash_flow_margin"], r["free_cash_flow_margin_status"]) for r in rows] == [(20.0, "available"), (None, "not_meaningful"), (None, "missing")]


def test_status_priority(spark):
    df = spark.createDataFrame([("a", "missing"), ("a", "ambiguous"), ("b", "available"), ("b", "not_meaningful"), ("c", "available")], "k string, status string")
    assert dict(metrics.dominant_status(df, ["k"]).collect()) == {"a": "ambiguous", "b": "not_meaningful", "c": "available"}


def test_total_debt(spark):
    df = spark.createDataFrame([(5.0, "available", 1.0, None), (None, "missing", 1.0, None), (None, "missing", None, None), (None, "ambiguous", 1.0, 2.0)], "d double, s string, a double, b double")
    v, s = metrics.total_debt(F.col("d"), F.col("s"), F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(v, s).collect()] == [(5.0, "available"), (1.0, "available"), (None, "missing"), (None, "ambiguous")]


def test_scores(spark):
    assert one(spark, S.growth_score(F.lit(10.0))) == 90.91
    assert one(spark, S.profitability_score(F.lit(-9.0))) == 0.0
    assert one(spark, S.stability_score(F.lit(40.0), F.lit(-1.0), F.lit(10.0))) == 82.5
    assert [one(spark, S.tier(F.lit(x))) for x in (90.0, 75.0, 50.0, 49.99)] == ["S", "A", "B", "C"]


@pytest.mark.parametrize("before,now,want", [(1.0, 3.0, "strong-improvement"), (1.0, 1.5, "improvement"), (1.0, 1.4, "stable"), (1.0, 0.5, "decline"), (3.0, 1.0, "strong-decline"), (None, 1.0, "baseline"), (1.0, None, "na")])
def test_trend(spark, before, now, want):
    assert one(spark, S.trend_class(F.lit(before).cast("double"), F.lit(now).cast("double"))) == want


def test_league_growth(spark):
    rows = [(c, 2022 + i, 100 * (1 + g) ** i, 100 * (1 + g) ** i * m) for c, g, m in (("alpha", 0.10, 0.20), ("beta", 0.04, 0.12)) for i in range(4)]
    series = spark.createDataFrame(rows, "company_id string, fiscal_year int, revenue double, operating_income double")
    position = spark.createDataFrame([("alpha", 40.0, 100.0, 0.0), ("beta", 40.0, 100.0, 0.0)], "company_id string, liabilities double, assets double, net_debt double")
    ranked = comparison.ranked(comparison.candidates(series, position))
    first = ranked.orderBy("rank").first()
    assert first["company_id"] == "alpha" and round(first["revenue_cagr"], 9) == 10.0 and (first["start_year"], first["end_year"]) == (2022, 2025)
    ahead = comparison.forecast(ranked).where("company_id = 'alpha'").orderBy("year").collect()
    assert [r["year"] for r in ahead] == [2026, 2027, 2028]


def test_histogram_keeps_empty_buckets(spark):
    df = spark.createDataFrame([(-5.0,), (4.9,), (30.0,), (None,)], "v double")
    assert [r["n"] for r in comparison.histogram(df, "v", C.CAGR_EDGES).orderBy("bucket").collect()] == [0, 2, 0, 0, 0, 0, 1]


def test_fusion(spark):
    sparse = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2)], "query_id int, cell string, rank int")
    dense = spark.createDataFrame([(1, "c1", 1), (1, "c3", 2)], "query_id int, cell string, rank int")
    rows = retrieval.fuse([(sparse, 1.0), (dense, 1.0)], ["cell"]).orderBy("rank").collect()
    assert [r["cell"] for r in rows] == ["c1", "c2", "c3"] and rows[0]["score"] == round(2 / 61, 10)
    assert retrieval.fuse([(sparse, 1.0), (dense, 0.0)], ["cell"]).count() == 2


def test_fusion_against_model(spark):
    rng = random.Random(3)
    branches = [[(q, f"c{rng.randrange(12)}", r + 1) for q in (1, 2) for r in range(8)] for _ in range(2)]
    scores = {}
    for rows in branches:
        best = {}
        for q, c, r in rows:
            best[q, c] = min(best.get((q, c), r), r)
        for k, r in best.items():
            scores[k] = scores.get(k, 0) + 1 / (60 + r)
    want = {}
    for (_, c), s in scores.items():
        want[c] = max(want.get(c, 0), round(s, 10))
    frames = [(spark.createDataFrame(rows, "query_id int, cell string, rank int"), 1.0) for rows in branches]
    assert {r["cell"]: r["score"] for r in retrieval.fuse(frames, ["cell"]).collect()} == want


def test_candidate_depth():
    assert [retrieval.candidate_depth(k) for k in (1, 10, 40, 2000)] == [100, 200, 800, 1000]


def test_header_variants(spark):
    got = [tuple(x) for x in one(spark, retrieval.header_variants(F.array(F.lit("Assets"), F.lit("Current Assets"), F.lit("Cash"))))]
    assert got[0] == ("Assets", "Current Assets", "Cash") and ("Cash",) in got and ("Current Assets", "Cash") in got and len(set(got)) == len(got)


def _evidence(spark, rows, kind="fy"):
    frame = spark.createDataFrame([(f"{c}", "co", "IS", c, int(c[1:]), ord(c[0]) - 64, [r], [p]) for c, r, p in rows], "cell_id string, company string, sheet string, coord string, row_index int, col_index int, row_tokens array<string>, column_tokens array<string>")
    wanted = spark.createDataFrame([("revenue", ["revenue", "totalrevenue"], ["costofrevenue"], ["fy2025"], kind)], "metric_id string, aliases array<string>, excluded array<string>, period_terms array<string>, kind string")
    return sorted(r["coord"] for r in retrieval.exact_evidence(frame, wanted).collect())


def test_evidence_keeps_best_alias_only(spark):
    assert _evidence(spark, [("O23", "totalrevenue", "fy2025"), ("O16", "asreportedtotalrevenue", "fy2025")]) == ["O23"]
    assert _evidence(spark, [("O23", "totalrevenue", "fy2025"), ("H33", "totalrevenue", "fy2025")]) == ["H33", "O23"]
    assert _evidence(spark, [("O16", "asreportedtotalrevenue", "fy2025")]) == ["O16"]
    assert _evidence(spark, [("O16", "costofrevenue", "fy2025")]) == []


def test_evidence_parts_fiscal_year_from_ltm(spark):
    rows = [("B5", "revenue", "fy2025"), ("C5", "revenue", "fy2025")]
    assert _evidence(spark, rows) == ["B5"] and _evidence(spark, rows, "ltm") == ["C5"]


def test_numbers(spark):
    assert one(spark, S.numbers_in(F.lit("1,234.5 and (17) or -3"))) == [1234.5, -17.0, -3.0]
    assert one(spark, S.number_matches(F.lit(100.4), F.lit(100.0))) and not one(spark, S.number_matches(F.lit(101.0), F.lit(100.0)))


def test_coordinates(spark):
    assert one(spark, S.column_of_coordinate(F.lit("AB12"))) == 28 and one(spark, S.row_of_coordinate(F.lit("AB12"))) == 12
    assert one(spark, S.column_letters(F.lit(28))) == "AB" and one(spark, S.column_letters(F.lit(26))) == "Z"
    assert one(spark, S.year_of_digits(F.lit("Q1 2024"))) == 1202 and one(spark, S.year_in_label(F.lit("Q1 2024"))) == 2024
    assert one(spark, S.normalize_token(F.lit("Net 매출 (A)"))) == "net매출a"


def test_quantized_search_agrees_with_exact(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(40)]) for i in range(90)], "id long, v array<float>")
    exact = retrieval.vector_search(rows.where("id < 3"), rows, 5).select("query_id", "doc_id", "rank")
    quantized = retrieval.vector_search(rows.where("id < 3"), rows, 5, quantized=True).select("query_id", "doc_id", "rank")
    assert sorted(exact.collect()) == sorted(quantized.collect())  # all 90 are candidates
    bits = rows.where("id < 2").groupBy().agg(F.collect_list(S.sign_bits(F.col("v"))).alias("b"), F.collect_list("v").alias("v"))
    r = bits.select(S.hamming(F.col("b")[0], F.col("b")[1]).alias("h"), "v").first()
    assert r["h"] == sum((x > 0) != (y > 0) for x, y in zip(*r["v"], strict=True))


def test_components_and_boxes(spark):
    df = spark.createDataFrame([("s", r, c) for r, c in [(1, 1), (1, 2), (2, 2), (5, 5), (5, 6)]], "sheet string, row int, col int")
    parts = cells.connected_cells(df)
    assert parts.select("component").distinct().count() == 2
    assert cells.merged_boxes(cells.bounds(parts), gap=2).count() == 1
    assert cells.merged_boxes(cells.bounds(parts), gap=0, min_cells=3).count() == 1


def test_stacked_tables(spark):
    df = spark.createDataFrame([("s", 1, 3, 1, 4, True), ("s", 5, 8, 1, 4, False), ("s", 9, 9, 1, 4, True), ("s", 1, 3, 6, 9, True)], "sheet string, min_row int, max_row int, min_col int, max_col int, has_header boolean")
    assert cells.stacked_tables(df).count() == 3


def test_majority_is_null_on_a_tie(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("b", "y")], "k string, v string")
    assert {r["k"]: r["majority"] for r in cells.unambiguous_majority(df, "k", "v").collect()} == {"a": None, "b": "x"}


def test_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (4, 5), (5, 4)], "source long, target long")
    levels = {r["node"]: r["level"] for r in graph.generations(nodes, edges).collect()}
    assert levels == {0: 0, 1: 1, 2: 1, 3: 2, 4: None, 5: None} and graph.has_cycle(nodes, edges)
    found = graph.descendants(nodes.where("node = 0"), edges, nodes.where("node = 2"))
    assert sorted(r["node"] for r in found.collect()) == [0, 1, 3]
    assert graph.problems(nodes.where("node > 0"), edges).collect()[0]["problem"] == "unknown_node"


def test_snapshots(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, snapshots.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert {r["k"]: r["operation"] for r in snapshots.audit(old, new, ["k"]).collect()} == {1: "delete", 2: "update", 3: "insert"}
