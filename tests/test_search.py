"""Cover density and nearest rows against plain versions, and what a search reads."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators import keyword, nearest, retrieval


def plain_density(text: str, query: set[str]) -> float | None:
    """By trying every stretch."""
    words = re.findall("[a-z0-9]+", text.lower())
    places = [k for k, w in enumerate(words) if w in query]
    holds = [(a, b) for a in places for b in places if a <= b and query <= set(words[a : b + 1])]
    if not holds:
        return None
    least = [(a, b) for a, b in holds if not any((c, d) != (a, b) and a <= c and d <= b for c, d in holds)]
    return sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for p in places) - 1)) for a, b in least)


def test_cover_density(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randrange(1, 25)))) for i in range(80)] + [(900, None), (901, ""), (902, "!!"), (903, "A-b, C"), (904, "a b c")]
    queries = [(1, ["a", "b"]), (2, ["c", "c", None]), (3, ["a", "b", "c", "d"]), (4, []), (5, ["a", "nowhere"]), (6, ["f"])]
    want = {}
    for q, words in queries:
        asked = {w for w in words if w}
        found = [(-round(plain_density(t or "", asked) or 0, 9), i) for i, t in texts if asked and plain_density(t or "", asked) is not None]
        want |= {(q, i): (n, -s) for n, (s, i) in enumerate(sorted(found)[:30], 1)}
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    stored = keyword.postings(docs)
    asked = spark.createDataFrame(queries, "query_id int, words array<string>")
    for listed, once in ((1000, False), (2, False), (1000, True), (2, True)):  # with and without a list of words, stored and not
        monkeypatch.setattr(keyword, "LISTED", listed)
        found = keyword.match_all(keyword.occurrences(docs, asked) if once else stored, asked, 30)
        got = {(r["query_id"], r["doc_id"]): (r["rank"], r["score"]) for r in found.collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in got)
    keyword.drop_postings(stored)
    nothing = asked.where("query_id = 4")
    assert keyword.match_all(keyword.occurrences(docs, nothing), nothing, 30).count() == 0
    assert keyword.match_all(keyword.occurrences(docs.limit(0), asked), asked, 30).count() == 0


def test_postings_of_asked_words_are_those_stored(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 11}" for k in range(i))) for i in range(40)] + [(99, None), (98, " . ")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, ["w3", "w5"]), (2, ["w5", "w0", None])], "query_id int, words array<string>")
    stored = keyword.postings(docs, buckets=4, shares=1)
    want = sorted(map(tuple, stored.where("word IN ('w0', 'w3', 'w5')").collect()))
    assert want and sorted(map(tuple, keyword.occurrences(docs, asked).collect())) == want
    plan = keyword.match_all(keyword.occurrences(docs, asked), asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BuildRight" in plan
    keyword.drop_postings(stored)


def test_a_search_reads_the_buckets_of_its_words(spark):
    docs = spark.createDataFrame([(i, f"common word{i} word{i % 7}") for i in range(300)], "doc_id long, text string")
    stored = keyword.postings(docs, buckets=16, shares=2)
    plan = keyword.match_all(stored, spark.createDataFrame([(1, ["common", "word3"])], "query_id int, words array<string>"), 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SelectedBucketsCount: [12] out of 16", plan), plan
    assert len(stored.inputFiles()) <= 16 * 2 and stored.where("word = 'common'").count() == 300


def test_layout_grows_with_the_table(spark):
    assert keyword.layout(0) == keyword.layout(1 << 20) == (8, 2)
    assert keyword.layout(100 << 30) == (40, 40)
    assert keyword.layout(40 << 40) == (810, 810)
    assert keyword.layout(1 << 63) == (64, 4)
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "doc_id long, text string")
    stored = keyword.postings(docs, buckets=3, shares=2)
    assert len(stored.inputFiles()) == 6 and stored.count() == 100
    keyword.drop_postings(stored)


def test_words_of_any_script(spark):
    row = spark.range(1).select(keyword.words(F.lit("Été, 日本 x_1 ２ ß-Test")).alias("w")).first()
    assert row["w"] == ["été", "日本", "x", "1", "２", "ß", "test"]


@pytest.mark.parametrize("dims,width,start,depth", [(64, 8, 0, 5), (100, 8, None, 20), (128, 16, 1, 3), (24, 8, 2, 400), (10, 8, None, 7)])
def test_hamming_nearest(spark, dims, width, start, depth):
    rng = np.random.RandomState(dims)
    base = rng.rand(12, dims) < 0.5
    bits = base[rng.randint(12, size=220)] ^ (rng.rand(220, dims) < rng.choice([0.02, 0.2], (220, 1)))
    bits[5] = bits[6] = bits[7]
    padded = np.zeros((220, -(-dims // 64) * 64), bool)
    padded[:, :dims] = bits
    packed = np.packbits(padded, axis=1, bitorder="little").view("<i8")
    rows = spark.createDataFrame([(3 * i, [int(x) for x in packed[i]]) for i in range(220)], "id long, bits array<long>")
    got = {}
    for r in nearest.hamming_nearest(rows.where("id < 60"), rows, depth, dims, width, start).collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["doc_id"]))
    far = (bits[:, None, :] ^ bits[None, :, :]).sum(2)
    want = {3 * i: sorted((int(far[i, j]), 3 * j) for j in range(220))[:depth] for i in range(20)}
    assert {q: sorted(x) for q, x in got.items()} == want


def test_search_without_rows(spark):
    none = spark.createDataFrame([], "id long, v array<float>")
    some = spark.createDataFrame([(1, [1.0, -1.0]), (2, None)], "id long, v array<float>")
    assert retrieval.vector_search(some, none, 3, quantized=True).count() == 0
    assert retrieval.vector_search(none, some, 3, quantized=True).count() == 0
    assert [(r["query_id"], r["doc_id"]) for r in retrieval.vector_search(some, some, 3, quantized=True).collect()] == [(1, 1)]


def test_evidence_that_ties_stays_together(spark):
    """More cells of the second alias come first by place; those of the best alias are kept, up to the limit."""
    rows = [(f"B{k:03}", 2, "other revenue") for k in range(50)] + [(f"Z{k}", 1, "revenue") for k in range(4)]
    cells = spark.createDataFrame([(c, "co", "s", c, k, 1, [t.replace(" ", "")], ["fy2020"]) for k, (c, _, t) in enumerate(rows)], "cell_id string, company string, sheet string, coord string, row_index int, col_index int, row_tokens array<string>, column_tokens array<string>")
    wanted = spark.createDataFrame([("m", ["revenue", "otherrevenue"], [], ["fy2020"], "fy")], "metric_id string, aliases array<string>, excluded array<string>, period_terms array<string>, kind string")
    assert [r["coord"] for r in retrieval.exact_evidence(cells, wanted, 3).orderBy("coord").collect()] == ["Z0", "Z1", "Z2"]
    assert retrieval.exact_evidence(cells, wanted).count() == 4
