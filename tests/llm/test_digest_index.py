"""Several tables through the operator on one index."""

from __future__ import annotations

import pytest

from gridlake.llm import digest_index


def test_second_call_on_one_index(spark):
    index = digest_index.DigestIndex(spark)

    def run(rows, **kw):
        out = digest_index.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), index=index, **kw)
        return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out.collect())

    first = [(5, "a"), (6, "b"), (7, "a")]
    assert run(first) == [(5, 5, 2, True), (6, 6, 1, True), (7, 5, 2, False)]
    assert run([(1, "b"), (20, "c"), (30, "c"), (40, "d")]) == [(1, 6, 1, False), (20, 20, 2, True), (30, 20, 2, False), (40, 40, 1, True)]
    assert run(first) == [(5, 5, 2, True), (6, 6, 1, True), (7, 5, 2, False)]
    assert sorted(r["keep_id"] for r in index.entries().collect()) == [5, 6, 20, 40]
    assert run([(50, "e")], batch="x") == run([(50, "e")], batch="x") == [(50, 50, 1, True)]
    with pytest.raises(ValueError):
        run([(51, "f")], batch="x")


def test_lookup_keeps_unknown_texts(spark):
    index = digest_index.DigestIndex(spark)
    rows = digest_index.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert [(r["doc_id"], r["keep_id"]) for r in index.lookup(rows).collect()] == [(1, None)]
