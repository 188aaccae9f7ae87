"""The whole pipeline against the plain versions of its stages, one after the other."""

from __future__ import annotations

import hashlib
import threading

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridlake.llm import mixing, storage
from tests.llm import brute, messy


def plain_run(data):
    names = [c.split(" ")[0] for c in messy.SCHEMA.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in data]
    langs = brute.languages(data)
    rows = [r for r in rows if any(map(str.isalpha, r["text"] or ""))]
    for r in rows:
        if r["lang"] is None and langs[r["doc_id"]][1] >= corpus_pipeline.SURE:
            r["lang"] = langs[r["doc_id"]][0]
    lines = {i: (text, n) for i, text, n, _ in brute.deduplicated_lines([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r | {"text": lines[r["doc_id"]][0]} for r in rows if not lines[r["doc_id"]][1] or lines[r["doc_id"]][0].strip(" \t\n\v\f\r")]
    groups = {i: c for i, _, _, c in brute.near_groups([(r["doc_id"], r["text"]) for r in rows], 5, (4, 5))}
    rows = [r for r in rows if groups[r["doc_id"]] == r["doc_id"]]
    chances = brute.mixed([r | {"topic": brute.topic(r["text"])} for r in rows], mixing.KEEP)
    rows = [r for r, (_, _, kept) in zip(rows, chances, strict=True) if kept]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    out = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        out.append((r["doc_id"], len(ids), ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


def test_run(spark, tmp_path):
    data = messy.rows()
    messy.frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_run(data)
    assert 10 < len(want) < len(data)
    assert sorted((r["doc_id"], r["n_tokens"], list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_a_predicted_language_changes_the_mixture(spark):
    """Rows without a language would be a cell of their own; with the predicted one they share that of the rest."""
    data = [(*r[:2], None if i % 3 == 0 else r[2], *r[3:]) for i, r in enumerate(messy.rows())]
    docs = messy.frame(spark, data)
    named = corpus_pipeline.STAGES[0][1](spark, docs, "")
    langs = brute.languages(data)
    filled = {r["doc_id"]: r["lang"] for r in named.collect()}
    for i, _, lang, *_ in data:
        if i in filled:
            assert filled[i] == (lang or (langs[i][0] if langs[i][1] >= corpus_pipeline.SURE else None))
    chances = [{r["doc_id"]: round(r["probability"], 6) for r in mixing.mix_sources(df).select("row.doc_id", "probability").collect()} for df in (named, docs.join(named.select("doc_id"), "doc_id", "left_semi"))]
    assert chances[0].keys() == chances[1].keys() and chances[0] != chances[1]


def test_the_last_stage_bears_odd_rows(spark):
    stage = corpus_pipeline.STAGES[4][1]
    schema = "doc_id long, text string, ids int, decoded string, n_tokens string"
    assert stage(spark, spark.createDataFrame([], schema), "").count() == 0
    rows = [(1, None, 1, "x", "y"), (2, "", 1, "x", "y"), (None, "some words", 1, "x", "y"), (2, "", 1, "x", "y"), (3, "a " * 5000, 1, "x", "y")]
    out = stage(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted((r["doc_id"] or 0, r["decoded_sha256"]) for r in out) == sorted((i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)


def test_a_run_deletes_its_own_tables_only(spark):
    other = storage.written(spark.range(3), "other")
    with storage.run(spark) as keep:
        gone = storage.written(spark.range(4), "gone")
        kept = keep(storage.written(spark.range(5), "kept"))
        held = []
        thread = threading.Thread(target=lambda: held.append(storage.written(spark.range(6), "of-another-thread")))
        thread.start()
        thread.join()
    assert [other.count(), kept.count(), held[0].count()] == [3, 5, 6]
    with pytest.raises(Exception, match="gone"):
        gone.count()


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_bear_an_empty_table(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    clash = {"row": "string", "topic": "string", "found": "int", "kept": "boolean", "line_stats": "int", "n_removed": "int", "keep_id": "long", "share": "double"}
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} {t}" for n, t in clash.items())
    assert stage(spark, spark.createDataFrame([], schema), "").count() == 0
    rest = ("r", "t", 1, True, 2, 3, 4, 0.5)
    texts = ["some words of the first document stand here in a line", None, "", "x " * 3000, None]
    docs = spark.createDataFrame([(None if i == 4 else i, t, None if i == 2 else "en", None, 7, *rest) for i, t in enumerate(texts)], schema)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns and all(tuple(r)[5:] == rest for r in out.collect())
