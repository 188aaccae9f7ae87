"""Each operator against a plain version of itself, over the same messy documents, and over an empty table."""

from __future__ import annotations

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import bpe, digest_index, epsilon_grid, kneser_ney, language_id, licenses, line_dedup, mixing, ngram_join, toxicity
from gridlake.llm.components import connected_components
from tests.llm import brute, messy
from tests.llm.brute import roots, words

@pytest.fixture(scope="module")
def docs(spark):
    return messy.frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return messy.frame(spark, [])


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots({x for p in links for x in p}, links)


@pytest.mark.parametrize("width,threshold,frequent,hot", [(4, (85, 100), 100, 64), (5, (4, 5), 1, 2), (2, (1, 2), 1, 2), (1, (1, 3), 1, 64)])
def test_ngram_join(docs, monkeypatch, width, threshold, frequent, hot):
    monkeypatch.setattr(ngram_join, "FREQUENT_DF", frequent)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK", 8 * hot)
    members, links = ngram_join.ngram_jaccard_join(docs, width, threshold)
    got = sorted((r["doc_id"], r["n_shingles"], r["n_links"], r["component_id"]) for r in members.collect())
    data = messy.rows()
    assert got == brute.near_groups(data, width, threshold)
    of_set = {r["set_id"]: r["component_id"] for r in members.collect() if r["set_id"] is not None}
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert all(of_set[a] == of_set[b] for a, b in pairs)
    root = roots(of_set, pairs)
    assert len(set(root.values())) == len({c for c in of_set.values()})  # the links join each component


def test_line_dedup(docs):
    out = {(r["doc_id"], r["text"], r["line_stats"]["n_removed"], r["line_stats"]["n_lines"]) for r in line_dedup.line_dedup(docs).collect()}
    want = brute.deduplicated_lines(messy.rows())
    assert any(n for _, _, n, _ in want) and out == want
    assert line_dedup.line_dedup(docs).columns == [*docs.columns, "line_stats"]


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["removed", "n_lines", "n_removed", "n_near", "near", "number", "line", "line_owner", "lines_removed", "rebuilt"]
    line = "one line of text that stands twice"
    rows = [(1, line, *range(len(names))), (2, f"x\n{line}", *range(len(names))), (None, line, *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = line_dedup.line_dedup(docs, stats="n_near").collect()
    assert {(r["doc_id"], r["text"]) for r in out} == {(1, line), (2, "x"), (None, line)}
    assert all(r[n] == k for r in out for k, n in enumerate(names) if n != "n_near") and {r["n_near"]["n_removed"] for r in out} == {0, 1}


def test_short_equal_lines_go_only_when_asked(spark):
    docs = spark.createDataFrame([(1, "two words\nmore"), (2, "two words\nmore")], "doc_id long, text string")
    assert {r["text"] for r in line_dedup.line_dedup(docs).collect()} == {"two words\nmore"}
    assert {r["text"] for r in line_dedup.line_dedup(docs, min_equal=2).collect()} == {"two words\nmore", "more"}


@pytest.mark.parametrize("a,b,want", [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a c", True), ("a c", "a b c", True), ("a b", "b a", False), ("a b c d", "a b", False), ("", "a", True), ("a a b", "a b", True)])
def test_one_edit(a, b, want):
    assert line_dedup.one_edit_apart(a.split(), b.split()) is want


def test_language_id(docs):
    model = language_id.train(docs)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    data = {r[0]: r for r in messy.rows()}
    assert all(0 <= s <= 1 for _, s in out.values()) and out.keys() == data.keys()
    for i, (lang, _) in out.items():
        letters = any(map(str.isalpha, data[i][1] or ""))
        assert (lang == "und") == (not letters)
    clear = [i for i, r in data.items() if r[2] and len(words(r[1])) > 5]
    assert sum(out[i][0] == data[i][2] for i in clear) >= 0.98 * len(clear)
    rows = language_id.identify(docs, model, with_row=True)
    assert rows.select("row.*").columns == docs.columns


def test_language_scores_by_brute_force(docs):
    out = {r["doc_id"]: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    want = brute.languages(messy.rows())
    assert len(out) == len(want)
    for i, (lang, p) in want.items():
        assert out[i]["score"] == pytest.approx(p, abs=1e-4), i
        assert out[i]["lang_pred"] == lang or 0.499 < p < 0.501


def test_language_backoff_learns_word_endings(spark):
    train = spark.createDataFrame([("machung richtung zeitung achtung", "de"), ("nation action station mention", "fr")] * 3, "text string, lang string")
    unseen = spark.createDataFrame([(1, "werkung endung"), (2, "fraction potion")], "doc_id long, text string")
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(unseen, language_id.train(train)).collect()}
    assert out == {1: "de", 2: "fr"}


def crossed(n=2400):
    """Texts that are toxic if exactly one of two words is there: neither tells anything alone."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        one, other = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, messy.sentence(rng, "en", 12) + " mocked" * one + " strangers" * other))
        labels.append((i, int(one != other)))
    return rows, labels


def test_toxicity_learns_pairs(spark):
    rows, marks = crossed()
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    machine = toxicity.train(docs.where(~held), labels.where(~held))
    alone = toxicity.Machine(machine.terms, machine.w0, machine.w, machine.v * 0)

    def order(m):
        """Share of pairs of a toxic and another text that the scores put in that order."""
        s = {r["doc_id"]: r["score"] for r in toxicity.score(docs.where(held), m).collect()}
        good, bad = [s[i] for i, t in marks if i in s and not t], [s[i] for i, t in marks if i in s and t]
        return sum(a < b for a in good for b in bad) / len(good) / len(bad)

    assert order(machine) > 0.95 and order(alone) < 0.65
    assert toxicity.train(docs.where(~held), labels.where(~held)).v.tolist() == machine.v.tolist()


def test_toxicity_scores_by_brute_force(spark):
    rows, marks = crossed(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame(marks, "doc_id int, toxic int"))
    place = {int(t): k for k, t in enumerate(m.terms)}
    for r in toxicity.score(docs.limit(80), m).collect():
        x = [place[t] for t in brute.terms(rows[r["doc_id"]][1]) if t in place]
        z = m.w0 + sum(m.w[k] for k in x) + sum(float(m.v[a] @ m.v[b]) for n, a in enumerate(x) for b in x[:n])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9) and r["predicted"] == (r["score"] >= 0.3)


def test_toxicity_on_messy(docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == len(messy.rows()) and all(0 <= r["score"] <= 1 for r in out)


@pytest.mark.parametrize("order,ranges", [(2, 700), (3, 1_000_000), (3, 700), (4, 700), (5, 700)])
def test_kneser_ney(docs, order, ranges, monkeypatch):
    monkeypatch.setattr(kneser_ney, "TOKENS_PER_RANGE", ranges)
    monkeypatch.setattr(kneser_ney, "ONE_HOP", 10 if order == 3 else 100_000)
    monkeypatch.setattr(kneser_ney, "_FLUSH", ranges)
    data = messy.rows()
    model = kneser_ney.train(docs.where("doc_id % 3 <> 0"), order=order)
    got = {r["doc_id"]: r for r in kneser_ney.score(docs, model).collect()}
    want = brute.kneser_ney([r[1] for r in data if r[0] % 3], [r[1] for r in data], order)
    for r, (n, known, total, base, score) in zip(data, want, strict=True):
        g = got[r[0]]
        assert (g["n_tokens"], g["n_known"], model.tokens) == (n, known, total)
        assert g["base_score"] == pytest.approx(base, rel=1e-9) and g["score"] == pytest.approx(score, rel=1e-9)


def test_kneser_ney_on_a_store_without_memory_maps(docs, monkeypatch):
    model = kneser_ney.train(docs.where("doc_id % 3 <> 0"))
    name = "gram-3-0000000"
    mapped = [a.tolist() for a in kneser_ney._arrays(model.folder, name)]
    monkeypatch.setattr(kneser_ney.fs, "LocalFileSystem", type(None))
    assert [a.tolist() for a in kneser_ney._arrays(model.folder, name)] == mapped
    monkeypatch.undo()
    model.delete(docs.sparkSession)


def test_licenses(spark, docs):
    rows = [(1, "Released under the MIT license, or the Apache  LICENSE. mit license"), (2, None), (3, "a summit licensed"), (4, "x\nLicensed under CC BY-NC 4.0!\ny"), (5, "Permission is granted, free of charge, to any person obtaining a copy of this software and its associated documentation files"), (6, "mit licensee")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out, matches = licenses.license_scan(frame)
    got = {r["doc_id"]: r for r in out.collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["score"]) == (3, 3, 9, "apache,mit", 1.0)
    assert (got[2]["n_words"], got[2]["labels"], got[2]["score"]) == (0, "", 0.0)
    assert got[3]["n_base"] == got[6]["n_base"] == 0 and got[3]["first_word"] is None
    assert got[4]["labels"] == "cc-by-nc" and got[4]["base_labels"] == "" and got[5]["labels"] == "mit"
    assert {(r["doc_id"], r["block"], r["width"], r["template"]) for r in matches.collect()} == brute.license_blocks(rows)
    assert licenses.license_scan(docs)[0].count() == len(messy.rows())


def test_wrapped_licenses(spark):
    rng = random.Random(5)
    rows = []
    for k, (_, text, *_) in enumerate(licenses.TEMPLATES):
        wrapped = "\n".join(f" * {x}" for x in textwrap.wrap(" ".join(text.split()), 40))
        rows.append((k, f"{messy.sentence(rng, 'en', rng.randrange(60))}\n{wrapped}\n{messy.sentence(rng, 'fr', 200)}"))
    rows.append((99, messy.sentence(rng, "en", 3000)))
    out, matches = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["labels"].split(",") for r in out.collect()}
    assert all(label in got[k] for k, (label, *_) in enumerate(licenses.TEMPLATES)) and got[99] == [""]
    assert {(r["doc_id"], r["block"], r["width"], r["template"]) for r in matches.collect()} == brute.license_blocks(rows)


#: Names of licenses that have no template, or that a template's notice differs from by its name only.
OTHER_NOTICES = [
    "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0", "Licensed under CC BY-NC-SA 4.0", "Released under the ISC License", "Licensed under the Eclipse License, Version 2.0",
    "Released under the BSD License", "The file was released in 2019 under the terms of a license", "This work is licensed under the Open Software License, version 3",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "This Source Code Form is subject to the terms of the Eclipse Public License, v. 2.0",
    "Licensed under the Educational Community License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://opensource.org/licenses/ECL-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
]


def test_no_label_for_another_license(spark):
    rows = list(enumerate(OTHER_NOTICES)) + [(100 + k, t[1]) for k, t in enumerate(licenses.TEMPLATES)] + [(500, "Released under the Apache License"), (501, "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License")]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert {t: got[k]["labels"] for k, t in enumerate(OTHER_NOTICES) if got[k]["labels"]} == {}
    for k, (label, *_) in enumerate(licenses.TEMPLATES):  # of all templates' notices each has its own label only
        assert got[100 + k]["labels"] == label
    assert got[500]["labels"] == got[500]["base_labels"] == "apache" and got[501]["labels"] == got[501]["base_labels"] == "gpl"


@pytest.mark.parametrize("cells,rounds", [(100_000, mixing.ROUNDS), (1, 5)])
def test_mixing(docs, cells, rounds, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", rounds)
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", cells)
    out = mixing.mix_sources(docs, keep=0.6, rounds=rounds).collect()
    data = messy.rows()
    assert len(out) == len(data) and all(0 <= r["probability"] <= 1 for r in out)
    want = brute.mixed([r["row"].asDict() | {"topic": r["topic"]} for r in out], 0.6)
    for r, (n, p, kept) in zip(out, want, strict=True):
        assert r["n_tokens"] == n and r["probability"] == pytest.approx(p, abs=1e-6) and r["kept"] == kept


def test_mixing_to_given_targets(spark):
    rows = [(i, "w " * 10, "en", "a" if i % 10 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = mixing.mix_sources(docs, keep=0.15, targets={"source": {"a": 0.5, "b": 0.5}}).where("kept").groupBy("row.source").count().collect()
    n = {r["source"]: r["count"] for r in kept}
    assert 15 <= n["a"] <= 48 and 18 <= n["b"] <= 40


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(epsilon_grid, "BLOCK", 16)
    monkeypatch.setattr(epsilon_grid, "LEAF", 4)
    rng = np.random.RandomState(0)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(150):
        v = (centres[i % 6] + rng.normal(size=12) * rng.choice([0.02, 0.12])).astype(np.float32)
        rows.append((i, v.tolist(), i % 2 if i % 11 else None))
    rows += [(200 + k, rows[1][1], 1) for k in range(5)] + [(300, None, 1), (301, [0.0] * 12, 1), (302, [float("nan")] * 12, 1), (303, [None] * 12, 1), (304, [], 1), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [float("inf")] + [0.0] * 11, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit(1)).withColumn("block", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in epsilon_grid.embedding_near_duplicates(df).collect()}

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or not a[1] or not b[1] or None in a[1] or None in b[1] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1], float), np.array(b[1], float)
        return bool(np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98)

    links = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and linked(a, b)]
    root, n = roots([r[0] for r in rows], links), Counter(x for p in links for x in p)
    assert len(links) > 50 and got == {r[0]: (n[r[0]], root[r[0]], root[r[0]] == r[0]) for r in rows}


def test_exact_dedup(docs):
    got = sorted(tuple(r) for r in digest_index.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    data = messy.rows()
    norm = {r[0]: re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in data}
    groups = defaultdict(list)
    for r in data:
        groups[norm[r[0]]].append(r[0])
    assert got == sorted((r[0], min(groups[norm[r[0]]]), len(groups[norm[r[0]]]), r[0] == min(groups[norm[r[0]]]), hashlib.sha256(norm[r[0]].encode()).hexdigest()) for r in data)


def test_digest_index_persists_and_repeats_nothing(spark):
    index = digest_index.DigestIndex(spark)
    first, second = (digest_index.digests(spark.createDataFrame(rows, "doc_id long, text string")) for rows in ([(5, "a"), (6, "b")], [(1, "a"), (7, "c"), (8, "c")]))
    index.ingest(first, "one")
    again = digest_index.DigestIndex(spark, index.path, index.buckets)
    again.ingest(second, "two")
    again.ingest(second, "two")
    assert sorted(r["keep_id"] for r in again.entries().collect()) == [5, 6, 7]


def test_digest_batch_that_died_halfway(spark):
    rows = digest_index.digests(spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")).cache()
    index = digest_index.DigestIndex(spark)
    part = rows.where("doc_id < 15").select("digest", F.col("doc_id").alias("keep_id"), F.lit("one").alias("batch"))
    part.write.mode("append").format("parquet").bucketBy(index.buckets, "digest").sortBy("digest").option("path", index.path).saveAsTable(index.table)
    index.ingest(rows, "one")  # again, after its append died
    assert sorted(r["keep_id"] for r in index.entries().collect()) == list(range(40)) and index.complete() == {"one"}


def test_bpe_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    data = [*messy.rows(), (900, "<|endoftext|>hi <|endoftext|>", None, None, 0, 0.0, "", True, 0), (902, "thequickbrownfox" * 2000 + "é" * 3000 + " " * 4000, None, None, 0, 0.0, "", True, 0), (901, "a\x1cb\x85c  d\n\n e'll I'LL 😀 café 　x", None, None, 0, 0.0, "", True, 0)]
    frame = messy.frame(docs.sparkSession, data)
    ids = bpe.encode(frame, path)
    got = {r["doc_id"]: list(r["ids"]) for r in ids.collect()}
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(ids, path).collect()}
    for r in data:
        want = library.encode(r[1] or "", add_special_tokens=False).ids
        assert got[r[0]] == want and back[r[0]] == library.decode(want, skip_special_tokens=False)
    both = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in bpe.round_trip(frame, path).collect()}
    assert both == {k: (got[k], back[k]) for k in got}


def test_empty_tables(empty, spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    members, links = ngram_join.ngram_jaccard_join(empty)
    for df in (
        members, links, line_dedup.line_dedup(empty), language_id.identify(empty, language_id.train(empty)), toxicity.score(empty, toxicity.train(empty, labels)),
        kneser_ney.score(empty, kneser_ney.train(empty)), *licenses.license_scan(empty), mixing.mix_sources(empty), epsilon_grid.embedding_near_duplicates(vectors),
        digest_index.exact_dedup(empty), bpe.decode(bpe.encode(empty, path), path), bpe.round_trip(empty, path),
    ):
        assert df.count() == 0


def test_nothing_learned(docs, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.train(empty)).collect()} == {"und"}
    assert toxicity.score(docs, toxicity.train(docs, labels)).where("score > 0.01").count() == 0
    assert kneser_ney.score(docs, kneser_ney.train(empty)).where("n_known > 0").count() == 0


def test_held_out_rule(spark):
    got = spark.range(50).select((F.crc32(F.col("id").cast("string")) % 4).alias("x")).collect()
    assert [r["x"] for r in got] == [zlib.crc32(str(i).encode()) % 4 for i in range(50)]
