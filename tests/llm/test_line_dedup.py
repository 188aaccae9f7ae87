"""Near copies beside lines that only look like partners, and repeats without spaces."""

from __future__ import annotations

import random

import numpy as np

from gridlake.llm import line_dedup
from gridlake.llm.text import span_hashes


def removed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    return {r["doc_id"]: (r["line_stats"]["n_removed"], r["line_stats"]["n_near"]) for r in line_dedup.line_dedup(docs).collect()}


def test_false_partner_does_not_hide_a_true_one(spark):
    assert removed(spark, ["a b c d e f", "b c d e f h", "b c d e f g", "q b c d e f"]) == {1: (0, 0), 2: (0, 0), 3: (1, 1), 4: (1, 1)}


def test_far_partner_does_not_hide_a_near_one(spark):
    assert removed(spark, ["bravo alpha charlie delta echo foxtrot", "alpha bravo charlie delta echo golf", "alpha bravo charlie delta echo foxtrot"]) == {1: (0, 0), 2: (0, 0), 3: (1, 1)}


def test_near_copies_by_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(5, 9))) for _ in range(150)]
    first = {}
    for i, t in enumerate(texts, 1):
        first.setdefault(t, i)
    near = {t for t in first if any(first[u] < first[t] and line_dedup.one_edit_apart(u.split(), t.split()) for u in first)}
    want = {i: (int(t in near or first[t] != i), int(t in near)) for i, t in enumerate(texts, 1)}
    assert len(near) < len(first) and removed(spark, texts) == want


def test_repeats_without_spaces(spark):
    line = "版权所有未经许可不得转载本文仅代表作者个人观点"
    url = "https://example.org/a/rather/long/address/of/a/page/of/this/site.html"
    short = "短い行"
    assert removed(spark, [f"{line}\n{url}\n{short}", f"x\n{line}", f"{url}\n{short}", line + "。"]) == {1: (0, 0), 2: (1, 0), 3: (1, 0), 4: (0, 0)}


def thue_morse(n):
    return [bin(k).count("1") % 2 for k in range(n)]


def test_patterned_lines_and_words_are_told_apart(spark):
    """Sequences over two letters and their opposites: sums of powers modulo 2^64 cannot tell them apart from 1,024 on."""
    bits = thue_morse(2048)
    lines = [" ".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    assert removed(spark, lines) == {1: (0, 0), 2: (0, 0)}
    words = ["".join("ab"[b ^ flip] for b in bits[:n]) for n in (256, 512, 1024, 2048) for flip in (0, 1)]
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    assert len(set(span_hashes(raw, ends - [len(w) for w in words], ends).tolist())) == len(words)
    texts = [f"one two three four {w}" for w in words]
    assert removed(spark, texts) == {1: (0, 0)} | {k: (1, 1) for k in range(2, 9)}  # a word apart, not equal


def test_span_hashes_do_not_depend_on_place():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc\u00e9") for _ in range(n)).encode() for n in [*range(0, 40), 500, 511, 512, 513, 600]]
    seen = []
    for order in (words, words[::-1]):
        raw = np.frombuffer(b"".join(order), np.uint8)
        ends = np.cumsum([len(w) for w in order])
        seen.append(dict(zip(order, span_hashes(raw, ends - [len(w) for w in order], ends).tolist(), strict=True)))
    assert seen[0] == seen[1] and len(set(seen[0].values())) == len(seen[0])
