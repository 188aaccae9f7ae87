"""Collocations against plain counting, in one hop and in several, with and without unlisted words."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridlake.llm import collocations
from gridlake.llm.collocations import BITS, Trie
from tests.llm import messy


def plain(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        longer = defaultdict(int)
        for p, a in c.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        for p, a in c.items():
            if len(p) < 2 or a < least or (len(p) == 2 and 100 * longer[p] >= 50 * a and longer[p]):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts():
    rng = random.Random(5)
    words = "New York city of new The and é日 x y z".split()
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", None, ""])) for _ in range(80)]
    rows += [("hot pair " * 500, "en"), ("a a a a a a a a a a a a a", "en"), (None, "en"), ("", None), (" \t\n.,", "de"), ("w" * 5000, "de")]
    return rows + rows[:3] + [(r[1], r[2]) for r in messy.rows()]


@pytest.mark.parametrize("least,top,ranges,fan,listed,flush", [(10, 2000, 2_000_000, 512, 1 << 20, 2_000_000), (3, 2000, 40, 4, 1 << 20, 50), (2, 20, 300, 3, 1 << 20, 400), (2, 2000, 200, 512, 12, 100), (3, 2000, 100, 3, 0, 200)])
def test_collocations(spark, monkeypatch, least, top, ranges, fan, listed, flush):
    for name, value in (("TOKENS_PER_RANGE", ranges), ("FAN", fan), ("LISTED", listed), ("FLUSH", flush), ("_MERGE", 64 if fan < 10 else 1 << 24)):
        monkeypatch.setattr(collocations, name, value)
    rows = texts()
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "text string, lang string, n int, phrase string, w int").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(df, least, top).collect())
    assert got == plain(rows, least, top)
    assert len(got) > 40
    assert collocations.collocations(df.limit(0), least, top).count() == 0


def test_products_beyond_64_bits(spark):
    big = spark.range(1).selectExpr("4000000000 AS a", "5000000000 AS l", "6000000000 AS r")
    assert big.select(collocations._score(*(big[c] for c in "alr")).alias("s")).first()["s"] == 1000000 * 4000000000**2 // (5000000000 * 6000000000)


def test_trie_round_trip():
    rng = np.random.RandomState(3)
    path = rng.randint(1, 30, (3, 4000)).astype(np.int64)
    pairs = path[0] << BITS | path[1]
    halves = [Trie.of(pairs[s], pairs[s] << BITS | path[2][s]) for s in (slice(0, 1500), slice(1500, None))]
    whole = Trie.of(pairs, pairs << BITS | path[2])
    pieces = [piece for t in halves for _, piece in t.cut(t.pairs >> BITS)]
    rng.shuffle(pieces)
    merged = Trie.merged(pieces)
    for name in ("pairs", "count", "kids", "last", "last_count", "triples"):
        assert (getattr(merged, name) == getattr(whole, name)).all(), name
