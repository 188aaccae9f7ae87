"""The model against a plain version, its gradients against differences, and bad passages among good ones."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from gridlake.llm import quality
from tests.llm import messy


def bags_of(texts):
    data = [t.encode() for t in texts]
    return quality.encoded(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(d) for d in data])))


def made(seed, n):
    """Good texts, and bad ones of which one passage shouts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = messy.sentence(rng, "en", rng.randrange(20, 600)).split(" ")
        bad = rng.random() < 0.4
        if bad:
            at = rng.randrange(len(words))
            words[at : at + 40] = [w.upper() + "!!" for w in (words * 3)[at : at + 40]]
        rows.append((i, " ".join(words), int(not bad)))
    return rows


def model(seed=1):
    rows = made(seed, 60)
    docs = []
    for _, text, _ in rows:
        b = bags_of([text])
        docs.append((b.shape, b.terms, np.diff(b.words)))
    return quality._fit(docs, np.array([float(r[2]) for r in rows]))


def test_passages():
    texts = ["", " \n", " ".join(map(str, range(130))), "one", "x " * 64, "y " * 65]
    bags = bags_of(texts)
    assert np.diff(bags.first).tolist() == [1, 1, 3, 1, 1, 2]
    assert np.diff(bags.words).tolist() == [0, 0, 64, 64, 2, 1, 64, 64, 1]
    for k, t in enumerate(texts):  # a text is encoded alike beside others and alone
        alone = bags_of([t])
        assert np.allclose(alone.shape, bags.shape[bags.first[k] : bags.first[k + 1]])


def test_forward_is_the_plain_formula():
    m, text = model(), made(9, 1)[0][1]
    bags, w = bags_of([text]), m.weights
    hs, es = [], []
    for k in range(len(bags.shape)):
        x = np.clip((bags.shape[k] - m.mean) / m.spread, -6, 6)
        terms = bags.terms[bags.words[k] : bags.words[k + 1]]
        h = np.tanh(x @ w["W"] + sum(w["E"][t] for t in terms) / max(len(terms), 1) + w["b"])
        hs.append(h)
        es.append(sum(u * math.tanh(a) / (1 + math.exp(-b)) for u, a, b in zip(w["u"], h @ w["V"], h @ w["U"], strict=True)))
    a = [math.exp(e) / sum(map(math.exp, es)) for e in es]
    z = sum(ak * h for ak, h in zip(a, hs, strict=True))
    f = m.forward(bags)
    assert np.allclose(f["a"], a) and np.isclose(f["p"][0], 1 / (1 + math.exp(-(z @ w["c"] + w["d"][0]))))


def test_gradients():
    m, texts, y = model(), [r[1] for r in made(4, 5)] + [""], np.array([1.0, 0, 1, 0, 0, 1])
    bags, rng = bags_of(texts), np.random.RandomState(0)

    def loss():
        p = m.forward(bags)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in m.gradients(bags, y).items():
        at = tuple(rng.randint(s) for s in g.shape) if name != "E" else (int(bags.terms[3]), 2)
        w, eps = m.weights[name], 1e-5
        w[at] += eps
        up = loss()
        w[at] -= 2 * eps
        assert np.isclose((up - loss()) / (2 * eps), g[at], rtol=1e-3, atol=1e-7), name
        w[at] += eps


def test_learns_from_one_bad_passage(spark):
    rows = made(2, 500)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 4] + [(1, None), (None, 1), (99999, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(df, quality.train(df, labels)).collect()}
    held = [(got[i], q) for i, _, q in rows if i % 4 == 0]
    assert sum(r["predicted"] == q for r, q in held) / len(held) > 0.9
    assert all(math.isclose(sum(r["weights"]), 1) for r, _ in held)


@pytest.mark.parametrize("labels", [[], [(0, 1), (1, 1)], [(0, 0), (1, 1), (1, 0)]])
def test_odd_tables(spark, labels):
    docs = messy.frame(spark)
    m = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    out = quality.score(docs, m)
    assert out.count() == len(messy.rows()) and out.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").count() == 0
    assert quality.score(messy.frame(spark, []), m).count() == 0
