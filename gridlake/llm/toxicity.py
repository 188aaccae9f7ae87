"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w over the text's terms + sum over pairs of terms of <v_i, v_j>).  The pairs let the model
learn that an insult beside the mention of a group weighs more than either alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LETTERS, LOWER, U, mix, span_hashes, string_chunks, word_spans

#: Terms are hashed to so many bits; terms of fewer sample texts than MIN_DF have no weight.
TERM_BITS, MIN_DF = 24, 3
#: Terms are the words, and the first bytes of longer words: inflected forms of an insult share them.
STEM = 5
#: The model is fitted on about this many labelled texts at most, picked by a hash of their doc_ids.
SAMPLE_DOCS = 12_000
#: Single weights are fitted alone for WARM epochs, then with the factors for EPOCHS epochs or STEPS batches at least: what
#: terms tell one by one is not left to pairs.  LASSO pulls weights of terms that tell nothing to zero, DECAY factors.
FACTORS, BATCH, WARM, EPOCHS, STEPS = 4, 128, 4, 2, 800
RATE, FACTOR_RATE, LASSO, DECAY = 0.2, 0.02, 5e-4, 1e-2
#: How much more a toxic text counts than another: the threshold lies below one half, so misses are the dearer error.
TOXIC_WEIGHT = 2.0
THRESHOLD = 0.3


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct terms of each text, in order of texts, and each one's text."""
    starts, ends, first = word_spans(data, off, LETTERS)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    low = LOWER[data]
    words = span_hashes(low, starts, ends)
    longer = np.flatnonzero(ends - starts > STEM)
    stems = mix(span_hashes(low, starts[longer], starts[longer] + STEM))
    text, terms = np.concatenate([text, text[longer]]), np.concatenate([words, stems])
    both = np.unique((text << TERM_BITS) | (terms >> U(64 - TERM_BITS)).astype(np.int64))
    return both & ((1 << TERM_BITS) - 1), both >> TERM_BITS


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in string_chunks(batch, "text"):
            terms, text = _terms(data, off)
            edge = np.searchsorted(text, np.arange(b - a + 1))
            lists = [terms[x:y].astype(np.int32).tobytes() for x, y in zip(edge, edge[1:], strict=False)]
            yield pa.record_batch([batch.column(1).slice(a, b - a), pa.array(lists, pa.binary())], names=["toxic", "terms"])


@dataclass
class Machine:
    """Terms (sorted), and the weights: one bias, one number and FACTORS factors for each term."""

    terms: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, index: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts that hold the terms index (places in terms), each of them the text of that number."""
        out = self.w0 + np.bincount(text, weights=self.w[index], minlength=n)
        for f in range(self.v.shape[1]):
            x = self.v[index, f]
            s = np.bincount(text, weights=x, minlength=n)
            out += (s * s - np.bincount(text, weights=x * x, minlength=n)) / 2
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


class _Batch:
    """The terms of a few texts, and the order that brings equal terms together."""

    def __init__(self, lists: list[np.ndarray], labels: np.ndarray):
        size = np.array([len(x) for x in lists])
        self.index = np.concatenate(lists)
        self.labels = labels
        self.begin = np.cumsum(size) - size
        self.text = np.repeat(np.arange(len(lists)), size)
        self.order = np.argsort(self.index, kind="stable")
        ordered = self.index[self.order]
        self.first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        self.terms = ordered[self.first]

    def by_text(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.begin)

    def by_term(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.order], self.first)


def _fit(lists: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Machine:
    """Mini-batch AdaGrad on the logistic loss; no term is left out for what it tells alone."""
    flat = np.concatenate([np.zeros(0, np.int32), *lists])
    terms, df = np.unique(flat, return_counts=True)
    terms = terms[df >= MIN_DF]
    m = len(terms)
    rate = float(labels.mean()) if len(labels) else 0.0
    w0 = float(np.log((rate + 1e-4) / (1 - rate + 1e-4)))
    held = []
    for x in lists if m else []:
        at = np.minimum(np.searchsorted(terms, x), m - 1)
        held.append(at[terms[at] == x])
    used = np.array([k for k, x in enumerate(held) if len(x)], dtype=np.int64)
    if not len(used):
        return Machine(terms[:0], w0, np.zeros(0), np.zeros((0, FACTORS)))
    rng = np.random.RandomState(seed)
    used = rng.permutation(used)
    batches = [_Batch([held[j] for j in used[k : k + BATCH]], labels[used[k : k + BATCH]]) for k in range(0, len(used), BATCH)]
    w, v = np.zeros(m), rng.normal(0, 0.01, (FACTORS, m))
    gw, gv, g0 = np.full(m, 1e-2), np.full((FACTORS, m), 1e-2), 1e-2
    for epoch in range(WARM + max(EPOCHS, -(-STEPS // len(batches)))):
        for k in rng.permutation(len(batches)):
            b = batches[k]
            n, u = len(b.labels), b.terms
            z = w0 + b.by_text(w[b.index])
            x = [f[b.index] for f in v] if epoch >= WARM else []
            s = [b.by_text(f) for f in x]
            for f, sf in zip(x, s, strict=True):
                z += (sf * sf - b.by_text(f * f)) / 2
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - b.labels) * np.where(b.labels > 0, TOXIC_WEIGHT, 1.0)
            of_term = g[b.text]
            step = b.by_term(of_term) / n
            gw[u] += step**2
            pace = RATE / np.sqrt(gw[u])
            moved = w[u] - pace * step
            w[u] = np.sign(moved) * np.maximum(np.abs(moved) - pace * LASSO, 0)
            for f, (xf, sf) in enumerate(zip(x, s, strict=True)):
                now = v[f, u]
                step = b.by_term(of_term * (sf[b.text] - xf)) / n + DECAY * now
                gv[f, u] += step**2
                v[f, u] = now - FACTOR_RATE * step / np.sqrt(gv[f, u])
            g0 += g.mean() ** 2
            w0 -= RATE * g.mean() / np.sqrt(g0)
    return Machine(terms, float(w0), w, v.T.copy())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Machine:
    """Fit on about sample_docs of the labelled rows, picked by a hash of the id; only their hashed terms are collected.

    Labels that are null, and ids without a text, are left out; of repeated labels all count.
    """
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    total, slots = labels.count(), 1_000_000
    share = min(slots, int(slots * sample_docs / max(total, 1)))
    picked = labels.where(F.pmod(F.xxhash64("id"), F.lit(slots)) < share)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the hash is on the key, so Spark filters both sides before the join
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(slots)) < share).join(picked, "id").select("text", "toxic")
    got = rows.mapInArrow(_sampled, "toxic int, terms binary").toArrow()
    lists = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in got["terms"]]
    toxic = got["toxic"].to_numpy().astype(float)
    order = sorted(range(len(lists)), key=lambda k: (lists[k].tobytes(), toxic[k]))  # whatever order the tasks ended in
    return _fit([lists[k] for k in order], np.array([toxic[k] for k in order]))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, data, off in string_chunks(batch, "text"):
                terms, text = _terms(data, off)
                if len(m.terms):
                    at = np.minimum(np.searchsorted(m.terms, terms), len(m.terms) - 1)
                    held = m.terms[at] == terms
                    at, text = at[held], text[held]
                else:
                    at, text = terms[:0], text[:0]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(m.score(at, text, b - a))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) of every whole text.

    Defined cases: null and empty texts have the score of a text without terms; repeated rows and null ids stay as they
    are; further columns are dropped; if nothing was learned every text has the share of toxic labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(_scorer(shared), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
