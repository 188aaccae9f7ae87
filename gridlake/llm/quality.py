"""Quality by attention-based multiple-instance learning: a document is a bag of passages, and only the bag has a label.

Every PASSAGE words are a passage.  It is encoded as h = tanh(W x + the mean of its words' vectors + b), where x tells its
shape (kinds of bytes, lengths, repetition) and words are hashed.  Gated attention a = softmax over the passages of
u . (tanh(V h) * sigmoid(U h)) weighs them, and sigmoid(c . sum of a h + d) is the score.  All is learned together from
document labels, so a document is judged by the passages that tell, however long the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, NON_SPACE, U, span_hashes, string_chunks, word_spans

PASSAGE = 64
#: Words are hashed to so many bits; sizes of the passage's and the gate's vectors.
TERM_BITS, WIDTH, GATE = 12, 16, 8
#: The model is fitted on about this many labelled texts at most, picked by a hash of their doc_ids; of each all passages.
SAMPLE_DOCS = 4_000
BATCH, EPOCHS, STEPS, RATE, DECAY = 64, 8, 400, 5e-3, 1e-4
THRESHOLD = 0.5

#: Kinds of bytes: lower, upper, digit, blank, line end, non-ASCII, control, then every ASCII sign by itself.
_KIND = np.full(256, 6)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9]], _KIND[10:14], _KIND[128:] = 0, 1, 2, 3, 4, 5
_SIGNS = [b for b in range(33, 127) if _KIND[b] == 6]
_KIND[_SIGNS] = 7 + np.arange(len(_SIGNS))
_KINDS = 7 + len(_SIGNS)
_UPPER, _LETTER = _KIND == 1, np.isin(_KIND, (0, 1, 5))
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
SHAPE = _KINDS + 9


@dataclass
class Bags:
    """Passages of some documents: first passage of each (one more entry), shapes, words of all passages, first word of each."""

    first: np.ndarray
    shape: np.ndarray
    terms: np.ndarray
    words: np.ndarray


def encoded(data: np.ndarray, off: np.ndarray) -> Bags:
    """The passages of each text; a text without words is one empty passage."""
    starts, ends, first = word_spans(data, off, NON_SPACE)
    per_text = np.maximum(1, -(-np.diff(first) // PASSAGE))
    bag = np.append(0, np.cumsum(per_text))
    n = int(bag[-1])
    nth = np.arange(n) - np.repeat(bag[:-1], per_text)
    word_edge = np.append(np.repeat(first[:-1], per_text) + nth * PASSAGE, first[-1])
    words = np.diff(word_edge)
    # a passage's bytes go to the next one's first word, or the text's end
    byte_edge = np.append(np.repeat(off[:-1], per_text), off[-1])
    later = np.flatnonzero(nth > 0)
    byte_edge[later] = starts[word_edge[later]]
    size = np.diff(byte_edge)
    of_byte, of_word = np.repeat(np.arange(n), size), np.repeat(np.arange(n), words)
    kinds = np.bincount(of_byte * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    hashes = span_hashes(LOWER[data], starts, ends)
    short = (hashes >> U(64 - 31)).astype(np.int64)
    keys, times = np.unique(of_word << 31 | short, return_counts=True)
    owner = keys >> 31
    most = np.zeros(n)
    np.maximum.at(most, owner, times)
    length = ends - starts
    total = np.maximum(words, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(of_word[flag], minlength=n) / total

    def within(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags[data]))
        return sums[ends] - sums[starts]

    again = np.zeros(len(starts), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    letters = within(_LETTER)
    rest = [
        np.log1p(words),
        np.bincount(of_word, weights=np.minimum(length, 64), minlength=n) / total / 8,
        np.bincount(owner, minlength=n) / total,
        most / total,
        share(again),
        share((letters > 1) & (within(_UPPER) == letters)),
        share(letters == 0),
        share(_ENDS[data[ends - 1]]) if len(ends) else np.zeros(n),
        share(length > 24),
    ]
    shape = np.column_stack([np.sqrt(kinds / np.maximum(size, 1)[:, None]), *rest]).astype(np.float32)
    return Bags(bag, shape, (hashes >> U(64 - TERM_BITS)).astype(np.int16), word_edge)


def _sums(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the rows between edges; nothing between gives zero."""
    if not len(x):
        return np.zeros((len(edges) - 1, *x.shape[1:]), x.dtype)
    out = np.add.reduceat(x, np.minimum(edges[:-1], len(x) - 1), axis=0)
    out[edges[1:] == edges[:-1]] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Attention:
    """The weights, by name, and the mean and spread of the shapes they were fitted on."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    spread: np.ndarray

    def forward(self, bags: Bags) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((bags.shape - self.mean) / self.spread, -6, 6)
        n_words = np.maximum(np.diff(bags.words), 1)[:, None]
        h = np.tanh(x @ w["W"] + _sums(w["E"][bags.terms], bags.words) / n_words + w["b"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["u"]
        of = np.repeat(np.arange(len(bags.first) - 1), np.diff(bags.first))
        e = np.exp(e - np.maximum.reduceat(e, bags.first[:-1])[of])
        a = e / np.add.reduceat(e, bags.first[:-1])[of]
        z = np.add.reduceat(a[:, None] * h, bags.first[:-1], axis=0)
        return {"x": x, "n": n_words, "h": h, "t": t, "s": s, "of": of, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"][0])}

    def gradients(self, bags: Bags, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss of the bags."""
        w, f = self.weights, self.forward(bags)
        h, t, s, of, a = f["h"], f["t"], f["s"], f["of"], f["a"]
        out = (f["p"] - y) / len(y)
        dz = (out[:, None] * w["c"])[of]
        da = (h * dz).sum(1)
        de = a * (da - np.add.reduceat(a * da, bags.first[:-1])[of])
        dgate = de[:, None] * w["u"]
        dv, du = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
        dh = (a[:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
        each = np.repeat(dh / f["n"], np.diff(bags.words), axis=0)
        de_words = np.stack([np.bincount(bags.terms, weights=each[:, k], minlength=1 << TERM_BITS) for k in range(WIDTH)], axis=1)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "E": de_words, "V": h.T @ dv, "U": h.T @ du, "u": (t * s).T @ de, "c": f["z"].T @ out, "d": out.sum(keepdims=True)}


def _together(docs: list[tuple]) -> Bags:
    """Bags of several documents, each (shape, terms, words of each passage)."""
    words = np.concatenate([d[2] for d in docs])
    return Bags(np.append(0, np.cumsum([len(d[2]) for d in docs])), np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs]), np.append(0, np.cumsum(words)))


def _fit(docs: list[tuple], labels: np.ndarray, seed: int = 3) -> Attention:
    """Adam on mini-batches of documents."""
    rng = np.random.RandomState(seed)
    rate = float(labels.mean()) if len(labels) else 1.0
    sizes = {"W": (SHAPE, WIDTH), "b": (WIDTH,), "E": (1 << TERM_BITS, WIDTH), "V": (WIDTH, GATE), "U": (WIDTH, GATE), "u": (GATE,), "c": (WIDTH,), "d": (1,)}
    weights = {k: np.zeros(v) if k in "bd" else rng.normal(0, 0.05 if k == "E" else v[0] ** -0.5, v) for k, v in sizes.items()}
    weights["d"][:] = np.log((rate + 1e-4) / (1 - rate + 1e-4))
    shapes = np.concatenate([d[0] for d in docs]) if docs else np.zeros((1, SHAPE))
    model = Attention(weights, shapes.mean(0), shapes.std(0) + 1e-2)
    if not docs or rate in (0.0, 1.0):  # nothing to tell apart: every text has the share of good labels
        weights["c"][:] = 0
        return model
    first, second = {k: np.zeros(v) for k, v in sizes.items()}, {k: np.zeros(v) for k, v in sizes.items()}
    rounds = max(EPOCHS, -(-STEPS * BATCH // len(docs)))
    step, last = 0, rounds * -(-len(docs) // BATCH)
    for _ in range(rounds):
        order = rng.permutation(len(docs))
        for k in range(0, len(docs), BATCH):
            pick = order[k : k + BATCH]
            step += 1
            pace = RATE * min(1.0, 2 * (1 - (step - 1) / last))
            for name, g in model.gradients(_together([docs[i] for i in pick]), labels[pick]).items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                weights[name] -= pace * (move + (DECAY * weights[name] if name not in "bd" else 0))
    return model


_SAMPLE = pa.schema([("quality", pa.int32()), ("shape", pa.binary()), ("terms", pa.binary()), ("words", pa.binary())])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in string_chunks(batch, "text"):
            bags, rows = encoded(data, off), []
            for k, quality in enumerate(batch.column(1).slice(a, b - a).to_pylist()):
                p, q = bags.first[k], bags.first[k + 1]
                x, y = bags.words[p], bags.words[q]
                rows.append({"quality": quality, "shape": bags.shape[p:q].tobytes(), "terms": bags.terms[x:y].tobytes(), "words": np.diff(bags.words[p : q + 1]).astype(np.int32).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=_SAMPLE)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Attention:
    """Fit on about sample_docs of the labelled rows, picked by a hash of the id; only their encoded passages are collected.

    Labels that are null, and ids without a text, are left out; of repeated labels all count.
    """
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("quality"))
    total, slots = labels.count(), 1_000_000
    picked = F.pmod(F.xxhash64("id"), F.lit(slots)) < min(slots, int(slots * sample_docs / max(total, 1)))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(picked).join(labels.where(picked), "id").select("text", "quality")
    got = rows.mapInArrow(_sampled, "quality int, shape binary, terms binary, words binary").toArrow()
    # in one order, whatever order the tasks ended in
    got = sorted(zip(*(got[c].to_pylist() for c in ("terms", "shape", "words", "quality")), strict=True))
    docs_of = [(np.frombuffer(s, np.float32).reshape(-1, SHAPE), np.frombuffer(t, np.int16), np.frombuffer(w, np.int32)) for t, s, w, _ in got]
    return _fit(docs_of, np.array([float(q > 0) for *_, q in got]))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, data, off in string_chunks(batch, "text"):
                bags = encoded(data, off)
                f = model.forward(bags)
                weights = pa.ListArray.from_arrays(pa.array(bags.first.astype(np.int32)), pa.array(f["a"]))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(f["p"]), weights], names=["doc_id", "score", "weights"])

    return run


def score(docs: DataFrame, model: Attention, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), weights (the attention paid to each passage, in order; their sum is 1) and predicted (1 if
    score >= threshold) of every whole text.

    Defined cases: null and empty texts are one empty passage; repeated rows and null ids stay as they are; further
    columns are dropped; if nothing was learned, or all labels are the same, every text has the share of good labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(_scorer(shared), "doc_id long, score double, weights array<double>")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
