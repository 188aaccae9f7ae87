"""Language identification by word-first backoff.

A word that training knows is scored by its log frequency in each language.  For any other word the longest known
character n-grams (from MAX_GRAM down to single characters) at each of its positions are scored instead.  A text's
language has the largest sum of log probabilities over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import BYTE_CODE, LETTERS, LOWER, U, mix, span_hashes, string_chunks, word_spans

#: The classifier is fitted on about this many labelled documents at most, picked by a hash of their texts; every word and
#: character n-gram of their whole texts is learned.
SAMPLE_DOCS = 12_000
MAX_GRAM = 4
#: Characters of an unseen word that weigh as much as one word.
UNIT = 4
UNKNOWN = "und"
_SLICE = 512 << 10  # bytes of text that a worker looks at together
_CUT = 512  # bytes of a word that n-grams are taken from at once; longer words are taken in pieces


def _piece_ends(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Where pieces of about _CUT bytes from begin on end: at a word's end or before the first byte of a character."""
    end = np.minimum(stop, begin + _CUT)
    for _ in range(3):
        end = end - ((end < stop) & ((data[np.minimum(end, len(data) - 1)] & 0xC0) == 0x80))
    return end


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = MAX_GRAM to 1: hashes of the n characters from each character on (0 where the word has ended), and each position's word."""
    size = ends - starts
    word = np.repeat(np.arange(len(starts)), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    lead = (data[at] & 0xC0) != 0x80  # first byte of a character
    first = np.flatnonzero(lead)
    # one code for each character, from its bytes
    code = np.add.reduceat(BYTE_CODE[LOWER[data[at]]] * (U(2) * (np.arange(len(at)) - np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))).astype(U) + U(1)), first) if len(first) else np.zeros(0, U)
    word = word[first]
    out = []
    for n in range(MAX_GRAM, 0, -1):
        h = np.full(len(code), U(n), dtype=U)
        whole = np.ones(len(code), dtype=bool)
        for k in range(n):
            shifted = np.zeros(len(code), dtype=U)
            shifted[: len(code) - k] = code[k:]
            h = mix(h * U(0x9E3779B97F4A7C15) + shifted)
            whole[: len(code) - k] &= word[k:] == word[: len(code) - k]
            whole[len(code) - k :] = False
        out.append((np.where(whole, h, U(0)), word))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, lang, n) of words (kind 0) and n-grams (kind n), counted for each slice of a batch."""
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist())
        for a, b, data, off in string_chunks(batch, "text"):
            starts, ends, first = word_spans(data, off, LETTERS)
            words = span_hashes(LOWER[data], starts, ends)
            owner = np.repeat(np.arange(a, b), np.diff(first))
            for lang in np.unique(langs[a:b]).tolist():
                mine = np.flatnonzero(langs[owner] == lang)
                found = {0: [words[mine]]}
                begin, stop = starts[mine], ends[mine]
                while len(begin):  # long words in pieces
                    end = _piece_ends(data, begin, stop)
                    for n, (h, _) in zip(range(MAX_GRAM, 0, -1), _grams(data, begin, end), strict=True):
                        found.setdefault(n, []).append(h[h > 0])
                    begin, stop = end[end < stop], stop[end < stop]
                for kind, parts in found.items():
                    h = np.concatenate(parts)
                    key, n = np.unique(h, return_counts=True)
                    m = len(key)
                    yield pa.record_batch([pa.array(np.full(m, kind, np.int32)), pa.array(key.view(np.int64)), pa.array([lang] * m, pa.string()), pa.array(n)], names=["kind", "key", "lang", "n"])


@dataclass
class Model:
    """Sorted hashes of words and n-grams, with the log probability of each in each language."""

    langs: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on a sample of about sample_docs of the rows with a text and a language.

    The sample is picked by a hash of the text alone, so equal inputs give equal models.  What reaches the driver is one
    row for each word or n-gram and language of the sample.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    total = rows.count()
    slots = 1_000_000
    share = min(slots, int(slots * sample_docs / max(total, 1)))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(slots)) < share)
    counts = sample.mapInArrow(_counts, "kind int, key long, lang string, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")).toArrow()
    lang = counts["lang"].combine_chunks().dictionary_encode()
    given = lang.dictionary.to_pylist()
    langs = sorted(given)
    place = np.array([langs.index(x) for x in given], dtype=np.int64)[lang.indices.to_numpy(zero_copy_only=False)]
    kinds, keys, times = counts["kind"].to_numpy(), counts["key"].to_numpy().view(U), counts["n"].to_numpy()
    tables = {}
    for kind in range(MAX_GRAM + 1):
        at = kinds == kind
        key, row = np.unique(keys[at], return_inverse=True)
        n = np.zeros((len(key), len(langs)))
        n[row, place[at]] = times[at]
        tables[kind] = key, (np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * (len(n) + 1))) if len(n) else n).astype(np.float32)
    return Model(langs, tables)


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, values = table
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros((len(keys), values.shape[1]), np.float32)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return hit, values[at] * hit[:, None]


def _word_scores(m: Model, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores of distinct words in each language."""
    hit, out = _find(m.tables[0], keys)
    new = np.flatnonzero(~hit)
    if len(new):
        score = np.zeros((len(new), len(m.langs)))
        begin, stop = starts[new], ends[new]
        places = np.zeros(len(new))
        row = np.arange(len(new))
        while len(row):  # long words in pieces
            end = _piece_ends(data, begin[row], stop[row])
            left = None
            for n, (h, word) in zip(range(MAX_GRAM, 0, -1), _grams(data, begin[row], end), strict=True):
                if left is None:
                    left = np.ones(len(h), bool)
                at = np.flatnonzero(left & (h > 0))
                known, values = _find(m.tables[n], h[at])
                at, values = at[known], values[known]
                for k in range(len(m.langs)):
                    score[row, k] += np.bincount(word[at], weights=values[:, k], minlength=len(row))
                places[row] += np.bincount(word[at], minlength=len(row))
                left[at] = False
            begin[row] = end
            row = row[end < stop[row]]
        # a word counts once for each UNIT places, once at least: one without spaces may be a whole paragraph
        out[new] = score / np.clip(places, 1, UNIT)[:, None]
    return out


def _predict(m: Model, texts: pa.Array) -> pa.Array:
    names = np.array([*m.langs, UNKNOWN], dtype=object)
    langs, scores = [], []
    for a, b, data, off in string_chunks(pa.record_batch([texts], names=["text"]), "text", _SLICE):
        starts, ends, first = word_spans(data, off, LETTERS)
        keys, at, which = np.unique(span_hashes(LOWER[data], starts, ends), return_index=True, return_inverse=True)
        n = b - a
        total = np.zeros((n, len(m.langs)))
        if m.langs and len(keys):
            values = _word_scores(m, keys, data, starts[at], ends[at])
            text = np.repeat(np.arange(n), np.diff(first))
            for k in range(len(m.langs)):
                total[:, k] = np.bincount(text, weights=values[which, k], minlength=n)
        has = np.diff(first) > 0
        letters = np.concatenate([[0], np.cumsum(LETTERS[data] & (data < 128))])
        ascii_ = letters[off[1:]] > letters[off[:-1]]
        for k in np.flatnonzero(has & ~ascii_).tolist():  # bytes beyond ASCII only: are they letters?
            has[k] = any(map(str.isalpha, texts[a + k].as_py()))
        if m.langs:
            best = total.argmax(axis=1)
            p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        else:
            best, p, has = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
        langs += names[np.where(has, best, len(m.langs))].tolist()
        scores.append(np.where(has, p, 0.0))
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], names=["lang_pred", "score"])


def prediction(spark: SparkSession, model: Model):
    """A function from a text column to a struct (lang_pred, score); only the texts are sent to the workers."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _predict(shared.value, texts)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # not deterministic: Spark then never works it out twice for a filter and a column
    return F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (probability of lang_pred among the languages learned) of every text.

    with_row adds the whole input row as a struct `row`.

    Defined cases: a null text, or one without any letter, is `und` with score 0, as is every text if nothing was
    learned; ties go to the language that sorts first; repeated rows and null ids stay as they are; further columns are
    dropped; texts and words may be of any length.
    """
    found = prediction(docs.sparkSession, model)(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *([F.struct("*").alias("row")] if with_row else []), found.alias("found"))
    return rows.select("doc_id", "found.lang_pred", "found.score", *(["row"] if with_row else []))
