"""Line dedup by a deletion-neighbourhood join.

Lines are compared as word sequences; two lines are copies when they are equal or one word apart (inserted, deleted or
replaced).  Every candidate line emits the hash of each variant that lacks one word.  A replaced word leaves equal
variants that lack the same place; an inserted one leaves a variant equal to the other line.  So a line meets every
line one word apart by equal keys, and the earliest line of each key is all that it has to know of it: keys are reduced
to that line before anything is joined.

Equal lines are told by 128 bits (line and check), each a sum over the words of a mixture of word and place that no pattern of
words can cancel.  Keys of variants and halves are sums of powers, from which a word can be taken at once: they only find
candidates, which are compared word by word.

Only lines that can have a neighbour emit variants: one edit leaves the first or the second half of a line unchanged, so
a line whose halves (cut for its own length and for a partner one word longer) no other line has is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, free_name
from .text import LOWER, NON_SPACE, U, give_back, mix, span_hashes, string_chunks, to_long, word_spans

#: Lines of fewer words are never removed: one word in five is the furthest that copies differ.  For equal lines a long
#: word counts once for each WORD_BYTES bytes, so that lines in scripts without spaces are long enough too.
MIN_WORDS, WORD_BYTES = 5, 12
#: Kinds of keys: a word left out at a known place, a word left out anywhere, the whole line.
_PLACED, _PLAIN, _WHOLE = range(3)
_NEWLINE = 10


def _lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines of all texts, one text after the other, and the number of each text's lines."""
    breaks = np.flatnonzero(data == _NEWLINE)
    text = np.searchsorted(off, breaks, side="right") - 1
    n = np.bincount(text, minlength=len(off) - 1) + 1
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    # an empty text's start and the next text's start are equal, and so may be a break's end and a text's end
    return starts, n


class _Words:
    """Word hashes of lines, with prefix sums from which any part of a line is hashed at once."""

    def __init__(self, data: np.ndarray, lines: np.ndarray):
        edges = np.append(lines, len(data))
        # a word never crosses a newline, so lines can be cut like texts
        starts, ends, self.first = word_spans(data, edges, NON_SPACE)
        self.words = span_hashes(LOWER[data], starts, ends)
        self.n = np.diff(self.first)
        self.size = np.diff(np.concatenate([[0], np.cumsum(np.maximum((ends - starts) // WORD_BYTES, 1))])[self.first])
        place = np.arange(len(self.words)) - np.repeat(self.first[:-1], self.n)
        placed = np.zeros(len(self.words) + 1, dtype=U)
        self.line, self.check = (mix(self._sums(mix(self.words ^ mix(place.astype(U) + U(salt))), placed) + self.n.astype(U)) for salt in (1, 1 << 40))
        m = len(self.words)
        self.power = np.ones(m + 2, dtype=U)
        if m:
            self.power[1:] = np.multiply.accumulate(np.full(m + 1, 0x9E3779B97F4A7C15, dtype=U))
        inverse = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
        self.inverse = np.ones(m + 2, dtype=U)
        self.inverse[1:] = np.multiply.accumulate(np.full(m + 1, inverse, dtype=U))
        self.sums = np.zeros(m + 1, dtype=U)
        np.cumsum(self.words * self.power[:m], out=self.sums[1:])

    def _sums(self, x: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Sum of each line's x."""
        np.cumsum(x, out=room[1:])
        return room[self.first[1:]] - room[self.first[:-1]]

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unfinished hash of words a to b."""
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def whole(self) -> np.ndarray:
        """The key under which variants of longer lines meet a line."""
        return mix(self.part(self.first[:-1], self.first[1:]) + self.n.astype(U))


def _half_keys(w: _Words, at: np.ndarray) -> np.ndarray:
    """For lines at: hashes of front and back half, cut for their own length and for that of a partner one word shorter."""
    n, first, last = w.n[at], w.first[:-1][at], w.first[1:][at]
    keys = np.empty((len(at), 4), dtype=U)
    for longer in (0, 1):
        front = (n - longer) // 2
        back = n - longer - front
        for k, size, h in ((0, front, w.part(first, first + front)), (1, back, w.part(last - back, last))):
            keys[:, 2 * longer + k] = mix(h + mix(size.astype(U) * U(2) + U(k)))
    return keys


def _occurrences(min_words: int):
    """(line, check, doc_id, number, halves) of every line of min_words words or more, long words counted more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in string_chunks(batch, "text"):
                lines, n = _lines(data, off)
                w = _Words(data, lines)
                doc = np.repeat(np.arange(a, b), n)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                at = np.flatnonzero(w.size >= min_words)
                halves = _half_keys(w, at)
                ids = batch.column(0).take(pa.array(doc[at]))
                yield pa.record_batch([to_long(w.line[at]), to_long(w.check[at]), ids, pa.array(number[at].astype(np.int32)), *(to_long(halves[:, k].copy()) for k in range(4))], names=["line", "check", "doc_id", "number", "h0", "h1", "h2", "h3"])

    return run


def _variants(min_words: int, chosen):
    """(key, line, kind, doc_id, number): keys for each word left out, and the whole line's own.

    Words are left out only in the half that an edit can be in: the other one has to be that of another line too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = chosen.value
        for batch in batches:
            for a, b, data, off in string_chunks(batch, "text"):
                lines, count = _lines(data, off)
                w = _Words(data, lines)
                line, whole = w.line, w.whole()
                at = np.flatnonzero(w.n >= min_words)
                met = _bit(bitmap, _half_keys(w, at).ravel()).reshape(-1, 4)
                some = met.any(axis=1)
                at, met = at[some], met[some]
                _, once = np.unique(line[at], return_index=True)  # of equal lines of a slice the first
                at, met = at[once], met[once]
                n, first = w.n[at], w.first[:-1][at]
                row = np.repeat(np.arange(len(at)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                front = (met[:, 0] | met[:, 2])[row] & (place >= ((n - 1) // 2)[row])
                back = (met[:, 1] | met[:, 3])[row] & (place <= (n // 2)[row])
                row, place = row[front | back], place[front | back]
                begin, end = first[row], first[row] + n[row]
                skip = begin + place
                # words before the place, then the words behind it moved up by one
                rest = w.part(begin, skip) + (w.sums[end] - w.sums[skip + 1]) * w.inverse[begin + 1]
                short = mix(rest + (n[row] - 1).astype(U))
                same_place = mix(short ^ mix(place.astype(U) + U(1)))
                keys = np.concatenate([same_place, short, whole[at]])
                owner = np.concatenate([at[row], at[row], at])
                kind = np.repeat(np.array([_PLACED, _PLAIN, _WHOLE], np.int32), [len(row), len(row), len(at)])
                doc = np.repeat(np.arange(a, b), count)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.record_batch(
                    [to_long(keys), to_long(line[owner]), pa.array(kind), batch.column(0).take(pa.array(doc[owner])), pa.array(number[owner].astype(np.int32))],
                    names=["key", "line", "kind", "doc_id", "number"],
                )

    return run


def _of_keys(chosen):
    """Rows whose first column's bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = chosen.value
        for batch in batches:
            yield batch.filter(pa.array(_bit(bitmap, batch.column(0).to_numpy(zero_copy_only=False))))

    return run


_BITS = 26


def _slots(h: np.ndarray) -> np.ndarray:
    return (mix(h.view(U)) >> U(64 - _BITS)).astype(np.int64)


def _bit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _slots(h)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = np.unique(np.concatenate([np.zeros(0, np.int64), *(_slots(b.column(0).to_numpy(zero_copy_only=False)) for b in batches)]))
    yield pa.record_batch([pa.array(at)], names=["slot"])


def _bitmap(hashes: DataFrame):
    """A bitmap of fixed size (8 MB) of the one column of hashes: more of them only mean more rows looked at in vain."""
    words = hashes.mapInArrow(_slot_rows, "slot long").groupBy(F.expr("slot >> 6").alias("word"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (_BITS - 6), dtype=np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))


def one_edit_apart(a: list[str], b: list[str]) -> bool:
    """Whether two word sequences are equal or one inserted, deleted or replaced word apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :] or (len(a) == len(b) == k)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for batch in batches:
        keep = [i for i, (x, y) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)) if one_edit_apart(_split(x.translate(low)), _split(y.translate(low)))]
        yield pa.record_batch([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 3)], names=["line", "check"])


def _split(text: str) -> list[str]:
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _texts_of(min_words: int, chosen):
    """(line, check, content) of lines whose bit is set, each once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = chosen.value
        for batch in batches:
            for _, _, data, off in string_chunks(batch, "text"):
                lines, n = _lines(data, off)
                w = _Words(data, lines)
                line = w.line
                at = np.flatnonzero(w.n >= min_words)
                at = at[_bit(bitmap, line[at])]
                _, once = np.unique(np.stack([line[at], w.check[at]]), axis=1, return_index=True)
                at = at[once]
                last = np.append(lines, len(data))[at + 1]
                yield pa.record_batch([to_long(line[at]), to_long(w.check[at]), pa.array([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(lines[at].tolist(), last.tolist(), strict=True)], pa.string())], names=["line", "check", "content"])

    return run


def _rebuilt(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """text without the lines of the array removed, and how many lines there were and are gone."""
    for texts, gone in batches:
        out, total, less = [], [], []
        for text, removed in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
            lines = text.split("\n") if text is not None else []
            total.append(len(lines))
            less.append(len(removed or ()))
            if removed:
                removed = set(removed)
                text = "\n".join(x for k, x in enumerate(lines) if k not in removed)
            out.append(text)
        yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(less, pa.int64())], names=["text", "n_lines", "n_removed"])
        give_back()


_rebuilt.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_equal: int | None = None) -> DataFrame:
    """(doc_id, number, near): the lines (numbered from 0) of docs (doc_id, text) that an earlier line is a copy of.

    Lines are ordered by doc_id, then by number.  near is false for equal lines, true for lines one word away from a
    line that is earlier than their own first occurrence; all occurrences of such a line go.  Lines of fewer than
    min_words words have no near copies; those of min_equal words or more (as many, unless given) go if equal.
    """
    tmp = Scratch()
    least = min_words if min_equal is None else min(min_equal, min_words)
    seen = tmp.written(docs.mapInArrow(_occurrences(least), "line long, check long, doc_id long, number int, h0 long, h1 long, h2 long, h3 long"), "lines")
    place = F.struct("doc_id", "number")
    lines = tmp.written(seen.groupBy("line", "check").agg(F.min(place).alias("first"), F.count("*").alias("times"), *(F.min(f"h{k}").alias(f"h{k}") for k in range(4))), "distinct-lines")

    halves = lines.select("line", F.explode(F.array_distinct(F.array("h0", "h1", "h2", "h3"))).alias("half"))
    met = halves.groupBy("half").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low <> high").select("half")
    variants = docs.mapInArrow(_variants(min_words, _bitmap(met)), "key long, line long, kind int, doc_id long, number int")
    variants = tmp.written(variants, "line-variants")

    # the earliest line of each key; under a plain variant's key whole lines and variants meet only each other: two lines
    # that lack a word each at different places are no partners, and may not hide one that is
    rank = F.struct("doc_id", "number", "line")
    best = variants.groupBy("key").agg(
        F.min(rank).alias("any"), F.min(F.when(F.col("kind") == _WHOLE, rank)).alias("complete"), F.min("line").alias("low"), F.max("line").alias("high")
    )
    best = tmp.written(best.where("low <> high").select("key", "any", "complete"), "variant-keys")
    keyed = variants.mapInArrow(_of_keys(_bitmap(best.select("key"))), variants.schema).select("key", "line", "kind").distinct()
    offer = F.when(F.col("kind") == _PLAIN, F.col("complete")).otherwise(F.col("any"))
    offered = keyed.join(best, "key").where((F.col("kind") != _PLAIN) | F.col("complete").isNotNull()).groupBy("line").agg(F.min(offer).alias("offer"))
    offered = offered.join(lines.select("line", "first"), "line").where("struct(offer.doc_id, offer.number) < first")
    offered = tmp.written(offered.select("line", F.col("offer.line").alias("partner")), "line-partners")

    needed = tmp.written(offered.select("line").union(offered.select("partner")).distinct(), "needed-lines")
    # a line that stands everywhere comes from every slice: it is reduced to one text before it meets the others
    content = docs.mapInArrow(_texts_of(min_words, _bitmap(needed)), "line long, check long, content string").groupBy("line", "check").agg(F.min("content").alias("content"))
    content = tmp.written(content.join(needed.withColumn("needed", F.lit(True)), "line", "left").where("needed").drop("needed"), "line-texts")
    both = offered.join(content, "line").join(content.select(F.col("line").alias("partner"), F.col("content").alias("other")), "partner")
    verified = both.select("line", "content", "other", "check").mapInArrow(_verify, "line long, check long")

    state = lines.join(verified.distinct().withColumn("near", F.lit(True)), ["line", "check"], "left").where("near OR times > 1").select("line", "check", "first", F.coalesce("near", F.lit(False)).alias("near"))
    # written, so that both sides of the join below are shuffled for it: the occurrences of one line can then be split
    state = tmp.written(state, "repeated-states")
    gone = seen.join(state, ["line", "check"]).where("near OR struct(doc_id, number) > first").select("doc_id", "number", "near")
    gone = tmp.written(gone, "repeated-lines")
    tmp.clear(gone)
    return gone


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_equal: int | None = None, id_col: str = "doc_id", text_col: str = "text", stats: str = "line_stats") -> DataFrame:
    """The documents without repeated lines: all columns, and a struct stats (n_lines, n_removed, n_near) of the original text.

    Of equal lines, and of lines one word apart, the earliest (by doc_id, then by place) stays.  Defined cases: lines of
    fewer than min_words words stay, but for equal ones with long words (a word counts once for each WORD_BYTES bytes)
    and equal ones of min_equal words or more if that is given; null texts stay null with 0 lines, and an empty text is
    one empty line; repeated rows of one id count as one document, whose lines are the earliest of each number; rows
    with a null id stay as they are, and no line goes because of them; a document that loses all its lines has an empty
    text; further columns are kept, whatever their names, but for one named like stats.  Case (A-Z) and the kind of
    white space between words make no difference.  A text may have any number of lines of any length.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gone = repeated_lines(rows, min_words, min_equal).dropDuplicates(["doc_id", "number"])
    # a document's removed lines are numbers of its own lines, fewer than its text has bytes
    key, removed, near, made = (free_name(docs, x) for x in ("line_owner", "lines_removed", "lines_near", "rebuilt"))
    by_doc = gone.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("number").alias(removed), F.sum(F.col("near").cast("long")).alias(near))
    joined = docs.join(by_doc, F.col(id_col).cast("long") == F.col(key), "left")
    rebuilt = F.arrow_udf(_rebuilt, "text string, n_lines long, n_removed long").asNondeterministic()
    joined = joined.withColumn(made, rebuilt(F.col(text_col).cast("string"), F.col(removed)))
    made = F.col(made)
    kept = [made["text"].alias(c) if c == text_col else F.col(c) for c in docs.columns if c.lower() != stats.lower()]
    return joined.select(*kept, F.struct(made["n_lines"].alias("n_lines"), made["n_removed"].alias("n_removed"), F.coalesce(near, F.lit(0)).alias("n_near")).alias(stats))
