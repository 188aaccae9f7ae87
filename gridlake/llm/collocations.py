"""Phrase collocation mining: count tries of depth 3 for each shard, merged by ranges of prefixes.

Texts have A-Z lower-cased and are split at [.,;:!?\\x0A-\\x0D] into pieces, those into words [^\\x20\\x09]+.  Everything is
counted for each lang (null: und).

Roots.  A first pass counts the words.  Those of min_count occurrences or more (no other word is part of a candidate) are
numbered in order of their bytes; a number stands for one lang and one word.  At most LISTED numbers are given, to the
commonest, so what is broadcast has a bound.  Phrases with a word that is frequent but has no number travel as plain
rows that Spark sums: all are counted, whatever the size of the vocabulary.

Tries.  A map task counts the pairs and triples of FLUSH words at a time into a trie: the pairs in order, each with its
count and its number of children, then the children's last words and counts, in order.  It is cut by prefix (the pair)
into ranges that hold about TOKENS_PER_RANGE tokens each, as told by the words' counts, and each piece is serialised on
its own.  With more than FAN ranges the pieces first go to FAN coarse ranges, where tasks merge what they have into tries
again and cut them further.  The task of a range merges its sorted pieces.  A hot word or pair is one number from each
shard, and a hot word's pairs lie in many ranges.

Parts.  The count of a triple's first pair is that of its parent in the trie, those of single words are in the list; the
count of its last pair is its suffix link: a join on the frequent pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch
from .text import LOWER, give_back, string_chunks

UNKNOWN = "und"
DEPTH, MIN_COUNT, TOP = 3, 10, 2000
#: Words that a map task counts at a time; tokens for each range; ranges that one hop cuts to; numbers given out.
FLUSH, TOKENS_PER_RANGE, FAN, LISTED = 1_200_000, 2_000_000, 512, (1 << 20) - 1
#: Bits of a number in a path of three.
BITS = 20
#: Bytes that end a piece, and bytes that stand between words of one.
STOP = np.zeros(256, dtype=bool)
STOP[[ord(c) for c in ".,;:!?"]] = STOP[10:14] = True
BETWEEN = STOP.copy()
BETWEEN[[9, 32]] = True


class _Words:
    """Words of a slice of texts, as one array of strings, the text of each, and whether the next one follows in its piece."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(data)
        cut = np.zeros(n + 1, dtype=bool)
        cut[off] = True
        inside = ~BETWEEN[data]
        begins = inside & (np.append(True, ~inside[:-1])[:n] | cut[:n])
        starts = np.flatnonzero(begins)
        size = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        self.offsets = np.append(0, np.cumsum(size))
        self.array = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(self.offsets), pa.py_buffer(np.ascontiguousarray(LOWER[data[inside]])))
        self.text = np.searchsorted(off, starts, side="right") - 1
        piece = np.cumsum(STOP[data])[starts] if n else starts
        self.joined = np.append((piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1]), False)[: len(starts)]


def _slices(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """About flush words at a time: words, their langs, whether the next follows in the same piece.  A text is not divided."""
    held, total = [], 0

    def joined():
        return pa.concat_arrays([h[0] for h in held]).dictionary_encode(), pa.concat_arrays([h[1] for h in held]).dictionary_encode(), np.concatenate([h[2] for h in held])

    for batch in batches:
        langs = batch.column(1).cast(pa.large_string())
        for a, b, data, off in string_chunks(batch, "text", 1 << 22):
            w = _Words(data, off)
            held.append((w.array, langs.slice(a, b - a).take(pa.array(w.text)), w.joined))
            total += len(w.text)
            if total >= flush:
                yield joined()
                held, total = [], 0
                give_back()
    if total:
        yield joined()


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of counts of each (null: 1)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


_COUNTS = pa.schema([("lang", pa.large_string()), ("word", pa.large_string()), ("n", pa.int64())])


def _word_counter(flush: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, _ in _slices(batches, flush):
            code, lang = words.indices.to_numpy().astype(np.int64), langs.indices.to_numpy().astype(np.int64)
            both, n = _summed(lang * len(words.dictionary) + code)
            of = langs.dictionary.take(pa.array(both // len(words.dictionary)))
            yield pa.record_batch([of, words.dictionary.take(pa.array(both % len(words.dictionary))), pa.array(n)], schema=_COUNTS)
            n = np.bincount(lang)
            yield pa.record_batch([langs.dictionary, pa.nulls(len(n), pa.large_string()), pa.array(n)], schema=_COUNTS)

    return run


class Roots:
    """The listed words: lang, word and count of each number, numbers from 1 in order of lang and word bytes."""

    def __init__(self, table: pa.Table, ranges: int, complete: bool):
        table = table.combine_chunks()
        self.langs = table["lang"].combine_chunks().dictionary_encode()
        self.words, self.count = table["word"].combine_chunks().cast(pa.large_string()), table["n"].to_numpy()
        self.ranges, self.complete = ranges, complete
        lang = self.langs.indices.to_numpy() if len(table) else np.zeros(0, np.int32)
        self.first = np.searchsorted(lang, np.arange(len(self.langs.dictionary) + 1))
        total = max(int(self.count.sum()), 1)
        self.before = np.append(0, np.cumsum(self.count))[:-1] / total
        self.share = self.count / total

    def numbers(self, words: pa.DictionaryArray, langs: pa.DictionaryArray) -> np.ndarray:
        """The number of each word in its lang; 0 where it has none."""
        out = np.zeros(len(words), dtype=np.int64)
        code, lang = words.indices.to_numpy(), langs.indices.to_numpy()
        for k, name in enumerate(langs.dictionary):
            at = self.langs.dictionary.index(name).as_py()
            if at < 0:
                continue
            own = self.words.slice(self.first[at], self.first[at + 1] - self.first[at])
            places = pc.fill_null(pc.index_in(words.dictionary, value_set=own), -1).to_numpy()
            here = lang == k
            got = places[code[here]].astype(np.int64)
            out[here] = np.where(got >= 0, got + 1 + self.first[at], 0)
        return out

    def range_of(self, pairs: np.ndarray, ranges: int) -> np.ndarray:
        """Range of each pair, rising with it: a word has a share of them as large as its count, and its pairs divide that."""
        a, b = (pairs >> BITS) - 1, (pairs & ((1 << BITS) - 1)) - 1
        return np.minimum((ranges * (self.before[a] + self.share[a] * self.before[b])).astype(np.int64), ranges - 1)


class Trie:
    """Pairs in order with counts and numbers of children; the children's last numbers and counts, in order."""

    def __init__(self, pairs: np.ndarray, count: np.ndarray, kids: np.ndarray, last: np.ndarray, last_count: np.ndarray):
        self.pairs, self.count, self.kids, self.last, self.last_count = pairs, count, kids, last, last_count

    @classmethod
    def of(cls, pairs: np.ndarray, triples: np.ndarray, pair_counts: np.ndarray | None = None, triple_counts: np.ndarray | None = None) -> Trie:
        """From paths in any order; each triple's first pair is among the pairs."""
        pairs, count = _summed(pairs, pair_counts)
        triples, last_count = _summed(triples, triple_counts)
        kids = np.diff(np.searchsorted(triples >> BITS, np.append(pairs, (pairs[-1] + 1) if len(pairs) else 0)))
        return cls(pairs, count, kids, triples & ((1 << BITS) - 1), last_count)

    @property
    def triples(self) -> np.ndarray:
        return np.repeat(self.pairs, self.kids) << BITS | self.last

    def cut(self, where: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(range, serialised piece) for each range in where, the rising range of each pair."""
        edge = np.append(np.flatnonzero(np.append(True, where[1:] != where[:-1])), len(where)) if len(where) else np.zeros(1, np.int64)
        below = np.append(0, np.cumsum(self.kids))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            c, d = below[a], below[b]
            yield int(where[a]), _packed(np.diff(self.pairs[a:b], prepend=0), self.count[a:b], self.kids[a:b], self.last[c:d], self.last_count[c:d])

    @classmethod
    def merged(cls, pieces: list[bytes]) -> Trie:
        """The sorted pieces as one: the stable sort merges the runs, equal paths add up."""
        parts = [_unpacked(p) for p in pieces]
        pairs = [np.cumsum(p[0]) for p in parts]
        triples = [np.repeat(k, p[2]) << BITS | p[3] for k, p in zip(pairs, parts, strict=True)]
        return cls.of(np.concatenate(pairs), np.concatenate(triples), np.concatenate([p[1] for p in parts]), np.concatenate([p[4] for p in parts]))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0, by planes of bytes, compressed: high bytes are mostly zero."""
    head, planes = [], []
    for x in arrays:
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        head += [len(x), width]
        planes.append(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    raw = np.array(head, dtype="<i8").tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    head = np.frombuffer(raw, dtype="<i8", count=10).tolist()
    out, at = [], 80
    for n, width in zip(head[::2], head[1::2], strict=True):
        x = np.zeros((n, 8), dtype=np.uint8)
        x[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T
        out.append(x.view("<i8").ravel())
        at += n * width
    return out


_PIECES = "part int, salt int, piece binary, lang string, w array<string>, n long"
_PIECE_SCHEMA = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("piece", pa.large_binary()), ("lang", pa.large_string()), ("w", pa.list_(pa.large_string())), ("n", pa.int64())])


def _piece_rows(trie: Trie, roots: Roots, ranges: int, salt: int) -> Iterator[pa.RecordBatch]:
    for part, piece in trie.cut(roots.range_of(trie.pairs, ranges)):
        yield pa.RecordBatch.from_pylist([{"part": part, "salt": salt, "piece": piece}], schema=_PIECE_SCHEMA)


def _unlisted(words: pa.DictionaryArray, langs: pa.DictionaryArray, number: np.ndarray, follows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Plain counted rows of the pairs and triples of which a word has no number."""
    for size, begins in enumerate(follows, 2):
        at = np.flatnonzero(begins)
        at = at[np.any([number[at + k] == 0 for k in range(size)], axis=0)]
        if not len(at):
            continue
        codes = [langs.indices.to_numpy()[at]] + [words.indices.to_numpy()[at + k] for k in range(size)]
        table = pa.table({f"c{k}": c for k, c in enumerate(codes)}).group_by([f"c{k}" for k in range(size + 1)]).aggregate([([], "count_all")])
        parts = np.stack([table[f"c{k + 1}"].to_numpy() for k in range(size)], axis=1).ravel()
        rows = len(table)
        w = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * size), words.dictionary.take(pa.array(parts)))
        yield pa.record_batch([pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.large_binary()), langs.dictionary.take(table["c0"].combine_chunks()), w, table["count_all"].combine_chunks()], schema=_PIECE_SCHEMA)


def _shard_tries(shared, flush: int, ranges: int, salts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, turn = shared.value, 0
        for words, langs, joined in _slices(batches, flush):
            number = roots.numbers(words, langs)
            two = joined
            three = np.append(joined[:-1] & joined[1:], False) if len(joined) else joined
            two_at = np.flatnonzero(two[:-1] & (number[:-1] > 0) & (number[1:] > 0)) if len(two) else np.zeros(0, np.int64)
            pairs = number[two_at] << BITS | number[two_at + 1]
            ok = np.flatnonzero(three[two_at])
            ok = ok[number[two_at[ok] + 2] > 0]
            turn += 1
            yield from _piece_rows(Trie.of(pairs, pairs[ok] << BITS | number[two_at[ok] + 2]), roots, ranges, (turn * 7919 + len(words)) % salts)
            if not roots.complete:
                yield from _unlisted(words, langs, number, [two, three])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, Trie, bool]]:
    """(range, merged trie, whether it is all of the range); the rows come in order of range.

    What is held of a range is merged whenever limit bytes of pieces have come.
    """
    part, held, size = None, [], 0
    for batch in batches:
        for p, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if p != part and held:
                yield part, held, True
                held, size = [], 0
            part = p
            held.append(piece.as_buffer().to_pybytes())
            size += len(held[-1])
            if size > limit:
                yield part, held, False
                size = 0
    if held:
        yield part, held, True


#: Bytes of serialised pieces that a task merges at a time.
_MERGE = 1 << 24


def _further(shared, ranges: int, salts: int) -> Callable:
    """Merge what came of a coarse range and cut it further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for _, held, _ in _gathered(batches, _MERGE):
            turn += 1
            trie = Trie.merged(held)
            held.clear()
            yield from _piece_rows(trie, shared.value, ranges, turn % salts)
            give_back()

    return run


_GRAMS = "lang string, w array<string>, a long, f1 long, f12 long, f_last long"
_GRAM_SCHEMA = pa.schema([("lang", pa.large_string()), ("w", pa.list_(pa.large_string())), ("a", pa.int64()), ("f1", pa.int64()), ("f12", pa.int64()), ("f_last", pa.int64())])


def _frequent(shared, least: int) -> Callable:
    """The frequent paths of each range with the counts of their left parts and last words."""

    def rows(roots: Roots, ids: np.ndarray, a: np.ndarray, f12: np.ndarray) -> pa.RecordBatch:
        size = ids.shape[1]
        w = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * size), roots.words.take(pa.array(ids.ravel() - 1)))
        lang = roots.langs.dictionary.take(roots.langs.indices.take(pa.array(ids[:, 0] - 1)))
        return pa.record_batch([lang, w, pa.array(a), pa.array(roots.count[ids[:, 0] - 1]), pa.array(f12), pa.array(roots.count[ids[:, -1] - 1])], schema=_GRAM_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, low = shared.value, (1 << BITS) - 1
        for _, held, whole in _gathered(batches, _MERGE):
            trie = Trie.merged(held)
            if not whole:  # more of this range is to come: go on from what is merged
                held[:] = [piece for _, piece in trie.cut(np.zeros(len(trie.pairs), np.int64))]
                continue
            k = np.flatnonzero(trie.count >= least)
            yield rows(roots, np.stack([trie.pairs[k] >> BITS, trie.pairs[k] & low], axis=1), trie.count[k], trie.count[k])
            k = np.flatnonzero(trie.last_count >= least)
            parent = np.searchsorted(np.cumsum(trie.kids), k, side="right")  # the walk up
            pairs = trie.pairs[parent]
            yield rows(roots, np.stack([pairs >> BITS, pairs & low, trie.last[k]], axis=1), trie.last_count[k], trie.count[parent])
            give_back()

    return run


def frequent_phrases(docs: DataFrame, least: int, scratch: Scratch, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (lang, word, n) of frequent words, and with a null word all words of the lang; and
    (lang, w, a, f1, f12, f_last) of pairs and triples of at least that count, f12 that of the first two words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    counted = texts.mapInArrow(_word_counter(FLUSH), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = scratch.written(counted.where(F.col("word").isNull() | (F.col("n") >= least)), "collocation-words")
    sums = words.agg(F.count("word").alias("listed"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("tokens")).first()
    listed = words.where("word IS NOT NULL")
    complete = sums["listed"] <= LISTED
    if not complete:
        listed = listed.orderBy(F.desc("n"), "lang", "word").limit(LISTED)
    ranges = max(1, -(-(sums["tokens"] or 0) // TOKENS_PER_RANGE))
    hops = []  # numbers of ranges, coarse to fine
    while not hops or hops[0] > FAN:
        hops.insert(0, ranges if not hops else -(-hops[0] // FAN))
    table = listed.toArrow()
    order = pc.sort_indices(pa.table({"lang": table["lang"].cast(pa.binary()), "word": table["word"].cast(pa.binary())}), [("lang", "ascending"), ("word", "ascending")])
    shared = spark.sparkContext.broadcast(Roots(table.take(order), ranges, complete))
    salts = [max(1, ranges // n) for n in hops]  # tasks that share a coarse range
    pieces = texts.mapInArrow(_shard_tries(shared, FLUSH, hops[0], salts[0]), _PIECES)
    if not complete:
        pieces = scratch.written(pieces, "collocation-pieces")
    tries = pieces.where("piece IS NOT NULL")
    for k, n in enumerate(hops):
        dealt = tries.select("part", "piece", "salt").repartition(min(ranges, 1 << 17), "part", "salt").sortWithinPartitions("part").select("part", "piece")
        if k + 1 < len(hops):
            tries = dealt.mapInArrow(_further(shared, hops[k + 1], salts[k + 1]), _PIECES)
        else:
            grams = dealt.mapInArrow(_frequent(shared, least), _GRAMS)
    if not complete:
        rest = pieces.where("piece IS NULL").groupBy("lang", "w").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        grams = grams.unionByName(rest, allowMissingColumns=True)
    return words, scratch.written(grams, "collocation-phrases")


def _score(a, left, right):
    """floor(1000000 a a / (left right)) in exact decimals."""
    wide = [x.cast("decimal(19,0)") for x in (a, a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)").cast("decimal(19,0)") * wide[0] * wide[1], wide[2] * wide[3])


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of 2 and 3 words of each lang: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, l and r the parts of its lowest-scoring cut (of equal ones the first), n all words of the lang;
    score is floor(1000000 a a / (l r)).  A pair that lies in a triple of min_count or more with 2 f(triple) >= a is dropped.
    Order: score and a descending, phrase ascending.

    Defined cases: null and empty texts have no words; null langs count as und; repeated rows count as often as they
    stand; an empty table gives no row; further columns are not read.
    """
    scratch = Scratch()
    words, grams = frequent_phrases(docs, min_count, scratch, text_col, lang_col)
    pairs = grams.where(F.size("w") == 2)
    triples = grams.where(F.size("w") == 3)
    single = words.where("word IS NOT NULL")
    bare = grams.where("f1 IS NULL")  # phrases with unlisted words; without any, the joins below have nothing to do
    if not bare.isEmpty():
        ends = single.select("lang", F.col("word").alias("head"), F.col("n").alias("n1")), single.select("lang", F.col("word").alias("tail"), F.col("n").alias("n2"))
        filled = bare.withColumns({"head": F.col("w")[0], "tail": F.element_at("w", -1)}).join(ends[0], ["lang", "head"]).join(ends[1], ["lang", "tail"])
        firsts = pairs.select("lang", F.col("w").alias("front"), F.col("a").alias("n12"))
        filled = filled.withColumn("front", F.slice("w", 1, 2)).join(firsts, ["lang", "front"]).select("lang", "w", "a", F.col("n1").alias("f1"), F.col("n12").alias("f12"), F.col("n2").alias("f_last"))
        grams = scratch.written(grams.where("f1 IS NOT NULL").unionByName(filled), "collocation-filled")
        pairs, triples = grams.where(F.size("w") == 2), grams.where(F.size("w") == 3)
    suffix = pairs.select("lang", F.col("w").alias("back"), F.col("a").alias("f23"))
    triples = triples.withColumn("back", F.slice("w", 2, 2)).join(suffix, ["lang", "back"])
    one, two = _score(F.col("a"), F.col("f1"), F.col("f23")), _score(F.col("a"), F.col("f12"), F.col("f_last"))
    cut = F.when(one <= two, F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"), one.alias("score"))).otherwise(F.struct(F.col("f12").alias("l"), F.col("f_last").alias("r"), two.alias("score")))
    long = triples.select("lang", "w", "a", cut.alias("cut")).select("lang", "w", "a", "cut.*")
    inner = F.explode(F.array(F.slice("w", 1, 2), F.slice("w", 2, 2)))
    covered = grams.where(F.size("w") == 3).select("lang", inner.alias("w"), F.col("a").alias("longer")).groupBy("lang", "w").agg(F.max("longer").alias("longer"))
    short = pairs.join(covered, ["lang", "w"], "left").where("longer IS NULL OR 2 * longer < a")
    short = short.select("lang", "w", "a", F.col("f1").alias("l"), F.col("f_last").alias("r"), _score(F.col("a"), F.col("f1"), F.col("f_last")).alias("score"))
    best = short.unionByName(long).withColumn("phrase", F.concat_ws(" ", "w"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first the best of shares of each lang, then the best of those: no task sorts a lang
    shares = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    best = best.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.where("word IS NULL").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
