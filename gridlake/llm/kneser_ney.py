"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, scored from memory maps.

Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end for each text; a text begins after order - 1
starts.  A word is a 64-bit hash, an n-gram the hash of its words' hashes.  The highest order counts places; a lower one
counts the different words that stand before its n-gram; each order has discounts of its own.

Counting.  Map tasks count the n-grams of what they have read and send them on in blobs, one for each GROUP of ranges of
hashes of the last order - 1 words.  A reduce task merges one range after the other; of each it has all n-grams that end alike: it writes their counts,
and the number of words before each ending, which are the counts of the next order.  From there on counts only add up:
what it knows of contexts (the n-gram without its last word) and of shorter endings goes to further ranges as sums.
There is a range for each TOKENS_PER_RANGE tokens, however large the corpus; beyond ONE_HOP ranges blobs are first
gathered for many groups.  Tasks merge counts before they send them, so a word or n-gram of any frequency is one
number from each.

Blobs number their words: a list of common ones is the same for all blobs, of others they hold the hashes.

Files of a model: gram-N-R (keys, counts), context-N-R (keys, how many n-grams of count 1, 2 and more go on from there,
sum of counts) and word-R (keys, counts, counts of order 1), each sorted by key; R orders the ranges.  Words have 64 bits
for a key; n-grams and contexts are told apart by 40 bits within their range, which holds about a million at any size: of
a million look-ups of unknown ones, one finds another.  Contexts that one n-gram of count 1 goes on from are not written:
any known n-gram that a text goes on from is one.  Workers map them
into memory and touch the pages that they look up.  A store that is no file system is read range by range instead; no
copy is kept.
"""

from __future__ import annotations

import collections
import functools
import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, new_path, remove
from .text import U, give_back, mix, string_chunks, word_hashes

ORDER = 3
END, START = U(1), U(2)
#: Tokens that a map task counts together.
_FLUSH = 1_500_000
#: Training tokens for each range of hashes (words: WORD_SHARE times as many), and bytes of text that make a token.
TOKENS_PER_RANGE, WORD_SHARE, BYTES_PER_TOKEN = 1_000_000, 8, 6
#: Ranges of n-grams that go to one task, which merges one after the other: their blobs share a list of words.
GROUP = 8
#: Ranges that blobs are sent to at once; with more, they go by groups of ranges first.
ONE_HOP = 16_384
#: Words with a number of their own in all blobs, the commonest of about COMMON_BYTES of text: they only make blobs smaller.
COMMON, COMMON_BYTES = 65_536, 1 << 24
#: Files that a worker keeps mapped.
_MAPPED = 4096
_ROWS = "kind string, part int, data binary"
_ROW_SCHEMA = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("data", pa.binary())])


# -- arrays in blobs and files ---------------------------------------------------------------------------------------


def _smallest(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of non-negative integers, compressed: first bytes of all values, then their second ones."""
    arrays = [_smallest(a) for a in arrays]
    head = struct.pack(f"<B{2 * len(arrays)}I", len(arrays), *(n for a in arrays for n in (a.itemsize, len(a))))
    body = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays)
    return head + pa.Codec("zstd", 3).compress(body, asbytes=True)


def _steps(ordered: np.ndarray) -> np.ndarray:
    """What to add to reach the next of ordered numbers (np.cumsum undoes it): smaller, so they pack better."""
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def _pack_sums(keys: np.ndarray, *values: np.ndarray) -> bytes:
    return _pack([_steps(keys), *values])


def _unpack(data: bytes | memoryview) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{2 * data[0]}I", data, 1)
    shapes = list(zip(sizes[::2], sizes[1::2], strict=True))
    body = pa.Codec("zstd").decompress(data[1 + 8 * data[0] :], decompressed_size=sum(k * n for k, n in shapes), asbytes=True)
    out, at = [], 0
    for k, n in shapes:
        planes = np.frombuffer(body, np.uint8, k * n, at).reshape(k, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{k}").ravel())
        at += k * n
    return out


@functools.lru_cache(64)
def _target(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def _save(folder: str, name: str, keys: np.ndarray, *values: np.ndarray) -> None:
    """Written under another name first, so that a task that is run again leaves whole files only."""
    store, path = _target(folder)
    store.create_dir(path, recursive=True)
    arrays = [keys, *map(_smallest, values)]
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(struct.pack("<I", len(head)) + head + b" " * (-(len(head) + 4) % 8))
        for a in sorted(arrays, key=lambda a: -a.itemsize):  # so that all stay aligned
            f.write(memoryview(a).cast("B") if len(a) else b"")
    store.move(part, f"{path}/{name}")


def _save_grams(folder: str, name: str, keys: np.ndarray, *values: np.ndarray) -> None:
    """Keys of 40 bits as their first 32 and last 8, and the number of each one's row in the list of different values."""
    order = np.argsort(keys)
    keys, values = keys[order], [v[order] for v in values]
    row, first = np.zeros(len(keys), np.int64), np.zeros(0, np.int64)
    for v in values:
        own, number = np.unique(v, return_inverse=True)
        _, first, row = np.unique(row * len(own) + number, return_index=True, return_inverse=True)
    _save(folder, name, (keys >> U(8)).astype(np.uint32), (keys & U(255)).astype(np.uint8), row, *(v[first] for v in values))


def _views(data: np.ndarray) -> list[np.ndarray]:
    n = int(data[:4].view("<u4")[0])
    shapes = json.loads(bytes(data[4 : 4 + n]))
    at = 4 + n + -(n + 4) % 8
    out: list[np.ndarray] = [data[:0]] * len(shapes)
    for k in sorted(range(len(shapes)), key=lambda k: -np.dtype(shapes[k][0]).itemsize):
        size = np.dtype(shapes[k][0]).itemsize * shapes[k][1]
        out[k] = data[at : at + size].view(shapes[k][0])
        at += size
    return out


_maps: collections.OrderedDict[str, list[np.ndarray]] = collections.OrderedDict()
#: What a range without entries has.
_NOTHING = [np.zeros(0, U)]


def _arrays(folder: str, name: str) -> list[np.ndarray]:
    """The arrays of a file: views of a memory map, or what was read of a store that has none.  A range that has no file has
    no entries; files are found by their names alone, so no list of them is kept anywhere."""
    store, path = _target(folder)
    path = f"{path}/{name}"
    if not isinstance(store, fs.LocalFileSystem):
        try:
            with store.open_input_stream(path) as f:
                return _views(np.frombuffer(f.read(), np.uint8))
        except FileNotFoundError:
            return _NOTHING
    if path in _maps:
        _maps.move_to_end(path)
    else:
        try:
            _maps[path] = _views(np.memmap(path, np.uint8, "r"))
        except FileNotFoundError:
            _maps[path] = _NOTHING
        if len(_maps) > _MAPPED:
            _maps.popitem(last=False)
    return _maps[path]


# -- tokens and hashes -----------------------------------------------------------------------------------------------


def _windows(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each token of all texts the order words that end with it, first words first; and where each text begins."""
    words, first = word_hashes(data, offsets)
    n = len(first) - 1
    pad = order - 1
    size = np.diff(first) + 1
    text = np.repeat(np.arange(n), np.diff(first))
    stream = np.full(len(words) + n * (1 + pad), START, dtype=U)
    stream[np.arange(len(words)) + text + (text + 1) * pad] = words | U(4)  # never START or END
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(begin[-1]) + (np.repeat(np.arange(n), size) + 1) * pad
    stream[at[begin[1:] - 1]] = END
    return [stream[at - pad + k] for k in range(order)], begin


def _hash(words: list[np.ndarray]) -> np.ndarray:
    h = words[-1]
    for w in words[-2::-1]:
        h = mix(h * U(0x9E3779B97F4A7C15) + w)
    return h


def _short(keys: np.ndarray) -> np.ndarray:
    """The 40 bits that tell the n-grams of one range apart."""
    return mix(keys ^ U(0x6A09E667F3BCC909)) >> U(24)


def _starts(n: int) -> np.ndarray:
    """The hash of n starts, the context of a text's first token."""
    return _hash([np.full(1, START, U)] * n)


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key, in the order of the keys."""
    return ((keys >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _shared(order: int) -> int:
    """How many last words of n-grams of this order decide their range when they are counted."""
    return max(2, order - 1)


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, a row of each, and the sums of the values."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], order[first], [np.add.reduceat(v[order], first) if len(keys) else v for v in values]


# -- counting --------------------------------------------------------------------------------------------------------


def _rows(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROW_SCHEMA.types, strict=True)], schema=_ROW_SCHEMA)


def _by_range(kind: str, where: np.ndarray, pack) -> Iterator[tuple[str, int, bytes]]:
    """A row for each range that occurs; pack makes the data of the places of its entries."""
    order = np.argsort(where, kind="stable")
    ordered = where[order]
    for part, a, b in zip(*(x.tolist() for x in _runs(ordered)), strict=True):
        yield kind, part, pack(order[a:b])


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], first, np.append(first[1:], len(ordered))


@dataclass
class Common:
    """The commonest words in order, and where each one stands among their sorted hashes."""

    words: np.ndarray

    def __post_init__(self) -> None:
        self.rank = np.argsort(self.words, kind="stable")
        self.sorted = self.words[self.rank]

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """The place of each word, -1 where it is none of them."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.rank[at], -1)


def _pack_grams(words: list[np.ndarray], count: np.ndarray, places: np.ndarray, within: np.ndarray, common: Common) -> bytes:
    """N-grams of a group of ranges: the words that occur, then for each range numbers into them and counts.

    Common words come first, by their places, so they have small numbers; others by their hashes.  N-grams are in the order of
    the last words, so that endings repeat.
    """
    own, number = np.unique(np.concatenate(words), return_inverse=True)
    rank = common.ranks(own)
    known = np.flatnonzero(rank >= 0)
    known, rest = known[np.argsort(rank[known])], np.flatnonzero(rank < 0)
    place = np.empty(len(own), dtype=np.int64)
    place[np.concatenate([known, rest])] = np.arange(len(own))
    numbers = np.split(place[number], len(words))
    order = np.lexsort([*numbers, within])
    cuts = np.searchsorted(within[order], np.arange(1, GROUP))
    parts = [_pack([_steps(rank[known]), _steps(own[rest])])]
    for at in np.split(order, cuts):
        *front, last = (n[at] for n in numbers)
        same = np.array_equal(count[at], places[at])  # as in the highest order
        parts.append(_pack([*front, _steps(last), count[at], *([] if same else [places[at]])]) if len(at) else b"")
    return struct.pack(f"<{1 + GROUP}I", *map(len, parts)) + b"".join(parts)


def _unpack_grams(data: bytes, common: Common) -> tuple[np.ndarray, list[memoryview]]:
    """The words, and what is packed of each range."""
    ends = np.cumsum([4 * (1 + GROUP), *struct.unpack_from(f"<{1 + GROUP}I", data)]).tolist()
    parts = [memoryview(data)[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    rank, rest = _unpack(parts[0])
    return np.concatenate([common.words[np.cumsum(rank.astype(np.int64))], np.cumsum(rest.astype(U))]), parts[1:]


def _grams(kind: str, words: list[np.ndarray], count: np.ndarray, places: np.ndarray, ranges: int, common: Common) -> Iterator[tuple[str, int, bytes]]:
    """Blobs of n-grams, one for each group of ranges."""
    where = _range(_hash(words[-_shared(len(words)) :]), ranges)
    yield from _by_range(kind, where // GROUP, lambda at: _pack_grams([w[at] for w in words], count[at], places[at], where[at] % GROUP, common))


def _count(order: int, ranges: int, shared):
    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        words = [np.concatenate([h[k] for h in held]) for k in range(order)]
        _, first, n = np.unique(_hash(words), return_index=True, return_counts=True)
        words = [w[first] for w in words]
        rows: list[tuple[str, int, bytes]] = []
        for row in _grams(f"gram-{order}", words, n, n, ranges, shared.value):
            rows.append(row)
            if len(rows) == 64:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, data, off in string_chunks(batch, "text"):
                words, begin = _windows(data, off, order)
                held.append(words)
                n += int(begin[-1])
                if n >= _FLUSH:
                    yield from flush(held)
                    held, n = [], 0
                    give_back()
        if n:
            yield from flush(held)

    return run


def _gathered(ranges: int, shared):
    """Blobs (kind, part, data) of many parts, put together again by part: fewer and larger ones."""

    def joined(held: dict[tuple[str, int], list[bytes]]) -> Iterator[pa.RecordBatch]:
        for (kind, part), blobs in held.items():
            if not kind.startswith("gram"):
                yield _rows([(kind, part, _pack_sums(*_sums(blobs)))])
                continue
            order = int(kind.split("-")[1])
            opened = [_unpack_grams(b, shared.value) for b in blobs]
            found = [g for k in range(GROUP) if (g := _all_grams(opened, order, k))]
            words = [np.concatenate(w) for w in zip(*(g[0] for g in found), strict=True)]
            count, places = (np.concatenate([g[k] for g in found]) for k in (1, 2))
            yield from (_rows([row]) for row in _grams(kind, words, count, places, ranges, shared.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[bytes]] = {}
        size = 0
        for batch in batches:
            for kind, part, data in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                held.setdefault((kind, part), []).append(data)
                size += len(data)
            if size > 64 << 20:
                yield from joined(held)
                held, size = {}, 0
        yield from joined(held)

    return run


def _all_grams(blobs: list[tuple[np.ndarray, list[memoryview]]], order: int, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray] | None:
    """The distinct n-grams of the k-th range of opened blobs with the sums of their two numbers, sorted by hash."""
    parts = []
    for own, ranges in blobs:
        if ranges[k]:
            got = _unpack(ranges[k])
            last = np.cumsum(got[order - 1].astype(np.int64))
            parts.append([*(own[n] for n in (*got[: order - 1], last)), *(x.astype(np.int64) for x in (got[order], got[-1]))])
    if not parts:
        return None
    *words, count, places = (np.concatenate(c) for c in zip(*parts, strict=True))
    _, row, (count, places) = _grouped(_hash(words), count, places)
    return [w[row] for w in words], count, places


def _sums(blobs: list[bytes]) -> list[np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    parts = [(np.cumsum(keys.astype(U)), *values) for keys, *values in map(_unpack, blobs)]
    keys, *values = (np.concatenate(c) for c in zip(*parts, strict=True))
    keys, _, values = _grouped(keys, *(v.astype(np.int64) for v in values))
    return [keys, *values]


def _counts_of(order: int, count: np.ndarray) -> tuple[str, int, bytes]:
    return "counts", 0, _pack_sums(np.array([order * 8 + k for k in range(1, 5)]), np.array([(count == k).sum() for k in range(1, 5)]))


def _goes_on(words: list[np.ndarray], count: np.ndarray, ranges: int) -> Iterator[tuple[str, int, bytes]]:
    """Sums for the contexts of n-grams: those of count 1, 2 and more, and all counts."""
    full, _, values = _grouped(_hash(words[:-1]), (count == 1).astype(np.int64), (count == 2).astype(np.int64), (count > 2).astype(np.int64), count)
    keys = _short(full)
    order = np.argsort(keys)
    where, keys, values = _range(full, ranges)[order], keys[order], [v[order] for v in values]
    yield from _by_range(f"context-{len(words) - 1}", where, lambda at: _pack_sums(keys[at], *(v[at] for v in values)))


def _merge(folder: str, ranges: int, word_ranges: int, shared):
    """Merge one range of one kind, write its file, and send on what it adds to others."""

    def of(n: int) -> int:
        return word_ranges if n == 1 else ranges

    def grams(words: list[np.ndarray], count: np.ndarray, places: np.ndarray, part: int) -> Iterator[tuple[str, int, bytes]]:
        order = len(words)
        _save_grams(folder, f"gram-{order}-{part:07d}", _short(_hash(words)), count)
        yield _counts_of(order, count)
        yield from _goes_on(words, count, of(order - 1))
        if _shared(order) < order:  # all n-grams with the same ending are here: what stands before it counts it
            words = words[1:]
            keys, row, (count, places) = _grouped(_hash(words), np.ones(len(count), np.int64), places)
            words = [w[row] for w in words]
            _save_grams(folder, f"gram-{order - 1}-{part:07d}", _short(keys), count)
            yield _counts_of(order - 1, count)
            yield from _goes_on(words, count, of(order - 2))
        keys, row, (count, places) = _grouped(_hash(words[1:]), np.ones(len(count), np.int64), places)
        if len(words) == 2:
            yield from _by_range("word", _range(keys, word_ranges), lambda at: _pack_sums(keys[at], places[at], count[at]))
        else:
            yield from _grams(f"gram-{len(words) - 1}", [w[row] for w in words[1:]], count, places, ranges, shared.value)

    def run(table: pa.Table) -> pa.Table:
        kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
        blobs = table["data"].to_pylist()
        if kind.startswith("gram"):
            out, opened = [], [_unpack_grams(b, shared.value) for b in blobs]
            sums: dict[tuple[str, int], list[bytes]] = {}
            for k in range(GROUP):
                if found := _all_grams(opened, int(kind.split("-")[1]), k):
                    for row in grams(*found, part * GROUP + k):
                        if row[0].startswith("gram"):
                            out.append(row)
                        else:
                            sums.setdefault(row[:2], []).append(row[2])
            out += [(*key, _pack_sums(*_sums(blobs)) if len(blobs) > 1 else blobs[0]) for key, blobs in sums.items()]
        else:
            keys, *values = _sums(blobs)
            out = []
            if kind == "counts":
                out.append((kind, 0, _pack_sums(keys, *values)))
            elif kind.startswith("context"):
                stored = (values[0] != 1) | (values[1] + values[2] > 0) | (keys == _short(_starts(int(kind.split("-")[1]))))
                _save_grams(folder, f"{kind}-{part:07d}", keys[stored], *(v[stored] for v in values))
            else:
                _save(folder, f"{kind}-{part:07d}", keys, *values)
            if kind == "word":
                places, count = values
                out.append(_counts_of(1, count))
                out.append(("counts", 0, _pack_sums(np.arange(4), np.array([places.sum(), len(keys), count.sum(), (count > 2).sum()]))))
        give_back()
        return pa.Table.from_batches([_rows(out)] if out else [], schema=_ROW_SCHEMA)

    return run


def _discounts(n: list[int]) -> np.ndarray:
    """D1, D2 and D3+ of modified Kneser-Ney from the numbers of entries that occur 1 to 4 times.

    Where the estimate is none (no such entries, or not between 0 and the count) it is half the count, so that what a
    context leaves to shorter ones is never nothing.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    d = np.array([k - (k + 1) * y * after / here if here else 0.0 for k, here, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))])
    most = np.array([1.0, 2.0, 3.0])
    return np.where((d > 0) & (d <= most), d, most / 2)


@dataclass
class Model:
    """A trained model: where its files are, and its few global numbers."""

    folder: str
    order: int
    ranges: int
    word_ranges: int
    tokens: int = 0  # N
    types: int = 0  # V
    endings: int = 0  # different pairs of words: the sum of all counts of order 1
    spread: float = 1.0  # what order 1 leaves to words never seen
    discounts: dict[int, np.ndarray] = field(default_factory=dict)  # by order

    def delete(self, spark) -> None:
        remove(spark, self.folder)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, off in string_chunks(batch, "text"):
            words, n = np.unique(word_hashes(data, off)[0] | U(4), return_counts=True)
            yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])


def _commonest(texts: DataFrame, size: int) -> Common:
    """The commonest words of a sample of texts, START and END before them."""
    share = min(1_000_000, int(1_000_000 * COMMON_BYTES / max(size, 1)) + 1)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share)
    words = sample.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON - 2).toArrow()
    return Common(np.concatenate([np.array([START, END]), words["word"].to_numpy().view(U)]))


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Count all texts of docs (null: empty) and write the model; what the driver holds is a few sums."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    tmp = Scratch()
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long") + BYTES_PER_TOKEN)).first()[0] or 0
    ranges = 1 + size // (BYTES_PER_TOKEN * TOKENS_PER_RANGE)
    m = Model(new_path(spark, "kneser-ney"), order, ranges, 1 + ranges // WORD_SHARE)
    common = spark.sparkContext.broadcast(_commonest(texts, size))
    merge = _merge(m.folder, m.ranges, m.word_ranges, common)

    def merged(rows: DataFrame) -> DataFrame:
        if m.ranges > ONE_HOP:
            group = F.floor(F.col("part") / int(m.ranges**0.5)).alias("group")
            rows = rows.withColumn("group", group).repartition("kind", "group").mapInArrow(_gathered(m.ranges, common), _ROWS)
        return rows.groupBy("kind", "part").applyInArrow(merge, _ROWS)

    rows = merged(texts.mapInArrow(_count(order, m.ranges, common), _ROWS))
    while order > 3:  # endings whose counts are still to be added up
        rows = tmp.written(rows, "n-gram-sums")
        order = _shared(order) - 1
        more = merged(rows.where(F.col("kind") == f"gram-{order}"))
        rows = rows.where(F.col("kind") != f"gram-{order}").unionByName(more)
    rows = merged(rows).toArrow()
    tmp.clear()
    blobs = rows["data"].to_pylist()
    got = dict(zip(*(x.tolist() for x in _sums(blobs)), strict=True)) if blobs else {}
    m.tokens, m.types, m.endings = (got.get(k, 0) for k in range(3))
    m.discounts = {n: _discounts([got.get(n * 8 + k, 0) for k in range(1, 5)]) for n in range(1, m.order + 1)}
    if m.endings:
        left = np.array([got.get(9, 0), got.get(10, 0), got.get(3, 0)], dtype=np.float64)
        m.spread = float(m.discounts[1] @ left) / m.endings
    return m


# -- scoring ---------------------------------------------------------------------------------------------------------


def _look_up(m: Model, kind: str, keys: np.ndarray, where: np.ndarray, columns: int) -> np.ndarray:
    """The numbers of each key, zeros where it is not known; where: the range of each key."""
    out = np.zeros((columns, len(keys)), dtype=np.int64)
    order = np.argsort(where, kind="stable")
    for part, a, b in zip(*(x.tolist() for x in _runs(where[order])), strict=True):
        known, *values = _arrays(m.folder, f"{kind}-{part:07d}")
        if not len(known):
            continue
        rows = order[a:b]
        if kind == "word":
            at = np.minimum(np.searchsorted(known, keys[rows]), len(known) - 1)
            hit = known[at] == keys[rows]
        else:
            tail, row, *values = values
            short = _short(keys[rows])
            want, rest = (short >> U(8)).astype(np.uint32), (short & U(255)).astype(np.uint8)
            at = np.minimum(np.searchsorted(known, want), len(known) - 1)
            while (on := (known[at] == want) & (tail[at] != rest) & (at < len(known) - 1)).any():
                at = at + on
            hit = (known[at] == want) & (tail[at] == rest)
        rows, at = rows[hit], at[hit]
        if kind != "word":
            at = row[at]
        for o, v in zip(out, values, strict=True):
            o[rows] = v[at]
    return out


def _of_distinct(m: Model, kind: str, words: list[np.ndarray], ranged_by: int, ranges: int, columns: int) -> np.ndarray:
    keys, first, back = np.unique(_hash(words), return_index=True, return_inverse=True)
    where = _range(_hash([w[first] for w in words[-ranged_by:]]), ranges)
    return _look_up(m, kind, keys, where, columns)[:, back]


def _scorer(m: Model):
    def of(n: int) -> int:
        return m.word_ranges if n == 1 else m.ranges

    #: by how many last words the files of each order are ranged: their own, where the next order counted them
    ranged_by, n = {}, m.order
    while n >= 2:
        ranged_by[n] = _shared(n)
        ranged_by.setdefault(_shared(n), _shared(n))
        n = _shared(n) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in string_chunks(batch, "text", 2 << 20):
                words, begin = _windows(data, off, m.order)
                places, count = _of_distinct(m, "word", words[-1:], 1, m.word_ranges, 2)
                base = np.log10((places + 0.5) / (m.tokens + 0.5 * (m.types + 1)))
                p = np.full(len(places), m.spread / (m.types + 1))
                if m.endings:
                    p += np.maximum(count - m.discounts[1][np.clip(count, 1, 3) - 1], 0) * (count > 0) / m.endings
                known = places > 0
                for n in range(2, m.order + 1):
                    *goes_on, total = _of_distinct(m, f"context-{n - 1}", words[-n:-1], n - 1, of(n - 1), 4)
                    once = (total == 0) & np.append(False, known[:-1])  # the context is the n-gram that ended one token before
                    once[begin[:-1]] = False
                    goes_on[0][once] = total[once] = 1
                    (count,) = _of_distinct(m, f"gram-{n}", words[-n:], ranged_by[n], m.ranges, 1)
                    own = np.maximum(count - m.discounts[n][np.clip(count, 1, 3) - 1], 0) * (count > 0)
                    known = count > 0
                    p = np.where(total > 0, (own + m.discounts[n] @ np.array(goes_on) * p) / np.maximum(total, 1), p)
                with np.errstate(divide="ignore"):
                    logs = np.log10(p)
                size = np.diff(begin)
                text = np.repeat(np.arange(len(size)), size)
                out = [np.bincount(text, weights=x, minlength=len(size)) for x in (base, logs)]
                n_known = np.bincount(text, weights=places > 0, minlength=len(size)).astype(np.int64)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(size), pa.array(n_known), *map(pa.array, out)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity of every text.

    base_score is the sum over tokens of log10((c + 0.5) / (N + 0.5 * (V + 1))); score is the model's log10 probability
    of the text, its end included; perplexity is 10 ** (-score / n_tokens).  Defined cases: a null or empty text is its
    end alone; repeated rows and null ids stay as they are; further columns are dropped; with nothing trained every
    token has probability 1.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scorer(shared.value)(batches)

    out = rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
