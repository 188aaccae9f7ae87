"""Vectorised words, word hashes and shingles over the string buffers of Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.RandomState(20240607)
BYTE_CODE = _rng.randint(0, 2**32, 256).astype(U) << U(32) | _rng.randint(0, 2**32, 256).astype(U)
_STEP = U(0x9E3779B97F4A7C15)
#: Bytes beyond which a span is hashed by BLAKE2 instead of eight bytes at a time.
_LONG_SPAN = 512

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes: all but the space and \t \n \v \f \r.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes: ASCII letters and every byte of a non-ASCII character.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda pad: None


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and what one batch took is not kept for the next."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def string_chunks(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about max_bytes; a null text has no bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64, count=n + 1 + col.offset)[col.offset :]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and len(bufs[2]) else np.zeros(0, np.uint8)
    if col.null_count:
        valid = np.asarray(col.is_valid())
        if (np.diff(off)[~valid] > 0).any():
            yield from string_chunks(pa.record_batch([col.fill_null("")], names=[column]), column, max_bytes)
            return
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + max_bytes, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
    give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of each text's first word (one more entry than texts)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = word_bytes[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    prev = np.empty(n, dtype=bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~prev | cut[:n]))
    nxt = np.empty(n, dtype=bool)
    nxt[-1] = False
    nxt[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~nxt | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands.

    Each eight bytes go through mix() with all that came before, so there are no families of patterned bytes that hash
    alike, as there are for sums of powers; two different spans meet by chance only.
    """
    n, size = len(data), ends - starts
    padded = np.zeros(n + 16, dtype=np.uint8)
    padded[:n] = data
    eight = np.ndarray((n + 8,), dtype="<u8", buffer=padded, strides=(1,))  # those that begin at each byte
    h = mix(size.astype(U) + _STEP)
    live = np.flatnonzero((size > 0) & (size <= _LONG_SPAN))
    at, left = starts[live], size[live]
    while len(live):
        block = eight[at]
        part = np.flatnonzero(left < 8)
        block[part] &= (U(1) << (left[part] * 8).astype(U)) - U(1)
        h[live] = mix(h[live] ^ (block * _STEP))
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    for k in np.flatnonzero(size > _LONG_SPAN).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and the index of each text's first word."""
    starts, ends, first = word_spans(data, offsets, word_bytes)
    return span_hashes(LOWER[data], starts, ends), first


_SHINGLE = [U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]


def shingle_sets(words: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles in ascending order; a text of fewer words has its whole sequence as one."""
    n = len(words)
    full = np.zeros(max(n - width + 1, 0), dtype=U)
    for k in range(width):
        full += words[k : k + len(full)] * _SHINGLE[k % 5] * U(2 * k + 1)
    full = mix(full)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            h = np.array([b - a], dtype=U)
            for k in range(a, b):
                h = mix(h * _SHINGLE[0] + words[k : k + 1])
            yield h
        else:
            yield words[:0]


def to_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
