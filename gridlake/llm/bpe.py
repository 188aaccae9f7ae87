"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in rank order, into a deterministic automaton over tokens whose accepted paths are exactly the
sequences that byte-pair encoding yields.  It starts with one state and a loop for each byte.  The gadget of a merge
(a, b -> c) adds a c-arc beside each path of an a-arc and a b-arc, and leads the a-arcs to a copy of their target state
that has no b-arc.  All arcs of one token lead to one state throughout, so the automaton is two tables: the state that
each token leads to, and a bit for each state and token that says whether the arc exists.

A word has one accepted path, and so has each of its prefixes; encoding walks all words of a batch forward together,
byte by byte, over a trie of the tokens, and keeps at each position the one token whose arc exists.  Decoding emits the
labels (bytes) of the arcs.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import string_chunks

#: Words kept with their tokens by a worker; it starts anew beyond that.
CACHE_WORDS = 150_000
#: Words of more bytes than this are walked alone, all shorter ones together.
LONG_WORD = 512
_SLICE_BYTES = 1 << 20

# The split pattern of byte-level BPE vocabularies (white space as Unicode's White_Space).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabularies: itself, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    """Tables of the compiled automaton; see the module's docstring."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.special = special
        self.label_end = np.cumsum([len(x) for x in labels], dtype=np.int64)
        self.label_len = np.array([len(x) for x in labels], dtype=np.int32)
        self.label_bytes = np.frombuffer(b"".join(labels), dtype=np.uint8)
        self._compile(labels, merges)
        self._index(labels)

    def _compile(self, labels: list[bytes], merges: list[tuple[int, int, int]]) -> None:
        size = len(labels)
        loops = [t for t, x in enumerate(labels) if len(x) == 1]
        planes = np.zeros((64, size), dtype=np.uint64)  # planes[s // 64, t] has bit s % 64: state s has an arc t
        planes[0, loops] = 1
        target = np.zeros(size, dtype=np.int64)
        arrivals = [1 + len(loops)]  # of each state: tokens that lead to it; the start state counts once more
        one = np.uint64(1)
        for a, b, c in merges:
            q = int(target[a])
            if not planes[q >> 6, b] >> np.uint64(q & 63) & one:
                continue
            target[c] = target[b]
            arrivals[target[b]] += 1
            if arrivals[q] > 1:
                new = len(arrivals)
                if new >> 6 >= len(planes):
                    planes = np.concatenate([planes, np.zeros((64, size), dtype=np.uint64)])
                planes[new >> 6] |= (planes[q >> 6] >> np.uint64(q & 63) & one) << np.uint64(new & 63)
                arrivals[q] -= 1
                arrivals.append(1)
                target[a] = q = new
            planes[q >> 6, b] &= ~(one << np.uint64(q & 63))
            planes[:, c] = planes[:, a]
        live = np.unique(np.append(target, 0))
        self.state = np.searchsorted(live, target).astype(np.int32)
        # tokens with the same arcs share a column
        keys = np.random.RandomState(7).randint(0, 2**62, size=len(live)).astype(np.uint64)
        sums = np.zeros(size, dtype=np.uint64)
        for k, s in enumerate(live.tolist()):
            sums += (planes[s >> 6] >> np.uint64(s & 63) & one) * keys[k]
        _, first, column = np.unique(sums, return_index=True, return_inverse=True)
        self.column = column.astype(np.int32)
        kept = planes[:, first]
        self.arcs = np.stack([np.packbits((kept[s >> 6] >> np.uint64(s & 63) & one).astype(bool)) for s in live.tolist()])

    def _index(self, labels: list[bytes]) -> None:
        nodes: dict[tuple[int, int], int] = {}
        token = [-1]
        for t, x in enumerate(labels):
            if t in self.special.values():
                continue
            at = 0
            for byte in x:
                nxt = nodes.get((at, byte))
                if nxt is None:
                    nxt = nodes[at, byte] = len(token)
                    token.append(-1)
                at = nxt
            token[at] = t
        self.token = np.array(token, dtype=np.int32)
        key = np.array([n * 256 + b for n, b in nodes], dtype=np.int64)
        child = np.array(list(nodes.values()), dtype=np.int32)
        self.bits = max(8, int(len(key) * 4 - 1).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_child = np.zeros(1 << self.bits, dtype=np.int32)
        at = self._slot(key)
        left = np.arange(len(key))
        while len(left):
            free = self.slot_key[at[left]] < 0
            _, first = np.unique(at[left][free], return_index=True)
            put = left[free][first]
            self.slot_key[at[put]], self.slot_child[at[put]] = key[put], child[put]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + (self.slot_key[at[left]] >= 0)) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node, 0 where it has none."""
        key = node.astype(np.int64) * 256 + byte
        at = self._slot(key)
        out = np.zeros(len(key), dtype=np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            found = self.slot_key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_child[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words in one array, number of tokens of each word)."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(size, kind="stable")
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        a = 0
        while a < len(order):
            b = a + 1
            longest = int(size[order[a]])
            if longest > LONG_WORD:
                got = self._walk_alone(words[order[a]])
                parts.append((order[a:b], got, np.array([len(got)])))
                a = b
                continue
            while b < len(order) and size[order[b]] <= 2 * longest + 4 and (b - a + 1) * size[order[b]] < 400_000:
                b += 1
            parts.append((order[a:b], *self._walk([words[k] for k in order[a:b]], size[order[a:b]])))
            a = b
        count = np.zeros(len(words), dtype=np.int64)
        for rows, _, n in parts:
            count[rows] = n
        begin = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), dtype=np.int32)
        for rows, got, n in parts:
            ids[np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(len(got))] = got
        return ids, count

    def _walk(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), int(size.max())
        grid = np.zeros((n, width), dtype=np.uint8)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        grid[np.arange(width) < size[:, None]] = flat
        last = np.full((n, width + 1), -1, dtype=np.int32)
        for j in range(width):
            rows = np.flatnonzero(size > j)
            at = self.state[last[rows, j]] if j else np.zeros(len(rows), dtype=np.int32)
            node = np.zeros(len(rows), dtype=np.int32)
            k = j
            while len(rows):
                node = self._step(node, grid[rows, k])
                k += 1
                go = node > 0
                rows, node, at = rows[go], node[go], at[go]
                t = self.token[node]
                has = np.flatnonzero(t >= 0)
                col = self.column[t[has]]
                ok = has[(self.arcs[at[has], col >> 3] >> (7 - (col & 7))) & 1 == 1]
                last[rows[ok], k] = t[ok]
                more = size[rows] > k
                rows, node, at = rows[more], node[more], at[more]
        # backwards from the ends
        out = np.empty((n, width), dtype=np.int32)
        count = np.zeros(n, dtype=np.int64)
        rows, pos = np.arange(n), size.copy()
        k = 0
        while len(rows):
            t = last[rows, pos]
            out[rows, k] = t
            k += 1
            count[rows] = k
            pos = pos - self.label_len[t]
            rows, pos = rows[pos > 0], pos[pos > 0]
        rank = count[:, None] - 1 - np.arange(width)
        keep = rank >= 0
        return np.take_along_axis(out, np.maximum(rank, 0), axis=1)[keep], count

    @functools.cached_property
    def _lists(self) -> tuple[dict[int, int], list[int], list[int], list[int], bytes]:
        """The tables as plain lists, for one step at a time."""
        used = self.slot_key >= 0
        return dict(zip(self.slot_key[used].tolist(), self.slot_child[used].tolist(), strict=True)), self.token.tolist(), self.state.tolist(), self.column.tolist(), self.arcs.tobytes()

    def _walk_alone(self, word: bytes) -> np.ndarray:
        """The tokens of one long word: the same transitions, without the cost of arrays of one row."""
        child, token, state, column, arcs = self._lists
        width, n = self.arcs.shape[1], len(word)
        last = [-1] * (n + 1)
        for j in range(n):
            row = (state[last[j]] if j else 0) * width
            node, k = 0, j
            while k < n:
                node = child.get(node * 256 + word[k])
                if node is None:
                    break
                k += 1
                t = token[node]
                if t >= 0:
                    col = column[t]
                    if arcs[row + (col >> 3)] >> (7 - (col & 7)) & 1:
                        last[k] = t
        out = []
        while n:
            out.append(last[n])
            n -= int(self.label_len[last[n]])
        return np.array(out[::-1], dtype=np.int32)

    def labels_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, end of each id's bytes)."""
        n = self.label_len[ids].astype(np.int64)
        end = np.cumsum(n)
        at = np.repeat(self.label_end[ids] - end, n) + np.arange(int(end[-1]) if len(end) else 0)
        return self.label_bytes[at], end


@functools.lru_cache(maxsize=2)
def compiled(path: str) -> Automaton:
    """The automaton of a tokenizer file (byte-level BPE, JSON as the tokenizers library writes it)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], _byte_letters()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    vocab = model["vocab"] | special
    labels = [b""] * (max(vocab.values()) + 1)
    for x, t in vocab.items():
        labels[t] = x.encode() if x in special else bytes(letters[c] for c in x)
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    return Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)


class _Encoder:
    """Encodes slices of texts, with the tokens of the words met so far."""

    def __init__(self, dfa: Automaton):
        self.dfa = dfa
        self.split = regex.compile(SPLIT).findall
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(dfa.special, key=len, reverse=True))) + ")").split if dfa.special else None
        self.index: dict[str, int] = {}

    def _words(self, text: str) -> list[str]:
        if self.apart and any(s in text for s in self.dfa.special):
            out: list[str] = []
            for part in self.apart(text):
                out += [part] if part in self.dfa.special else self.split(part)
            return out
        return self.split(text)

    def ids_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin and the last one's end)."""
        words: list[str] = []
        edge = [0]
        for text in texts:
            if text:
                words += self._words(text)
            edge.append(len(words))
        if not self.index or len(self.index) > CACHE_WORDS:
            self.index = {s: k for k, s in enumerate(self.dfa.special)}
            self.ids, self.end = np.array(list(self.dfa.special.values()), dtype=np.int32), np.arange(len(self.dfa.special) + 1)
        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        if new:
            got, n = self.dfa.encode_words([w.encode() for w in new])
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.ids, self.end = np.concatenate([self.ids, got]), np.concatenate([self.end, self.end[-1] + np.cumsum(n)])
        w = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
        n = self.end[w + 1] - self.end[w]
        stop = np.cumsum(n)
        flat = self.ids[np.repeat(self.end[w + 1] - stop, n) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return flat, np.concatenate([[0], stop])[np.array(edge)]


def _texts(dfa: Automaton, ids: np.ndarray, edge: np.ndarray) -> pa.Array:
    """The decoded texts whose ids stand between the edges."""
    data, end = dfa.labels_of(ids)
    raw, at = data.tobytes(), np.concatenate([[0], end])[edge].tolist()
    return pa.array([raw[x:y].decode("utf-8", errors="replace") for x, y in zip(at, at[1:], strict=False)], pa.string())


def _encoder(automaton, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfa = automaton.value
        encoder = _Encoder(dfa)
        for batch in batches:
            texts = batch.column(1)
            for a, b, _, _ in string_chunks(batch, "text", _SLICE_BYTES):
                flat, edge = encoder.ids_of(texts.slice(a, b - a).to_pylist())
                out = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat))]
                if decoded:
                    out.append(_texts(dfa, flat, edge))
                yield pa.record_batch(out, names=["doc_id", "ids", "decoded"][: len(out)])

    return run


def _decoder(automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfa = automaton.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column(batch.schema.get_field_index("ids"))
                edge = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                text = _texts(dfa, lists.flatten().to_numpy(zero_copy_only=False), edge)
                kept = [part.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "ids"]
                yield pa.record_batch([*kept, text], names=[*(n for n in batch.schema.names if n != "ids"), "decoded"])

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, as the tokenizer's own library gives them without added tokens.

    tokenizer is a file on the driver; the compiled tables (bounded by the vocabulary) are broadcast.  A special token's
    string in a text is that token.  Defined cases: a null or empty text has no ids; repeated rows and null ids of
    documents stay as they are; further columns are dropped; words and texts may be of any length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compiled(tokenizer))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoder(shared, False), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): decode(encode(docs)) with the ids, in one pass: ids do not leave the worker in between."""
    shared = docs.sparkSession.sparkContext.broadcast(compiled(tokenizer))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoder(shared, True), "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, tokenizer: str, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, decoded) of (doc_id, ids): the labels of the ids, special tokens included; no ids give the empty text.

    keep names further columns to carry along.  Bytes that are no valid UTF-8 become U+FFFD.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(compiled(tokenizer))
    rows = encoded.select("doc_id", *(keep or []), "ids")
    fields = ", ".join(f"`{n}` {kind}" for n, kind in rows.dtypes if n != "ids")
    return rows.mapInArrow(_decoder(shared), f"{fields}, decoded string")
