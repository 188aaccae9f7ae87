"""Conversation structure repair by a scan of min-plus matrices.

A repaired conversation has roles with the initials (s?(ua)+)?.  Four states tell how far one has come: nothing yet, after
the system turn, after a user, after an assistant; it may end in the first or the last.  A turn is a 4x4 matrix: entry
(i, j) is the cheapest (cost, audit) that leads from i to j by what may be done to the turn, followed by insertions (the
insert closure).  Sums take the lesser cost, then the ASCII-least audit; products add costs and join audits.  Two audits
of the same turns and the same cost are never one the beginning of the other, as insertions cost, so the product keeps
their order and is associative: turns are reduced in any tree.

Conversations of up to LONG turns and LONG_BYTES are reduced whole where their turns meet.  Longer ones are put in order
over as many partitions as they need, each block of BLOCK turns becomes one matrix, and rounds of products of FANIN
neighbours reduce the blocks; only the digest, a SHA-256 of one text, and the repaired turns read a conversation in
sequence, as a stream.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

#: Costs of the edits, by the initials that stand in an audit; an undeleted truncated turn costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns and bytes of text beyond which a conversation is handled in blocks; turns of a block; blocks of one product.
LONG, LONG_BYTES, BLOCK, FANIN = 10_000, 1 << 26, 4096, 16
#: Turns whose product is remembered.
_SHORT = 8

Matrix = tuple[tuple[tuple[int, str] | None, ...], ...]


def _matrix(entries: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(tuple(entries.get((i, j)) for j in range(4)) for i in range(4))


#: Where a user's and an assistant's turn lead.
_USER, _ASSISTANT = ((0, 2), (1, 2), (3, 2)), ((2, 3),)
#: Any number of insertions.
CLOSURE = _matrix({(i, i): (0, "") for i in range(4)} | {move: (INSERT, "I") for move in (*_USER, *_ASSISTANT)} | {(0, 3): (2 * INSERT, "II"), (1, 3): (2 * INSERT, "II")})


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product."""
    out = []
    for row in a:
        line = []
        for j in range(4):
            best = None
            for k in range(4):
                x, y = row[k], b[k][j]
                if x is not None and y is not None:
                    cost = x[0] + y[0]
                    if best is None or cost < best[0]:
                        best = (cost, x[1] + y[1])
                    elif cost == best[0]:
                        best = min(best, (cost, x[1] + y[1]))
            line.append(best)
        out.append(tuple(line))
    return tuple(out)


def kind(initial: str, gone: bool, truncated: bool) -> str:
    """A turn in one letter: x must be deleted; s, u, a, o by the role's initial, upper-case if truncated."""
    letter = "x" if gone else initial if initial in ("s", "u", "a") else "o"
    return letter.upper() if truncated and not gone else letter


@functools.cache
def _turn(letter: str) -> Matrix:
    moves = {(i, i): (DELETE, "D") for i in range(4)}
    if letter != "x":
        more = TRUNCATED if letter.isupper() else 0
        own = {"s": ((0, 1),), "u": _USER, "a": _ASSISTANT, "o": ()}[letter.lower()]
        moves |= {move: (REROLE + more, "R") for move in (*_USER, *_ASSISTANT)} | {move: (KEEP + more, "K") for move in own}
    return times(_matrix(moves), CLOSURE)


def product(kinds: str) -> Matrix:
    """The matrix of one turn or more, by halves."""
    if len(kinds) <= _SHORT:
        return _short(kinds)
    half = max(_SHORT, len(kinds) // 2 // _SHORT * _SHORT)
    return times(product(kinds[:half]), product(kinds[half:]))


@functools.lru_cache(1 << 15)
def _short(kinds: str) -> Matrix:
    return _turn(kinds) if len(kinds) == 1 else times(_short(kinds[: len(kinds) // 2]), _short(kinds[len(kinds) // 2 :]))


def cheapest(matrix: Matrix | None) -> tuple[int, str]:
    """Cost and audit of a conversation from the matrix of its turns (None: no turn)."""
    row = (times(CLOSURE, matrix) if matrix else CLOSURE)[0]
    return min(x for x in (row[0], row[3]) if x is not None)


def repaired(audit: Iterable[str], turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what the edits make of (role, text) turns."""
    user, begun = True, False
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "K" and not begun and role[:1] == "s":
            begun = True
            yield edit, role, text
            continue
        if edit != "K":
            role = "user" if user else "assistant"
        user, begun = not user, True
        yield edit, role, text


class _Digest:
    """SHA-256 of role:text lines, joined by newlines."""

    def __init__(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{'\n' if self.any else ''}{role}:{text}".encode())
        self.any = True


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns damaged by crc32 of conv_id:turn modulo 20: 0 drops one (present is false), 1 empties its text, 2 takes its
    [.!?], 3 repeats it, 4 makes its role user.  Nulls of the key, of role and of text count as one space."""

    def given(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    what = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn"))) % 20
    rows = conversations.select("conv_id", "turn", given("role").alias("role"), given("text").alias("text"), what.alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("what") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("what") != 0).alias("present"), copies.cast("long").alias("copies"))


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORT_NAMES = [c.split()[0] for c in _REPORT.split(", ")]
_REPORT_SCHEMA = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in _REPORT_NAMES])
_CHUNK = 2000


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, batch.num_rows, _CHUNK):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, _CHUNK).columns), strict=True)


def _conversation(rows: Iterable[tuple]) -> tuple:
    """Report of one conversation; rows (conv_id, turn, role, text, present, copies, last) in order."""
    seen, kinds, turns, found = set(), [], [], []
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    conv = None
    for conv, turn, role, text, present, copies, last in rows:
        if not present:
            continue
        for _ in range(copies):
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            if fault:
                counts[fault] += 1
            seen.add((role, text))
            kinds.append(kind(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            found.append((role, text))
        if turn is not None:
            turns.append(turn)
    illegal = sum(not _legal(a[0][:1], b[0][:1]) for a, b in itertools.pairwise(found))
    cost, audit = cheapest(product("".join(kinds)) if kinds else None)
    digest = _Digest()
    for _, role, text in repaired(audit, iter(found)):
        digest.add(role, text)
    gaps = turns and turns[-1] - turns[0] + 1 - len(set(turns)) or 0
    return conv, gaps, *counts.values(), illegal, cost, audit, digest.sha.hexdigest()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    each = (_conversation(rows) for _, rows in itertools.groupby(_rows(batches), lambda r: r[0]))
    while chunk := list(itertools.islice(each, _CHUNK)):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*chunk, strict=True), _REPORT_SCHEMA.types, strict=True)], schema=_REPORT_SCHEMA)


# -- long conversations ----------------------------------------------------------------------------------------------

_CELLS = "cells array<struct<cost:long,audit:string>>"
_PART = f"conv_id long, block long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, head string, tail string, {_CELLS}"
_PART_NAMES = ["conv_id", "block", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "head", "tail", "cells"]
_PART_SCHEMA = pa.schema([(c, pa.string() if c in ("head", "tail") else pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])) if c == "cells" else pa.int64()) for c in _PART_NAMES])


def _part(conv: int | None, block: int, turns: list[dict]) -> dict:
    """What is to be known of a block: its faults, its ends and its matrix."""
    out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"conv_id": conv, "block": block, "low": None, "high": None, "head": turns[0]["initial"], "tail": turns[-1]["initial"]}
    kinds, before = [], None
    for t in turns:
        n, more = t["copies"], t["copies"] - 1
        fault = "blank" if not t["last"] else "duplicate" if not t["first"] else "truncated" if t["last"] not in ".!?" else None
        if fault == "blank":
            out["blank"] += n
        else:
            out["duplicate"] += more
            if fault:
                out[fault] += 1
        kinds.append(kind(t["initial"], fault in ("blank", "duplicate"), fault == "truncated") + "x" * more)
        out["illegal"] += more + (before is not None and not _legal(before, t["initial"]))
        before = t["initial"]
        if t["turn"] is not None:
            out["turns"] += t["turn"] != out["high"]
            out["low"] = t["turn"] if out["low"] is None else out["low"]
            out["high"] = t["turn"]
    return out | {"cells": _cells(product("".join(kinds)))}


def _cells(matrix: Matrix) -> list[dict | None]:
    return [x and {"cost": x[0], "audit": x[1]} for row in matrix for x in row]


def _of_cells(cells: list[dict | None]) -> Matrix:
    flat = [x and (x["cost"], x["audit"]) for x in cells]
    return tuple(tuple(flat[k : k + 4]) for k in range(0, 16, 4))


def _joined(a: dict, b: dict) -> dict:
    """Two neighbours as one."""
    out = {c: a[c] + b[c] for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += not _legal(a["tail"], b["head"])
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out |= {"head": a["head"], "tail": b["tail"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}
    return out | {"cells": _cells(times(_of_cells(a["cells"]), _of_cells(b["cells"])))}


def _tree(parts: list[dict]) -> dict:
    while len(parts) > 1:
        parts = [_joined(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield pa.RecordBatch.from_pylist([_part(row["conv_id"], row["block"], row["held"])], schema=_PART_SCHEMA)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield pa.RecordBatch.from_pylist([_tree(row["held"]) | {"conv_id": row["conv_id"], "block": row["block"]}], schema=_PART_SCHEMA)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The report of each conversation, but for the digest."""
    for batch in batches:
        for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            cost, audit = cheapest(_of_cells(row["cells"]))
            gaps = 0 if row["low"] is None else row["high"] - row["low"] + 1 - row["turns"]
            yield pa.RecordBatch.from_pylist([{c: row.get(c) for c in _REPORT_NAMES} | {"gaps": gaps, "cost": cost, "audit": audit}], schema=_REPORT_SCHEMA)


def _in_sequence(turns: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, audit, role, text, copies): of each conversation its audit, then its turns in order."""
    heads = report.select("conv_id", F.lit(0).alias("body"), F.col("audit"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"))
    rows = turns.select("conv_id", F.lit(1).alias("body"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies")
    return heads.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "body", "turn", "role", "text").select("conv_id", "audit", "role", "text", "copies")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str, str]]]]:
    """(conv_id, its repaired turns), read as they come."""
    for conv, rows in itertools.groupby(_rows(batches), lambda r: r[0]):
        audit = next(rows)[1]
        yield conv, repaired(audit, ((role, text) for _, _, role, text, copies in rows for _ in range(copies)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv, turns in _streams(batches):
        digest = _Digest()
        for _, role, text in turns:
            digest.add(role, text)
        yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([digest.sha.hexdigest()])], names=["conv_id", "repaired_sha256"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv, turns in _streams(batches):
        numbered = enumerate(turns)
        while chunk := list(itertools.islice(numbered, _CHUNK)):
            yield pa.record_batch([pa.array([conv] * len(chunk), pa.int64()), pa.array([k for k, _ in chunk], pa.int64()), *(pa.array([t[i] for _, t in chunk], pa.string()) for i in range(3))], names=["conv_id", "place", "edit", "role", "text"])


def _reduced(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Reports of long conversations: order over partitions, blocks, rounds of products, digests."""
    same = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    same = same.withColumn("beginning", F.substring("text", 1, 40)).repartitionByRange("conv_id", "turn", "role", "beginning").sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = scratch.written(same.drop("beginning").withColumn("place", F.monotonically_increasing_id()), "conversation-turns")
    low = F.col("place").bitwiseAND((1 << 33) - 1)  # rows of a partition are numbered from its number times 2^33
    most = ordered.agg(F.max(low)).first()[0] or 0
    bits = (most // BLOCK).bit_length()
    block = F.shiftright("place", 33) * (1 << bits) + F.floor(low / BLOCK)
    first = ordered.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("place").alias("first_place")).select("first_place")
    facts = ordered.select("conv_id", block.cast("long").alias("block"), "place", "turn", F.substring("role", 1, 1).alias("initial"), _last("text").alias("last"), "copies")
    facts = facts.join(first, F.col("place") == F.col("first_place"), "left").withColumn("first", F.col("first_place").isNotNull()).drop("first_place")
    held = F.sort_array(F.collect_list(F.struct("place", "turn", "initial", "last", "first", "copies"))).alias("held")
    parts = scratch.written(facts.groupBy("conv_id", "block").agg(held).mapInArrow(_blocks, _PART), "conversation-blocks")
    while not parts.groupBy("conv_id").count().where("count > 1").isEmpty():
        whole = F.sort_array(F.collect_list(F.struct("block", *_PART_NAMES[2:]))).alias("held")
        above = F.floor(F.col("block") / FANIN).cast("long").alias("block")
        parts = scratch.written(parts.groupBy("conv_id", above).agg(whole).mapInArrow(_products, _PART), "conversation-products")
    report = scratch.written(parts.mapInArrow(_ends, _REPORT), "conversation-ends").drop("repaired_sha256")
    digests = _in_sequence(ordered, report).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    digests = digests.withColumnRenamed("conv_id", "of_conv")
    return report.join(digests, F.col("conv_id").eqNullSafe(F.col("of_conv"))).select(_REPORT_NAMES)


def _last(text: str):
    """The last character that is no white space; empty if there is none."""
    return F.substring(F.rtrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), -1, 1)


def _given(turns: DataFrame) -> DataFrame:
    more = {"present": F.lit(True), "copies": F.lit(1).cast("long")}
    cols = [F.col(c) if c in turns.columns else v.alias(c) for c, v in more.items()]
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), *cols)


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns (conv_id, turn, role, text) are taken in order of turn, nulls first, then role and text.  A turn with present
    false only names its conversation; one with copies n stands n times.  A turn's first fault counts: blank, duplicate
    (its role and text stand earlier in the conversation), truncated (it ends without [.!?]).  audit has the cheapest edits
    (K keep, R set the role, D delete, I insert an empty turn) that give roles with the initials (s?(ua)+)?.

    Defined cases: a null conv_id is one conversation; null roles and texts are one space, so blank; null turns have no
    part in gaps; a conversation without turns has zeros, an empty audit and the digest of nothing; repeated rows are
    repeated turns; an empty table gives no row; further columns are not read (present must be boolean, copies a number).
    A conversation's audit must fit a cell; nothing else of a long one is held at once but sixteen audits.
    """
    rows = _given(turns)
    size = F.sum(F.when(F.col("present"), F.col("copies")).otherwise(0))
    room = F.sum(F.when(F.col("present"), F.octet_length("text") * F.col("copies")).otherwise(0))
    long = rows.groupBy("conv_id").agg(size.alias("size"), room.alias("room")).where((F.col("size") > LONG) | (F.col("room") > LONG_BYTES)).select(F.col("conv_id").alias("long_id"))
    short = rows
    scratch = Scratch()
    long = scratch.written(long, "conversation-long")
    some = not long.isEmpty()
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    if some:
        short = rows.join(long, same, "left_anti")
    dealt = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = dealt.select("conv_id", "turn", "role", "text", "present", "copies", _last("text").alias("last")).mapInArrow(_reports, _REPORT)
    if some:
        out = out.unionByName(_reduced(rows.join(long, same, "left_semi").where("present"), scratch))
    return out


def repaired_turns(turns: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every repaired conversation, from what repair() told of them."""
    return _in_sequence(_given(turns).where("present"), report).mapInArrow(_placed, "conv_id long, place long, edit string, role string, text string")
