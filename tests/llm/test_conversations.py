"""Repair against a plain search of all edits, in one piece and in blocks over partitions."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from gridlake.llm import conversations

WS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def search(turns: list[tuple[str, str]], gone: list[bool], late: list[bool]) -> tuple[int, str, list[tuple[str, str]]]:
    """Dijkstra over (turns handled, roles so far as the pattern allows), in order of cost and audit."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        tail = roles[-1:] if roles != "s" else "S"
        if (i, tail) in done:
            continue
        done.add((i, tail))
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(out)

        def go(more, letter, used, line):
            new = roles + line[0][:1] if line else roles
            if re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, audit + letter, i + used, new, (*out, line) if line else out))

        for role in ("user", "assistant"):
            go(5, "I", 0, (role, ""))
            if i < len(turns) and not gone[i]:
                go(1 + 5 * late[i], "R", 1, (role, turns[i][1]))
        if i < len(turns):
            go(2, "D", 1, None)
            if not gone[i] and turns[i][0][:1]:
                go(5 * late[i], "K", 1, turns[i])
    raise AssertionError


def plain(rows: list[tuple]) -> tuple:
    """Report of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, gone, late = set(), [], []
    counts = [0, 0, 0]
    for _, role, text in rows:
        last = text.rstrip(WS)[-1:]
        fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        seen.add((role, text))
        gone.append(fault in (0, 1))
        late.append(fault == 2)
    turns = [r[1:] for r in rows]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    at = [r[0] for r in rows if r[0] is not None]
    cost, audit, out = search(turns, gone, late)
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (max(at) - min(at) + 1 - len(set(at)) if at else 0, *counts, illegal, cost, audit, digest)


def made(seed: int, conversations: int, longest: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for k in range(rng.randrange(0, longest)):
            turn = rng.choice([None, k, k, k, k // 2, k + 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            text = rng.choice(["Yes.", "No!", "why ?\n", "cut off", "cut off ", "", " \t\n", None, f"text {rng.randrange(9)}.", "é. \x0b"])
            rows.append((conv if conv != 3 else None, turn, role, text))
    return rows + rows[:2]


def grouped(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


def reports(df):
    return {r["conv_id"]: tuple(r[c] for c in conversations._REPORT_NAMES[1:]) for r in df.collect()}


@pytest.mark.parametrize("long,room,block,fanin", [(10_000, 1 << 26, 4096, 16), (5, 1 << 26, 2, 2), (0, 1 << 26, 3, 4), (10_000, 20, 1, 2)])
def test_reports(spark, monkeypatch, long, room, block, fanin):
    for name, value in (("LONG", long), ("LONG_BYTES", room), ("BLOCK", block), ("FANIN", fanin)):
        monkeypatch.setattr(conversations, name, value)
    rows = made(7, 40, 9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    report = conversations.repair(df)
    assert reports(report) == {conv: plain(turns) for conv, turns in grouped(rows).items()}
    lines = {}
    for r in conversations.repaired_turns(df, report).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, got in reports(report).items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == got[-1]


def test_product_is_associative():
    rng = random.Random(2)
    for _ in range(50):
        kinds = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randrange(2, 40)))
        cut = rng.randrange(1, len(kinds))
        one = conversations._turn(kinds[0])
        for k in kinds[1:]:
            one = conversations.times(one, conversations._turn(k))
        assert conversations.product(kinds) == one == conversations.times(conversations.product(kinds[:cut]), conversations.product(kinds[cut:]))


def test_damage_and_dropped_conversations(spark):
    rows = [(conv, turn, role, "One. Two!") for conv in range(60) for turn, role in enumerate(("user", "assistant"))] + [(None, None, None, None)]
    want = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        kept = want.setdefault(conv, [])
        role, text = role or " ", text or " "
        if what:
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            kept += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    df = spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, audit string")
    got = reports(conversations.repair(conversations.damaged(df)))
    assert got == {conv: plain(turns) for conv, turns in want.items()}
    assert conversations.repair(conversations.damaged(df.limit(0))).count() == 0
    nothing = conversations.repair(df.selectExpr("conv_id", "turn", "role", "text", "false AS present").limit(1)).first()
    assert (nothing["cost"], nothing["audit"], nothing["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())
