"""Components, cycles, levels, grids and ranks against plain versions, on the driver's path and on the rounds of joins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridlake.operators import cells, graph, ranking


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("few", [200_000, 0])
def test_connected(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(few)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 540)]
    got = {r["node"]: r["root"] for r in graph.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [x for x in links if x[0] != x[1]]
    assert got == roots({n for x in links for n in x}, links)
    assert graph.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def reach(edges):
    out = {}
    for a, _ in edges:
        seen, todo = set(), [a]
        while todo:
            for s, t in edges:
                if s == todo[0] and t not in seen:
                    seen.add(t)
                    todo.append(t)
            todo.pop(0)
        out[a] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(18), rng.randrange(18)) for _ in range(22)] + [(30, 31), (31, 30), (40, 40), (31, 50), (50, 51)]
    far = reach(edges)
    want = {n: min(m for m in seen if m in far and n in far[m]) for n, seen in far.items() if n in seen}
    nodes = spark.createDataFrame([(n,) for n in range(60)], "node long")
    got = {r["node"]: r["cycle"] for r in graph.cycles(nodes, spark.createDataFrame(edges, "source long, target long")).collect()}
    assert got == want and {30, 31, 40} <= set(got) and 50 not in got


def test_no_cycles_and_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)], "source long, target long")
    nodes = spark.createDataFrame([(k,) for k in range(13)], "node long")
    assert graph.cycles(nodes, edges).count() == 0 and not graph.has_cycle(nodes, edges)
    levels = graph.generations(nodes, edges)
    assert {r["node"]: r["level"] for r in levels.collect()} == {k: k for k in range(13)}
    assert levels._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0  # levels are one table
    assert sorted(r["node"] for r in graph.descendants(nodes.where("node = 9"), edges).collect()) == [9, 10, 11, 12]


def test_edge_problems(spark):
    ports = spark.createDataFrame([(n, side, p) for n in (1, 2, 3) for side, p in (("out", "o"), ("in", "i"), ("in", "j"))], "node long, side string, port string")
    rows = [
        (1, 1, 2, "o", "i", "yes"), (2, 1, 2, "o", "i", "no"),  # branches of one source: no conflict
        (3, 1, 3, "o", "i", "yes"), (4, 1, 3, "o", "i", "yes"),  # the same branch twice
        (5, 1, 2, "o", "j", None), (6, 3, 2, "o", "j", None), (6, 3, 1, "x", "i", None), (7, 2, 2, "o", "z", None),
    ]
    edges = spark.createDataFrame(rows, "edge_id long, source long, target long, output string, input string, branch string")
    got = sorted((r["problem"], r["item"]) for r in graph.edge_problems(edges, ports).collect())
    assert got == [("duplicate_edge", "6"), ("input_conflict", "2:j"), ("input_conflict", "3:i"), ("self_edge", "7"), ("unknown_input", "7"), ("unknown_output", "6")]


@pytest.mark.parametrize("few", [200_000, 0])
def test_components_over_strips(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(cells, "STRIP_ROWS", 4)
    rng = random.Random(8)
    places = {("a", rng.randrange(-6, 16), rng.randrange(12)) for _ in range(130)} | {("b", r, 3) for r in range(15)} | {("b", 7, c) for c in range(5, 9)}
    places = {p for p in places if p[1] >= 0}
    links = [(p, q) for p in places for q in places if p < q and p[0] == q[0] and abs(p[1] - q[1]) + abs(p[2] - q[2]) == 1]
    root = roots(places, links)
    number = {r: 1 + sum(x[0] == r[0] and x < r for x in set(root.values())) for r in set(root.values())}
    df = spark.createDataFrame(sorted(places) + [("b", 7, 3)], "sheet string, row int, col int").repartition(3)
    assert {tuple(r)[:3]: r["component"] for r in cells.connected_cells(df).collect()} == {p: number[root[p]] for p in places}


@pytest.mark.parametrize("gap,seed", [(0, 1), (1, 2), (3, 3)])
def test_merged_boxes(spark, gap, seed):
    rng = random.Random(seed)
    boxes = []
    for k in range(60):
        r, c = rng.randrange(90), rng.randrange(90)
        boxes.append(("ab"[k % 2], r, r + rng.randrange(6), c, c + rng.randrange(6), rng.randrange(1, 5)))
    want = [list(b) for b in boxes]
    changed = True
    while changed:
        changed = False
        for i in range(len(want)):
            for j in range(i):
                x, y = want[i], want[j]
                if x[0] == y[0] and x[1] <= y[2] + gap + 1 and y[1] <= x[2] + gap + 1 and x[3] <= y[4] + gap + 1 and y[3] <= x[4] + gap + 1:
                    want[j] = [x[0], min(x[1], y[1]), max(x[2], y[2]), min(x[3], y[3]), max(x[4], y[4]), x[5] + y[5]]
                    del want[i]
                    changed = True
                    break
            if changed:
                break
    df = spark.createDataFrame(boxes, "sheet string, min_row int, max_row int, min_col int, max_col int, n_cells long")
    assert sorted(map(list, map(tuple, cells.merged_boxes(df, gap, 3).collect()))) == sorted(w for w in want if w[5] >= 3)


def test_numbers_without_a_single_window(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["x", "y", None, "z" if rng.random() < 0.05 else "x"]), rng.randrange(1000), k) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(5)
    by_key, every = {}, sorted(rows, key=lambda r: (-r[1], r[2]))
    for r in every:
        by_key.setdefault(r[0], []).append(r[2])
    got = ranking.numbered(df, ["k"], [F.desc("v"), F.col("id")], "n")
    assert {r["id"]: r["n"] for r in got.collect()} == {i: n for ids in by_key.values() for n, i in enumerate(ids, 1)}
    got = ranking.numbered(df, [], [F.desc("v"), F.col("id")], "n")
    assert {r["id"]: r["n"] for r in got.collect()} == {r[2]: n for n, r in enumerate(every, 1)}
    values = sorted({r[0] for r in rows if r[0]})
    dense = ranking.dense_numbers(df, "k", "n").select("k", "n").distinct().collect()
    assert {r["k"]: r["n"] for r in dense} == {None: 1} | {v: n for n, v in enumerate(values, 2)}
    assert ranking.numbered(df.limit(0), [], [F.col("v")]).count() == 0
