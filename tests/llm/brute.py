"""Plain versions of the operators, on lists of rows like those of messy.rows()."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

from gridlake.llm import language_id, licenses, line_dedup, mixing
from gridlake.llm.text import mix, span_hashes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = "[^\x20\x09-\x0d]+"


def words(text):
    return re.findall(WORD, (text or "").translate(LOW))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def shingles(text, width):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near_groups(data, width, threshold):
    """(doc_id, n_shingles, n_links, component_id) for each row."""
    sets = {r[0]: shingles(r[1], width) for r in data}
    times = Counter(r[0] for r in data)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and threshold[1] * len(sets[a] & sets[b]) >= threshold[0] * len(sets[a] | sets[b])]
    n = {i: times[i] - 1 if sets[i] else 0 for i in sets}
    for a, b in links:
        n[a] += times[b]
        n[b] += times[a]
    root = roots(sets, links)
    return sorted((r[0], len(sets[r[0]]), n[r[0]], root[r[0]]) for r in data)


def deduplicated_lines(data):
    """{(doc_id, text, lines removed, lines)}"""
    data = sorted({r[:2] for r in data}, key=lambda r: r[0])
    lines = [(i, k, tuple(words(x))) for i, t in data for k, x in enumerate((t or "").split("\n"))]
    first = {}
    for i, k, w in lines:
        if len(w) >= line_dedup.MIN_WORDS and w not in first:
            first[w] = (i, k)
    near = {w for w in first if any(first[v] < first[w] and line_dedup.one_edit_apart(list(v), list(w)) for v in first)}
    gone = {(i, k) for i, k, w in lines if w in first and (w in near or first[w] != (i, k))}
    out = set()
    for i, t in data:
        kept = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone]
        out.add((i, None if t is None else "\n".join(kept), sum(a == i for a, _ in gone), len(t.split("\n")) if t is not None else 0))
    return out


def letter_words(text):
    """Runs of ASCII letters and characters beyond ASCII."""
    return re.findall("[a-z\u0080-\U0010ffff]+", (text or "").translate(LOW))


def languages(data):
    """{doc_id: (language, probability)} of a model of the same rows."""
    top = language_id.MAX_GRAM
    counts = {k: defaultdict(Counter) for k in range(top + 1)}
    for r in data:
        if r[1] is not None and r[2] is not None:
            for w in letter_words(r[1]):
                counts[0][w][r[2]] += 1
                for n in range(1, top + 1):
                    for k in range(len(w) - n + 1):
                        counts[n][w[k : k + n]][r[2]] += 1
    langs = sorted({r[2] for r in data if r[1] is not None and r[2] is not None})
    sums = {k: {x: sum(c[x] for c in counts[k].values()) for x in langs} for k in counts}

    def log(kind, key, x):
        return math.log((counts[kind][key][x] + 0.5) / (sums[kind][x] + 0.5 * (len(counts[kind]) + 1)))

    def word(w):
        if w in counts[0]:
            return [log(0, w, x) for x in langs]
        total, places = [0.0] * len(langs), 0
        for k in range(len(w)):
            for n in range(min(top, len(w) - k), 0, -1):
                if w[k : k + n] in counts[n]:
                    total = [t + log(n, w[k : k + n], x) for t, x in zip(total, langs, strict=True)]
                    places += 1
                    break
        return [t / min(max(places, 1), language_id.UNIT) for t in total]

    out = {}
    for r in data:
        if not any(map(str.isalpha, r[1] or "")):
            out[r[0]] = (language_id.UNKNOWN, 0.0)
            continue
        total = [sum(c) for c in zip(*map(word, letter_words(r[1])), strict=True)]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        out[r[0]] = (langs[best], 1 / sum(math.exp(t - total[best]) for t in total))
    return out


def terms(text):
    """Hashed terms of a text: its words, and the first five bytes of longer ones."""
    out = set()
    for w in letter_words(text):
        raw = np.frombuffer(w.encode(), dtype=np.uint8)
        out.add(int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0] >> np.uint64(40)))
        if len(raw) > 5:
            out.add(int(mix(span_hashes(raw, np.array([0]), np.array([5])))[0] >> np.uint64(40)))
    return sorted(out)


def kneser_ney(train, texts, order):
    """(tokens, known, training tokens, base score, score) of each text, with dictionaries."""
    pad = ["<s>"] * (order - 1)
    grams = {n: Counter() for n in range(1, order + 1)}
    count = Counter()
    for t in train:
        w = [*pad, *words(t), None]
        count.update(w[order - 1 :])
        grams[order].update(tuple(w[k : k + order]) for k in range(len(w) - order + 1))
    for n in range(order - 1, 0, -1):
        grams[n].update(g[1:] for g in grams[n + 1])
    total, v = sum(count.values()), len(count)

    def discounts(values):
        c = Counter(values)
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + c[2] else 0
        d = [k - (k + 1) * y * c[k + 1] / c[k] if c[k] else 0.0 for k in (1, 2, 3)]
        return [x if 0 < x <= k else k / 2 for k, x in enumerate(d, 1)]

    d = {n: discounts(grams[n].values()) for n in grams}
    after = {n: defaultdict(list) for n in grams}
    for n in grams:
        for g, c in grams[n].items():
            after[n][g[:-1]].append(c)

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / (v + 1)
        seen = after[n].get(g[:-1])
        if not seen:
            return lower
        c = grams[n][g]
        return (max(c - d[n][min(max(c, 1), 3) - 1], 0) * (c > 0) + sum(d[n][min(x, 3) - 1] for x in seen) * lower) / sum(seen)

    out = []
    for t in texts:
        w = [*pad, *words(t), None]
        own = w[order - 1 :]
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (v + 1))) for x in own)
        out.append((len(own), sum(count[x] > 0 for x in own), total, base, sum(math.log10(p(tuple(w[k : k + order]))) for k in range(len(own)))))
    vocabulary = [*count, "a word never seen"]
    assert abs(sum(p((*["the"] * (order - 1), b)) for b in vocabulary) - 1) < 1e-9
    return out


def license_blocks(rows):
    """{(doc_id, first word, width, template)} of the windows that a template is contained in."""
    out = set()
    for t in licenses.templates():
        for i, text in rows:
            w = re.findall(licenses.WORD, (text or "").lower())
            for k in range(0, len(w), t.width):
                run = w[k : k + 2 * t.width]
                if len(set(run) & set(t.tokens)) >= t.need and f" {t.key} " in f" {' '.join(run)} ":
                    out.add((i, k, 2 * t.width, t.number))
    return out


def topic(text):
    if text is None:
        return "prose"
    if " | " in text:
        return "table"
    if "license" in text.lower():
        return "notice"
    return "contact" if re.search(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+|\+[0-9]+ ", text) else "prose"


def mixed(rows, keep):
    """(tokens, probability, kept) of each row, a dictionary with a topic."""
    keys = [(r["source"] or "(none)", r["lang"] or "(none)", r["topic"]) for r in rows]
    cells = defaultdict(int)
    for k, r in zip(keys, rows, strict=True):
        cells[k] += len(words(r["text"]))
    share = {k: float(n) for k, n in cells.items()}
    for _ in range(mixing.ROUNDS):
        for d, name in enumerate(mixing.DIMENSIONS):
            of = defaultdict(int)
            for k, n in cells.items():
                of[k[d]] += n
            power = {c: n ** mixing.TEMPERING[name] if n else 0 for c, n in of.items()}
            sums = defaultdict(float)
            for k, s in share.items():
                sums[k[d]] += s
            share = {k: s * power[k[d]] / sum(power.values()) / sums[k[d]] if sums[k[d]] else 0 for k, s in share.items()}
    total = sum(cells.values())
    low, high = 0.0, 1e9  # the level at which capped cells give the budget, by bisection
    for _ in range(200):
        level = (low + high) / 2
        given = sum(min(n, level * share[k]) for k, n in cells.items())
        low, high = (level, high) if given < keep * total else (low, level)
    out = []
    for k, r in zip(keys, rows, strict=True):
        p = min(1.0, level * share[k] / cells[k]) if cells[k] else 1.0
        u = int(hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        out.append((len(words(r["text"])), p, u < p))
    return out
