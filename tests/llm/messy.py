"""A small documents table with the cases that every operator has a defined result for."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, kept boolean, component_id long"
WORDS = {
    "en": "the house and garden were quiet that evening while people walked slowly along the river towards home with their friends".split(),
    "fr": "la maison et le jardin étaient calmes ce soir tandis que les gens marchaient lentement le long de la rivière vers chez eux".split(),
    "de": "das haus und der garten waren ruhig an diesem abend während die leute langsam am fluss entlang nach hause gingen mit freunden".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(3)) * (rng.random() < 0.2) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    """Texts in three languages; copies, near copies, repeated lines, null, empty and odd ones; a hot source; extra columns."""
    rng = random.Random(seed)
    out = []
    for i in range(60):
        lang = rng.choice(list(WORDS))
        lines = [sentence(rng, lang, rng.randrange(4, 30)) for _ in range(rng.randrange(1, 6))]
        out.append(["\n".join(lines), lang])
    for i in range(0, 30, 3):
        out.append(list(out[i]))
    base = out[5][0].split(" ")
    for k in range(12):  # a group of near copies, each with a word of its own
        words = list(base)
        words[(7 * k) % len(words)] = f"changed{k}"
        out.append([" ".join(words), out[5][1]])
    shared = sentence(rng, "en", 25)
    for i in range(0, 20, 2):
        out[i][0] += "\n" + shared
    out[3][0] += "\n" + shared.replace(shared.split()[4], "altered", 1)
    out[7][0] += "\n" + shared + " longer"
    out += [[None, "en"], ["", "en"], [" \t\n ", None], ["1234 5678 !!", "en"], ["one", "en"], ["one", "en"], ["ONE", None], ["É à", "fr"], ["日本語 テキスト", None]]
    out += [[sentence(rng, "en", 6000), "en"], ["x" * 20000, "en"], ["Released under the MIT License.", "en"]]
    table = [(i, t, lang, None if i % 17 == 0 else "src0" if i % 3 else f"src{i % 5}", len(t or ""), 0.5, "r", True, 7) for i, (t, lang) in enumerate(out)]
    return [*table, table[4]]  # one row twice


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
