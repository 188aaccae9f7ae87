"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a window of words, twice as long as the templates of its size class (a power of two) and half overlapped by
the next, so that any run of words as long as a template lies in one, however its lines are broken.  Tokens are ordered
by their frequency over all documents, rarest first.  A template of n tokens is met by a block that holds need =
ceil(threshold * n) of them, so such a block holds one of the template's first n - need + 1 tokens (prefix filter), at
least need tokens of the template vocabulary (length filter), and enough tokens behind the shared one on both sides
(positional filter).  What is left is verified on whole sets.

Sets alone do not tell licenses apart whose notices differ by a name.  So a template of fewer than SHORT distinct words is
met word for word only, in its order, and a longer one only where the phrase that names it, its key, stands in the block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: A word of a text: ASCII letters and digits, and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that name a license, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Templates of fewer distinct words must stand word for word.
SHORT = 16

# Well-known license notices, whole or by their sentences, with their labels; of longer ones the key.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "any person obtaining a copy"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
        "any person obtaining a copy",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "appear in all copies",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    (
        "bsd",
        """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
        "redistributions in binary form must reproduce",
    ),
    (
        "bsd",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
        NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
        THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
        OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "provided by the copyright holders and contributors",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
        in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
        "apache license",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu general public license"),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
        "gnu general public license",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    (
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "mozilla public license",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
        "released into the public domain",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    tokens: tuple[str, ...]
    need: int
    width: int  # of its size class: windows are twice as long
    key: str  # words that stand in a row in a block that meets it


def templates(pairs=TEMPLATES, threshold: tuple[int, int] = (4, 5)) -> list[Template]:
    num, den = threshold
    found = []
    for k, (label, text, *key) in enumerate(pairs):
        words = re.findall(WORD, text.lower())
        tokens = tuple(dict.fromkeys(words))
        short = len(tokens) < SHORT
        need = len(tokens) if short else -(-num * len(tokens) // den)
        found.append(Template(k, label, tokens, need, max(8, 1 << (len(words) - 1).bit_length()), " ".join(words) if short else " ".join(key)))
    return found


def _pieces(text):
    """The words of a text, with an empty piece before a gap at the start and after one at the end."""
    return F.split(text, GAP, -1)


def _count(pieces):
    """How many words the pieces hold."""
    last = F.size(pieces)
    ends = F.when((last > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    return last - F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) - ends


def _stands(words, parts: list[str]):
    """Whether the words from a given index on are parts, A-Z taken as lower case."""

    def test(i):
        same = F.lit(True)
        for k, part in enumerate(parts):
            same = same & (F.translate(F.get(words, i + k), _UPPER, _LOWER) == part)
        return F.coalesce(same, F.lit(False))

    return test


def _may_hold_phrase(text):
    """False only for texts without any phrase; (?i) folds ASCII letters only."""
    return text.rlike("(?i)" + "|".join(GAP.join(phrase.split(" ")) for phrase, _ in PHRASES))


def license_scan(docs: DataFrame, given=TEMPLATES, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, matches).

    documents, one row for each input row: doc_id, n_words, n_base (places of PHRASES), first_word, last_word (their
    smallest and largest start, else null), base_labels, labels (also those of templates met; distinct, sorted, joined
    with commas), score (1 if a phrase stands there, else the largest containment of a template met, else 0).
    matches: doc_id, block (first word of the window, from 0), width (its length), label, template, containment.

    given has (label, text) or (label, text, key).  Templates are a parameter of bounded size; their vocabulary is the only thing collected.  Defined cases: null or
    empty texts have no words and no labels; repeated rows with one id share the labels found in either; rows with a
    null id are left out; further columns are ignored.
    """
    found = templates(given, threshold)
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    # one count for each token of the vocabulary; tokens that no document holds come first
    vocabulary = sorted({t for x in found for t in x.tokens})
    held = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), _pieces(F.lower("text")))).alias("token"))
    count = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    ordered = sorted(vocabulary, key=lambda t: (count.get(t, 0), t))
    place = {t: k for k, t in enumerate(ordered)}
    order = F.array(*map(F.lit, ordered))
    prefixes = {x.number: sorted(x.tokens, key=place.get)[: len(x.tokens) - x.need + 1] for x in found}
    first_tokens = F.array(*(F.lit(t) for t in sorted({t for p in prefixes.values() for t in p})))

    base = docs.withColumn("pieces", _pieces(F.lower("text"))).withColumn("known", F.array_intersect(order, "pieces"))
    least = min(x.need for x in found)
    candidate = F.arrays_overlap("known", first_tokens) & (F.size("known") >= least)
    base = base.select(
        "doc_id",
        _count(F.col("pieces")).cast("long").alias("n_words"),
        F.when(_may_hold_phrase(F.col("text")), F.array_remove(_pieces(F.col("text")), "")).alias("words"),
        F.when(candidate, F.col("text")).alias("text"),
    )
    base = written(base, "license-base")

    # blocks of candidate documents, joined with the templates' prefixes
    words = base.where("text IS NOT NULL").select("doc_id", F.array_remove(_pieces(F.lower("text")), "").alias("words"))

    def windows(width: int):
        own = [x for x in found if x.width == width]
        order = F.array(*(F.lit(t) for t in ordered if any(t in x.tokens for x in own)))
        start = F.sequence(F.lit(0), F.size("words") - 1, F.lit(width))
        known = F.transform(start, lambda i: F.struct(i.alias("block"), F.array_intersect(order, F.slice("words", i + 1, 2 * width)).alias("known")))
        known = F.filter(known, lambda x: F.size(x["known"]) >= min(x.need for x in own))
        return F.transform(known, lambda x: F.struct(x["block"].alias("block"), F.lit(2 * width).alias("width"), x["known"].alias("known"), F.concat(F.lit(" "), F.array_join(F.slice("words", x["block"] + 1, 2 * width), " "), F.lit(" ")).alias("run")))

    blocks = words.where("size(words) > 0").select("doc_id", F.explode(F.concat(*(windows(w) for w in sorted({x.width for x in found})))).alias("w")).select("doc_id", "w.*")
    spark = docs.sparkSession
    index = spark.createDataFrame(
        [(t, k, 2 * x.width, x.number, x.label, len(x.tokens), x.need, list(x.tokens), f" {x.key} " if x.key else "") for x in found for k, t in enumerate(prefixes[x.number])],
        "token string, i int, width int, template int, label string, size int, need int, tokens array<string>, key string",
    )
    entries = blocks.select("doc_id", "block", "width", "known", "run", F.posexplode("known").alias("j", "token"))
    pairs = entries.join(F.broadcast(index), ["token", "width"]).where("size(known) >= need AND 1 + least(size - i, size(known) - j) - 1 >= need")
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("known", "tokens"))).where("shared >= need AND contains(run, key)")
    matches = pairs.select("doc_id", "block", "width", "label", "template", (F.col("shared") / F.col("size")).alias("containment")).distinct()

    by_doc = matches.groupBy("doc_id").agg(F.collect_set("label").alias("added"), F.max("containment").alias("containment"))
    none = F.array().cast("array<int>")
    at = {f"at_{label}": F.when(F.col("words").isNotNull(), F.filter(F.sequence(F.lit(0), F.size("words")), _stands(F.col("words"), phrase.split(" ")))).otherwise(none) for phrase, label in PHRASES}
    joined = base.select("doc_id", "n_words", "words").withColumns(at).join(by_doc, "doc_id", "left")
    own = F.array_compact(F.array(*(F.when(F.size(f"at_{label}") > 0, F.lit(label)) for _, label in PHRASES)))
    joined = joined.withColumns({"places": F.concat(*at), "own": own})
    out = joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort("own")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("own", F.coalesce("added", F.array().cast("array<string>"))))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
    return out, matches
