"""One query for each operator over its whole table, and the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at Jaccard 0.85 over 4-word shingles; one row for each document with its component."""
    from .ngram_join import ngram_jaccard_join

    members, _ = ngram_jaccard_join(_documents(spark, sf_dir), width=4, threshold=(85, 100))
    return members.select("doc_id", "n_shingles", "n_links", "component_id")


def _remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated lines counted and the digest of what is left of its text."""
    from .line_dedup import line_dedup

    out = line_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "line_stats.n_lines", "line_stats.n_removed", "line_stats.n_near", F.sha2("text", 256).alias("text_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; texts whose remainder modulo 4 is 2 are held out of training."""
    from .language_id import identify, train

    docs = _documents(spark, sf_dir)
    held_out = _remainder(4) == 2
    model = train(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; texts whose remainder modulo 4 is 2 are held out of training."""
    from .toxicity import score, train

    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = _remainder(4) == 2
    machine = train(docs.where(~held_out), labels.where(~held_out))
    return score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


#: Order of op5's model.
LM_ORDER = 3


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney and unigram scores of every text; texts whose remainder modulo 5 is 1 are held out of training."""
    from .kneser_ney import score, train

    docs = _documents(spark, sf_dir)
    held_out = _remainder(5) == 1
    model = train(docs.where(~held_out), order=LM_ORDER)
    out = score(docs, model).withColumns({"held_out": held_out, "train_tokens": F.lit(model.tokens).cast("long")})
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every text."""
    from .licenses import license_scan

    return license_scan(_documents(spark, sf_dir))[0]


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under the raked mix of sources, languages and topics, and whether it stays."""
    from .mixing import mix_sources

    out = mix_sources(_documents(spark, sf_dir))
    return out.select("row.doc_id", "topic", "n_tokens", "probability", "kept")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.98 within a label; one row for each vector."""
    from .epsilon_grid import embedding_near_duplicates

    return embedding_near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by the digest of the normalised text; one row for each document."""
    from .digest_index import exact_dedup

    return exact_dedup(_documents(spark, sf_dir))


#: The tokenizer file of op10 and of the pipeline; the file stays where its package keeps it.
TOKENIZER = "byte_bpe_50k.json"


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and the text that they decode to, as digests."""
    import public_tokenizers

    from .bpe import round_trip

    both = round_trip(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a rule, with its faults, its cheapest edits and the digest of what they make of it."""
    from .conversations import damaged, repair

    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; texts whose remainder modulo 3 is 1 are held out of training."""
    from .quality import score, train

    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = _remainder(3) == 1
    model = train(docs.where(~held_out), labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each lang."""
    from .collocations import collocations

    return collocations(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_line_dedup, op3_language_id, op4_toxicity, op5_kneser_ney, op6_license_scan, op7_mix_sources, op8_embedding_near_dedup, op9_exact_dedup, op10_bpe_round_trip, op11_conversation_repair, op12_quality, op13_collocations)}


def _license_sql() -> str:
    from .licenses import PHRASES, templates

    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    hits = []
    for phrase, label in PHRASES:
        parts = phrase.split(" ")
        same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        hits.append(f"list_filter(range(len(w)), lambda i: coalesce({same}, false)) AS at_{label}")
    rows = ", ".join(f"('{t.label}', [{', '.join(repr(x) for x in t.tokens)}], {t.need}, {t.width}, '{t.key}')" for t in templates())
    own = ", ".join(f"CASE WHEN len(at_{label}) > 0 THEN '{label}' END" for _, label in PHRASES)
    places = " || ".join(f"at_{label}" for _, label in PHRASES)
    return f"""
        WITH t(label, tokens, need, width, key) AS (VALUES {rows}),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents),
        b AS (SELECT doc_id, len(w) AS n_words, {", ".join(hits)} FROM d),
        c AS (SELECT doc_id, n_words, {places} AS places, list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM b),
        l AS (SELECT doc_id, width, list_distinct(w[i + 1 : i + 2 * width]) AS k, ' ' || array_to_string(w[i + 1 : i + 2 * width], ' ') || ' ' AS run
              FROM (SELECT doc_id, width, w, unnest(range(0, len(w), width)) AS i FROM d, (SELECT DISTINCT width FROM t))),
        m AS (SELECT doc_id, list(DISTINCT label) AS added, max(len(list_intersect(k, tokens))::DOUBLE / len(tokens)) AS best
              FROM l JOIN t USING (width) WHERE len(list_intersect(k, tokens)) >= need AND contains(run, ' ' || key || ' ') GROUP BY doc_id)
        SELECT c.doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
               array_to_string(list_sort(own), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(own || coalesce(added, []))), ',') AS labels,
               CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
        FROM c LEFT JOIN m ON m.doc_id = c.doc_id
    """


def _mixing_sql() -> str:
    from .mixing import DIMENSIONS, KEEP, ROUNDS, TEMPERING

    steps = []
    for d in DIMENSIONS:
        steps.append(f"t_{d} AS (SELECT {d}, pow(sum(tokens)::DOUBLE, {TEMPERING[d]}) AS p FROM cells GROUP BY {d} HAVING sum(tokens) > 0)")
        steps.append(f"s_{d} AS (SELECT {d}, p / sum(p) OVER () AS target_{d} FROM t_{d})")
    joins = " ".join(f"LEFT JOIN s_{d} USING ({d})" for d in DIMENSIONS)
    goal = ", ".join(f"coalesce(target_{d}, 0) AS target_{d}" for d in DIMENSIONS)
    steps.append(f"r0 AS (SELECT source, lang, topic, tokens, {goal}, tokens::DOUBLE AS share FROM cells {joins})")
    k = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            sums = f"sum(share) OVER (PARTITION BY {d})"
            steps.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {sums} > 0 THEN share * target_{d} / {sums} ELSE 0 END AS share) FROM r{k})")
            k += 1
    chain = ", ".join(steps)
    return rf"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
                   CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(lower(text), 'license') THEN 'notice'
                        WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+|\+[0-9]+ ') THEN 'contact' ELSE 'prose' END AS topic,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
                   ('0x' || substr(md5('17:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
            FROM documents),
        cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
        {chain},
        f AS (SELECT source, lang, topic, tokens, share / sum(share) OVER () AS share FROM r{k}),
        g AS (SELECT *, CASE WHEN tokens > 0 THEN share / tokens ELSE 0 END AS ratio FROM f),
        h AS (SELECT *, row_number() OVER o AS place, coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                     sum(share) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, {KEEP} * sum(tokens) OVER () AS budget
              FROM g WINDOW o AS (ORDER BY ratio DESC, source, lang, topic)),
        i AS (SELECT *, CASE WHEN rest > 0 THEN greatest(0, budget - before) / rest ELSE 0 END AS scale FROM h),
        l AS (SELECT arg_min(scale, place) AS level FROM i WHERE scale * ratio <= 1),
        c AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN least(1, coalesce(level, 0) * ratio) ELSE 1 END, 9)::DOUBLE AS probability FROM i, l)
        SELECT doc_id, topic, n_tokens, probability, u < probability AS kept FROM d JOIN c USING (source, lang, topic)
    """


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _collocations_sql(min_count: int, top: int) -> str:
    cut = "((1000000::HUGEINT * t.a * t.a) // ({l}::HUGEINT * {r}))::BIGINT"
    one, two = cut.format(l="u.a", r="q.a"), cut.format(l="p.a", r="v.a")
    return rf"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
        g AS (SELECT lang, w[i : i + k - 1] AS p, count(*) AS a FROM s, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {min_count}),
        triples AS (
            SELECT t.lang, t.p, t.a, CASE WHEN {one} <= {two} THEN u.a ELSE p.a END AS l, CASE WHEN {one} <= {two} THEN q.a ELSE v.a END AS r, least({one}, {two}) AS score
            FROM g t JOIN g u ON u.lang = t.lang AND u.p = t.p[1:1] JOIN g q ON q.lang = t.lang AND q.p = t.p[2:3]
                     JOIN g p ON p.lang = t.lang AND p.p = t.p[1:2] JOIN g v ON v.lang = t.lang AND v.p = t.p[3:3]
            WHERE len(t.p) = 3),
        inner_pairs AS (SELECT lang, p[1:2] AS p, a FROM triples UNION ALL SELECT lang, p[2:3], a FROM triples),
        covered AS (SELECT lang, p, max(a) AS longer FROM inner_pairs GROUP BY ALL),
        pairs AS (
            SELECT t.lang, t.p, t.a, u.a AS l, v.a AS r, {cut.format(l="u.a", r="v.a")} AS score
            FROM g t JOIN g u ON u.lang = t.lang AND u.p = t.p[1:1] JOIN g v ON v.lang = t.lang AND v.p = t.p[2:2]
                     LEFT JOIN covered c ON c.lang = t.lang AND c.p = t.p
            WHERE len(t.p) = 2 AND NOT coalesce(100 * c.longer >= 50 * t.a, false)),
        a AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM (SELECT * FROM pairs UNION ALL SELECT * FROM triples))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM a JOIN n USING (lang) QUALIFY rank <= {top}
    """


def _repair_sql() -> str:
    """crc32 from its table, then a step of the four states for each turn; a state is (cost, audit, lines)."""

    def step(state: str, cost: str, letter: str, line: str, when: str = "true") -> str:
        return f"CASE WHEN {state} IS NOT NULL AND ({when}) THEN {{'c': ({state}.c + {cost})::BIGINT, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"

    def best(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"

    def taken(state: str, initial: str, role: str) -> tuple[str, str]:
        own = "chr(10) || role || ':' || text"
        return step(state, "late", "K", own, f"NOT gone AND initial = '{initial}'"), step(state, "late + 1", "R", f"chr(10) || '{role}:' || text", "NOT gone")

    def dropped(state: str) -> str:
        return step(state, "2", "D", "''")

    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
        WITH RECURSIVE bits(k, c, n) AS (
            SELECT k, k, 0 FROM range(256) t(k) UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8),
        codes AS (SELECT list(c ORDER BY k) AS code FROM bits WHERE n = 8),
        given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations),
        hashed AS (SELECT * EXCLUDE (bytes, code), xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, code[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS what FROM given, codes),
        kept AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                        unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) FROM hashed WHERE what <> 0),
        turns AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM kept),
        faults AS (SELECT *, left(role, 1) AS initial, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                                WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                          lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM turns),
        rows AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late FROM faults),
        ids AS (SELECT DISTINCT conv_id FROM conversations),
        path AS (
            SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1,
                   {{'c': 5::BIGINT, 'a': 'I', 't': {user}}} AS s2, {{'c': 10::BIGINT, 'a': 'II', 't': {user} || {assistant}}} AS s3 FROM ids
            UNION ALL
            SELECT conv_id, i, n0, n1, {best("n2", *(step(f"n{k}", "5", "I", user) for k in (0, 1, 3)))},
                   {best("n3", step("n2", "5", "I", assistant), step("n0", "10", "II", f"{user} || {assistant}"), step("n1", "10", "II", f"{user} || {assistant}"))}
            FROM (SELECT p.conv_id, r.i, {dropped("s0")} AS n0, {best(dropped("s1"), taken("s0", "s", "")[0])} AS n1,
                         {best(dropped("s2"), *taken("s0", "u", "user"), *taken("s1", "u", "user"), *taken("s3", "u", "user"))} AS n2,
                         {best(dropped("s3"), *taken("s2", "a", "assistant"))} AS n3
                  FROM path p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)),
        ends AS (SELECT conv_id, {best("s0", "s3")} AS e FROM path QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                          count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
        SELECT ends.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               e.c AS cost, e.a AS audit, sha256(substr(e.t, 2)) AS repaired_sha256
        FROM ends LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ends.conv_id
    """


def _collocations() -> str:
    from .collocations import MIN_COUNT, TOP

    return _collocations_sql(MIN_COUNT, TOP)


ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": _repair_sql(),
    "op13_collocations": _collocations(),
    "op7_mix_sources": _mixing_sql(),
    "op6_license_scan": _license_sql(),
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
}
