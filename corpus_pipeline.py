"""Corpus pipeline: each stage takes (spark, docs, sf_dir) and returns what it keeps; see STAGES.

Defined cases, for every stage: an empty table gives an empty table; columns beyond those of documents are kept, whatever
their names, by all stages but the last; null, empty and very long texts, nulls in any column, ties and repeated rows are
treated as the operators' docstrings say.  Rows with a null doc_id cannot be a copy of another row: they pass.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import bpe, language_id
from gridlake.llm.line_dedup import line_dedup
from gridlake.llm.mixing import mix_sources
from gridlake.llm.ngram_join import ngram_jaccard_join
from gridlake.llm.storage import drop, free_name, run as storage_run, written

#: The tokenizer's file, where its package keeps it.
TOKENIZER = "byte_bpe_50k.json"
#: Probability from which a predicted language stands in for one that is not given.
SURE = 0.9


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word-first backoff: documents whose text has no letter, or is null, go; where no language is given the one predicted
    with a probability of SURE or more stands in for it, so that later stages weigh the document by it."""
    model = language_id.train(docs)
    if not model.langs:  # nothing to learn from, so no text has a language
        return docs.where("text RLIKE '\\\\p{L}'")
    found = language_id.identify(docs, model, with_row=True).where(F.col("lang_pred") != language_id.UNKNOWN)
    lang = F.coalesce(F.col("row.lang"), F.when(F.col("score") >= SURE, F.col("lang_pred")))
    return found.select(*(lang.alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletion-neighbourhood join: repeated lines go; documents of which nothing is left go with them."""
    stats = free_name(docs, "line_stats")
    out = line_dedup(docs, stats=stats)
    changed = F.col(f"{stats}.n_removed") > 0
    out = out.where(~changed | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join at five words and 0.8: of each group the document with the smallest doc_id stays.

    Repeated rows of one doc_id are one document: they stay or go together.
    """
    members, _ = ngram_jaccard_join(docs, width=5, threshold=(4, 5))
    gone = members.groupBy("doc_id").agg(F.min("component_id").alias("keep_id")).where("doc_id <> keep_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Iterative proportional fitting: documents sampled to the tempered mix of sources, languages and topics."""
    return mix_sources(docs).where("kept").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenization automaton: token ids of every text, and the digest of what they decode to."""
    out = bpe.round_trip(docs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mix_sources", mixture),
    ("bpe", tokens),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py compares the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with storage_run(spark) as keep:  # what the stage writes on its way goes once its result is written
            kept = keep(written(stage(spark, docs, sf_dir), f"stage-{name}"))
        drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
