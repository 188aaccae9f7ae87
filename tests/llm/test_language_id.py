"""Scripts without spaces, and tables without languages."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from gridlake.llm import language_id
from tests.llm import messy


def predicted(spark, train, texts):
    model = language_id.train(spark.createDataFrame(train, "text string, lang string"))
    return [r["lang_pred"] for r in sorted(language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect())]


def test_long_words_are_learned_whole(spark):
    late = "人民日报今天发表文章"
    train = [("一" * 300 + late, "zh"), ("一" * 300 + "のですからありました", "ja")] * 3
    assert predicted(spark, train, [late * 2, "のですからありました" * 2]) == ["zh", "ja"]


def test_a_paragraph_without_spaces_weighs_more_than_a_few_names(spark):
    rng = random.Random(4)
    signs = "天地人日月山水火木金土上下大小中国家学生年時分生活経済社会文化歴史"
    chinese = ["".join(rng.choice(signs) for _ in range(120)) for _ in range(30)]
    train = [(t, "zh") for t in chinese] + [(messy.sentence(rng, "en", 60) + " Microsoft London Google", "en") for _ in range(30)]
    text = "".join(rng.choice(signs) for _ in range(300))
    assert predicted(spark, train, [f"Microsoft London Google {text} Microsoft London Google"]) == ["zh"]


def test_stage_keeps_texts_when_no_row_has_a_language(spark):
    docs = messy.frame(spark).withColumn("lang", F.lit(None).cast("string"))
    want = sorted(r[0] for r in messy.rows() if any(map(str.isalpha, r[1] or "")))
    kept = corpus_pipeline.languages(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want
