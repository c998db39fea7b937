"""A corpus from `documents` in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

run() applies them to the documents, writing each stage's rows as Parquet to the session's shared folder and reading
them again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlake.llm import bpe, language, mixing, near_text, queries_text, toxicity
from bitlake.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Where the chosen language's filter holds less than this share of a text's n-grams, the text is in no learned language. On
#: sf0.1 clean documents have 0.556 or more, other scripts 0, junk of letters about 0.1; a related language may have more (from 0.42).
LEAST_LANGUAGE = 0.4


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, fitted on the labelled rows among them, scores below 0.5."""
    model = queries_text.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model).where("score < 0.5").select(*COLUMNS)


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or with too few n-grams of a learned language, go."""
    model = language.fit(language.training_rows(docs, lambda c: F.lit(True)))
    return language.predicted(docs, model).where((F.col("lang_pred") != "und") & (F.col("known") >= LEAST_LANGUAGE)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; documents in no group, empty ones too, all stay."""
    return near_text.first_of_groups(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number; without words, once."""
    shares = mixing.taken(docs).select("doc_id", "size", "taken").where("doc_id is not null")
    times = shares.groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    n = F.when(F.coalesce("size", F.lit(0)) == 0, 1).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
    rows = docs.select(*COLUMNS).join(times, "doc_id", "left").withColumn("n", n).where("n > 0")
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "n")).alias("_copy")).drop("_copy")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, lossless): token ids, and whether they decode to the text's bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN, keep_text=True, back=True)
    whole = F.col("decoded") == F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), whole.alias("lossless"))


STAGES = [
    ("toxicity", reject_toxic),
    ("language", reject_unknown_language),
    ("near_text", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: SQL can express neither the fitted models nor the merges; tests/llm/test_pipeline.py holds each stage against a plain recomputation.
ORACLE_SQL = None
