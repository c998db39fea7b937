"""Queries of operators 7 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlake.llm import language, toxicity
from bitlake.llm.common import remainder


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = lambda c: F.coalesce(remainder(c, 4) == 2, F.lit(False))
    model = language.fit(language.training_rows(docs, lambda c: remainder(c, 4) != 2))  # not of rows without an id
    return language.predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(toxicity.labelled_rows(docs, labels, "toxic", lambda c: F.coalesce(remainder(c, 5) != 0, F.lit(False))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
QUERIES = {"op7_language_id": op7_language_id, "op9_toxicity": op9_toxicity}
