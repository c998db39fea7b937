"""Queries of operators 1 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlake.llm import media, quality


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.with_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size = F.octet_length("samples").cast("long")
    codes = F.concat_ws(",", F.transform("times", lambda t: t.cast("string"))), F.concat_ws(",", F.transform("pairs", lambda p: p.cast("string")))
    return rows.select(
        "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.expr(f"substring(samples, octet_length(samples) - {media.UNIT - 1}, {media.UNIT})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat(F.size("times").cast("string"), F.lit(":"), F.md5(F.concat_ws(";", *codes))).alias("feature"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op1_quality": op1_quality, "op6_media": op6_media}
