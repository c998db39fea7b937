"""Queries of operator 8, and of operator 5 by its counts."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlake.llm import bpe, rollups
from bitlake.llm.common import cut, shared_dir


def digests(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.encode(docs, path, public_tokenizers.PATTERN, back=True)
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_bpe_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of the whole table by the byte-level tokenizer's own counts: one batch, sent twice, compacted, and sent again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.struct("source", "lang").alias("key"), "text")
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, id_col="key")
    counts = cut(ids.select("key.source", "key.lang", F.size("ids").cast("long").alias("n")), "rollup-bpe")
    store = rollups.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    batch = rollups.change(counts, 1, "byte-bpe-50k", "n")
    for _ in range(2):
        store.commit(1, batch)
    store.compact()
    store.commit(1, batch)
    return store.totals()


SQL: dict[str, str] = {}
QUERIES = {"op8_byte_bpe": op8_byte_bpe, "op5_bpe_totals": op5_bpe_totals}
