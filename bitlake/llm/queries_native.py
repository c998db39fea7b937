"""Queries and SQL of operators 3, 4 and 5."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlake.llm import mixing, rollups, url_filter
from bitlake.llm.common import cut, shared_dir

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _rolled(spark: SparkSession, sf_dir: str) -> tuple[rollups.Rollup, DataFrame, Column, Column]:
    """Batch 1 inserts all documents; batch 2, sent twice, moves a fifth to another tokenizer; batch 3 deletes an eleventh."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = cut(docs.select("doc_id", "source", "lang", *(rollups.tokens(F.col("text"), v).alias(c) for v, c in (("words-1", "a"), ("pieces-2", "b")))), "rollup-counts")
    moved, gone = (F.coalesce(F.pmod("doc_id", F.lit(k)), F.lit(1)) == 0 for k in (5, 11))
    store = rollups.Rollup(spark, f"{shared_dir(spark)}/bitlake-rollup-{uuid.uuid4().hex}")
    store.commit(1, rollups.change(counts, 1, "words-1", "a"))
    revised = rollups.change(counts.where(moved), -1, "words-1", "a").unionAll(rollups.change(counts.where(moved), 1, "pieces-2", "b"))
    store.commit(2, revised)
    store.commit(2, revised)
    deleted = counts.where(gone)
    store.commit(3, rollups.change(deleted.where(~moved), -1, "words-1", "a").unionAll(rollups.change(deleted.where(moved), -1, "pieces-2", "b")))
    return store, counts, moved, gone


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after the deltas: not all documents, and each under one version; op5_token_totals has the whole table."""
    return _rolled(spark, sf_dir)[0].totals()


def op5_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same deltas; then batch 4 inserts the deleted documents again, and batch 5 counts each document under its other version too."""
    store, counts, moved, gone = _rolled(spark, sf_dir)
    back = counts.where(gone)
    store.commit(4, rollups.change(back.where(~moved), 1, "words-1", "a").unionAll(rollups.change(back.where(moved), 1, "pieces-2", "b")))
    store.commit(5, rollups.change(counts.where(moved), 1, "words-1", "a").unionAll(rollups.change(counts.where(~moved), 1, "pieces-2", "b")))
    return store.totals()


SQL = {
    "op3_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
p AS (SELECT row_number() OVER () k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM u),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT k, arg_max(rh || rp, length(rh || rp)) rule, arg_max(v, length(rh || rp)) v FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, 'allow') verdict FROM p LEFT JOIN m USING (k)""",
    "op4_mix_sources": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT size FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size, row_number() OVER (ORDER BY source NULLS LAST) no FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(no - 1) % 3 + 1] w, 2 * source_size cap FROM s),
b AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE budget, sum(w) OVER () all_w, coalesce(sum(cap) OVER o, 0) c, coalesce(sum(w) OVER o, 0) cw FROM w
  WINDOW o AS (ORDER BY cap::DOUBLE / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap <= w * ((budget - c) / (all_w - cw)) is_full FROM b),
t AS (SELECT *, CASE WHEN is_full THEN cap::DOUBLE ELSE w * ((budget - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) / (all_w - coalesce(sum(w) FILTER (is_full) OVER (), 0))) END target FROM f),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT quota,
  coalesce(sum(d.size) OVER (PARTITION BY t.no ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT start
  , t.no, row_number() OVER () k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
every AS (SELECT no, quota, ceil(quota / 512)::BIGINT need, sum(ceil(quota / 512)::BIGINT) OVER ()::BIGINT n, coalesce(sum(quota) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE before, sum(quota) OVER ()::DOUBLE whole
  FROM (SELECT no, floor(target)::BIGINT quota FROM t)),
spans AS (SELECT no, need, n, floor(before / whole * 4294967296) lo, floor((before + quota) / whole * 4294967296) hi FROM every WHERE need > 0),
slots AS (SELECT slot, (slot + 1) % 2147483648 * 2654435769 % 4294967296 x FROM (SELECT unnest(range((SELECT coalesce(max(n), 0) FROM every))) slot)),
named AS (SELECT no, slot, need, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 rank FROM slots JOIN spans ON lo <= x AND x < hi),
placed AS (SELECT no, rank, slot FROM named WHERE rank < need UNION ALL
  SELECT no, rank, n + rank * 1048576 + no FROM (SELECT spans.no, n, unnest(range(coalesce(got, 0), need)) rank FROM spans LEFT JOIN (SELECT no, count(*) got FROM named GROUP BY no) USING (no))),
parts AS (SELECT k, no, epoch * source_size + start first, least(epoch * source_size + start + size, quota) last FROM q, (VALUES (0), (1)) v(epoch) WHERE size > 0),
cells AS (SELECT k, no, unnest(range(first // 512, (last - 1) // 512 + 1)) rank FROM parts WHERE first < last),
firsts AS (SELECT k, count(*) pieces, min(slot) first_slot FROM cells JOIN placed USING (no, rank) GROUP BY k)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, quota) - start) + greatest(0, least(source_size + start + size, quota) - source_size - start))::BIGINT taken,
  coalesce(pieces, 0)::BIGINT pieces, first_slot::BIGINT first_slot FROM q LEFT JOIN firsts USING (k)""",
    "op5_token_rollup": r"""
WITH d AS (SELECT source, lang, coalesce(doc_id % 5 = 0, false) moved, coalesce(doc_id % 11 = 0, false) gone,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT a,
  coalesce(len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]')), 0)::BIGINT b FROM documents)
SELECT source, lang, CASE WHEN moved THEN 'pieces-2' ELSE 'words-1' END AS version, count(*) docs, sum(CASE WHEN moved THEN b ELSE a END)::BIGINT tokens
FROM d WHERE NOT gone GROUP BY ALL""",
    "op5_token_totals": r"""
WITH d AS (SELECT source, lang, 'words-1' AS version, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT n FROM documents
  UNION ALL SELECT source, lang, 'pieces-2', coalesce(len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]')), 0)::BIGINT FROM documents)
SELECT source, lang, version, count(*) docs, sum(n)::BIGINT tokens FROM d GROUP BY ALL""",
}
QUERIES = {"op3_url_filter": op3_url_filter, "op4_mix_sources": op4_mix_sources, "op5_token_rollup": op5_token_rollup, "op5_token_totals": op5_token_totals}
