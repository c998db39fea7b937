"""URL filter: a blocked Bloom filter of listed canonical keys, then an exact hash join.

A listed key is a canonical host followed by the start of a path (`net/fr/`). Each URL yields one candidate key for
every (labels of the host, length of the path) that some listed key has, so a key covers its subdomains and every
path that starts with its own. Candidates meet the filter's 512-bit blocks in an equi-join; those whose eight bits
are all set go on to the exact join, which removes the filter's false positives. Both tables are broadcast only
while their size, known from the number of keys, is under BROADCAST_MB; beyond it they are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitlake.llm.common import cut

BROADCAST_MB = 32
KEYS_PER_BLOCK = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty for null or without `://`."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(8)]


def bloom_filter(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(block, w0..w7) of the distinct strings in column key, and the number of blocks for n keys."""
    blocks = 1 << max(0, math.ceil(math.log2(max(1, n) / KEYS_PER_BLOCK)))
    masks = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *(b.alias(f"m{i}") for i, b in enumerate(_bits(F.col("key")))))
    return masks.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(8))), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict.

    listed has host, path and verdict. The longest listed key that fits decides, else `default`; of two verdicts for
    one key the later in the alphabet holds (block before allow). Null and malformed URLs have empty host and path and
    fit nothing; repeated rows and null ids stay as they are; an empty table or list gives an empty or all-default
    result. Other columns of pages are not read.
    """
    listed = listed.groupBy(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")).agg(F.max("verdict").alias("listed_verdict"))
    listed = cut(listed, "url-listed")
    n = listed.count()
    shapes = [(r[0], r[1]) for r in listed.select("labels", "length").distinct().orderBy("labels", "length").collect()]
    bloom, blocks = bloom_filter(listed, n)
    small = lambda df, mb: F.broadcast(df) if mb <= BROADCAST_MB else df

    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    parts = F.split("host", r"\.")
    fits = [F.when((F.size("parts") >= k) & (F.length("path") >= length), F.concat(F.array_join(F.slice("parts", F.size("parts") - (k - 1), k), "."), F.substring("path", 1, length))) for k, length in shapes]
    keyed = urls.where("host <> ''").withColumn("parts", parts).select("id", "host", "path", F.explode(F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>")).alias("key"))
    probed = keyed.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).join(small(bloom, blocks * 72 / 1e6), "block")
    for i, bit in enumerate(_bits(F.col("key"))):
        probed = probed.where(F.col(f"w{i}").bitwiseAND(bit) != 0)
    hits = probed.select("id", "host", "path", "key").join(small(listed.select("key", "listed_verdict"), n * 120 / 1e6), "key")

    found = F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), F.col("listed_verdict").alias("verdict"))
    none = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    rows = urls.select("id", "host", "path", F.lit(1).alias("row"), none.alias("found")).unionAll(hits.select("id", "host", "path", F.lit(0).alias("row"), found.alias("found")))
    best = rows.groupBy("id", "host", "path").agg(F.sum("row").cast("int").alias("n"), F.max("found").alias("found"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), "n")).alias("_row")).drop("_row")
