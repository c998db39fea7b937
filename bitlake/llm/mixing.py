"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

Target words a source: weights share `share` of all words, no source above `most` times its own; what exceeds that is
shared again by weight. A golden-ratio sequence mapped through the cumulative targets names the source of each slot.
Slots are ranked within their source and joined to that source's blocks: its documents in hashed order, laid end to
end and cut into blocks of equal length, the stream repeated up to `most` times. A source that the sequence leaves
short by a few slots gets them at the schedule's end, and its last block is cut at its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlake.llm.common import WORD, bucketed_prefix, cut

#: The golden ratio's fraction in 2**32 parts; the sequence starts anew after 2**31 slots, where it has run through every second part.
GOLDEN, PARTS, PERIOD, CELL = 2654435769, 1 << 32, 1 << 31, 20
#: Documents in a bucket of the first prefix sum and slots in one of the second, on average.
BUCKET = 4096
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, src, source_size, target, quota): one row a source, in the order of its name, null last.

    src numbers the sources; quota is the target in whole words. A source is full if the words left, shared by weight
    among it and those that fill later, reach its limit; sorting by limit over weight finds all full ones in one pass.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("src", F.row_number().over(by_name))
    src = src.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("src") - 1, F.lit(len(weights))) + 1)).withColumn("cap", F.col("source_size") * most)
    all_rows, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    src = src.withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(float(share))).withColumn("all_w", F.sum("w").over(all_rows))
    src = src.withColumn("full", F.col("cap") <= F.col("w") * ((F.col("budget") - zero(F.sum("cap").over(before))) / (F.col("all_w") - zero(F.sum("w").over(before)))))
    held = lambda c: zero(F.sum(F.when(F.col("full"), F.col(c))).over(all_rows))
    rate = F.try_divide(F.col("budget") - held("cap"), F.col("all_w") - held("w"))
    src = src.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * rate))
    return src.select("source", "src", "source_size", "target", F.floor("target").cast("long").alias("quota"))


def schedule(src: DataFrame, n: int, block: int) -> DataFrame:
    """(slot, src, rank): every rank below a source's number of blocks exactly once; n is the sum of those numbers."""
    need = F.ceil(F.col("quota") / F.lit(block)).cast("long")
    src = src.select("src", "quota", need.alias("need"))
    before, all_rows = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ends = src.withColumn("from", F.coalesce(F.sum("quota").over(before), F.lit(0))).withColumn("all", F.sum("quota").over(all_rows))
    part = lambda c: F.floor(c.cast("double") / F.col("all") * PARTS).cast("long")
    ends = ends.where("need > 0").select("src", "need", part(F.col("from")).alias("lo"), part(F.col("from") + F.col("quota")).alias("hi"))
    cells = ends.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", CELL), F.shiftright(F.col("hi") - 1, CELL))))
    spark = src.sparkSession
    slots = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id") + 1, F.lit(PERIOD)) * F.lit(GOLDEN), F.lit(PARTS)).alias("x"))
    named = slots.withColumn("cell", F.shiftright("x", CELL)).join(cells, "cell").where("lo <= x and x < hi").select("slot", "src", "need")
    ranked = bucketed_prefix(named.withColumn("chunk", F.col("slot").cast("long") - F.pmod("slot", F.lit(BUCKET))), ["src"], "chunk", [F.col("slot")], F.lit(1), "rank")
    got = named.groupBy("src").agg(F.count("*").alias("got"))
    short = ends.select("src", "need").join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    tail = short.select("src", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank")).select((F.lit(n) + F.col("rank") * F.lit(1 << 20) + F.col("src")).alias("slot"), "src", "rank")
    return ranked.where("rank < need").select("slot", "src", F.col("rank").cast("long").alias("rank")).unionAll(tail.select("slot", "src", F.col("rank").cast("long")))


def placed(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = (3, 1, 2), seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Documents with the place where they start in their source's stream, and the table of sources."""
    sizes = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "mix-sizes")
    src = cut(targets(sizes, share, most, weights), "mix-sources")
    n_docs, n_src = sizes.count(), src.count()
    few = F.broadcast(src) if n_src <= BROADCAST_SOURCES else src
    buckets = max(1, n_docs // BUCKET)
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = sizes.join(few.withColumnRenamed("source", "_s"), sizes["source"].eqNullSafe(F.col("_s"))).drop("_s").withColumn("mixed", mixed)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("mixed", 1, 8), 16, 10).cast("double") * buckets / PARTS).cast("long"))
    return bucketed_prefix(rows, ["src"], "bucket", [F.col("mixed"), F.col("id"), F.col("size")], F.col("size"), "start"), src


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = (3, 1, 2), block: int = 512, seed: str = "mix", **columns: str) -> tuple[DataFrame, DataFrame]:
    """The mix as (slot, rank, id, source, first, words), a row for each piece of a document in a slot, and the placed documents.

    first is the piece's first word in its document. Null texts have no words and get no piece; null sources are one
    source; equal rows are separate documents; an empty table gives an empty mix. Other columns are not read.
    """
    rows, src = placed(docs, share, most, weights, seed, **columns)
    rows = cut(rows.select("id", "source", "src", "size", "source_size", "target", "quota", "start"), "mix-placed")
    n = src.agg(F.sum(F.ceil(F.col("quota") / F.lit(block)))).first()[0] or 0
    slots = schedule(src, int(n), block)
    begin = F.col("epoch") * F.col("source_size") + F.col("start")
    spans = rows.where("size > 0").withColumn("epoch", F.explode(F.array(*(F.lit(e).cast("long") for e in range(most))))).withColumn("begin", begin).withColumn("end", F.least(begin + F.col("size"), F.col("quota"))).where("begin < end")
    blocks = spans.withColumn("rank", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))))
    pieces = blocks.join(slots, ["src", "rank"])
    first = F.greatest("begin", F.col("rank") * block)
    pieces = pieces.withColumn("first", first - F.col("begin")).withColumn("words", F.least("end", (F.col("rank") + 1) * block) - first)
    return pieces.select("slot", "rank", "id", "source", "src", "start", "size", "first", "words"), rows


def taken(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row a document: id, size, source_size, target, taken (its words in the mix, repeats counted), pieces, first_slot.

    pieces is in how many pieces the mix takes the document, and first_slot the first slot of the schedule that has one;
    null without a piece. Null texts have size 0; null ids and sources are kept; repeated rows are documents each, with
    places of their own; an empty table gives an empty result; other columns are not read.
    """
    pieces, rows = mix(docs, id_col=id_col, **options)
    none = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0).cast("long")
    both = rows.select("id", "src", "start", "size", F.lit(1).alias("row"), zero.alias("words"), zero.alias("piece"), none("long").alias("slot"), "source_size", "target")
    both = both.unionAll(pieces.select("id", "src", "start", "size", F.lit(0), "words", F.lit(1).cast("long"), "slot", none("long"), none("double")))
    sums = [F.sum("row").cast("int").alias("n"), F.sum("words").alias("taken"), F.sum("piece").alias("pieces"), F.min("slot").alias("first_slot"), F.max("source_size").alias("source_size"), F.max("target").alias("target")]
    summed = both.groupBy("src", "start", "id", "size").agg(*sums)
    return summed.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "pieces", "first_slot", F.explode(F.sequence(F.lit(1), "n")).alias("_row")).drop("_row")
