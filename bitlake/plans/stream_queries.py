"""Queries of reference marking, changed lists and streaming display order, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlake.operators import marking, pictures
from bitlake.operators.shared import new_folder
from bitlake.streaming import reorder


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def stream_display_order(spark: SparkSession, d: str) -> DataFrame:
    """The coded pictures of all users, written as files, read as a stream and put in display order by a streaming query."""
    folder = new_folder(spark, "stream")
    pics = pictures.with_order_counts(pictures.coded_pictures(events(spark, d))).select("stream_id", "seq", "idr", "poc", F.lit(False).alias("last"), F.concat(F.lit("p"), F.col("seq").cast("string")).alias("meta"))
    ends = pics.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq")).select("stream_id", "seq", F.lit(False).alias("idr"), F.lit(0).cast("long").alias("poc"), F.lit(True).alias("last"), F.lit(None).cast("string").alias("meta"))
    rows = pics.unionByName(ends)
    rows.write.parquet(f"{folder}/in")
    found = reorder.in_display_order(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(reorder.OUT).parquet(f"{folder}/out").select("stream_id", "seq", "group_no", "poc", "meta", "shown")


def marked_pictures(spark: SparkSession, d: str, operations: bool) -> DataFrame:
    """Coded pictures with their numbers and order counts; with operations each second reference unmarks the one before it."""
    pics = pictures.with_numbers(pictures.coded_pictures(events(spark, d)), 16).select("stream_id", "seq", "frame_num", "group_no", "idr", "ref")
    counts = pictures.with_order_counts(pictures.coded_pictures(events(spark, d))).select("stream_id", "seq", "poc")
    some = F.array(F.array(F.lit(1), F.lit(0), F.lit(0)).cast("array<long>")) if operations else F.array().cast("array<array<long>>")
    chosen = F.when(F.col("frame_num") % 2 == 1, some).otherwise(F.array().cast("array<array<long>>"))
    return pics.join(counts, ["stream_id", "seq"]).select("*", chosen.alias("marking"), F.lit(False).alias("long_term"))


def joined(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


def marked_references(spark: SparkSession, d: str) -> DataFrame:
    out = marking.with_marked_references(marked_pictures(spark, d, True))
    return out.select("stream_id", "seq", joined(F.transform("short", lambda x: x["frame_num"])).alias("short"), F.size("long").cast("long").alias("long"))


def changed_lists(spark: SparkSession, d: str) -> DataFrame:
    """List p of each picture after one change: the picture seq % 5 + 1 numbers back comes first, if it is held."""
    out = marking.with_marked_references(marked_pictures(spark, d, False))
    plain = marking.lists(F.col("short"), F.col("long"), F.col("poc"), "p")
    rows = out.select("stream_id", "seq", "frame_num", plain.alias("plain"))
    operations = F.array(F.array(F.lit(0).cast("long"), F.col("seq") % 5))
    return rows.select("stream_id", "seq", joined(F.col("plain")).alias("plain"), joined(marking.changed(F.col("plain"), operations, F.col("frame_num"), 16)).alias("changed"))


def field_order(spark: SparkSession, d: str) -> DataFrame:
    """Parts as lists of four fields of two frames: fields of the picture's own parity come first in their frame."""
    k = F.col("p_partkey")
    one = lambda n, b: F.struct((k + n).alias("frame_num"), b.alias("bottom"))
    fields = F.array(one(0, k % 2 == 0), one(0, k % 2 == 1), one(1, k % 3 == 0), one(1, k % 3 > 0))
    out = marking.same_parity_first(fields, k % 5 < 2)
    return spark.read.parquet(f"{d}/part.parquet").select(k, F.array_join(F.transform(out, lambda x: F.concat(x["frame_num"].cast("string"), F.when(x["bottom"], "b").otherwise("t"))), " ").alias("fields"))


def order_counts(spark: SparkSession, d: str) -> DataFrame:
    """Order counts of all users' pictures, each user's stream of one of the three types."""
    pics = pictures.coded_pictures(events(spark, d))
    low = pictures.with_order_counts(pics).select("stream_id", "seq", "poc")
    rows = pictures.with_numbers(pics, 4).join(low, ["stream_id", "seq"])
    return rows.select("stream_id", "seq", pictures.order_count(F.col("stream_id") % 3, F.col("poc"), F.col("number"), F.col("ref"), [2, 4], -2).cast("long").alias("poc"))


QUERIES = {"poc_by_type": order_counts, "stream_display_order": stream_display_order, "marked_references": marked_references, "changed_lists": changed_lists, "field_order": field_order}


def sql(pictures_sql: str) -> dict[str, str]:
    numbers = pictures_sql + """, k AS (SELECT stream_id, group_no, seq, ref, poc, coalesce(sum(ref::INT) OVER (PARTITION BY stream_id, group_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT % 16 frame_num FROM o)"""
    field = lambda n, bottom: f"(k + {n}) || CASE WHEN {bottom} THEN 'b' ELSE 't' END"
    pair = lambda n, a, b: f"CASE WHEN ({a}) = (k % 5 < 2) THEN {field(n, a)} || ' ' || {field(n, b)} ELSE {field(n, b)} || ' ' || {field(n, a)} END"
    return {
        "poc_by_type": pictures_sql + """, k AS (SELECT stream_id, seq, ref, poc, coalesce(sum(ref::INT) OVER (PARTITION BY stream_id, group_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT number FROM o),
z AS (SELECT *, CASE WHEN number > 0 AND NOT ref THEN number - 1 ELSE number END m FROM k)
SELECT stream_id, seq, (CASE stream_id % 3 WHEN 0 THEN poc WHEN 1 THEN CASE WHEN m > 0 THEN (m - 1) // 2 * 6 + CASE WHEN (m - 1) % 2 = 0 THEN 2 ELSE 6 END ELSE 0 END - CASE WHEN ref THEN 0 ELSE 2 END
  ELSE 2 * number - CASE WHEN ref THEN 0 ELSE 1 END END)::BIGINT poc FROM z""",
        "stream_display_order": pictures_sql + " SELECT stream_id, seq, group_no, poc, 'p' || seq meta, row_number() OVER (PARTITION BY stream_id ORDER BY group_no, poc, seq) shown FROM o",
        # a number is held if it is lower than the picture's, but for even ones whose odd successor, which unmarks them, is lower too
        "marked_references": numbers + """, h AS (SELECT stream_id, seq, [n FOR n IN range(frame_num) IF n % 2 = 1 OR n + 1 >= frame_num] held FROM k),
w AS (SELECT stream_id, seq, CASE WHEN len(held) > 4 THEN held[-4:] ELSE held END held FROM h) SELECT stream_id, seq, array_to_string(held, ',') short, 0::BIGINT AS long FROM w""",
        "changed_lists": numbers + """, z AS (SELECT *, coalesce(list({'poc': poc, 'n': frame_num}) FILTER (ref) OVER w, []) held FROM k WINDOW w AS (PARTITION BY stream_id, group_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT stream_id, seq, (frame_num - seq % 5 - 1 + 16) % 16 wanted, [x.n FOR x IN list_reverse_sort(CASE WHEN len(held) > 4 THEN held[-4:] ELSE held END)] plain FROM z)
SELECT stream_id, seq, array_to_string(plain, ',') plain, array_to_string(CASE WHEN list_contains(plain, wanted) THEN list_concat([wanted], [n FOR n IN plain IF n <> wanted]) ELSE plain END, ',') changed FROM p""",
        "field_order": f"WITH t AS (SELECT p_partkey k FROM part) SELECT k p_partkey, {pair(0, 'k % 2 = 0', 'k % 2 = 1')} || ' ' || {pair(1, 'k % 3 = 0', 'k % 3 > 0')} fields FROM t",
    }
