"""Queries of blocks, edges, neighbours and picture numbering, and their SQL, on bytes of texts and rows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitlake.functions import blocks
from bitlake.operators import pictures


def queries(of_samples, samples_sql: str, pictures_sql: str, whole: bool = False) -> tuple[dict, dict]:
    """The queries and their SQL; of_samples and the SQL's beginnings make the carriers. whole: all values of a block."""
    values, points = (16, [(x, y) for y in range(8) for x in range(8)]) if whole else (8, [(0, 0), (7, 0), (3, 5), (7, 7)])
    longs = lambda prefix, columns: [c.cast("long").alias(f"{prefix}{i}") for i, c in enumerate(columns)]
    named = lambda **columns: [c.cast("long").alias(k) for k, c in columns.items()]
    wide = lambda s: [c.cast("long") for c in s]
    found = {
        "dequantise": of_samples(lambda *s: longs("d", [blocks.dequantised(v - 128, s[0] % 52, i % 4, i // 4) for i, v in enumerate(wide(s)[:values])])),
        "dequantise_chroma_dc": of_samples(lambda *s: longs("d", [blocks.dequantised_chroma_dc(v - 128, s[0] % 52) for v in wide(s)[:4]])),
        "inverse_rows": of_samples(lambda *s: longs("r", blocks.by_rows([v - 128 for v in wide(s)], blocks.butterfly))),
        "inverse_columns": of_samples(lambda *s: longs("r", blocks.second_half([64 * v - 8192 for v in wide(s)]))),
        "hadamard4": of_samples(lambda *s: longs("h", blocks.hadamard4([v - 128 for v in wide(s)])[:values])),
        "quarter_samples": of_samples(lambda *s: named(quarter=blocks.quarter_sample(list(s[:6])))),
        "intra_plane": of_samples(lambda *s: longs("v", [blocks.plane(list(s[:8]), list(s[8:16]), s[7], x, y) for x, y in points])),
        "strong_filter": of_samples(lambda *s: longs("p", blocks.strong_filter(*s[:6], 60, 40))),
        "edge_strength": lambda s, d: neighbours(s, d).select("event_id", blocks.edge_strength(F.col("mode") < 2, F.col("place") % 4 == 0, F.col("n") % 3 == 0, F.col("mode") % 5 == 4, F.col("mode") - F.col("n"), F.col("n") - 9).cast("long").alias("strength")),
        "implicit_weights": lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q")).select("l_orderkey", "l_suppkey", "q", *longs("w", blocks.implicit_weights((F.col("l_suppkey") % 300 - 150).cast("long"), F.col("q").cast("long")))),
        "least_reference": lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", blocks.least_reference(F.col("l_partkey") % 5 - 2, F.col("l_suppkey") % 4 - 2, F.col("l_linenumber") - 4).cast("long").alias("ref")),
        "predicted_mode": lambda s, d: neighbours(s, d).select("event_id", blocks.predicted_mode(F.col("left_mode"), F.col("up_mode")).cast("long").alias("mode")),
        "coefficient_context": lambda s, d: neighbours(s, d).select("event_id", blocks.coefficient_context(F.col("left_n"), F.col("up_n")).cast("long").alias("context")),
        "poc_type1": lambda s, d: numbered(s, d).select("stream_id", "seq", pictures.order_count_cycle(F.col("number"), F.col("ref"), [2, 4], -2).cast("long").alias("poc")),
        "poc_type2": lambda s, d: numbered(s, d).select("stream_id", "seq", pictures.order_count_plain(F.col("number"), F.col("ref")).cast("long").alias("poc")),
        "frame_numbers": lambda s, d: numbered(s, d).select("stream_id", "seq", "frame_num", F.col("number").cast("long")),
    }
    scale = lambda x, y: f"[{','.join(str(r[0 if x % 2 == y % 2 == 0 else 1 if x % 2 == y % 2 == 1 else 2]) for r in blocks.SCALES)}][s1 % 52 % 6 + 1]"
    deq = lambda i: f"(CASE WHEN s1 % 52 >= 24 THEN (s{i + 1} - 128) * {scale(i % 4, i // 4)} * 16 * (1 << greatest(0, s1 % 52 // 6 - 4)) ELSE floor(((s{i + 1} - 128) * {scale(i % 4, i // 4)} * 16 + (1 << greatest(0, 3 - s1 % 52 // 6))) / (1 << greatest(0, 4 - s1 % 52 // 6))) END)::BIGINT d{i}"
    fly = lambda a, b, c, d: [f"{a} + {c} + {b} + ({d} >> 1)", f"{a} - {c} + ({b} >> 1) - {d}", f"{a} - {c} - ({b} >> 1) + {d}", f"{a} + {c} - {b} - ({d} >> 1)"]
    rows = ", ".join(f"({e})::BIGINT r{4 * y + x}" for y in range(4) for x, e in enumerate(fly(*(f"(s{4 * y + i} - 128)" for i in range(1, 5)))))
    cols = ", ".join(f"(({e} + 32) >> 6)::BIGINT r{4 * y + x}" for x in range(4) for y, e in enumerate(fly(*(f"(64 * s{4 * i + x + 1} - 8192)" for i in range(4)))))
    sign = [[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]]
    had = ", ".join(f"({' + '.join(f'{sign[k // 4][i // 4] * sign[k % 4][i % 4]} * (s{i + 1} - 128)' for i in range(16))})::BIGINT h{k}" for k in range(values))
    slope = lambda o: f"((34 * ((s{o + 5} - s{o + 3}) + 2 * (s{o + 6} - s{o + 2}) + 3 * (s{o + 7} - s{o + 1}) + 4 * (s{o + 8} - s8)) + 32) >> 6)"
    plane = ", ".join(f"greatest(0, least(255, (16 * (s8 + s16) + {slope(0)} * {x - 3} + {slope(8)} * {y - 3} + 16) >> 5))::BIGINT v{i}" for i, (x, y) in enumerate(points))
    grid = """WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 place, event_id % 9 mode, event_id % 17 n FROM events),
b AS (SELECT *, CASE WHEN place % 8 > 0 THEN lag(mode) OVER w END left_mode, lag(mode, 8) OVER w up_mode, CASE WHEN place % 8 > 0 THEN lag(n) OVER w END left_n, lag(n, 8) OVER w up_n FROM a WINDOW w AS (PARTITION BY user_id ORDER BY place))"""
    numbers = pictures_sql + ", k AS (SELECT stream_id, seq, ref, coalesce(sum(ref::INT) OVER (PARTITION BY stream_id, group_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT number FROM g)"
    sql = {
        "dequantise": samples_sql + f" SELECT doc_id, {', '.join(deq(i) for i in range(values))} FROM s",
        "dequantise_chroma_dc": samples_sql + " SELECT doc_id, " + ", ".join(f"(((s{i + 1} - 128) * {scale(0, 0)} * 16 * (1 << (s1 % 52 // 6))) >> 5)::BIGINT d{i}" for i in range(4)) + " FROM s",
        "inverse_rows": samples_sql + f" SELECT doc_id, {rows} FROM s",
        "inverse_columns": samples_sql + f" SELECT doc_id, {cols} FROM s",
        "hadamard4": samples_sql + f" SELECT doc_id, {had} FROM s",
        "quarter_samples": samples_sql + " SELECT doc_id, ((s3 + greatest(0, least(255, (s1 - 5 * s2 + 20 * s3 + 20 * s4 - 5 * s5 + s6 + 16) >> 5)) + 1) >> 1)::BIGINT AS quarter FROM s",
        "intra_plane": samples_sql + f" SELECT doc_id, {plane} FROM s",
        "strong_filter": samples_sql + """, e AS (SELECT *, abs(s2 - s4) < 40 AND abs(s4 - s5) < 17 ok FROM s) SELECT doc_id, (CASE WHEN ok THEN (s2 + 2 * s3 + 2 * s4 + 2 * s5 + s6 + 4) >> 3 ELSE (2 * s3 + s4 + s6 + 2) >> 2 END)::BIGINT p0,
  (CASE WHEN ok THEN (s2 + s3 + s4 + s5 + 2) >> 2 ELSE s3 END)::BIGINT p1, (CASE WHEN ok THEN (2 * s1 + 3 * s2 + s3 + s4 + s5 + 4) >> 3 ELSE s2 END)::BIGINT p2 FROM e""",
        "edge_strength": grid + " SELECT event_id, (CASE WHEN mode < 2 THEN CASE WHEN place % 4 = 0 THEN 4 ELSE 3 END WHEN n % 3 = 0 THEN 2 WHEN mode % 5 = 4 OR abs(mode - n) > 3 OR abs(n - 9) > 3 THEN 1 ELSE 0 END)::BIGINT strength FROM b",
        "implicit_weights": """WITH t AS (SELECT l_orderkey, l_suppkey, l_quantity::INT q, greatest(-128, least(127, l_suppkey % 300 - 150)) tb FROM lineitem),
u AS (SELECT *, greatest(-1024, least(1023, (tb * ((16384 + q // 2) // q) + 32) >> 6)) >> 2 w FROM t)
SELECT l_orderkey, l_suppkey, q, (CASE WHEN w BETWEEN -64 AND 128 THEN 64 - w ELSE 32 END)::BIGINT w0, (CASE WHEN w BETWEEN -64 AND 128 THEN w ELSE 32 END)::BIGINT w1 FROM u""",
        "least_reference": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(list_min(list_filter([l_partkey % 5 - 2, l_suppkey % 4 - 2, l_linenumber - 4], lambda v: v >= 0)), -1)::BIGINT ref FROM lineitem",
        "predicted_mode": grid + " SELECT event_id, (CASE WHEN left_mode IS NULL OR up_mode IS NULL THEN 2 ELSE least(left_mode, up_mode) END)::BIGINT mode FROM b",
        "coefficient_context": grid + " SELECT event_id, coalesce((left_n + up_n + 1) >> 1, left_n, up_n, 0)::BIGINT context FROM b",
        "poc_type1": numbers + ", z AS (SELECT *, CASE WHEN number > 0 AND NOT ref THEN number - 1 ELSE number END m FROM k) SELECT stream_id, seq, (CASE WHEN m > 0 THEN (m - 1) // 2 * 6 + CASE WHEN (m - 1) % 2 = 0 THEN 2 ELSE 6 END ELSE 0 END - CASE WHEN ref THEN 0 ELSE 2 END)::BIGINT poc FROM z",
        "poc_type2": numbers + " SELECT stream_id, seq, (2 * number - CASE WHEN ref THEN 0 ELSE 1 END)::BIGINT poc FROM k",
        "frame_numbers": numbers + " SELECT stream_id, seq, number % 4 frame_num, number FROM k",
    }
    return found, sql


def numbered(spark: SparkSession, d: str) -> DataFrame:
    return pictures.with_numbers(pictures.coded_pictures(spark.read.parquet(f"{d}/events.parquet")), 4)


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as blocks in rows of eight, each with its left and upper neighbour's mode and coefficients."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    a = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", (F.col("event_id") % 9).alias("mode"), (F.col("event_id") % 17).alias("n"), (F.row_number().over(w) - 1).alias("place"))
    left = lambda c: F.when(F.col("place") % 8 > 0, F.lag(c).over(w))
    return a.select("*", left("mode").alias("left_mode"), F.lag("mode", 8).over(w).alias("up_mode"), left("n").alias("left_n"), F.lag("n", 8).over(w).alias("up_n"))
