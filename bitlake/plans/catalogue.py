"""The registered queries of the decoder's operators and their SQL; carriers turn table rows into codec inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitlake.functions import codec
from bitlake.operators import pictures
from bitlake.plans import assembly_queries, block_queries, grid_queries, header_queries, prediction_queries, sample_queries, stream_queries
from bitlake.sources import framing


def table(name: str):
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


def byte(col: str, at: int) -> Column:
    return F.conv(F.hex(F.substring(F.encode(F.col(col), "UTF-8"), at, 1)), 16, 10).cast("int")


def of_events(make):
    return lambda spark, d: make(pictures.coded_pictures(table("events")(spark, d)))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """The first 16 bytes of each document as samples s1 to s16; shorter texts repeat a pattern byte."""
    docs = table("documents")(spark, d).select("doc_id", F.concat(F.col("text"), F.repeat(F.lit("Q"), 16)).alias("t"))
    return docs.select("doc_id", *(byte("t", i).alias(f"s{i}") for i in range(1, 17)))


def of_samples(make):
    return lambda spark, d: (lambda s: s.select("doc_id", *make(*(F.col(f"s{i}") for i in range(1, 17)))))(samples(spark, d))


def groups(spark: SparkSession, d: str, width: int) -> DataFrame:
    """Each whole text as groups of `width` bytes, numbered from 0: samples s1 to s`width`; the last group is padded like a short text."""
    padded = F.encode(F.concat(F.col("text"), F.repeat(F.lit("Q"), width)), "UTF-8")
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / width)).cast("int")
    cut = F.transform(F.array(padded), lambda b: F.transform(F.sequence(F.lit(0), n - 1), lambda g: F.substring(b, g * width + 1, F.lit(width))))[0]
    rows = table("documents")(spark, d).select("doc_id", F.posexplode(cut).alias("group_no", "g"))
    at = range(0, width, 6)  # as many bytes at once as a long holds
    rows = rows.select("doc_id", F.col("group_no").cast("long"), *(F.conv(F.hex(F.substring("g", i + 1, 6)), 16, 10).cast("long").alias(f"w{i}") for i in at))
    return rows.select("doc_id", "group_no", *(F.shiftright(f"w{i}", 8 * (min(6, width - i) - 1 - k)).bitwiseAND(255).cast("int").alias(f"s{i + k + 1}") for i in at for k in range(min(6, width - i))))


def of_groups(width: int, make):
    return lambda spark, d: (lambda s: s.select("doc_id", "group_no", *make(*(F.col(f"s{i}") for i in range(1, width + 1)))))(groups(spark, d, width))


def line_ints(spark: SparkSession, d: str) -> DataFrame:
    return table("lineitem")(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))


def half_samples(spark: SparkSession, d: str) -> DataFrame:
    """Horizontal half samples over the quantities of a supplier's part sizes: rows of p_size by brand."""
    parts = table("part")(spark, d)
    w = Window.partitionBy("p_brand").orderBy("p_partkey")  # a row of samples; as many tasks as rows
    all_w = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("p_size").over(all_w), F.last("p_size").over(all_w)
    taps = [F.coalesce(F.lag("p_size", k).over(w), first) if k > 0 else F.col("p_size") if k == 0 else F.coalesce(F.lead("p_size", -k).over(w), last) for k in (2, 1, 0, -1, -2, -3)]
    return parts.select("p_partkey", codec.six_tap(taps).cast("long").alias("half"))


def start_code_units(spark: SparkSession, d: str) -> DataFrame:
    """Texts as streams: each `a` is a start code."""
    docs = table("documents")(spark, d).select("doc_id", F.encode(F.replace("text", F.lit("a"), F.lit("\0\0\1")), "UTF-8").alias("data"))
    u = framing.units(docs, "doc_id", "data")
    return u.groupBy("doc_id").agg(F.count("*").alias("units"), F.sum(F.length("payload") + 1).cast("long").alias("bytes"))


def type_histogram(spark: SparkSession, d: str) -> DataFrame:
    docs = table("documents")(spark, d).where("text <> ''")
    return docs.select(*framing.header(byte("text", 1))).where("forbidden = 0").groupBy("unit_type").agg(F.count("*").alias("n"))


SAMPLED = {
    "weighted_prediction": lambda *s: [codec.weighted_uni(s[0], 5, s[1] - 90, s[2] - 100).cast("long").alias("uni"), codec.weighted_bi(s[0], s[1], 5, s[2] - 64, s[3] - 64, s[4] - s[5]).cast("long").alias("bi"), F.shiftright(s[0] + s[1] + 1, 1).cast("long").alias("mean")],
    "chroma_bilinear": lambda *s: [codec.bilinear(s[0], s[1], s[2], s[3], s[4] % 8, s[5] % 8).cast("long").alias("value")],
    "hadamard": lambda *s: [c.cast("long").alias(f"h{i}") for i, c in enumerate(codec.hadamard2(*s[:4]))],
    "intra_mean": lambda *s: [F.shiftright(sum(s[1:8], s[0]) + 4, 3).cast("long").alias("both"), F.shiftright(s[0] + s[1] + s[2] + s[3] + 2, 2).cast("long").alias("above")],
    "edge_filter": lambda *s: [codec.should_filter(s[1], s[2], s[3], s[4], 60, 40).alias("filtered"), codec.filtered_p0(s[0], s[1], s[2], s[3], s[4], s[5], 4, 40).cast("long").alias("p0")],
}

QUERIES = {
    "display_order": of_events(lambda p: pictures.display_order(p).select("stream_id", "seq", "group_no", "poc", "shown")),
    "poc_type0": of_events(lambda p: pictures.with_order_counts(p).select("stream_id", "seq", "poc")),
    "gop_session": of_events(lambda p: pictures.with_groups(p).groupBy("stream_id", "group_no").agg(F.count("*").alias("pictures"), F.min("seq").alias("first_seq"))),
    "dpb_sliding_window": of_events(lambda p: pictures.with_references(p).select("stream_id", "seq", F.array_join("refs", ",").alias("refs"))),
    "reference_lists": of_events(lambda p: pictures.reference_lists(p).select("stream_id", "seq", *(F.array_join(c, ",").alias(c) for c in ("p", "l0", "l1")))),
    "unit_type_histogram": type_histogram,
    "start_code_units": start_code_units,
    "unit_header": lambda s, d: table("documents")(s, d).where("text <> ''").select("doc_id", *framing.header(byte("text", 1))),
    "frame_digest": lambda s, d: table("documents")(s, d).select("doc_id", F.sha2("text", 256).alias("digest")),
    "exp_golomb": lambda s, d: table("events")(s, d).withColumn("bits", codec.ue_code(F.col("event_id") % 1000)).select("event_id", "bits", codec.read_ue(F.col("bits")).alias("ue"), codec.read_se(F.col("bits")).alias("se")),
    "quality_steps": lambda s, d: line_ints(s, d).select("l_orderkey", "l_linenumber", "q", codec.chroma_qp(F.col("q"), 3).cast("long").alias("chroma"), codec.context_state(F.col("l_linenumber") - 4, F.col("q"), F.col("q")).cast("long").alias("state")),
    "temporal_scale": lambda s, d: line_ints(s, d).select("l_orderkey", "l_suppkey", "q", codec.temporal_scale((F.col("l_suppkey") % 60 - 30).cast("long"), F.col("q").cast("long")).cast("long").alias("scale")),
    "vector_median": lambda s, d: line_ints(s, d).select("l_orderkey", "l_partkey", "l_suppkey", "q", codec.median(F.col("l_partkey") % 64, F.col("l_suppkey") % 64, F.col("q").cast("long")).alias("mid")),
    "half_samples": half_samples,
} | {name: of_samples(make) for name, make in SAMPLED.items()}

PICS = """
WITH a AS (SELECT user_id stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 seq FROM events),
b AS (SELECT *, seq % 12 p FROM a),
c AS (SELECT stream_id, seq, p = 0 idr, (p = 0 OR (p - 1) % 3 = 0) ref, CASE WHEN p = 0 THEN 0 WHEN (p - 1) % 3 = 0 THEN p + 2 ELSE p - 1 END shown FROM b),
g AS (SELECT *, (2 * shown) % 16 lsb, (sum(idr::INT) OVER (PARTITION BY stream_id ORDER BY seq))::BIGINT group_no FROM c),
o AS (SELECT *, (2 * shown)::BIGINT poc FROM g),
f AS (SELECT *, coalesce(list(poc) FILTER (ref) OVER w, []) held FROM o WINDOW w AS (PARTITION BY stream_id, group_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN len(held) > 4 THEN held[-4:] ELSE held END refs FROM f)"""
BYTES = """
WITH t AS (SELECT doc_id, encode(text || repeat('Q', 16)) b FROM documents),
s AS (SELECT doc_id, """ + ", ".join(f"('0x' || hex(b[{i}:{i}]))::INT s{i}" for i in range(1, 17)) + " FROM t)"  # fmt: skip
FIRST = "SELECT doc_id, ('0x' || hex(encode(text)[1:1]))::INT b FROM documents WHERE text <> ''"

SQL = {
    "display_order": PICS + " SELECT stream_id, seq, group_no, poc, row_number() OVER (PARTITION BY stream_id ORDER BY group_no, poc, seq) shown FROM o",
    "poc_type0": PICS + " SELECT stream_id, seq, poc FROM o",
    "gop_session": PICS + " SELECT stream_id, group_no, count(*) pictures, min(seq) first_seq FROM g GROUP BY ALL",
    "dpb_sliding_window": PICS + " SELECT stream_id, seq, array_to_string(refs, ',') refs FROM r",
    "reference_lists": PICS + """, x AS (SELECT *, list_reverse_sort(list_filter(refs, lambda v: v <= poc)) past, list_sort(list_filter(refs, lambda v: v > poc)) future FROM r),
y AS (SELECT *, list_concat(past, future) l0, list_concat(future, past) l1 FROM x)
SELECT stream_id, seq, array_to_string(list_reverse_sort(refs), ',') p, array_to_string(l0, ',') l0,
  array_to_string(CASE WHEN len(l1) > 1 AND l0 = l1 THEN list_concat([l1[2], l1[1]], l1[3:]) ELSE l1 END, ',') l1 FROM y""",
    "unit_type_histogram": f"SELECT b & 31 unit_type, count(*) n FROM ({FIRST}) WHERE b < 128 GROUP BY 1",
    "start_code_units": """
WITH p AS (SELECT doc_id, unnest(string_split(text, 'a')[2:]) u FROM documents)
SELECT doc_id, count(*) units, sum(strlen(u))::BIGINT bytes FROM p WHERE u <> '' AND ascii(u) < 128 GROUP BY doc_id""",
    "unit_header": f"SELECT doc_id, b >> 7 forbidden, (b >> 5) & 3 ref_idc, b & 31 unit_type FROM ({FIRST})",
    "frame_digest": "SELECT doc_id, sha256(text) digest FROM documents",
    "exp_golomb": "SELECT event_id, repeat('0', len(bin(event_id % 1000 + 1)) - 1) || bin(event_id % 1000 + 1) bits, event_id % 1000 ue, CASE WHEN event_id % 2 = 0 THEN -((event_id % 1000) // 2) ELSE (event_id % 1000 + 1) // 2 END se FROM events",
    "quality_steps": """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity::INT q FROM lineitem), u AS (SELECT *, 2 * ((((l_linenumber - 4) * q) >> 4) + q) - 127 pre, least(51, q + 3) c FROM t),
v AS (SELECT *, CASE WHEN pre < 0 THEN -pre - 1 ELSE pre END z FROM u)
SELECT l_orderkey, l_linenumber, q, (CASE WHEN c < 30 THEN c ELSE [29,30,31,32,32,33,34,34,35,35,36,36,37,37,37,38,38,38,39,39,39,39][c - 29] END)::BIGINT chroma, (CASE WHEN z > 124 THEN 124 + z % 2 ELSE z END)::BIGINT state FROM v""",
    "temporal_scale": "WITH t AS (SELECT l_orderkey, l_suppkey, l_quantity::INT q, l_suppkey % 60 - 30 tb FROM lineitem) SELECT l_orderkey, l_suppkey, q, greatest(-1024, least(1023, (tb * ((16384 + q // 2) // q) + 32) >> 6))::BIGINT scale FROM t",
    "vector_median": "WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity::INT q FROM lineitem) SELECT *, list_sort([l_partkey % 64, l_suppkey % 64, q::BIGINT])[2] mid FROM t",
    "half_samples": """
WITH t AS (SELECT p_partkey, p_size s2, coalesce(lag(p_size, 2) OVER w, first_value(p_size) OVER a) s0, coalesce(lag(p_size) OVER w, first_value(p_size) OVER a) s1, coalesce(lead(p_size) OVER w, last_value(p_size) OVER a) s3,
  coalesce(lead(p_size, 2) OVER w, last_value(p_size) OVER a) s4, coalesce(lead(p_size, 3) OVER w, last_value(p_size) OVER a) s5 FROM part
  WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey), a AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT p_partkey, greatest(0, least(255, (s0 - 5 * s1 + 20 * s2 + 20 * s3 - 5 * s4 + s5 + 16) >> 5))::BIGINT half FROM t""",
    "weighted_prediction": BYTES + " SELECT doc_id, greatest(0, least(255, ((s1 * (s2 - 90) + 16) >> 5) + s3 - 100))::BIGINT uni, greatest(0, least(255, ((s1 * (s3 - 64) + s2 * (s4 - 64) + 32) >> 6) + ((s5 - s6 + 1) >> 1)))::BIGINT bi, ((s1 + s2 + 1) >> 1)::BIGINT mean FROM s",
    "chroma_bilinear": BYTES + " SELECT doc_id, (((8 - s5 % 8) * (8 - s6 % 8) * s1 + (s5 % 8) * (8 - s6 % 8) * s2 + (8 - s5 % 8) * (s6 % 8) * s3 + (s5 % 8) * (s6 % 8) * s4 + 32) >> 6)::BIGINT AS value FROM s",
    "hadamard": BYTES + " SELECT doc_id, (s1 + s2 + s3 + s4)::BIGINT h0, (s1 - s2 + s3 - s4)::BIGINT h1, (s1 + s2 - s3 - s4)::BIGINT h2, (s1 - s2 - s3 + s4)::BIGINT h3 FROM s",
    "intra_mean": BYTES + " SELECT doc_id, ((s1 + s2 + s3 + s4 + s5 + s6 + s7 + s8 + 4) >> 3)::BIGINT AS both, ((s1 + s2 + s3 + s4 + 2) >> 2)::BIGINT above FROM s",
    "edge_filter": BYTES + """, e AS (SELECT *, 4 + (abs(s1 - s3) < 40)::INT + (abs(s6 - s4) < 40)::INT tc FROM s)
SELECT doc_id, abs(s3 - s4) < 60 AND abs(s2 - s3) < 40 AND abs(s5 - s4) < 40 filtered, greatest(0, least(255, s3 + greatest(-tc, least(tc, ((s4 - s3) * 4 + (s2 - s5) + 4) >> 3))))::BIGINT p0 FROM e""",
}

_queries, _sql = block_queries.queries(of_samples, BYTES, PICS)
QUERIES |= _queries | header_queries.QUERIES
SQL |= _sql | header_queries.sql(PICS)

#: The queries of samples over whole texts: by each name, the bytes that a block takes. The SQL differs in its carrier and, for three, in returning all values.
WHOLE = {"weighted_prediction": 6, "chroma_bilinear": 6, "hadamard": 4, "intra_mean": 8, "edge_filter": 6, "dequantise": 16, "dequantise_chroma_dc": 4, "inverse_rows": 16, "inverse_columns": 16, "hadamard4": 16, "quarter_samples": 6, "intra_plane": 16, "strong_filter": 6}


def groups_sql(width: int) -> str:
    bytes_ = ", ".join(f"('0x' || hex(b[{width} * group_no + {i}:{width} * group_no + {i}]))::INT s{i}" for i in range(1, width + 1))
    return f"""
WITH t AS (SELECT doc_id, encode(text || repeat('Q', {width})) b, unnest(range(greatest(1, (coalesce(strlen(text), 0) + {width - 1}) // {width}))) group_no FROM documents),
s AS (SELECT doc_id, group_no, {bytes_} FROM t)"""


_makers, _sql = block_queries.queries(lambda make: make, "", PICS, whole=True)
_makers |= SAMPLED
_sql |= {name: SQL[name].removeprefix(BYTES) for name in SAMPLED}
for _name, _width in WHOLE.items():
    QUERIES[f"whole_{_name}"] = of_groups(_width, _makers[_name])
    SQL[f"whole_{_name}"] = groups_sql(_width) + _sql[_name].replace("SELECT doc_id,", "SELECT doc_id, group_no,")
for _name, _make in sample_queries.MAKERS.items():
    _width, _ordered = sample_queries.WIDTHS[_name], sample_queries.ORDERED.get(_name)
    QUERIES[_name] = sample_queries.in_order(_width, *_ordered) if _ordered else sample_queries.of_arrays(_width, _make)
QUERIES |= sample_queries.QUERIES | stream_queries.QUERIES | assembly_queries.QUERIES | grid_queries.QUERIES | prediction_queries.QUERIES
SQL |= sample_queries.sql(groups_sql) | stream_queries.sql(PICS) | assembly_queries.SQL | grid_queries.SQL | prediction_queries.sql(PICS)
