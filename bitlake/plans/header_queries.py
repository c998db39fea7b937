"""Queries of framing, parameter sets and slice headers, and their SQL: table rows are written as bits, then read by the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlake.functions.codec import more_data, read_te, read_u, ue_code
from bitlake.functions.either import let
from bitlake.operators import parameters, pictures, runs
from bitlake.sources import framing


def fixed(value: Column, n: int) -> Column:
    return F.lpad(F.bin(value), n, "0")


def se_code(value: Column) -> Column:
    return ue_code(F.when(value > 0, 2 * value - 1).otherwise(-2 * value))


def bits(*parts: Column | str) -> Column:
    """The parts as bytes, with the stop bit and zeros up to a whole byte."""
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("1"))
    padded = lambda t: F.rpad(t, F.ceil(F.length(t) / 8).cast("int") * 8, "0")
    digit = lambda t: lambda i: F.lpad(F.conv(F.substring(t, i, F.lit(8)), 2, 16), 2, "0")
    packed = lambda t: F.array_join(F.transform(F.sequence(F.lit(1), F.length(t) - 7, F.lit(8)), digit(t)), "")
    return F.unhex(let(let(text, padded), packed))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sized(data: Column) -> Column:
    """A unit of type 1 with this payload behind its length."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data) + 1), 8, "0")), F.lit(bytearray(b"\x41")), data)


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Texts as streams of the bytes 0 to 3, from their small letters and spaces by frequency."""
    kept = F.translate(F.regexp_replace("text", "[^a-z ]+", ""), " etaoinrshldcumfpgwybvkxjqz", "ppppqsrrrrrrrrrrrrrrrrrrrrr")
    return table(spark, d, "documents").select("doc_id", F.unhex(F.translate(F.hex(F.encode(kept, "UTF-8")), "7", "0")).alias("data"))  # p to s are 70 to 73


def escapes(spark: SparkSession, d: str) -> DataFrame:
    """Each whole stream as one unit, without the bytes that keep start codes out."""
    units = framing.units(symbols(spark, d).withColumn("data", sized(F.col("data"))), "doc_id", "data", 4)
    return units.select("doc_id", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))


def start_codes(spark: SparkSession, d: str) -> DataFrame:
    units = framing.units(symbols(spark, d), "doc_id", "data")
    return units.select("doc_id", "unit_no", F.col("unit_type").cast("long"), F.sha2("payload", 256).alias("digest"))


def lengths(spark: SparkSession, d: str) -> DataFrame:
    """Turns as units behind their lengths, a stream for each conversation."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", sized(F.coalesce(F.encode("text", "UTF-8"), F.lit(bytearray()))).alias("one"))
    streams = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "one"))).alias("all"))
    joined = streams.select("conv_id", F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["one"])), "")).alias("data"))
    units = framing.units(joined, "conv_id", "data", 4)
    return units.select("conv_id", "unit_no", F.col("ref_idc").cast("long"), parameters.unit_type_name(F.col("unit_type")).alias("name"), F.sha2("payload", 256).alias("digest"))


def sequence_units(spark: SparkSession, d: str) -> DataFrame:
    """Each part as a sequence parameter set whose fields are made from its numbers."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    high, cropped, timed, planes, kind = k % 3 == 0, k % 5 == 0, k % 4 == 0, k % 4 == 3, k % 3
    lists = F.when(k % 2 == 0, F.concat(F.lit("1" + 7 * "0" + "1"), se_code(F.lit(-8)), F.when(planes, "0000").otherwise(""))).otherwise("0")
    depth = F.concat(ue_code(k % 4), F.when(planes, "0").otherwise(""), ue_code(k % 7), ue_code(k % 5), F.lit("0"), lists)
    order = F.when(kind == 0, ue_code(k % 9)).when(kind == 1, F.concat(F.lit("0"), se_code(k % 5 - 2), se_code(F.lit(1)), ue_code(F.lit(2)), se_code(F.lit(2)), se_code(size % 7 - 3))).otherwise("")
    crop = F.when(cropped, F.concat(F.lit("1"), ue_code(size % 4), ue_code(size % 3), ue_code(F.lit(1)), ue_code(size % 2))).otherwise("0")
    rated = F.concat(ue_code(F.lit(1)), F.lit(8 * "0"), *(x for _ in range(2) for x in (ue_code(size), ue_code(k), F.lit("1"))), F.lit(20 * "0"))
    colour = F.concat(F.lit("1" + "101" + "1" + "1"), fixed(size % 10, 8), fixed(size % 18, 8), fixed(size % 9, 8))
    usage = F.concat(F.lit("0" + "0"), colour, F.lit("0" + "1"), fixed(size % 10, 32), fixed(k % 60000, 32), F.lit("1" + "1"), rated, F.lit("0" + "0" + "0" + "1" + "1"), *(ue_code(F.lit(0)) for _ in range(4)), ue_code(size % 5), ue_code(F.lit(4)))
    payload = bits(
        fixed(F.when(high, 100).otherwise(66), 8), 8 * "0", fixed(10 + size, 8), ue_code(k % 32), F.when(high, depth).otherwise(""), ue_code(k % 13), ue_code(kind), order,
        ue_code(size % 17), "0", ue_code(size - 1), ue_code(size % 20), F.when(k % 2 == 0, "1").otherwise("01"), "1", crop, F.when(timed, F.concat(F.lit("1"), usage)).otherwise("0"),
    )
    return table(spark, d, "part").select(k.alias("stream_id"), F.lit(0).cast("long").alias("unit_no"), F.lit(3).alias("ref_idc"), F.lit(7).alias("unit_type"), payload.alias("payload"))


def sequence_sets(*names: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = {"sps_id": F.col("sps.sps_id"), "level": F.col("sps.level")} | parameters.information()
        sps = parameters.sequence_sets(sequence_units(spark, d))
        return sps.select(F.col("stream_id").alias("p_partkey"), *(found[n].cast("double" if n == "frame_rate" else "long").alias(n) for n in names))

    return query


def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    """Parts by brand as streams of many sets, of which each number's last one counts; and whether their sizes are usable, up to 400."""
    units = sequence_units(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("stream_id"), "p_brand"), "stream_id")
    sets = parameters.sequence_sets(units.select("p_brand", F.col("stream_id").alias("unit_no"), "unit_type", "payload"), "p_brand")
    rates = parameters.stream_rates(sets, "p_brand")
    bad = sets.groupBy("p_brand").agg(F.count(parameters.size_error(most=400)).alias("bad"))
    return rates.join(bad, "p_brand").select("p_brand", *(F.when(F.col("rate_num").isNotNull(), F.col("sps_id")).alias("sps_id"), "rate_num", "rate_den", "frame_rate"), "bad")


def picture_units(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier as a stream of a sequence set with a list and a picture set whose lists are left out, given, or absent."""
    k = F.col("s_suppkey")
    head = F.when(k % 2 == 0, "1").otherwise("0")
    rest = F.concat(ue_code(F.lit(0)), ue_code(F.lit(2)), ue_code(F.lit(1)), F.lit("0"), ue_code(F.lit(9)), ue_code(F.lit(9)), F.lit("1" + "1" + "0" + "0"))
    lists = F.when(k % 2 == 0, F.concat(F.lit("0" + "1"), *(se_code(F.lit(v)) for v in (2, -10)), F.lit(6 * "0"))).otherwise("")
    sps = bits(fixed(F.lit(100), 8), 16 * "0", ue_code(F.lit(3)), ue_code(F.lit(1)), ue_code(F.lit(0)), ue_code(F.lit(0)), "0", head, lists, rest)
    own = F.when(k % 3 == 0, F.concat(F.lit("11"), F.lit("001"), *(se_code(F.lit(v)) for v in (4, -12)), F.lit("00000"), se_code(k % 5 - 2))).when(k % 3 == 1, F.concat(F.lit("00"), se_code(k % 5 - 2))).otherwise("")
    pps = bits(ue_code(k % 4), ue_code(F.lit(3)), F.when(k % 2 == 0, "1").otherwise("0"), "0", ue_code(F.lit(0)), ue_code(k % 5), ue_code(k % 3), "1", "10", se_code(k % 9 - 4), se_code(F.lit(0)), se_code(k % 25 - 12), "100", own)
    unit = lambda no, kind, data: F.struct(F.lit(no).cast("long").alias("unit_no"), F.lit(3).alias("ref_idc"), F.lit(kind).alias("unit_type"), data.alias("payload"))
    return table(spark, d, "supplier").select(k.alias("stream_id"), F.inline(F.array(unit(0, 7, sps), unit(1, 8, pps))))


def picture_sets(spark: SparkSession, d: str) -> DataFrame:
    units = picture_units(spark, d)
    sps = parameters.sequence_sets(units).withColumn("_sps_id", F.col("sps.sps_id"))
    pps = parameters.picture_sets(units).withColumn("_sps_id", F.col("pps.sps_id"))
    pps = parameters.with_scaling(runs.held(pps, sps, ["stream_id", "_sps_id"], "unit_no", "sps"))
    own = [F.col(f"pps.{n}").cast("long").alias(n) for n in ("pps_id", "sps_id", "arithmetic", "refs_l0", "refs_l1", "weighted_bi", "init_qp", "chroma_offset", "transform_8x8", "second_chroma_offset")]
    return pps.select(F.col("stream_id").alias("s_suppkey"), *own, F.array_join(F.transform("matrices", lambda m: F.concat(F.element_at(m, 1).cast("string"), F.lit("/"), F.element_at(m, -1).cast("string"))), " ").alias("matrices"))


def slice_units(spark: SparkSession, d: str) -> DataFrame:
    """Coded pictures as slices behind their stream's sets; each stream changes its picture set before picture 24."""
    pics = pictures.with_numbers(pictures.coded_pictures(table(spark, d, "events")), 16)
    k, seq, lsb = F.col("stream_id"), F.col("seq"), F.col("lsb")
    is_b, p_or_b = ~F.col("ref") & ~F.col("idr"), ~F.col("idr")
    kind = F.when(F.col("idr"), 7).when(is_b, 1).otherwise(5).cast("long")
    marks = F.when(F.col("idr"), "00").when(F.col("ref"), F.when(seq % 2 == 0, F.concat(F.lit("1"), ue_code(F.lit(1)), ue_code(seq % 3), ue_code(F.lit(3)), ue_code(F.lit(0)), ue_code(F.lit(2)), ue_code(F.lit(0)))).otherwise("0")).otherwise("")
    refs = F.when(seq % 3 == 0, F.concat(F.lit("1"), ue_code(seq % 5), F.when(is_b, ue_code(F.lit(0))).otherwise(""))).otherwise("0")
    change = F.concat(F.when(seq % 4 == 1, F.concat(F.lit("1"), ue_code(F.lit(0)), ue_code(seq % 7), ue_code(F.lit(3)))).otherwise("0"), F.when(is_b, "0").otherwise(""))
    filters = F.concat(ue_code(seq % 3), F.when(seq % 3 != 1, F.concat(se_code(seq % 5 - 2), se_code(F.lit(1)))).otherwise(""))
    head = [ue_code(F.lit(0)), ue_code(kind), ue_code(k % 4), fixed(F.col("frame_num"), 4), F.when(F.col("idr"), ue_code(seq % 11)).otherwise(""), fixed(lsb, 4)]
    payload = bits(*head, F.when(is_b, "1").otherwise(""), F.when(p_or_b, F.concat(refs, change)).otherwise(""), marks, se_code(seq % 7 - 3), filters, "10110")
    row = lambda no, ref, type_, data: F.struct(no.cast("long").alias("unit_no"), ref.cast("int").alias("ref_idc"), type_.cast("int").alias("unit_type"), data.alias("payload"))
    one = row(seq + F.when(seq >= 24, 3).otherwise(2), F.col("ref").cast("int"), F.when(F.col("idr"), 5).otherwise(1), payload)
    sps = bits(fixed(F.lit(66), 8), 16 * "0", ue_code(F.lit(0)), ue_code(F.lit(0)), ue_code(F.lit(0)), ue_code(F.lit(0)), ue_code(F.lit(4)), "0", ue_code(F.lit(9)), ue_code(F.lit(9)), "1100")
    pps = lambda qp: bits(ue_code(k % 4), ue_code(F.lit(0)), "00", ue_code(F.lit(0)), ue_code(F.lit(1)), ue_code(F.lit(1)), "000", se_code(qp), se_code(F.lit(0)), se_code(F.lit(0)), "100")
    sets = [(F.lit(0), F.lit(3), F.lit(7), sps), (F.lit(1), F.lit(3), F.lit(8), pps(k % 10 - 5)), (F.lit(26), F.lit(3), F.lit(8), pps(k % 7 + 1))]
    firsts = F.when(seq == 0, F.array(*(row(*x) for x in sets)))  # with each stream's first picture, so that events are read once
    return pics.select(k, F.inline(F.concat(F.array(one), F.coalesce(firsts, F.array().cast("array<struct<unit_no: bigint, ref_idc: int, unit_type: int, payload: binary>>")))))


def slice_headers(spark: SparkSession, d: str) -> DataFrame:
    whole = runs.short(table(spark, d, "events"), ["user_id"], runs.RUN - 3)  # a unit for each, and three sets
    s = parameters.slice_headers(slice_units(spark, d), whole=whole)
    seq = F.col("unit_no") - F.when(F.col("unit_no") > 26, 3).otherwise(2)
    own = [F.col(f"header.{n}").cast("long").alias(n) for n in ("frame_num", "idr_pic_id", "poc_lsb", "refs_l0", "refs_l1", "filter_off", "alpha_offset")]
    joined = lambda c: F.array_join(F.transform(f"header.{c}", lambda x: F.array_join(x.cast("array<string>"), ":")), " ").alias(c)
    return s.select("stream_id", seq.alias("seq"), F.col("header.slice_type").alias("slice_type"), *own, joined("changes_l0"), joined("marking"), "qp", "error")


def side_messages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as user data behind an identifier made from their numbers, then a message of another type; every seventh unit is cut."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(bytearray()))
    size = F.octet_length(text) + 16
    coded = F.concat(F.repeat(F.lit("FF"), F.floor(size / 255).cast("int")), F.lpad(F.hex(size % 255), 2, "0"))
    uuid = F.lpad(F.hex(F.col("conv_id") * 1000 + F.col("turn")), 32, "0")
    payload = F.unhex(F.concat(F.lit("05"), coded, uuid, F.hex(text), F.lit("FF3002ABCD"), F.when(F.col("conv_id") % 7 == 0, "0109").otherwise("80")))
    units = table(spark, d, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("unit_no"), F.lit(0).alias("ref_idc"), F.lit(6).alias("unit_type"), payload.alias("payload"))
    rows = parameters.side_messages(units)
    return rows.select(F.col("stream_id").alias("conv_id"), F.col("unit_no").alias("turn"), "message_no", "payload_type", F.hex("uuid").alias("uuid"), F.sha2("data", 256).alias("digest"), "error")


def configurations(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as configuration records of a sequence and up to two picture sets, some of another version, or cut."""
    k = F.col("s_suppkey")
    unit = lambda head, n: F.concat(F.lpad(F.hex(n + 1), 4, "0"), F.lit(head), F.repeat(F.lit("5A"), n.cast("int")))
    text = F.concat(F.when(k % 11 == 0, "02").otherwise("01"), F.lit("42001E"), F.lpad(F.hex(252 + k % 4), 2, "0"), F.lit("E1"), unit("67", k % 9), F.lpad(F.hex(k % 3), 2, "0"), F.when(k % 3 > 0, unit("68", k % 5)).otherwise(""), F.when(k % 3 > 1, unit("68", k % 6)).otherwise(""))
    cut = F.when(k % 13 == 0, F.substring(text, 1, 14)).otherwise(text)
    found = parameters.configurations(table(spark, d, "supplier").select("s_suppkey", F.unhex(cut).alias("record")), "s_suppkey", "record")
    c = lambda n: F.col(f"configuration.{n}")
    return found.select("s_suppkey", c("length_size").cast("long").alias("length_size"), F.hex(F.get(c("sps"), F.lit(0))).alias("sps"), F.array_join(F.transform(c("pps"), lambda x: F.hex(x)), " ").alias("pps"), "error")


def truncated_codes(spark: SparkSession, d: str) -> DataFrame:
    """Event numbers as fixed, truncated and Exp-Golomb codes read back, and whether data is left behind them."""
    n, most = F.col("event_id") % 1000, 1 + F.col("event_id") % 2 * 999
    coded = F.when(most > 1, ue_code(n)).otherwise(F.when(n % 4 == 0, "1").otherwise("0"))
    rows = table(spark, d, "events").select("event_id", F.concat(coded, F.lit("1000")).alias("bits"), most.alias("most"), F.length(coded).alias("at"), fixed(n, 10).alias("u"))
    return rows.select("event_id", read_te(F.col("bits"), F.col("most")).alias("te"), read_u(F.col("u"), 10).alias("u"), more_data(F.col("bits"), F.col("at") - 1).alias("more"), more_data(F.col("bits"), F.col("at").cast("int")).alias("done"))


QUERIES = {
    "epb_removal": escapes,
    "annexb_split": start_codes,
    "avcc_split": lengths,
    "avcc_configuration": configurations,
    "sps_dims": sequence_sets("sps_id", "level", "coded_width", "coded_height", "width", "height", "depth_luma", "max_refs", "progressive"),
    "sps_frame_rate": sequence_sets("rate_num", "rate_den", "frame_rate", "full_range", "primaries", "transfer", "matrix", "max_reorder"),
    "stream_rates": stream_rates,
    "pps_fields": picture_sets,
    "slice_headers": slice_headers,
    "sei_messages": side_messages,
    "te_decode": truncated_codes,
}

_PART = """WITH p AS (SELECT p_partkey k, p_size::BIGINT z, p_brand FROM part),
f AS (SELECT *, CASE WHEN k % 3 = 0 THEN k % 4 ELSE 1 END chroma, k % 2 = 0 frames, k % 5 = 0 cropped, k % 4 = 0 timed FROM p),
s AS (SELECT *, 16 * z cw, 16 * (z % 20 + 1) * CASE WHEN frames THEN 1 ELSE 2 END ch FROM f)"""
_DIGITS = "WITH t AS (SELECT doc_id, translate(regexp_replace(text, '[^a-z ]', '', 'g'), ' etaoinrshldcumfpgwybvkxjqz', '000013222222222222222222222') y FROM documents)"
_BYTES = r"sha256(unhex(regexp_replace({}, '(.)', '0\1', 'g')))"


def sql(pictures_sql: str) -> dict[str, str]:
    return {
        "epb_removal": _DIGITS + ", u AS (SELECT doc_id, replace(y, '003', '00') p FROM t WHERE y IS NOT NULL) SELECT doc_id, len(p) bytes, " + _BYTES.format("p") + " digest FROM u",
        "annexb_split": _DIGITS + """, l AS (SELECT doc_id, string_split_regex(y, '000?1') parts FROM t), n AS (SELECT doc_id, len(parts) n, unnest(parts) u, generate_subscripts(parts, 1) place FROM l),
u AS (SELECT doc_id, place, CASE WHEN place < n THEN rtrim(u, '0') ELSE u END u FROM n WHERE place > 1), g AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 unit_no, u FROM u WHERE u <> '')
SELECT doc_id, unit_no, u[1]::BIGINT unit_type, """ + _BYTES.format("replace(u[2:], '003', '00')") + " digest FROM g",
        "avcc_split": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 unit_no, 2::BIGINT ref_idc, 'Slice' AS name, sha256(coalesce(text, '')) digest FROM conversations",
        "avcc_configuration": """WITH c AS (SELECT s_suppkey, s_suppkey k, CASE WHEN s_suppkey % 11 = 0 THEN 'avcC: unsupported configurationVersion' WHEN s_suppkey % 4 = 2 THEN 'avcC: invalid lengthSizeMinusOne'
  WHEN s_suppkey % 13 = 0 THEN 'avcC: truncated SPS length' END error FROM supplier)
SELECT s_suppkey, CASE WHEN error IS NULL THEN k % 4 + 1 END length_size, CASE WHEN error IS NULL THEN '67' || repeat('5A', k % 9) END sps,
  CASE WHEN error IS NULL THEN CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '68' || repeat('5A', k % 5) ELSE '68' || repeat('5A', k % 5) || ' 68' || repeat('5A', k % 6) END END pps, error FROM c""",
        "sps_dims": _PART + """ SELECT k p_partkey, k % 32 sps_id, 10 + z AS level, cw coded_width, ch coded_height,
  cw - CASE WHEN cropped THEN (z % 4 + z % 3) * CASE WHEN chroma IN (0, 3) THEN 1 ELSE 2 END ELSE 0 END width,
  ch - CASE WHEN cropped THEN (1 + z % 2) * CASE WHEN chroma = 1 THEN 2 ELSE 1 END * CASE WHEN frames THEN 1 ELSE 2 END ELSE 0 END height,
  CASE WHEN k % 3 = 0 THEN 8 + k % 7 ELSE 8 END depth_luma, z % 17 max_refs, frames::BIGINT progressive FROM s""",
        "sps_frame_rate": _PART + """, r AS (SELECT *, timed AND z % 10 > 0 AND k % 60000 > 0 rated FROM s)
SELECT k p_partkey, CASE WHEN rated THEN k % 60000 END rate_num, CASE WHEN rated THEN 2 * (z % 10) END rate_den, CASE WHEN rated THEN (k % 60000)::DOUBLE / (2 * (z % 10)) END frame_rate,
  timed::BIGINT full_range, CASE WHEN timed THEN z % 10 ELSE 2 END primaries, CASE WHEN timed THEN z % 18 ELSE 2 END transfer, CASE WHEN timed THEN z % 9 ELSE 2 END matrix, CASE WHEN timed THEN z % 5 END max_reorder FROM r""",
        "stream_rates": _PART + """, w AS (SELECT *, timed AND z % 10 > 0 AND k % 60000 > 0 rated, cw - CASE WHEN cropped THEN (z % 4 + z % 3) * CASE WHEN chroma IN (0, 3) THEN 1 ELSE 2 END ELSE 0 END w,
  ch - CASE WHEN cropped THEN (1 + z % 2) * CASE WHEN chroma = 1 THEN 2 ELSE 1 END * CASE WHEN frames THEN 1 ELSE 2 END ELSE 0 END h FROM s),
l AS (SELECT *, row_number() OVER (PARTITION BY p_brand, k % 32 ORDER BY k DESC) newest FROM w), r AS (SELECT p_brand, k, z, row_number() OVER (PARTITION BY p_brand ORDER BY k % 32) no FROM l WHERE newest = 1 AND rated),
b AS (SELECT p_brand, count(*) FILTER (w < 1 OR w > 400 OR h < 1 OR h > 400) bad FROM w GROUP BY 1)
SELECT b.p_brand, k % 32 sps_id, k % 60000 rate_num, 2 * (z % 10) rate_den, (k % 60000)::DOUBLE / (2 * (z % 10)) frame_rate, bad FROM b LEFT JOIN r ON r.p_brand = b.p_brand AND no = 1""",
        "pps_fields": """WITH s AS (SELECT s_suppkey k FROM supplier)
SELECT k s_suppkey, k % 4 pps_id, 3::BIGINT sps_id, (k % 2 = 0)::BIGINT arithmetic, k % 5 + 1 refs_l0, k % 3 + 1 refs_l1, 2::BIGINT weighted_bi, 22 + k % 9 init_qp, k % 25 - 12 chroma_offset, (k % 3 = 0)::BIGINT transform_8x8,
  CASE WHEN k % 3 < 2 THEN k % 5 - 2 ELSE k % 25 - 12 END second_chroma_offset,
  CASE WHEN k % 3 = 0 THEN '6/42 ' || CASE WHEN k % 2 = 0 THEN '10/10' ELSE '6/42' END || ' 12/12 10/34 10/34 10/34 16/16 16/16'
    WHEN k % 2 = 0 THEN '6/42 10/10 10/10 10/34 10/34 10/34 16/16 16/16' ELSE rtrim(repeat('16/16 ', 8)) END matrices FROM s""",
        "slice_headers": pictures_sql + """, k AS (SELECT stream_id, seq, idr, ref, lsb, coalesce(sum(ref::INT) OVER (PARTITION BY stream_id, group_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT % 16 frame_num FROM g)
SELECT stream_id, seq, CASE WHEN idr THEN 'I' WHEN ref THEN 'P' ELSE 'B' END slice_type, frame_num, CASE WHEN idr THEN seq % 11 END idr_pic_id, lsb poc_lsb,
  CASE WHEN idr THEN 0 WHEN seq % 3 = 0 THEN seq % 5 + 1 ELSE 2 END refs_l0, CASE WHEN ref THEN 0 WHEN seq % 3 = 0 THEN 1 ELSE 2 END refs_l1, seq % 3 filter_off, CASE WHEN seq % 3 <> 1 THEN seq % 5 - 2 ELSE 0 END alpha_offset,
  CASE WHEN NOT idr AND seq % 4 = 1 THEN '0:' || (seq % 7) ELSE '' END changes_l0, CASE WHEN ref AND NOT idr AND seq % 2 = 0 THEN '1:' || (seq % 3) || ':0 3:0:2' ELSE '' END marking,
  26 + CASE WHEN seq < 24 THEN stream_id % 10 - 5 ELSE stream_id % 7 + 1 END + seq % 7 - 3 qp, NULL::VARCHAR error FROM k""",
        "sei_messages": """WITH t AS (SELECT conv_id, turn, coalesce(text, '') x FROM conversations), e AS (SELECT conv_id, turn FROM t WHERE conv_id % 7 = 0), g AS (SELECT * FROM t WHERE conv_id % 7 <> 0)
SELECT conv_id, turn, 0::BIGINT message_no, 5::BIGINT payload_type, lpad(hex(conv_id * 1000 + turn), 32, '0') uuid, sha256(x) digest, NULL::VARCHAR error FROM g
UNION ALL SELECT conv_id, turn, 1, 303, NULL, sha256(unhex('ABCD')), NULL FROM g UNION ALL SELECT conv_id, turn, NULL, NULL, NULL, NULL, 'SEI payload size exceeds RBSP length' FROM e""",
        "te_decode": "WITH e AS (SELECT event_id, event_id % 1000 n FROM events) SELECT event_id, CASE WHEN event_id % 2 = 1 THEN n WHEN n % 4 = 0 THEN 0 ELSE 1 END te, n u, true more, false done FROM e",
    }
