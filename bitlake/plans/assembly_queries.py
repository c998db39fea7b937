"""Queries from files of byte streams to pictures, order counts and display order, and their SQL: events are the coded pictures of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitlake.functions.codec import ue_code
from bitlake.operators import assembly, marking, parameters, pictures, runs
from bitlake.operators.shared import new_folder, written
from bitlake.plans.header_queries import bits, fixed, se_code, symbols
from bitlake.sources import ranges

#: Bytes of a range in the queries: small, so that many units are cut by a range's end.
RANGE = 1 << 16


def files_of_texts(spark: SparkSession, d: str) -> str:
    """Streams of 500 documents each, as in annexb_split, one behind the other, as files; their folder."""
    place = new_folder(spark, "texts")
    rows = symbols(spark, d).where("data is not null and doc_id is not null").select(F.floor(F.col("doc_id") / 500).cast("string").alias("name"), F.col("doc_id").alias("unit_no"), "data")
    ranges.written(rows, place).write.format("noop").mode("overwrite").save()
    return place


def file_number(path: Column) -> Column:
    return F.regexp_extract(path, "([0-9-]+)$", 1).cast("long")


def units_by_ranges(spark: SparkSession, d: str) -> DataFrame:
    found = ranges.numbered(ranges.units(spark, files_of_texts(spark, d), RANGE))
    return found.select(file_number(F.col("path")).alias("file"), "unit_no", F.col("unit_type").cast("long"), F.sha2("payload", 256).alias("digest"))


def starts(stream: Column, seq: Column) -> Column:
    return (seq == 0) | ((seq * 7 + stream * 3) % 19 == 0) | ((seq * 5 + stream) % 23 == 0)


def references(p: Column) -> Column:
    """The references among the first p pictures of a group: its first, second, fifth, eighth, ..."""
    return F.when(p < 2, p).otherwise(2 + F.floor((p - 2) / 3))


def expected(number: Column, ref: Column) -> Column:
    """Type 1 with offsets 2 and 4 and -2 for pictures that are no reference."""
    m = F.when(~ref & (number > 0), number - 1).otherwise(number)
    return F.when(m > 0, F.floor((m - 1) / 2) * 6 + F.when((m - 1) % 2 == 0, 2).otherwise(6)).otherwise(0) + F.when(ref, 0).otherwise(-2)


def coded(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as a stream: groups of irregular lengths that begin with a refresh or, some, with a reset by marking operation 5.

    A stream's order count type is its number modulo 3; its periods depend on its number, too. p is a picture's place in its
    group, and old its place, at a reset, in the group before, whose counts and numbers its header still goes by.
    """
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"))
    k, seq = F.col("stream_id"), F.col("seq")
    rows = rows.withColumn("start", starts(k, seq))
    upto = Window.partitionBy("stream_id").orderBy("seq")
    rows = rows.withColumn("p", seq - F.max(F.when(F.col("start"), seq)).over(upto)).withColumn("old", F.lag("p").over(upto) + 1)
    reset = F.col("start") & (seq > 0) & ((seq + k) % 3 == 0)
    p = F.col("p")
    rows = rows.select("*", reset.alias("reset"), (F.col("start") & ~reset).alias("idr"), ((p == 0) | ((p - 1) % 3 == 0)).alias("ref"), (k % 3).alias("kind"), (4 + k % 4).alias("lsb_bits"), (4 + k % 2).alias("num_bits"))
    place = F.when(F.col("reset"), F.col("old")).otherwise(p)
    poc = F.when(F.col("reset"), 2 * F.col("old") + 4).otherwise(2 * F.when(p == 0, 0).when(F.col("ref"), p + 2).otherwise(p - 1))
    return rows.withColumns({"number": references(place), "poc": poc})


def file_units(spark: SparkSession, d: str) -> DataFrame:
    """(stream_id, unit_no, data): the coded pictures as units of one to three slices, of a few of which the first is lost, behind their sets."""
    c, seq, k = F.col, F.col("seq"), F.col("stream_id")
    rows = coded(spark, d)
    is_b = ~c("ref") & ~c("idr")
    kind = F.when(c("idr"), 7).when(is_b, 1).otherwise(5).cast("long")
    order = F.when(c("kind") == 0, F.lpad(F.bin(c("poc") % F.pow(F.lit(2), c("lsb_bits")).cast("long")), c("lsb_bits").cast("int"), F.lit("0"))).when(c("kind") == 1, se_code(c("poc") - expected(c("number"), c("ref")))).otherwise("")
    number = F.lpad(F.bin(c("number") % F.pow(F.lit(2), c("num_bits")).cast("long")), c("num_bits").cast("int"), F.lit("0"))
    marks = F.when(c("idr"), "00").when(c("reset"), F.concat(F.lit("1"), ue_code(F.lit(5)), ue_code(F.lit(0)))).when(c("ref"), "0").otherwise("")
    lists = F.when(c("idr"), "").when(is_b, "1" + "0" + "00").otherwise("0" + "0")
    slice_no = F.posexplode(F.array_repeat(F.lit(0), (1 + seq % 3).cast("int")))
    parts = rows.select("*", slice_no.alias("i", "_")).where(~((c("i") == 0) & (seq % 3 > 0) & (seq % 10 == 7) & (c("kind") == 0) & (c("p") > 1)))
    payload = bits(ue_code(5 * c("i")), ue_code(kind), ue_code(k % 3), number, F.when(c("idr"), ue_code(seq % 7)).otherwise(""), order, lists, marks, se_code(seq % 5 - 2), ue_code(F.lit(1)))
    unit = lambda no, head, data: [k, no.cast("long").alias("unit_no"), F.concat(F.lit(b"\0\0\0\1"), F.unhex(F.lpad(F.hex(head), 2, "0")), ranges.escaped(data)).alias("data")]
    head = F.when(c("ref"), 32).otherwise(0) + F.when(c("idr"), 5).otherwise(1)
    slices = parts.select(*unit(seq * 8 + 4 + c("i"), head, payload))
    types = F.when(k % 3 == 0, ue_code(k % 4)).when(k % 3 == 1, F.concat(F.lit("0"), se_code(F.lit(-2)), se_code(F.lit(0)), ue_code(F.lit(2)), se_code(F.lit(2)), se_code(F.lit(4)))).otherwise("")
    sps = bits(fixed(F.lit(66), 8), 16 * "0", ue_code(F.lit(0)), ue_code(k % 2), ue_code(k % 3), types, ue_code(F.lit(4)), "0", ue_code(F.lit(9)), ue_code(F.lit(9)), "1100")
    pps = bits(ue_code(k % 3), ue_code(F.lit(0)), "00", ue_code(F.lit(0)), ue_code(F.lit(1)), ue_code(F.lit(1)), "000", se_code(seq % 9 - 4), se_code(F.lit(0)), se_code(F.lit(0)), "100")
    firsts = rows.where("idr")
    return slices.unionAll(firsts.select(*unit(seq * 8 + 1, F.lit(0x67), sps))).unionAll(firsts.select(*unit(seq * 8 + 2, F.lit(0x68), pps)))


def read_back(spark: SparkSession, d: str) -> DataFrame:
    """The units of file_units, written as a file a stream and read again by byte ranges; stream_id and, as unit_no, offsets."""
    place = new_folder(spark, "streams")
    ranges.written(file_units(spark, d).withColumn("name", F.col("stream_id").cast("string")), place).write.format("noop").mode("overwrite").save()
    found = ranges.units(spark, place, RANGE, [1, 5, 7, 8])
    found = found.select(file_number(F.col("path")).alias("stream_id"), F.col("offset").alias("unit_no"), "ref_idc", "unit_type", "payload")
    return written(found, "units")  # three passes follow over its sets and slices


def assembled(spark: SparkSession, d: str) -> tuple[DataFrame, bool]:
    """The pictures, and whether their streams are short."""
    units = read_back(spark, d)
    whole = runs.short(units, ["stream_id"])
    return assembly.with_order_counts(assembly.gathered(parameters.slice_headers(units, whole=whole), whole=whole), whole=whole), whole


def bytes_to_display(spark: SparkSession, d: str) -> DataFrame:
    pics, whole = assembled(spark, d)
    return assembly.display_order(pics, whole=whole).select("stream_id", "seq", "slices", "group_no", "poc", "shown")


def poc_epochs(spark: SparkSession, d: str) -> DataFrame:
    return assembled(spark, d)[0].select("stream_id", "seq", "epoch", "number", "poc", "shown_poc", F.array_join("types", "").alias("types"))


def fields(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as fields, two a frame, in groups of 8 to 10 frames whose numbers have a period of 3, so that they occur twice.

    Frames in places 2 and 3 of three are shown before that in place 1; each fifth is no reference, of each seventh only the first field.
    """
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"))
    c, k, f = F.col, F.col("stream_id"), F.floor(F.col("seq") / 2)
    rows = rows.withColumns({"frame_no": f, "second": c("seq") % 2 == 1, "bottom": (c("seq") + k) % 2 == 1, "group_no": F.floor(f / (8 + k % 3)), "place": f % (8 + k % 3)})
    rows = rows.withColumn("ref", (c("place") % 5 != 4) & ~((c("place") % 7 == 6) & c("second")))
    shown = F.when(c("place") % 3 == 0, c("place") + 2).otherwise(c("place") - 1)
    return rows.withColumns({"number": c("place"), "frame_num": c("place") % 3, "poc": 2 * shown + c("bottom").cast("long")})


def field_lists(spark: SparkSession, d: str) -> DataFrame:
    held = pictures.with_held_frames(fields(spark, d))
    joined = lambda fs: F.array_join(F.transform(fs, lambda x: F.concat(x["frame_num"].cast("string"), F.when(x["bottom"], "b").otherwise("t"))), " ")
    lists = held.select("stream_id", "seq", marking.field_lists(F.col("held"), F.col("poc"), F.col("bottom")).alias("lists"))
    return lists.select("stream_id", "seq", *(joined(F.col(f"lists.{k}")).alias(k) for k in ("p", "l0", "l1")))


def marked_rows(spark: SparkSession, d: str) -> DataFrame:
    """The pictures of coded(), with marking operations 1 to 6 by their places, and numbers by place modulo 16."""
    c, seq = F.col, F.col("seq")
    rows = coded(spark, d)
    op = lambda *xs: F.array(*(F.array(*(F.lit(v) if isinstance(v, int) else v for v in x)).cast("array<bigint>") for x in xs))
    none = F.array().cast("array<array<bigint>>")
    kinds = [none, op((1, seq % 3, 0)), op((3, seq % 2, seq % 2)), op((2, seq % 2, 0)), op((4, 1, 0)), op((6, seq % 2, 0)), op((1, 0, 0), (3, 1, 0)), none]
    chosen = F.when(c("idr") | ~c("ref"), none).when(c("reset"), op((5, 0, 0)))
    for i, k in enumerate(kinds):
        chosen = chosen.when(F.floor(c("p") / 3 + seq) % 8 == i, k)
    group = F.sum(c("idr").cast("long")).over(Window.partitionBy("stream_id").orderBy("seq"))
    return rows.select("stream_id", "seq", group.alias("group_no"), "idr", "ref", (c("number") % 16).alias("frame_num"), "poc", chosen.alias("marking"), (c("idr") & (seq % 2 == 1)).alias("long_term"), (2 + c("stream_id") % 3).alias("max_refs"), F.lit(16).alias("period"))


def marked_operations(spark: SparkSession, d: str) -> DataFrame:
    """What each picture may refer to: short-term numbers, oldest first, and long-term ones with their indexes."""
    out = marking.with_marked_references(marked_rows(spark, d), None, None)
    show = lambda c, f: F.array_join(F.transform(c, f), " ")
    text = lambda x, *names: F.concat_ws(":", *(x[n].cast("string") for n in names))
    return out.select("stream_id", "seq", show("short", lambda x: text(x, "frame_num", "poc")).alias("short"), show("long", lambda x: text(x, "index", "frame_num", "poc")).alias("long"))


QUERIES = {"units_by_ranges": units_by_ranges, "bytes_to_display": bytes_to_display, "poc_epochs": poc_epochs, "field_lists": field_lists, "marked_operations": marked_operations}

_DIGITS = "WITH t AS (SELECT doc_id, translate(regexp_replace(text, '[^a-z ]', '', 'g'), ' etaoinrshldcumfpgwybvkxjqz', '000013222222222222222222222') y FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)"
_CODED = """WITH a AS (SELECT user_id stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 seq FROM events),
b AS (SELECT *, seq = 0 OR (seq * 7 + stream_id * 3) % 19 = 0 OR (seq * 5 + stream_id) % 23 = 0 start FROM a),
c AS (SELECT *, seq - max(seq) FILTER (start) OVER (PARTITION BY stream_id ORDER BY seq) p, start AND seq > 0 AND (seq + stream_id) % 3 = 0 reset FROM b),
e AS (SELECT *, lag(p) OVER (PARTITION BY stream_id ORDER BY seq) + 1 old, start AND NOT reset idr, p = 0 OR (p - 1) % 3 = 0 ref, stream_id % 3 kind FROM c),
n AS (SELECT *, CASE WHEN reset THEN old ELSE p END place, (sum(start::INT) OVER (PARTITION BY stream_id ORDER BY seq))::BIGINT group_no FROM e),
o AS (SELECT *, (CASE WHEN place < 2 THEN place ELSE 2 + (place - 2) // 3 END)::BIGINT number, 2 * CASE WHEN reset THEN old + 2 WHEN p = 0 THEN 0 WHEN ref THEN p + 2 ELSE p - 1 END up FROM n),
q AS (SELECT *, CASE WHEN idr THEN 0 WHEN kind < 2 THEN up ELSE 2 * number - CASE WHEN ref THEN 0 ELSE 1 END END::BIGINT poc, 1 + seq % 3 - (seq % 3 > 0 AND seq % 10 = 7 AND kind = 0 AND p > 1)::INT slices FROM o),
r AS (SELECT *, CASE WHEN reset THEN 0 ELSE poc END shown_poc FROM q)"""
SQL = {
    "units_by_ranges": _DIGITS + r""", f AS (SELECT doc_id // 500 file, string_agg(y, '' ORDER BY doc_id) y FROM t GROUP BY 1), l AS (SELECT file, string_split_regex(y, '000?1') parts FROM f),
n AS (SELECT file, len(parts) n, unnest(parts) u, generate_subscripts(parts, 1) place FROM l), u AS (SELECT file, place, CASE WHEN place < n THEN rtrim(u, '0') ELSE u END u FROM n WHERE place > 1),
g AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY place) - 1 unit_no, u FROM u WHERE u <> '')
SELECT file, unit_no, u[1]::BIGINT unit_type, sha256(unhex(regexp_replace(replace(u[2:], '003', '00'), '(.)', '0\1', 'g'))) digest FROM g""",
    "bytes_to_display": _CODED + " SELECT stream_id, seq, slices, group_no, shown_poc poc, row_number() OVER (PARTITION BY stream_id ORDER BY group_no, shown_poc, seq) shown FROM r",
    "poc_epochs": _CODED + """ SELECT stream_id, seq, (sum(idr::INT) OVER w + coalesce(sum(reset::INT) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT epoch, number, poc, shown_poc,
  repeat(CASE WHEN idr THEN 'I' WHEN ref THEN 'P' ELSE 'B' END, slices::INT) types FROM r WINDOW w AS (PARTITION BY stream_id ORDER BY seq)""",
    "field_lists": """WITH a AS (SELECT user_id k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 seq FROM events), b AS (SELECT *, seq // 2 f, 8 + k % 3 size FROM a),
c AS (SELECT *, f // size g, f % size place, (seq + k) % 2 = 1 bot, seq % 2 = 1 sec FROM b), r AS (SELECT *, place % 5 <> 4 AND NOT (place % 7 = 6 AND sec) ref, 2 * CASE WHEN place % 3 = 0 THEN place + 2 ELSE place - 1 END + bot::INT poc FROM c),
h AS (SELECT x.k, x.seq, x.poc, x.bot, y.place, min(y.poc) low, bool_or(NOT y.bot) t, bool_or(y.bot) b FROM r x JOIN r y ON y.k = x.k AND y.g = x.g AND y.ref AND y.seq < x.seq GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY k, seq ORDER BY place DESC) newest FROM h), m AS (SELECT * FROM l WHERE newest <= 4),
o AS (SELECT *, -place p, CASE WHEN low <= poc THEN -low - 1000000 ELSE low END l0, CASE WHEN low > poc THEN low - 1000000 ELSE 1000000 - low END l1 FROM m),
w AS (SELECT k, seq, kind, key, place % 3 n, bot own, field FROM (UNPIVOT (SELECT k, seq, bot, t, b, place, p, l0, l1 FROM o) ON p, l0, l1 INTO NAME kind VALUE key), (VALUES (true), (false)) v(field) WHERE CASE WHEN field THEN b ELSE t END),
z AS (SELECT *, row_number() OVER (PARTITION BY k, seq, kind, field ORDER BY key) turn FROM w), q AS (SELECT *, least(count(*) FILTER (field = own) OVER v, count(*) FILTER (field <> own) OVER v) shared FROM z WINDOW v AS (PARTITION BY k, seq, kind)),
s AS (SELECT k, seq, kind, list(n || CASE WHEN field THEN 'b' ELSE 't' END ORDER BY CASE WHEN turn <= shared THEN turn ELSE 1000 END, field <> own, turn) x FROM q GROUP BY ALL),
e AS (SELECT k, seq, first(x) FILTER (kind = 'p') p, first(x) FILTER (kind = 'l0') l0, first(x) FILTER (kind = 'l1') l1 FROM s GROUP BY ALL)
SELECT r.k stream_id, r.seq, coalesce(array_to_string(p, ' '), '') p, coalesce(array_to_string(l0, ' '), '') l0, coalesce(array_to_string(CASE WHEN len(l1) > 1 AND l0 = l1 THEN list_concat([l1[2], l1[1]], l1[3:]) ELSE l1 END, ' '), '') l1
FROM r LEFT JOIN e ON e.k = r.k AND e.seq = r.seq""",
    "marked_operations": _CODED.replace("WITH a AS", "WITH RECURSIVE a AS") + """, m AS (SELECT stream_id k, seq, idr, ref, reset, number % 16 n, up::BIGINT poc, (sum(idr::INT) OVER (PARTITION BY stream_id ORDER BY seq))::BIGINT g, idr AND seq % 2 = 1 lt, 2 + stream_id % 3 most, floor(p / 3 + seq)::BIGINT % 8 i FROM q),
ops AS (SELECT *, CASE WHEN idr OR NOT ref THEN [] WHEN reset THEN [[5, 0, 0]] WHEN i = 1 THEN [[1, seq % 3, 0]] WHEN i = 2 THEN [[3, seq % 2, seq % 2]] WHEN i = 3 THEN [[2, seq % 2, 0]] WHEN i = 4 THEN [[4, 1, 0]] WHEN i = 5 THEN [[6, seq % 2, 0]]
  WHEN i = 6 THEN [[1, 0, 0], [3, 1, 0]] ELSE [] END op FROM m),
f(k, seq, s) AS (SELECT DISTINCT k, -1::BIGINT, []::STRUCT(n BIGINT, poc BIGINT, x BIGINT)[] FROM m UNION ALL
  SELECT f.k, f.seq + 1, CASE WHEN NOT o.ref THEN f.s WHEN o.idr THEN [{'n': o.n, 'poc': o.poc, 'x': CASE WHEN o.lt THEN 0 ELSE -1 END::BIGINT}]
    WHEN len(op) = 0 THEN list_concat([e FOR e, pos IN f.s IF e.x >= 0 OR len([y FOR y, j IN f.s IF y.x < 0 AND j <= pos]) > len(f.s) - greatest(1, most) + 1], [{'n': o.n, 'poc': o.poc, 'x': -1::BIGINT}])
    WHEN op[1][1] = 5 THEN [{'n': 0::BIGINT, 'poc': 0::BIGINT, 'x': -1::BIGINT}]
    WHEN op[1][1] = 6 THEN list_concat([e FOR e IN f.s IF e.x <> op[1][2]], [{'n': o.n, 'poc': o.poc, 'x': op[1][2]}])
    WHEN op[1][1] = 2 THEN list_concat([e FOR e IN f.s IF e.x <> op[1][2]], [{'n': o.n, 'poc': o.poc, 'x': -1::BIGINT}])
    WHEN op[1][1] = 4 THEN list_concat([e FOR e IN f.s IF e.x < op[1][2]], [{'n': o.n, 'poc': o.poc, 'x': -1::BIGINT}])
    WHEN op[1][1] = 3 THEN list_concat([CASE WHEN e.x < 0 AND e.n = (o.n - op[1][2] - 1 + 16) % 16 THEN {'n': e.n, 'poc': e.poc, 'x': op[1][3]} ELSE e END FOR e IN f.s IF e.x <> op[1][3]], [{'n': o.n, 'poc': o.poc, 'x': -1::BIGINT}])
    ELSE list_concat([CASE WHEN len(op) > 1 AND e.x < 0 AND e.n = (o.n - op[2][2] - 1 + 16) % 16 THEN {'n': e.n, 'poc': e.poc, 'x': op[2][3]} ELSE e END FOR e IN f.s IF (e.x >= 0 OR e.n <> (o.n - op[1][2] - 1 + 16) % 16) AND (len(op) < 2 OR e.x <> op[2][3])], [{'n': o.n, 'poc': o.poc, 'x': -1::BIGINT}]) END
  FROM f JOIN ops o ON o.k = f.k AND o.seq = f.seq + 1)
SELECT m.k stream_id, m.seq, CASE WHEN m.idr THEN '' ELSE array_to_string([e.n || ':' || e.poc FOR e IN s IF e.x < 0], ' ') END short,
  CASE WHEN m.idr THEN '' ELSE array_to_string([y.x || ':' || y.n || ':' || y.poc FOR y IN list_sort([{'x': e.x, 'n': e.n, 'poc': e.poc} FOR e IN s IF e.x >= 0])], ' ') END long FROM m JOIN f ON f.k = m.k AND f.seq = m.seq - 1""",
}
