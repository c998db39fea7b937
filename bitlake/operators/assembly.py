"""From slice headers to coded pictures, order counts and display order, with the periods and limits of the sets bound to each slice.

Streams may be of any length: all prefix values are two-level (runs.before), ranks are by range of order count. Where streams are
known to be short (runs.short), `whole` makes prefix values windows over a stream, so that one shuffle serves the chain and nothing is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlake.operators import parameters, pictures, runs
from bitlake.operators.shared import written

#: Order counts that are ranked in one task.
COUNTS = 65_536


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def starts_picture(h: Column, p: Column) -> Column:
    """Whether slice h begins a picture, p being the slice before it (null for none): block 0, or fields that a picture's slices share differ."""
    shared = ["pps_id", "frame_num", "field", "bottom", "idr", "idr_pic_id", "poc_lsb", "delta_bottom", "delta_0", "delta_1"]
    changed = differs((h["ref_idc"] == 0), (p["ref_idc"] == 0))
    for name in shared:
        changed = changed | differs(h[name], p[name])
    return p.isNull() | (h["first_mb"] == 0) | changed


def gathered(headers: DataFrame, id_col: str = "stream_id", whole: bool = False) -> DataFrame:
    """Pictures from rows of parameters.slice_headers: (stream id, seq, unit_no, slices, types, intra, and the fields below).

    seq counts a stream's pictures from 0; unit_no is that of its first slice, whose header gives the picture's fields. Slices
    with an error are in no picture. intra holds if all slices are; types are the slices' types in order.
    """
    h, s, p = (lambda n: F.col(f"header.{n}")), (lambda n: F.col(f"sps.{n}")), (lambda n: F.col(f"pps.{n}"))
    head = ["first_mb", "slice_type", "pps_id", "frame_num", "field", "bottom", "idr_pic_id", "poc_lsb", "delta_bottom", "delta_0", "delta_1"]
    lists = ["refs_l0", "refs_l1", "changes_l0", "changes_l1", "marking", "long_term"]
    sets = [s(n).alias(n) for n in ("poc_type", "max_refs", "offsets", "offset_not_ref", "offset_bottom")]
    period = lambda n: F.pow(F.lit(2), n).cast("long")
    size = [c.alias(k) for k, c in parameters.information().items() if k in ("width", "height")]
    row = F.struct(*(h(n).alias(n) for n in head + lists), (F.col("unit_type") == 5).alias("idr"), "ref_idc", *sets, period(s("poc_lsb_bits")).alias("lsb_period"), period(s("frame_num_bits")).alias("period"), p("weighted_bi").alias("weighted_bi"), *size)
    good = headers.where("header is not null and sps is not null").select(id_col, "unit_no", row.alias("h"))
    fresh = runs.before(good, [id_col], "unit_no", {"p": ("last", F.col("h"))}, whole=whole).withColumn("new", starts_picture(F.col("h"), F.col("p")).cast("long")).drop("p")
    numbered = runs.before(fresh, [id_col], "unit_no", {"seq": ("sum", F.col("new"))}, whole=whole).withColumn("seq", F.col("seq") + F.col("new") - 1)
    first = F.min_by("h", "unit_no").alias("h")
    types = F.transform(F.array_sort(F.collect_list(F.struct("unit_no", F.col("h.slice_type").alias("t")))), lambda x: x["t"]).alias("types")
    made = numbered.groupBy(id_col, "seq").agg(F.min("unit_no").alias("unit_no"), F.count("*").alias("slices"), types, F.bool_and(F.col("h.slice_type").isin("I", "SI")).alias("intra"), first)
    return made.select(id_col, "seq", "unit_no", "slices", "types", "intra", "h.*").withColumn("ref", F.col("ref_idc") > 0).drop("first_mb", "slice_type", "ref_idc")


def with_epochs(pics: DataFrame, id_col: str = "stream_id", compat: bool = False, whole: bool = False) -> DataFrame:
    """Adds reset, epoch, group_no and opening.

    reset: the picture is a reference whose marking has operation 5, after which low part, number and list begin anew. epoch
    counts refresh pictures up to a picture and resets before it: within an epoch order counts and numbers go on. group_no
    counts both up to the picture: a group's pictures are shown together. opening is the low part that the epoch's first picture compares with.
    With compat a reset begins no group, and the low part after it compares with 0.
    """
    reset = F.col("ref") & ~F.col("idr") & F.exists(F.coalesce("marking", F.array().cast("array<array<bigint>>")), lambda m: m[0] == 5)
    rows = pics.withColumn("reset", F.coalesce(reset, F.lit(False)))
    event = (F.col("idr") | F.col("reset")).cast("long")
    left = F.when(F.col("reset"), F.when(F.col("field"), 0).otherwise(F.greatest(-F.col("delta_bottom"), F.lit(0)))).when(F.col("idr"), 0).cast("long")
    rows = runs.before(rows, [id_col], "seq", {"epoch": ("sum", event), "opening": ("last", left)}, whole=whole)
    if compat:
        rows = runs.before(rows.withColumn("opening", F.lit(0).cast("long")), [id_col], "seq", {"group_no": ("sum", F.col("idr").cast("long"))}, whole=whole)
        return rows.withColumns({"group_no": F.col("group_no") + F.col("idr").cast("long"), "epoch": F.col("epoch") + F.col("idr").cast("long")})
    return rows.withColumns({"group_no": F.col("epoch") + event, "epoch": F.col("epoch") + F.col("idr").cast("long"), "opening": F.coalesce("opening", F.lit(0))})


def cycle_count(number: Column) -> Column:
    """The expected count of order count type 1 from a picture's unwrapped number and the set's cycle."""
    n = F.size("offsets")
    absolute = F.when(n > 0, F.when(~F.col("ref") & (number > 0), number - 1).otherwise(number)).otherwise(0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    whole = F.floor((absolute - 1) / F.greatest(n, F.lit(1))) * total(F.col("offsets"))
    part = total(F.slice(F.col("offsets"), F.lit(1), ((absolute - 1) % F.greatest(n, F.lit(1)) + 1).cast("int")))
    return F.when(absolute > 0, whole + part).otherwise(0) + F.when(F.col("ref"), 0).otherwise(F.col("offset_not_ref"))


def with_order_counts(pics: DataFrame, id_col: str = "stream_id", compat: bool = False, whole: bool = False) -> DataFrame:
    """Adds with_epochs' columns, number (frame_num without wraps), poc, and shown_poc, which is 0 after a reset.

    Each picture's type, periods and offsets are columns. A refresh picture's order count is 0. Of a frame, the smaller count of both
    fields holds; a field has its own. By default the standard's rules hold; with compat those of a plain decoder: types 1 and 2 go by frame_num
    itself, however often it wraps, and a picture with a reset keeps its order count and its place among the others.
    """
    c, by = F.col, [id_col, "epoch"]
    rows = with_epochs(pics, id_col, compat, whole)
    rows = runs.before(rows, by, "seq", {"_num": ("last", c("frame_num")), "_lsb": ("last", F.when(c("ref"), F.when(c("idr"), 0).otherwise(c("poc_lsb"))))}, whole=whole)
    last, now, period = F.coalesce("_lsb", "opening"), c("poc_lsb"), c("lsb_period")
    step = F.when(c("idr"), 0).when((now < last) & (last - now >= period / 2), period).when((now > last) & (now - last > period / 2), -period).otherwise(0)
    rows = rows.withColumns({"_wrap": F.coalesce(c("_num") > c("frame_num"), F.lit(False)).cast("long"), "_step": step})
    rows = runs.before(rows, by, "seq", {"_wraps": ("sum", c("_wrap")), "_msb": ("sum", F.when(c("ref"), c("_step")))}, whole=whole)
    rows = rows.withColumn("number", c("frame_num") if compat else (c("_wraps") + c("_wrap")) * c("period") + c("frame_num"))
    top = F.when(c("poc_type") == 0, c("_msb") + c("_step") + c("poc_lsb")).when(c("poc_type") == 1, cycle_count(c("number")) + c("delta_0")).otherwise(2 * c("number") - F.when(c("ref"), 0).otherwise(1))
    down = F.when(c("poc_type") == 0, c("delta_bottom")).when(c("poc_type") == 1, c("offset_bottom") + c("delta_1")).otherwise(0)
    poc = F.when(c("idr"), 0).when(~c("field"), F.least(top, top + down)).when(c("bottom"), top + down).otherwise(top).cast("long")
    rows = rows.withColumn("poc", poc).withColumn("shown_poc", F.when(c("reset") & F.lit(not compat), 0).otherwise(c("poc")).cast("long"))
    return rows.drop("_num", "_lsb", "_wrap", "_step", "_wraps", "_msb", "opening")


def with_frames(pics: DataFrame, id_col: str = "stream_id", whole: bool = False) -> DataFrame:
    """Adds frame_no, from 0, and second: two fields of one frame share a frame_no.

    A field completes the one before it where that is of the other parity, of the same number, also a reference or also none,
    not completed itself, and it is no refresh picture and no reset.
    """
    c = F.col
    rows = runs.before(pics, [id_col], "seq", {"_p": ("last", F.struct("field", "bottom", "frame_num", "ref"))}, whole=whole)
    meets = c("field") & c("_p.field") & (c("bottom") != c("_p.bottom")) & (c("frame_num") == c("_p.frame_num")) & (c("ref") == c("_p.ref")) & ~c("idr") & ~c("reset")
    rows = rows.withColumn("_meets", F.coalesce(meets, F.lit(False)))
    rows = runs.before(rows, [id_col], "seq", {"_start": ("last", F.when(~c("_meets"), c("seq")))}, whole=whole)
    rows = rows.withColumn("second", c("_meets") & ((c("seq") - c("_start")) % 2 == 1)).drop("_p", "_meets", "_start")
    rows = runs.before(rows, [id_col], "seq", {"frame_no": ("sum", (~c("second")).cast("long"))}, whole=whole)
    return rows.withColumn("frame_no", c("frame_no") - c("second").cast("long"))


def display_order(pics: DataFrame, id_col: str = "stream_id", whole: bool = False) -> DataFrame:
    """Frames of with_order_counts' pictures in display order: (stream id, frame_no, seq, unit_no, pictures, slices, group_no, poc, shown)."""
    rows = with_frames(pics, id_col, whole)
    frames = rows.groupBy(id_col, "frame_no").agg(F.min("seq").alias("seq"), F.min("unit_no").alias("unit_no"), F.count("*").alias("pictures"), F.sum("slices").alias("slices"), F.min("group_no").alias("group_no"), F.min("shown_poc").alias("poc"))
    if whole:
        return frames.withColumn("shown", F.row_number().over(Window.partitionBy(id_col).orderBy("group_no", "poc", "seq")).cast("long"))
    part = [id_col, "group_no", "_range"]
    ranged = frames.withColumn("_range", F.floor(F.col("poc") / COUNTS))
    placed = written(ranged, "frames").withColumn("shown", F.row_number().over(Window.partitionBy(*part).orderBy("poc", "seq")).cast("long"))
    placed = written(pictures.started(placed, part[:2], "_range", F.lit(1), "_before"), "frames")
    placed = pictures.started(placed, part[:1], "group_no", F.lit(1), "_groups")
    return placed.withColumn("shown", F.col("shown") + F.col("_before") + F.col("_groups")).drop("_range", "_before", "_groups")
