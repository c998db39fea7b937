"""Parameter sets, slice headers, side messages and decoder configurations as tables, and the sets bound to slices.

Each takes units as framing.units gives them: (stream id, unit_no, ref_idc, unit_type, payload). Only the units of the
types read reach Python, of slices only their first HEADER_BYTES. What can't be read is a row with its error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bitlake.functions import headers
from bitlake.functions.codec import read_ue
from bitlake.operators import runs

#: More than the largest slice header: 64 weights of six numbers and 132 list and marking operations take under 4 KB.
HEADER_BYTES = 16_384
# Names of unit types 1 to 12.
UNIT_TYPES = "Slice SliceDataA SliceDataB SliceDataC SliceIdr Sei Sps Pps AccessUnitDelimiter EndOfSequence EndOfStream FillerData".split()

SEQUENCE = """profile int, constraints int, level int, sps_id long, chroma_format long, separate_planes boolean, depth_luma long, depth_chroma long,
bypass boolean, scaling array<array<int>>, frame_num_bits long, poc_type long, poc_lsb_bits long, poc_no_deltas boolean, offset_not_ref long,
offset_bottom long, offsets array<long>, max_refs long, gaps boolean, width_mbs long, height_units long, frames_only boolean, mbaff boolean,
direct_8x8 boolean, cropped boolean, crop_left long, crop_right long, crop_top long, crop_bottom long, usability boolean, full_range boolean,
primaries int, transfer int, matrix int, chroma_location long, num_units_in_tick long, time_scale long, fixed_rate boolean, max_reorder long"""
PICTURE = """pps_id long, sps_id long, arithmetic boolean, bottom_deltas boolean, refs_l0 long, refs_l1 long, weighted boolean, weighted_bi int,
init_qp long, init_qs long, chroma_offset long, filter_control boolean, constrained_intra boolean, redundant boolean, transform_8x8 boolean,
scaling array<array<int>>, second_chroma_offset long"""
SLICE = """first_mb long, slice_type string, pps_id long, frame_num long, field boolean, bottom boolean, mbaff boolean, idr_pic_id long, poc_lsb long,
delta_bottom long, delta_0 long, delta_1 long, direct_spatial boolean, refs_l0 long, refs_l1 long, changes_l0 array<array<long>>,
changes_l1 array<array<long>>, luma_denom int, chroma_denom int, weights_l0 array<array<int>>, weights_l1 array<array<int>>, no_output boolean,
long_term boolean, marking array<array<long>>, cabac_init long, qp_delta long, filter_off long, alpha_offset long, beta_offset long, data_bit long"""


USED = {
    "sps": ("frame_num_bits", "frames_only", "mbaff", "poc_type", "poc_lsb_bits", "poc_no_deltas"),
    "pps": ("bottom_deltas", "refs_l0", "refs_l1", "weighted", "weighted_bi", "arithmetic", "filter_control"),
}


def unit_type_name(unit_type: Column) -> Column:
    """The name of a unit type; others are Other(n)."""
    return F.coalesce(F.get(F.array(*map(F.lit, UNIT_TYPES)), (unit_type - 1).cast("int")), F.concat(F.lit("Other("), unit_type.cast("string"), F.lit(")")))


def read_with(rows: DataFrame, keys: list[str], inputs: list[str], read, fields: str, name: str) -> DataFrame:
    """(keys, `name` struct of fields, error): read(*inputs) of each row, null with the reason where it raises ValueError."""
    kinds = dict(rows.dtypes)
    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{name}` {fields}", "error string"])
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for values in zip(*(batch.column(c).to_pylist() for c in inputs), strict=True):
                try:
                    found.append(read(*values))
                    errors.append(None)
                except ValueError as e:
                    found.append(None)
                    errors.append(str(e))
            out = [*(batch.column(k) for k in keys), pa.array(found, schema.field(name).type), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return rows.select(*keys, *(c for c in inputs if c not in keys)).mapInArrow(make, ddl)


def sequence_sets(units: DataFrame, id_col: str = "stream_id") -> DataFrame:
    """(stream id, unit_no, sps, error) of the units of type 7."""
    return read_with(units.where("unit_type = 7"), [id_col, "unit_no"], ["payload"], lambda data: headers.sequence_set(data or b""), f"struct<{SEQUENCE}>", "sps")


def picture_sets(units: DataFrame, id_col: str = "stream_id") -> DataFrame:
    """(stream id, unit_no, pps, error) of the units of type 8."""
    return read_with(units.where("unit_type = 8"), [id_col, "unit_no"], ["payload"], lambda data: headers.picture_set(data or b""), f"struct<{PICTURE}>", "pps")


def side_messages(units: DataFrame, id_col: str = "stream_id") -> DataFrame:
    """(stream id, unit_no, message_no, payload_type, uuid, data, error) of the units of type 6: a row a message, or one with the error."""
    found = read_with(units.where("unit_type = 6"), [id_col, "unit_no"], ["payload"], lambda data: [dict(zip(("payload_type", "uuid", "data"), m, strict=True)) for m in headers.messages(data or b"")], "array<struct<payload_type long, uuid binary, data binary>>", "messages")
    rows = found.select(id_col, "unit_no", "error", F.posexplode_outer("messages").alias("message_no", "m")).where("error is not null or m is not null")
    return rows.select(id_col, "unit_no", F.col("message_no").cast("long"), "m.payload_type", "m.uuid", "m.data", "error")


def configurations(records: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, configuration struct of length_size and the units sps and pps, error): a row for each record."""
    return read_with(records.withColumnRenamed(data_col, "payload"), [id_col], ["payload"], lambda data: headers.configuration(data or b""), "struct<length_size int, sps array<binary>, pps array<binary>>", "configuration")


def crop_units(sps: str = "sps") -> tuple[Column, Column]:
    """Samples that one step of the crop fields takes, across and down."""
    c = lambda name: F.col(f"{sps}.{name}")
    across = F.when(c("chroma_format").isin(0, 3), 1).otherwise(2)
    return across, F.when(c("chroma_format") == 1, 2).otherwise(1) * F.when(c("frames_only"), 1).otherwise(2)


def information(sps: str = "sps") -> dict[str, Column]:
    """Coded and shown size, frame rate and colour of a sequence set; the rate is null without timing or where it is 0."""
    c = lambda name: F.col(f"{sps}.{name}")
    across, down = crop_units(sps)
    wide, high = 16 * c("width_mbs"), 16 * c("height_units") * F.when(c("frames_only"), 1).otherwise(2)
    shown = lambda size, lost: F.greatest(size - F.when(c("cropped"), lost).otherwise(0), F.lit(0))
    timed = (c("num_units_in_tick") > 0) & (c("time_scale") > 0)
    ticks = F.least(2 * c("num_units_in_tick"), F.lit((1 << 32) - 1))
    found = {"coded_width": wide, "coded_height": high, "width": shown(wide, (c("crop_left") + c("crop_right")) * across), "height": shown(high, (c("crop_top") + c("crop_bottom")) * down)}
    found |= {"rate_num": F.when(timed, c("time_scale")), "rate_den": F.when(timed, ticks), "frame_rate": F.when(timed, c("time_scale") / ticks), "progressive": c("frames_only")}
    return found | {name: c(name) for name in ("profile", "chroma_format", "depth_luma", "depth_chroma", "max_refs", "full_range", "primaries", "transfer", "matrix", "chroma_location", "max_reorder")}


def size_error(sps: str = "sps", most: int = 16_384) -> Column:
    """Why a sequence set's shown size cannot be used, null where it can: a side is 0 or over `most`."""
    found = information(sps)
    outside = lambda c: (c < 1) | (c > most)
    return F.when(outside(found["width"]) | outside(found["height"]), "dimensions out of range")


def stream_rates(sets: DataFrame, id_col: str = "stream_id") -> DataFrame:
    """(stream id, sps_id, rate_num, rate_den, frame_rate) of rows of sequence_sets: one row for each stream with a set.

    Of each number's last set, the rate of the lowest number that has one; null where none has. A null stream is a stream.
    """
    found = information()
    last = sets.where("sps is not null").groupBy(id_col, F.col("sps.sps_id").alias("sps_id")).agg(F.max_by("sps", "unit_no").alias("sps"))
    rated = last.select(id_col, F.struct("sps_id", *(found[k].alias(k) for k in ("rate_num", "rate_den", "frame_rate"))).alias("r"))
    chosen = rated.groupBy(id_col).agg(F.min_by("r", F.when(F.col("r.rate_num").isNotNull(), F.col("r.sps_id"))).alias("r"))
    return chosen.select(id_col, "r.*")


def with_scaling(pps: DataFrame, flat: int = 16) -> DataFrame:
    """Adds `matrices`, the eight lists that hold for a picture set with its sequence set: its own, else the sequence's, else the rule's.

    The rule for lists left out of a set that has some: the first of intra and of inter are the standard's, others as the one
    before; of 8x8 lists, those of the sequence set, or flat.
    """

    def filled(own: Column, rest: list[Column]) -> Column:
        out: list[Column] = []
        for i in range(8):
            fallback = rest[i] if rest else F.array(*map(F.lit, DEFAULT_4X4[i // 3])) if i in (0, 3) else out[i - 1] if i < 6 else F.array_repeat(F.lit(flat), 64)
            out.append(F.coalesce(F.get(own, F.lit(i)), fallback))
        return F.array(*out)

    plain = F.array(*(F.array_repeat(F.lit(flat), 16 if i < 6 else 64) for i in range(8)))
    sequence = F.when(F.col("sps.scaling").isNull(), plain).otherwise(filled(F.col("sps.scaling"), []))
    inherited = [F.get(F.col("_sequence"), F.lit(i)) for i in range(8)]
    own = F.when(F.col("sps.scaling").isNull(), filled(F.col("pps.scaling"), [])).otherwise(filled(F.col("pps.scaling"), inherited))
    return pps.withColumn("_sequence", sequence).withColumn("matrices", F.when(F.col("pps.scaling").isNull(), F.col("_sequence")).otherwise(own)).drop("_sequence")


# The scaling lists of intra and inter 4x4 blocks that hold where a set leaves them out, in scan order.
DEFAULT_4X4 = ([6, 13, 13, 20, 20, 20, 28, 28, 28, 28, 32, 32, 32, 37, 37, 42], [10, 14, 14, 20, 20, 20, 24, 24, 24, 24, 27, 27, 27, 30, 30, 34])


def slice_head(payload: Column) -> tuple[Column, Column, Column]:
    """First block, slice type and picture set number of a slice's payload, as far as they can be read."""
    digits = F.rpad(F.hex(F.substring(payload, 1, 24)), 48, "0")
    bits = F.concat(*(F.lpad(F.conv(F.substring(digits, at, 16), 16, 2), 64, "0") for at in (1, 17, 33)))
    behind = lambda b: F.substring(b, 2 * F.instr(b, "1"), F.lit(192))
    return read_ue(bits), read_ue(behind(bits)), read_ue(behind(behind(bits)))


def slice_headers(units: DataFrame, id_col: str = "stream_id", whole: bool = False) -> DataFrame:
    """(stream id, unit_no, ref_idc, unit_type, sps, pps, header, qp, error) of the units of types 1 and 5.

    A slice's picture set is the last one of its number before the slice, and its sequence set the last one of that set's number
    before the slice. Both are bound by as-of joins, so that a set may change any number of times. A header that does not end within
    HEADER_BYTES is an error of its own. whole: streams are short (runs.short).
    """
    sps = sequence_sets(units, id_col).select(id_col, "unit_no", F.col("sps.sps_id").alias("_sps_id"), "sps").where("sps is not null")
    pps = picture_sets(units, id_col).select(id_col, "unit_no", F.col("pps.pps_id").alias("_pps_id"), "pps").where("pps is not null")
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    slices = units.where("unit_type in (1, 5)").select(id_col, "unit_no", "ref_idc", "unit_type", F.substring(payload, 1, HEADER_BYTES).alias("payload"), (F.octet_length(payload) > HEADER_BYTES).alias("_cut"))
    bound_slices = runs.held(slices.withColumn("_pps_id", slice_head(F.col("payload"))[2]), pps, [id_col, "_pps_id"], "unit_no", "pps", whole=whole)
    held = runs.held(bound_slices.withColumn("_sps_id", F.col("pps.sps_id")), sps, [id_col, "_sps_id"], "unit_no", "sps", whole=whole)
    for name, used in USED.items():  # what a header's syntax depends on; whole sets would be made dictionaries of in each row
        held = held.withColumn(f"_{name}", F.when(F.col(name).isNotNull(), F.struct(*(F.col(f"{name}.{n}").alias(n) for n in used))))

    def read(data: bytes, cut: bool, sps: dict | None, pps: dict | None, unit_type: int, ref_idc: int) -> dict:
        headers.slice_start(data)
        if not sps or not pps:
            raise ValueError("no parameter sets")
        try:
            return headers.slice_header(data, sps, pps, unit_type, ref_idc)
        except ValueError as e:
            raise ValueError(f"header of over {HEADER_BYTES} bytes" if cut and str(e) == "end of bitstream" else str(e)) from e

    out = read_with(held, [id_col, "unit_no", "ref_idc", "unit_type", "sps", "pps"], ["payload", "_cut", "_sps", "_pps", "unit_type", "ref_idc"], read, f"struct<{SLICE}>", "header")
    return out.withColumn("qp", F.col("pps.init_qp") + F.col("header.qp_delta"))
