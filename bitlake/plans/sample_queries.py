"""Queries of spatial modes, quarter samples, 8x8 transforms, matrix scaling, edges and motion rules over whole texts and events, and their SQL.

The SQL is written from the formulas of single samples, by coordinates, not from the library's lines and lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitlake.functions import blocks, motion, samples

#: By each query over groups of bytes, the bytes that a group has.
WIDTHS = {"intra4_modes": 13, "intra4_available": 14, "intra8_available": 26, "chroma_means": 17, "intra8_modes": 25, "intra16_modes": 33, "quarter_places": 36, "inverse8": 64, "matrix_scaling": 16, "scaling8": 64, "luma_dc": 16, "edge_both_sides": 8, "edge_chroma": 4, "implicit_samples": 4, "inverse4_both": 16, "inverse8_both": 64, "whole_dequantise": 16, "whole_intra_plane": 16}


#: Groups of one batch of arrays at most, and numbers, made ones and samples.
GROUPS, NUMBERS = 16_384, 1 << 20


def line(s: list, n: int) -> samples.Line:
    return samples.Line(s[: 2 * n], s[2 * n : 3 * n], s[3 * n])


def modes(n: int, filtered: bool):
    def make(s: list) -> dict:
        used = line(s, n).filtered() if filtered else line(s, n)
        return {f"m{m}": samples.predicted(m, used, n) for m in range(9)}

    return make


def shape16(s: list) -> list:
    """As bytes, what all modes of a 16x16 block depend on: the plane's slopes and ends, high byte first, and the three means."""
    above, left, corner = s[:16], s[16:32], s[32]
    across, down = samples.slopes16(above, left, corner)
    means = [samples.average(a, b) for a, b in ((above, left), (above, None), (None, left))]
    return [b for v in (across + 1024, down + 1024, above[15] + left[15]) for b in (v >> 8, v & 255)] + means


def modes_of_shape16(b: list) -> dict:
    across, down, ends = (256 * b[i] + b[i + 1] for i in (0, 2, 4))
    return {f"dc{i}": b[6 + i] for i in range(3)} | {"dc3": np.full_like(b[0], 128), "plane": samples.plane_of_slopes16(across - 1024, down - 1024, ends)}


def inverse8(s: list) -> dict:
    """Both passes, each from its own levels."""
    v = [x - 128 for x in s]
    down = samples.across(samples.by_lines(samples.across([64 * x for x in v], 8), 8, samples.line8), 8)
    return {"rows": samples.by_lines(v, 8, samples.line8), "columns": [samples.rounded(x, 6) for x in down]}


def matrix_scaling(v: list) -> dict:
    qp = v[0] % 52
    four = [samples.scaled4(v[i] - 128, qp, i % 4, i // 4, v[15 - i] % 64 + 1) for i in range(16)]
    return {"levels": four, "chroma": [samples.scaled_chroma_dc(v[i] - 128, qp, v[1] % 64 + 1) for i in range(4)]}


def edge_both_sides(s: list) -> dict:
    p, q = s[3::-1], s[4:]
    return {"normal": samples.normal_filter(p[:3], q[:3], 4, 40), "strong": samples.strong_filter_both(p, q, 60, 40)}


def edge_chroma(s: list) -> dict:
    p, q = [s[1], s[0]], [s[2], s[3]]
    return {"normal": samples.normal_filter_chroma(p, q, 3), "strong": samples.strong_filter_chroma(p, q)}


def inverse(n: int, use):
    """The inverse transform of n x n blocks: the lines, then the columns of what they give."""

    def make(s: list) -> dict:
        lines = samples.across(samples.by_lines([v - 128 for v in s], n, use), n)
        return {"residual": [samples.rounded(v, 6) for v in samples.across(samples.by_lines(lines, n, use), n)]}

    return make


def sides(flags: np.ndarray) -> dict:
    """Which sides of a block are there, by the bits of a byte."""
    return {k: flags >> i & 1 == 0 for i, k in enumerate(("above", "left", "right", "corner"))}


def shape_available(n: int, filtered: bool):
    """As bytes, what the modes that need no corner depend on where sides may be missing: which are, the left samples from the lowest up, the upper ones from the last."""

    def pack(s: list) -> list:
        above, left, corner, has = s[: 2 * n], s[2 * n : 3 * n], s[3 * n], sides(s[-1])
        used = (samples.filled_filtered if filtered else samples.filled)(above, left, corner, n, has)
        return [s[-1] & 3, *used.left[::-1], *used.above[::-1]]

    return pack


def modes_of_shape_available(n: int):
    def make(b: list) -> dict:
        used, has = samples.Line(b[:n:-1], b[n:0:-1], None), sides(b[0])
        mean = [samples.mean_of_sides(used.above[:n], used.left, has)] * (n * n)
        return {f"m{m}": mean if m == 2 else samples.predicted(m, used, n) for m in (0, 1, 2, 3, 7, 8)}

    return make


def modes_available(n: int, filtered: bool):
    """The modes that need no corner, where sides may be missing."""
    pack, make = shape_available(n, filtered), modes_of_shape_available(n)
    return lambda s: make(pack(s))


#: By each query, what makes its columns of a group's samples: a list becomes a text of its numbers, one array a number.
MAKERS = {
    "intra4_modes": modes(4, False), "intra8_modes": modes(8, True), "intra16_modes": lambda s: modes_of_shape16(shape16(s)),
    "intra4_available": modes_available(4, False), "intra8_available": modes_available(8, True),
    "chroma_means": lambda s: {"means": samples.chroma_means(s[:8], s[8:16], sides(s[16]))},
    "quarter_places": lambda s: {"places": [samples.fractional(s, x, y) for y in range(4) for x in range(4)]},
    "inverse8": inverse8, "matrix_scaling": matrix_scaling,
    "scaling8": lambda s: {"levels": [samples.scaled8(v - 128, s[0] % 52, i % 8, i // 8, s[63 - i] % 64 + 1) for i, v in enumerate(s)]},
    "luma_dc": lambda s: {"levels": [samples.scaled_luma_dc(v - 128, s[0] % 52, s[1] % 64 + 1) for v in s]},
    "edge_both_sides": edge_both_sides, "edge_chroma": edge_chroma,
    "implicit_samples": lambda s: {"value": samples.weighted_implicit(s[0], s[1], s[2] % 129 - 32, 64 - (s[2] % 129 - 32))},
    "inverse4_both": inverse(4, lambda v: blocks.butterfly(*v)), "inverse8_both": inverse(8, samples.line8),
    "whole_intra_plane": lambda s: {f"v{i}": v for i, v in enumerate(blocks.planes(s[:8], s[8:16], s[7], [(x, y) for y in range(8) for x in range(8)]))},
    "whole_dequantise": lambda s: {f"d{i}": blocks.dequantised(v - 128, s[0] % 52, i % 4, i // 4) for i, v in enumerate(s)},
}


#: Groups of one range of ordered ones, about: so few that most columns are written as places in lists of their values; and ranges at most.
RANGE, RANGES = 100_000, 8_192

#: The same where sides may be missing: Parquet decides by a file's first 20,000 rows whether it writes a column so; the driver gets a sample for each range.
RANGE_AVAILABLE, RANGES_AVAILABLE = 25_000, 4_096

#: Of a 4x4 block's samples those that most modes read first: the upper four, the left ones, the corner, the upper-right ones.
FIRST4 = [0, 1, 2, 3, 8, 9, 10, 11, 12, 4, 5, 6, 7]

#: Of an 8x8 block's samples the left ones from the lowest up first, on which most of five modes depends, then the corner and the upper ones.
FIRST8 = [23, 22, 21, 20, 19, 18, 17, 16, 24, *range(16)]

#: By each query whose rows go out in the order of what their values depend on: the bytes of this, of a group's samples, what makes its columns of them, and a range's groups and the most ranges, if not RANGE and RANGES.
ORDERED = {
    "intra4_modes": (lambda s: [s[i] for i in FIRST4], lambda b: MAKERS["intra4_modes"]([b[FIRST4.index(i)] for i in range(13)])),
    "intra8_modes": (lambda s: [s[i] for i in FIRST8], lambda b: MAKERS["intra8_modes"]([b[FIRST8.index(i)] for i in range(25)])),
    "intra16_modes": (shape16, modes_of_shape16),
    "intra8_available": (shape_available(8, True), modes_of_shape_available(8), RANGE_AVAILABLE, RANGES_AVAILABLE),
}


def cut(texts: pa.Array, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, places of texts, group numbers and whether the text is null, of at most `most` groups at once; long texts go on in the next."""
    parts, at, first, room = [], [], [], most

    def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(p) // width for p, _ in parts])
        group = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return np.frombuffer(b"".join(p for p, _ in parts), np.uint8).reshape(-1, width), np.repeat(at, n), group, np.repeat([null for _, null in parts], n)

    for i, one in enumerate(texts):
        text = one.as_py()
        n, begun = max(1, -(-len(text or b"") // width)), 0
        while begun < n:
            take = min(room, n - begun)
            parts.append(((text or b"")[begun * width : (begun + take) * width].ljust(take * width, b"Q"), text is None))
            at.append(i)
            first.append(begun)
            begun, room = begun + take, room - take
            if not room:
                yield whole()
                parts, at, first, room = [], [], [], most
    if parts:
        yield whole()


def arrays(bytes_: np.ndarray) -> list:
    return list(np.ascontiguousarray(bytes_.T).astype(np.int64))


#: The texts of all bytes, each with a space after it, as numbers of four characters of which those not used are 0; and a space.
TEXTS, SPACE = np.array([f"{i} " for i in range(256)], "S4").view(np.uint32), 32


def joined_bytes(values: np.ndarray, null: np.ndarray) -> pa.Array:
    """The numbers of each row, all of them bytes, as a text with spaces between them."""
    made = TEXTS[values].view(np.uint8)
    last = made[:, -4:]
    last[last == SPACE] = 0
    used = made != 0
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum(np.count_nonzero(used, axis=1), out=ends[1:])
    there = pa.array(~null).buffers()[1] if null.any() else None
    return pa.StringArray.from_buffers(len(values), pa.py_buffer(ends), pa.py_buffer(made[used]), there)


def column(value, null: np.ndarray) -> pa.Array:
    if not isinstance(value, list):
        return pa.array(value.astype(np.int64), mask=null)
    values = np.stack(value, axis=1).astype(np.int64, copy=False)
    if values.min() >= 0 and values.max() <= 255:
        return joined_bytes(values.astype(np.uint8), null)
    flat = pa.array(values.reshape(-1))
    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(null) + 1, dtype=np.int32) * len(value)), flat.cast(pa.string()))
    return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), pc.binary_join(rows, " "))


def shape_of(made: dict, width: int) -> tuple[int, str]:
    """The groups of one batch, and the columns' types, by what is made of a group."""
    most = max(1, min(GROUPS, NUMBERS // (width + sum(len(v) if isinstance(v, list) else 1 for v in made.values()))))
    return most, ", ".join(f"`{k}` {'string' if isinstance(v, list) else 'bigint'}" for k, v in made.items())


def texts_of(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return docs, f"doc_id {dict(docs.dtypes)['doc_id']}, group_no bigint"


def of_arrays(width: int, make):
    """A query of (doc_id, group_no, what make gives) over whole texts in groups of `width` bytes, as arrays; texts are padded by Q.

    Null and empty texts have one group, of a null text's all values are null.
    """
    most, columns = shape_of(make([np.zeros(1, np.int64)] * width), width)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for bytes_, doc, group, null in cut(batch.column(1), width, most):
                made = make(arrays(bytes_))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(group), *(column(v, null) for v in made.values())], names=["doc_id", "group_no", *made])

    def query(spark: SparkSession, d: str) -> DataFrame:
        docs, keys = texts_of(spark, d)
        return docs.mapInArrow(each, f"{keys}, {columns}")

    return query


def in_order(width: int, pack, make, size_of_range: int = RANGE, ranges: int = RANGES):
    """The same query, its rows in the order of the bytes that pack gives and make reads, so that equal and similar values are written side by side.

    Only these bytes are shuffled, and the values of equal ones that stand together are made once. The groups are counted at once, by the texts' lengths.
    """
    of_none = pack([np.zeros(1, np.int64)] * width)
    size = len(of_none)
    most, columns = shape_of(make(of_none), width)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for bytes_, doc, group, null in cut(batch.column(1), width, GROUPS):
                used = np.stack(pack(arrays(bytes_)), axis=1).astype(np.uint8)
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(used), [None, pa.py_buffer(used.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(group), pc.if_else(pa.array(null), pa.scalar(None, pa.binary()), rows)], names=["doc_id", "group_no", "used"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, most) for whole in batches for i in range(0, whole.num_rows, most)):
            null = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            used = np.frombuffer(b"".join(batch.column(2).fill_null(bytes(size)).to_pylist()), np.uint8).reshape(-1, size)
            new = np.concatenate([[True], (used[1:] != used[:-1]).any(axis=1) | (null[1:] != null[:-1])])
            made, at = make(arrays(used[new])), pa.array(np.cumsum(new) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(column(v, null[new]).take(at) for v in made.values())], names=["doc_id", "group_no", *made])

    def query(spark: SparkSession, d: str) -> DataFrame:
        docs, keys = texts_of(spark, d)
        groups = docs.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("data"), F.lit(0)) / width)))).first()[0] or 0
        order = ["used", "doc_id", "group_no"]
        rows = docs.mapInArrow(packed, f"{keys}, used binary").repartitionByRange(min(ranges, groups // size_of_range + 1), *order).sortWithinPartitions(*order)
        return rows.mapInArrow(each, f"{keys}, {columns}")

    return query


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as blocks in rows of eight with vectors and references, and their left, upper and upper-right neighbours.

    Without an upper-right neighbour the upper-left one counts.
    """
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = F.col("event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.struct((e % 5 - 2).alias("x"), (e * 7 % 11 - 5).alias("y"), (e % 4 - 1).alias("ref")).alias("v"), (F.row_number().over(w) - 1).alias("place"))
    at = F.col("place") % 8
    a, b, d_ = F.when(at > 0, F.lag("v").over(w)), F.lag("v", 8).over(w), F.when(at > 0, F.lag("v", 9).over(w))
    return rows.select("event_id", "v", a.alias("a"), b.alias("b"), F.coalesce(F.when(at < 7, F.lag("v", 7).over(w)), d_).alias("c"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    n = neighbours(spark, d)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    both = lambda v: F.concat(v["x"].cast("string"), F.lit(","), v["y"].cast("string"))
    shapes = {"whole": ("16x16", 0), "upper": ("16x8", 0), "lower": ("16x8", 1), "left": ("8x16", 0), "right": ("8x16", 1)}
    return n.select("event_id", *(both(motion.predicted_vector(a, b, c, F.col("event_id") % 2, *s)).alias(k) for k, s in shapes.items()), both(motion.skipped_vector(a, b, c)).alias("skipped"))


def direct(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_suppkey")
    q = F.col("l_quantity").cast("long")
    first, second = motion.direct_vectors(k % 200 - 100, k % 60 - 30, q % 16 * 3 - 9)
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", k, first.alias("first"), second.alias("second"), motion.resting(F.struct((k % 5 - 2).alias("x"), (q % 3).alias("y"), (k % 2).alias("ref"))).alias("rests"), motion.chroma_field_offset(k % 2 == 0, q % 2 == 0).cast("long").alias("shift"))


def differs(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    use = lambda x, y, ref: F.struct(x.alias("x"), y.alias("y"), ref.alias("ref"))
    p0, p1 = use(e % 9, e % 5, e % 3 - 1), use(e % 7, e % 6, e % 4 - 1)
    q0, q1 = use(e * 3 % 9, e * 2 % 5, e * 2 % 3 - 1), use(e * 5 % 7, e % 8, e * 3 % 4 - 1)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", motion.motion_differs(p0, p1, q0, q1).alias("differs"))


def spatial(spark: SparkSession, d: str) -> DataFrame:
    v = motion.spatial_vector(F.col("a"), F.col("b"), F.col("c"), F.col("event_id") % 2 == 0)
    return neighbours(spark, d).select("event_id", v["x"].alias("x"), v["y"].alias("y"), v["ref"].alias("ref"))


QUERIES = {"spatial_vectors": spatial, "vector_rules": vectors, "direct_vectors": direct, "motion_differs": differs}


# The SQL.


def _join(values: list[str]) -> str:
    return f"concat_ws(' ', {', '.join(f'({v})::BIGINT' for v in values)})"


def _clip(v: str, lo: str = "0", hi: str = "255") -> str:
    return f"greatest({lo}, least({hi}, {v}))"


def _mode_sql(n: int, up, side, corner: str) -> list[str]:
    """The modes by the formulas of each sample; up(i) and side(i) name the neighbours, up(-1) and side(-1) the corner."""
    t = lambda i: corner if i < 0 else up(i)
    s = lambda i: corner if i < 0 else side(i)
    two = lambda a, b: f"(({a} + {b} + 1) >> 1)"
    three = lambda a, b, c: f"(({a} + 2 * {b} + {c} + 2) >> 2)"

    def diagonal(x: int, y: int) -> str:
        if x > y:
            return three(t(x - y - 2), t(x - y - 1), t(x - y))
        return three(s(y - x - 2), s(y - x - 1), s(y - x)) if x < y else three(t(0), corner, s(0))

    def slant(x: int, y: int, t, s) -> str:
        z, i = 2 * x - y, x - (y >> 1)
        if z >= 0:
            return two(t(i - 1), t(i)) if z % 2 == 0 else three(t(i - 2), t(i - 1), t(i))
        return three(s(0), corner, t(0)) if z == -1 else three(s(y - 2 * x - 1), s(y - 2 * x - 2), s(y - 2 * x - 3))

    def up_right(x: int, y: int) -> str:
        z, i = x + 2 * y, y + (x >> 1)
        if z > 2 * n - 3:
            return s(n - 1)
        if z == 2 * n - 3:
            return f"(({s(n - 2)} + 3 * {s(n - 1)} + 2) >> 2)"
        return two(s(i), s(i + 1)) if z % 2 == 0 else three(s(i), s(i + 1), s(i + 2))

    bits = n.bit_length()
    mean = f"(({' + '.join([up(i) for i in range(n)] + [side(i) for i in range(n)])} + {n}) >> {bits})"
    left_down = lambda x, y: f"(({t(2 * n - 2)} + 3 * {t(2 * n - 1)} + 2) >> 2)" if x == y == n - 1 else three(t(x + y), t(x + y + 1), t(x + y + 2))
    vertical_left = lambda x, y: three(t(x + (y >> 1)), t(x + (y >> 1) + 1), t(x + (y >> 1) + 2)) if y % 2 else two(t(x + (y >> 1)), t(x + (y >> 1) + 1))
    each = [lambda x, y: up(x), lambda x, y: side(y), lambda x, y: mean, left_down, diagonal, lambda x, y: slant(x, y, t, s), lambda x, y: slant(y, x, s, t), vertical_left, up_right]
    return [_join([f(x, y) for y in range(n) for x in range(n)]) + f" m{m}" for m, f in enumerate(each)]


def _available_sql(n: int, filtered: bool) -> str:
    """The modes without a corner where the last byte's bits name missing sides."""
    k = 3 * n + 1
    raw = [f"CASE WHEN a THEN s{i + 1} ELSE 128 END" for i in range(n)] + [f"CASE WHEN NOT a THEN 128 WHEN r THEN s{n + i + 1} ELSE s{n} END" for i in range(n)] + [f"CASE WHEN l THEN s{2 * n + i + 1} ELSE 128 END" for i in range(n)]
    names = [f"u{i}" for i in range(2 * n)] + [f"l{i}" for i in range(n)]
    ctes = f", has AS (SELECT *, s{k + 1} % 2 = 0 a, s{k + 1} // 2 % 2 = 0 l, s{k + 1} // 4 % 2 = 0 r, s{k + 1} // 8 % 2 = 0 k FROM s), e AS (SELECT doc_id, group_no, a, l, k, s{k} corner, {', '.join(f'{v} {x}' for v, x in zip(raw, names, strict=True))} FROM has)"
    if filtered:
        side = lambda p, n, first: [f"(({first} + 2 * {p}0 + {p}1 + 2) >> 2)"] + [f"(({p}{i - 1} + 2 * {p}{i} + {p}{i + 1} + 2) >> 2)" for i in range(1, n - 1)] + [f"(({p}{n - 2} + 3 * {p}{n - 1} + 2) >> 2)"]
        up, low = side("u", 2 * n, "CASE WHEN k THEN corner ELSE u0 END"), side("l", n, "CASE WHEN k THEN corner ELSE l0 END")
        values = [f"CASE WHEN a THEN {v} ELSE 128 END u{i}" for i, v in enumerate(up)] + [f"CASE WHEN l THEN {v} ELSE 128 END l{i}" for i, v in enumerate(low)]
        ctes += f", f AS (SELECT doc_id, group_no, a, l, {', '.join(values)} FROM e)"
    total = lambda p: " + ".join(f"{p}{i}" for i in range(n))
    bits = n.bit_length()
    mean = f"CASE WHEN a AND l THEN ({total('u')} + {total('l')} + {n}) >> {bits} WHEN a THEN ({total('u')} + {n // 2}) >> {bits - 1} WHEN l THEN ({total('l')} + {n // 2}) >> {bits - 1} ELSE 128 END"
    found = {m: v for m, v in enumerate(_mode_sql(n, lambda i: f"u{i}", lambda i: f"l{i}", "0")) if m in (0, 1, 3, 7, 8)} | {2: _join([mean] * (n * n)) + " m2"}
    return f"{ctes} SELECT doc_id, group_no, {', '.join(found[m] for m in sorted(found))} FROM {'f' if filtered else 'e'}"


def _chroma_means_sql() -> str:
    four = lambda i: f"(s{i} + s{i + 1} + s{i + 2} + s{i + 3})"
    one = lambda i: f"({four(i)} + 2) >> 2"
    both = lambda i, j: f"CASE WHEN a AND l THEN ({four(i)} + {four(j)} + 4) >> 3 WHEN a THEN {one(i)} WHEN l THEN {one(j)} ELSE 128 END"
    beside = [f"CASE WHEN a THEN {one(5)} WHEN l THEN {one(9)} ELSE 128 END", f"CASE WHEN l THEN {one(13)} WHEN a THEN {one(1)} ELSE 128 END"]
    return f", has AS (SELECT *, s17 % 2 = 0 a, s17 // 2 % 2 = 0 l FROM s) SELECT doc_id, group_no, {_join([both(1, 9), *beside, both(5, 13)])} means FROM has"


def _filtered_sql() -> str:
    """Common table f: the smoothed neighbours of an 8x8 block, u0 to u15, l0 to l7 and c."""
    a, b = (lambda i: f"s{i + 1}"), (lambda i: f"s{i + 17}")
    u = [f"((s25 + 2 * {a(0)} + {a(1)} + 2) >> 2)"] + [f"(({a(i - 1)} + 2 * {a(i)} + {a(i + 1)} + 2) >> 2)" for i in range(1, 15)] + [f"(({a(14)} + 3 * {a(15)} + 2) >> 2)"]
    v = [f"((s25 + 2 * {b(0)} + {b(1)} + 2) >> 2)"] + [f"(({b(i - 1)} + 2 * {b(i)} + {b(i + 1)} + 2) >> 2)" for i in range(1, 7)] + [f"(({b(6)} + 3 * {b(7)} + 2) >> 2)"]
    names = [f"{e} u{i}" for i, e in enumerate(u)] + [f"{e} l{i}" for i, e in enumerate(v)]
    return f", f AS (SELECT doc_id, group_no, {', '.join(names)}, (({b(0)} + 2 * s25 + {a(0)} + 2) >> 2) c FROM s)"


def _intra16_sql() -> str:
    up, side = "(" + " + ".join(f"s{i}" for i in range(1, 17)) + ")", "(" + " + ".join(f"s{i}" for i in range(17, 33)) + ")"
    grade = lambda o: "((5 * (" + " + ".join(f"{i + 1} * (s{o + 9 + i} - s{33 if i == 7 else o + 7 - i})" for i in range(8)) + ") + 32) >> 6)"
    plane = _join([_clip(f"(16 * (s16 + s32) + h * {x - 7} + v * {y - 7} + 16) >> 5") for y in range(16) for x in range(16)])
    return f", g AS (SELECT *, {grade(0)} h, {grade(16)} v FROM s) SELECT doc_id, group_no, (({up} + {side} + 16) >> 5)::BIGINT dc0, (({up} + 8) >> 4)::BIGINT dc1, (({side} + 8) >> 4)::BIGINT dc2, 128::BIGINT dc3, {plane} plane FROM g"


def quarter_places_sql() -> str:
    s = lambda x, y: f"s{6 * (y + 2) + x + 3}"
    raw = lambda v: f"({v[0]} - 5 * {v[1]} + 20 * {v[2]} + 20 * {v[3]} - 5 * {v[4]} + {v[5]})"
    h = lambda y: _clip(f"({raw([s(x, y) for x in range(-2, 4)])} + 16) >> 5")
    v = lambda x: _clip(f"({raw([s(x, y) for y in range(-2, 4)])} + 16) >> 5")
    m = _clip(f"({raw([raw([s(x, y) for x in range(-2, 4)]) for y in range(-2, 4)])} + 512) >> 10")
    columns = {"g": s(0, 0), "e": s(1, 0), "k": s(0, 1), "b": h(0), "j": h(1), "t": v(0), "w": v(1), "m": m}
    mean = lambda a, b: f"({a} + {b} + 1) >> 1"
    rows = [["g", mean("g", "b"), "b", mean("b", "e")], [mean("g", "t"), mean("b", "t"), mean("b", "m"), mean("b", "w")], ["t", mean("t", "m"), "m", mean("m", "w")], [mean("k", "t"), mean("t", "j"), mean("m", "j"), mean("w", "j")]]
    return f", q AS (SELECT doc_id, group_no, {', '.join(f'{e} {k}' for k, e in columns.items())} FROM s) SELECT doc_id, group_no, {_join([e for row in rows for e in row])} places FROM q"


def _four(v: list[str]) -> list[str]:
    a, b, c, d = v
    return [f"({a} + {c} + {b} + ({d} >> 1))", f"({a} - {c} + ({b} >> 1) - {d})", f"({a} - {c} - ({b} >> 1) + {d})", f"({a} + {c} - {b} - ({d} >> 1))"]


def _both_sql(n: int, one) -> str:
    rows = [e for y in range(n) for e in one([f"(s{n * y + x + 1} - 128)" for x in range(n)])]
    down = [one([f"r{n * y + x}" for y in range(n)]) for x in range(n)]
    values = _join([f"({down[x][y]} + 32) >> 6" for y in range(n) for x in range(n)])
    return f", h AS (SELECT doc_id, group_no, {', '.join(f'{e} r{i}' for i, e in enumerate(rows))} FROM s) SELECT doc_id, group_no, {values} residual FROM h"


def _eight() -> object:
    def one(v: list[str]) -> list[str]:
        a = {0: f"({v[0]} + {v[4]})", 2: f"({v[0]} - {v[4]})", 4: f"(({v[2]} >> 1) - {v[6]})", 6: f"(({v[6]} >> 1) + {v[2]})"}
        a |= {1: f"({v[5]} - {v[3]} - {v[7]} - ({v[7]} >> 1))", 3: f"({v[1]} + {v[7]} - {v[3]} - ({v[3]} >> 1))", 5: f"({v[7]} - {v[1]} + {v[5]} + ({v[5]} >> 1))", 7: f"({v[3]} + {v[5]} + {v[1]} + ({v[1]} >> 1))"}
        b = {0: f"({a[0]} + {a[6]})", 2: f"({a[2]} + {a[4]})", 4: f"({a[2]} - {a[4]})", 6: f"({a[0]} - {a[6]})"}
        b |= {1: f"(({a[7]} >> 2) + {a[1]})", 3: f"({a[3]} + ({a[5]} >> 2))", 5: f"(({a[3]} >> 2) - {a[5]})", 7: f"({a[7]} - ({a[1]} >> 2))"}
        return [f"({b[i]} {sign} {b[j]})" for i, sign, j in ((0, "+", 7), (2, "+", 5), (4, "+", 3), (6, "+", 1), (6, "-", 1), (4, "-", 3), (2, "-", 5), (0, "-", 7))]

    return one


def _inverse8_sql() -> str:
    one = _eight()
    rows = [e for y in range(8) for e in one([f"(s{8 * y + x + 1} - 128)" for x in range(8)])]
    down = [one([f"(64 * s{8 * y + x + 1} - 8192)" for y in range(8)]) for x in range(8)]
    return f" SELECT doc_id, group_no, {_join(rows)} AS rows, {_join([f'({down[x][y]} + 32) >> 6' for y in range(8) for x in range(8)])} AS columns FROM s"


# The scales of 4x4 and of 8x8 places by quality modulo 6, for the SQL alone, as lists of each kind of place.
_FOUR = {"ee": "[10, 11, 13, 14, 16, 18]", "oo": "[16, 18, 20, 23, 25, 29]", "eo": "[13, 14, 16, 18, 20, 23]"}
_EIGHT = {"00": "[20, 22, 26, 28, 32, 36]", "11": "[18, 19, 23, 25, 28, 32]", "22": "[32, 35, 42, 45, 51, 58]", "01": "[19, 21, 24, 26, 30, 34]", "02": "[25, 28, 33, 35, 40, 46]", "12": "[24, 26, 31, 33, 38, 43]"}


def _scaled_sql(level: str, scales: str, weight: str, shift: int) -> str:
    v = f"(({level}) * {scales}[s1 % 52 % 6 + 1] * ({weight}))"
    return f"CASE WHEN s1 % 52 // 6 >= {shift} THEN {v} * (1 << greatest(0, s1 % 52 // 6 - {shift})) ELSE ({v} + (1 << greatest(0, {shift} - 1 - s1 % 52 // 6))) >> greatest(0, {shift} - s1 % 52 // 6) END"


def _four_sql() -> str:
    kind = lambda i: _FOUR["".join(sorted("eo"[k % 2] for k in (i % 4, i // 4)))]
    levels = _join([_scaled_sql(f"s{i + 1} - 128", kind(i), f"s{16 - i} % 64 + 1", 4) for i in range(16)])
    return f" SELECT doc_id, group_no, {levels} AS levels, {_join([_scaled_sql(f's{i + 1} - 128', _FOUR['ee'], 's2 % 64 + 1', 5) for i in range(4)])} chroma FROM s"


def _eight_sql() -> str:
    part = lambda k: {0: "0", 1: "1", 2: "2", 3: "1"}[k % 4]
    kind = lambda i: _EIGHT["".join(sorted((part(i % 8), part(i // 8))))]
    return f" SELECT doc_id, group_no, {_join([_scaled_sql(f's{i + 1} - 128', kind(i), f's{64 - i} % 64 + 1', 6) for i in range(64)])} AS levels FROM s"


def _edges_sql() -> str:
    p, q = ["s4", "s3", "s2", "s1"], ["s5", "s6", "s7", "s8"]
    second = lambda a: f"CASE WHEN abs({a[2]} - {a[0]}) < 40 THEN {a[1]} + greatest(-4, least(4, (({a[2]} + ((s4 + s5 + 1) >> 1)) >> 1) - {a[1]})) ELSE {a[1]} END"
    strong = lambda a, b: [f"CASE WHEN abs(s4 - s5) < 17 AND abs({a[2]} - {a[0]}) < 40 THEN {x} ELSE {y} END" for x, y in ((f"({a[2]} + 2 * {a[1]} + 2 * {a[0]} + 2 * {b[0]} + {b[1]} + 4) >> 3", f"(2 * {a[1]} + {a[0]} + {b[1]} + 2) >> 2"), (f"({a[2]} + {a[1]} + {a[0]} + {b[0]} + 2) >> 2", a[1]), (f"(2 * {a[3]} + 3 * {a[2]} + {a[1]} + {a[0]} + {b[0]} + 4) >> 3", a[2]))]
    normal = [_clip("s4 + move"), second(p), _clip("s5 - move"), second(q)]
    return f", e AS (SELECT *, 4 + (abs(s2 - s4) < 40)::INT + (abs(s7 - s5) < 40)::INT tc FROM s), m AS (SELECT *, greatest(-tc, least(tc, ((s5 - s4) * 4 + (s3 - s6) + 4) >> 3)) move FROM e) SELECT doc_id, group_no, {_join(normal)} normal, {_join(strong(p, q) + strong(q, p))} strong FROM m"


_VECTORS = """WITH a AS (SELECT event_id, user_id, {'x': event_id % 5 - 2, 'y': event_id * 7 % 11 - 5, 'ref': event_id % 4 - 1} v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 place FROM events),
n AS (SELECT event_id, event_id % 2 r, CASE WHEN place % 8 > 0 THEN lag(v) OVER w END a, lag(v, 8) OVER w b, coalesce(CASE WHEN place % 8 < 7 THEN lag(v, 7) OVER w END, CASE WHEN place % 8 > 0 THEN lag(v, 9) OVER w END) c FROM a WINDOW w AS (PARTITION BY user_id ORDER BY place)),
m AS (SELECT *, list_sort([coalesce(a.x, 0), coalesce(b.x, 0), coalesce(c.x, 0)])[2] mx, list_sort([coalesce(a.y, 0), coalesce(b.y, 0), coalesce(c.y, 0)])[2] my FROM n)"""


def _vector_sql(ref: str, first: str = "") -> str:
    same = {k: f"coalesce({k}.ref = {ref}, false)" for k in "abc"}
    one = " + ".join(f"{s}::INT" for s in same.values())
    pick = lambda k: f"{k}.x || ',' || {k}.y"
    whens = [f"WHEN {same[first]} THEN {pick(first)}"] if first else []
    whens += [f"WHEN {one} = 1 AND {same[k]} THEN {pick(k)}" for k in "abc"]
    return f"CASE {' '.join(whens)} WHEN b IS NULL AND c IS NULL AND a IS NOT NULL THEN {pick('a')} ELSE mx || ',' || my END"


def sql(groups_sql) -> dict[str, str]:
    direct4 = lambda i: f"s{i + 1}"
    rests = lambda k: f"({k} IS NULL OR ({k}.ref = 0 AND {k}.x = 0 AND {k}.y = 0))"
    alike = lambda p, q: f"CASE WHEN {p}r < 0 AND {q}r < 0 THEN true WHEN {p}r < 0 OR {q}r < 0 THEN false ELSE {p}r = {q}r AND abs({p}x - {q}x) < 4 AND abs({p}y - {q}y) < 4 END"
    body = {
        "intra4_modes": f" SELECT doc_id, group_no, {', '.join(_mode_sql(4, direct4, lambda i: f's{i + 9}', 's13'))} FROM s",
        "intra4_available": _available_sql(4, False), "intra8_available": _available_sql(8, True), "chroma_means": _chroma_means_sql(),
        "intra8_modes": _filtered_sql() + f" SELECT doc_id, group_no, {', '.join(_mode_sql(8, lambda i: f'u{i}', lambda i: f'l{i}', 'c'))} FROM f",
        "intra16_modes": _intra16_sql(),
        "quarter_places": quarter_places_sql(),
        "inverse8": _inverse8_sql(),
        "matrix_scaling": _four_sql(),
        "scaling8": _eight_sql(),
        "luma_dc": f" SELECT doc_id, group_no, {_join([_scaled_sql(f's{i + 1} - 128', _FOUR['ee'], 's2 % 64 + 1', 6) for i in range(16)])} AS levels FROM s",
        "edge_both_sides": _edges_sql(),
        "edge_chroma": f", m AS (SELECT *, {_clip('((s3 - s2) * 4 + (s1 - s4) + 4) >> 3', '-4', '4')} move FROM s) SELECT doc_id, group_no, {_join([_clip('s2 + move'), _clip('s3 - move')])} normal, {_join(['(2 * s1 + s2 + s4 + 2) >> 2', '(2 * s4 + s3 + s1 + 2) >> 2'])} strong FROM m",
        "implicit_samples": f" SELECT doc_id, group_no, ({_clip('(s1 * (s3 % 129 - 32) + s2 * (96 - s3 % 129) + 32) >> 6')})::BIGINT AS value FROM s",
    }
    found = {name: groups_sql(WIDTHS[name]) + text for name, text in body.items()}
    shapes = {"whole": "", "upper": "b", "lower": "a", "left": "a", "right": "c"}
    found["vector_rules"] = _VECTORS + " SELECT event_id, " + ", ".join(f"{_vector_sql('r', k)} \"{n}\"" for n, k in shapes.items()) + f", CASE WHEN {rests('a')} OR {rests('b')} THEN '0,0' ELSE {_vector_sql('0')} END skipped FROM m"
    found |= {"inverse4_both": groups_sql(16) + _both_sql(4, _four), "inverse8_both": groups_sql(64) + _both_sql(8, _eight())}
    used = _vector_sql("least")
    found["spatial_vectors"] = _VECTORS + f""", l AS (SELECT *, coalesce(list_min(list_filter([a.ref, b.ref, c.ref], lambda v: v >= 0)), -1) least FROM m),
z AS (SELECT event_id, least, CASE WHEN least < 0 OR (least = 0 AND event_id % 2 = 0) THEN '0,0' ELSE {used} END v FROM l)
SELECT event_id, split_part(v, ',', 1)::BIGINT x, split_part(v, ',', 2)::BIGINT y, greatest(least, 0)::BIGINT AS ref FROM z"""
    found["direct_vectors"] = """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey k, l_quantity::BIGINT q, l_suppkey % 200 - 100 v, l_suppkey % 60 - 30 tb, l_quantity::BIGINT % 16 * 3 - 9 td FROM lineitem),
u AS (SELECT *, CASE WHEN td > 0 THEN (16384 + td // 2) // td WHEN td < 0 THEN -((16384 + (-td) // 2) // (-td)) END tx FROM t), s AS (SELECT *, greatest(-1024, least(1023, (tb * tx + 32) >> 6)) scale FROM u),
f AS (SELECT *, CASE WHEN td = 0 THEN v ELSE (scale * v + 128) >> 8 END first FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, first, CASE WHEN td = 0 THEN 0 ELSE first - v END AS second, k % 2 = 0 AND abs(k % 5 - 2) <= 1 AND q % 3 <= 1 rests, (CASE WHEN (k % 2 = 0) = (q % 2 = 0) THEN 0 WHEN k % 2 = 0 THEN 2 ELSE -2 END)::BIGINT shift FROM f"""
    found["motion_differs"] = f"""WITH t AS (SELECT event_id, event_id % 9 p0x, event_id % 5 p0y, event_id % 3 - 1 p0r, event_id % 7 p1x, event_id % 6 p1y, event_id % 4 - 1 p1r,
event_id * 3 % 9 q0x, event_id * 2 % 5 q0y, event_id * 2 % 3 - 1 q0r, event_id * 5 % 7 q1x, event_id % 8 q1y, event_id * 3 % 4 - 1 q1r FROM events)
SELECT event_id, NOT (({alike('p0', 'q0')} AND {alike('p1', 'q1')}) OR ({alike('p0', 'q1')} AND {alike('p1', 'q0')})) differs FROM t"""
    return found
