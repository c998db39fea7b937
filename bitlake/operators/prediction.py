"""Prediction of blocks from reference planes by vectors: a join of blocks to strips of planes.

Planes are rows of their lines. A strip is SIDE lines with HALO lines above and below them. Where a vector leads decides the one strip that holds
all lines that the block needs; the clamp at the plane's edge is in that key, so that vectors may lead anywhere. Of a strip
only the few samples around the place leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitlake.functions import samples
from bitlake.functions.codec import bilinear

SIDE, HALO = 32, 8
#: Lines and columns of samples that a block is made from.
PATCH = 9


def strip_key(rows: DataFrame, plane: str, ty: Column) -> Column:
    """A strip's key, of one type whatever may be null, so that a join by it takes strips as they lie."""
    return F.struct(F.col(plane).alias(plane), ty.alias("ty")).cast(f"struct<`{plane}`:{dict(rows.dtypes)[plane]},ty:bigint>")


def tiles(lines: DataFrame, plane: str = "plane") -> DataFrame:
    """(_key, first, lines, width, height) from (plane, y, line): y counts a plane's lines from 0, all of one length.

    _key is plane and strip; a strip is at most SIDE + 2 * HALO lines, in order, from line `first` on. width and height are those of the strip's own lines, and
    height counts from the plane's first line on, so that the plane's are their greatest. Strips also lie HALO lines
    around the plane, where clamped vectors lead. Planes without a line have no strips; null lines must not occur.
    """
    y = F.col("y").cast("long")
    strip = F.explode(F.sequence(F.floor((y - HALO) / SIDE), F.floor((y + HALO) / SIDE)))
    rows = lines.select(plane, y.alias("y"), "line", strip.alias("ty"))
    held = rows.groupBy(strip_key(rows, plane, F.col("ty")).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("_held"), F.max(F.octet_length("line")).alias("width"), (F.max("y") + 1).alias("height"))
    return held.select("_key", F.get("_held", F.lit(0))["y"].alias("first"), F.col("_held.line").alias("lines"), "width", "height")


def touched(at: Column, vector: Column, unit: int, size: Column) -> Column:
    """The whole sample that a block's first one is predicted from, clamped to where all beyond is the plane's edge."""
    return F.greatest(F.least(at + F.floor(vector / unit), size + F.lit(HALO - 4)), F.lit(-HALO - 1)).cast("long")


def predicted(blocks: DataFrame, planes: DataFrame, plane: str = "plane", chroma: bool = False) -> DataFrame:
    """blocks (plane, x, y, mvx, mvy, ...) with `block`, the 4x4 samples (chroma: 2x2) in row order as binary that the vector leads to.

    planes are strips; x and y are the block's first sample, vectors are in quarters of a luma sample or eighths of a chroma one.
    Blocks whose plane has no strips are left out. Null planes meet null planes.
    """
    unit, side = (8, 2) if chroma else (4, 4)
    names = [n for n in blocks.columns if n != "block"]
    kinds = dict(blocks.dtypes)
    c = F.col
    sizes = planes.groupBy(F.struct(c(f"_key.{plane}").alias(plane)).alias("_p")).agg(F.max("width").alias("_w"), F.max("height").alias("_h"))
    rows = blocks.select(*names, F.struct(plane).alias("_p")).join(sizes, "_p").drop("_p")
    rows = rows.withColumns({"_x": touched(c("x"), c("mvx"), unit, c("_w")), "_y": touched(c("y"), c("mvy"), unit, c("_h")), "_fx": F.pmod("mvx", F.lit(unit)).cast("long"), "_fy": F.pmod("mvy", F.lit(unit)).cast("long")})
    rows = rows.withColumn("_key", strip_key(rows, plane, F.floor(c("_y") / SIDE)))
    last = F.size("lines") - 1
    line = lambda i: F.get("lines", F.least(F.greatest(c("_y") - 2 + i - c("first"), F.lit(0)), last).cast("int"))
    met = rows.join(planes.select("_key", "first", "lines"), "_key").withColumn("_from", F.greatest(F.least(c("_x") - 2, c("_w") - 1), F.lit(0)))
    patch = F.concat(*(F.rpad(F.substring(line(i), (c("_from") + 1).cast("int"), F.lit(PATCH)), PATCH, F.lit(b"\0")) for i in range(PATCH)))
    used = ["_x", "_w", "_from", "_fx", "_fy"]
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "block binary"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, width, begun, fx, fy = (batch.column(u).to_numpy().astype(np.int64) for u in used)
            held = np.frombuffer(b"".join(batch.column("_patch").to_pylist()), np.uint8).reshape(-1, PATCH, PATCH)
            columns = np.clip(x[:, None] - 2 + np.arange(PATCH), 0, width[:, None] - 1) - begun[:, None]
            held = np.take_along_axis(held, columns[:, None, :], axis=2).astype(np.int64)
            out = np.zeros((len(x), side * side), np.uint8)
            for a, b in {(int(p), int(q)) for p, q in zip(fx, fy, strict=True)}:
                own = np.flatnonzero((fx == a) & (fy == b))
                near = held[own]
                at = lambda dy, dx: near[:, dy + 2, dx + 2]  # noqa: B023, E731
                for i in range(side * side):
                    r, k = divmod(i, side)
                    if chroma:
                        out[own, i] = bilinear(at(r, k), at(r, k + 1), at(r + 1, k), at(r + 1, k + 1), a, b)
                    else:
                        out[own, i] = samples.fractional([at(r + p - 2, k + q - 2) for p in range(6) for q in range(6)], a, b)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([row.tobytes() for row in out], pa.binary())], names=[*names, "block"])

    return met.select(*names, *used, patch.alias("_patch")).mapInArrow(make, schema)
