"""Blocks of pictures by their places: neighbours over any picture width with slices, and the edges between blocks with their strengths.

A picture's 4x4 blocks are rows with their macroblock's address and their number in it. Neighbours are looked up in tiles
of SIDE x SIDE blocks: a block goes to its own tile and, near a border, to those next to it, so that one shuffle serves all neighbours
and no task holds a picture.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlake.functions.codec import CHROMA_QP
from bitlake.functions.either import clip, entry, shift
from bitlake.functions.motion import colocated_rests, motion_differs, spatial_direct

#: Blocks of a tile across and down, and the farthest neighbour that is asked for, in blocks.
SIDE, REACH = 64, 4
# The edge filter's thresholds by quality 16 to 51, 0 below: alpha, beta, and tc0 of strengths 1, 2 and 3.
ALPHA = [4, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15, 17, 20, 22, 25, 28, 32, 36, 40, 45, 50, 56, 63, 71, 80, 90, 101, 113, 127, 144, 162, 182, 203, 226, 255, 255]
BETA = [2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14, 15, 15, 16, 16, 17, 17, 18, 18]
TC0 = [
    [0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6, 6, 7, 8, 9, 10, 11, 13],
    [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 7, 8, 8, 10, 11, 12, 13, 15, 17],
    [0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6, 6, 7, 8, 9, 10, 11, 13, 14, 16, 18, 20, 23, 25],
]


def place(address: Column, block: Column, width: Column) -> tuple[Column, Column]:
    """Column and row, in blocks, of a macroblock's block in a picture that is `width` macroblocks wide."""
    bit = lambda n: shift(block, n).bitwiseAND(1)
    return (address % width) * 4 + bit(0) + 2 * bit(2), F.floor(address / width) * 4 + bit(1) + 2 * bit(3)


def with_neighbours(blocks: DataFrame, picture: list[str], asked: dict[str, tuple[Column | int, Column | int]], values: list[str], only: Column | None = None) -> DataFrame:
    """blocks (picture, x, y, ...) with a struct of `values` for each of asked: that of the block so far across and down, null where there is none.

    With only, just the blocks for which it holds are rows; all are neighbours. Distances are at most REACH. Rows of one place of a picture are not told apart: one of them is the neighbour. Null pictures are one picture.
    """
    names = blocks.columns
    kinds = dict(blocks.dtypes)
    steps = {f"_{k}_{axis}": (d if isinstance(d, Column) else F.lit(d)).cast("int") for k, pair in asked.items() for axis, d in zip("xy", pair, strict=True)}
    tile = lambda c, d: F.greatest(F.floor((F.col(c) + d) / SIDE), F.lit(0))  # no block lies left of or above 0
    spread = lambda c: F.explode(F.array_distinct(F.array(tile(c, -REACH), tile(c, 0), tile(c, REACH))))
    rows = blocks.withColumns(steps).withColumn("_own", F.lit(True) if only is None else F.coalesce(only, F.lit(False))).withColumn("_tx", spread("x")).withColumn("_ty", spread("y"))
    one = ", ".join(f"`{v}`: {kinds[v]}" for v in values)
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), *(f"`{k}` struct<{one}>" for k in asked)])
    edge, wanted = SIDE + 2 * REACH, list(asked)
    side, reach = SIDE, REACH

    def look(batch: pa.RecordBatch, tile: np.ndarray) -> pa.RecordBatch:
        """The neighbours within whole tiles, numbered by tile: places of all tiles are one ascending list of codes, which is searched."""
        get = lambda n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
        x, y = get("x") - get("_tx") * side + reach, get("y") - get("_ty") * side + reach
        code = (tile * edge + y) * edge + x
        order = np.argsort(code, kind="stable")
        ascending = code[order]
        own = np.flatnonzero((get("_own") > 0) & (x >= reach) & (x < edge - reach) & (y >= reach) & (y < edge - reach))
        columns = [batch.column(n).take(pa.array(own)) for n in names]
        for k in wanted:
            sought = code[own] + get(f"_{k}_y")[own] * edge + get(f"_{k}_x")[own]
            near = np.searchsorted(ascending, sought, "right") - 1  # of rows of one place, the last
            missing = (near < 0) | (ascending[near] != sought)
            index = pa.array(order[near], mask=missing)
            columns.append(pa.StructArray.from_arrays([batch.column(v).take(index) for v in values], names=values, mask=pa.array(missing)))
        return pa.RecordBatch.from_arrays(columns, names=[*names, *wanted])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Many tiles at once; the last one of a batch waits for its rows in the next."""
        left: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = batch.column("_new").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            if not len(starts):
                left.append(batch)
                continue
            done = [*left, batch.slice(0, starts[-1])]
            left = [batch.slice(starts[-1])]
            if whole := joined(done):
                yield look(*whole)
        if whole := joined(left):
            yield look(*whole)

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray] | None:
        parts = [p for p in parts if p.num_rows]
        if not parts:
            return None
        one = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return one, np.cumsum(one.column("_new").to_numpy(zero_copy_only=False))

    keys = [*picture, "_tx", "_ty"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x")) == 1  # leaves each tile's rows together, in one task
    return rows.withColumn("_new", first.cast("long")).mapInArrow(each, schema)


def available(neighbour: Column) -> Column:
    """A neighbour (struct of address, block and slice), null where it is in another slice or coded later."""
    earlier = (neighbour["address"] < F.col("address")) | ((neighbour["address"] == F.col("address")) & (neighbour["block"] < F.col("block")))
    return F.when((neighbour["slice"] == F.col("slice")) & earlier, neighbour)


def coded_neighbours(blocks: DataFrame, picture: list[str], values: list[str], wide: Column | int = 1, only: Column | None = None) -> DataFrame:
    """blocks (picture, address, block, slice, width, ...) with x, y and left, above, above_right and above_left, null where not available.

    Each is a struct of address, block, slice and values. above_right is that of a part `wide` blocks wide; c is the one that vectors are
    predicted from, above_right or, without it, above_left.
    """
    x, y = place(F.col("address"), F.col("block"), F.col("width"))
    asked = {"left": (-1, 0), "above": (0, -1), "above_right": (wide, -1), "above_left": (-1, -1)}
    found = with_neighbours(blocks.withColumns({"x": x, "y": y}), picture, asked, ["address", "block", "slice", *values], only)
    return found.withColumns({k: available(F.col(k)) for k in asked}).withColumn("c", F.coalesce("above_right", "above_left"))


def thresholds(quality: Column, strength: Column, alpha_offset: Column | int = 0, beta_offset: Column | int = 0) -> dict[str, Column]:
    """alpha, beta and tc0 (null but for strengths 1 to 3) by the mean quality of both sides and the slice's offsets."""
    index = lambda offset: clip(quality + offset, 0, 51)
    of = lambda table, i: F.when(i < 16, 0).otherwise(entry(table, F.greatest(i - 16, F.lit(0))))
    a, b = index(alpha_offset), index(beta_offset)
    tc0 = F.when(strength == 1, of(TC0[0], a)).when(strength == 2, of(TC0[1], a)).when(strength == 3, of(TC0[2], a))
    return {"alpha": of(ALPHA, a), "beta": of(BETA, b), "tc0": tc0}


def chroma_quality(luma: Column, offset: Column | int) -> Column:
    q = clip(luma + offset, 0, 51)
    return F.when(q < 30, q).otherwise(entry(CHROMA_QP, F.greatest(q - 30, F.lit(0))))


def edges(blocks: DataFrame, picture: list[str], chroma_offset: int = 0) -> DataFrame:
    """The edges between blocks: picture, x, y of the block behind, across (a vertical edge, to its left) or not, strength, thresholds of luma and chroma.

    Blocks hold address, block, width, intra, coded, whole8 (its transform is 8x8, so that its own odd edges are none), quality,
    alpha_offset, beta_offset, and use0 and use1, structs (x, y, ref) of the picture that each list uses, ref -1 for none. Strength
    is 4 at a macroblock's edge and 3 inside where a side is intra, else 2 where one is coded, 1 where motion differs, or 0, and such
    edges are rows too. A picture's border has no edge; slices make no difference.
    """
    c = F.col
    x, y = place(c("address"), c("block"), c("width"))
    sides = with_neighbours(blocks.withColumns({"x": x, "y": y}), picture, {"left": (-1, 0), "above": (0, -1)}, ["address", "intra", "coded", "quality", "use0", "use1"])
    both = sides.select("*", F.explode(F.array(F.struct(F.lit(True).alias("across"), c("left").alias("p")), F.struct(F.lit(False).alias("across"), c("above").alias("p")))).alias("e")).where("e.p is not null")
    p = lambda n: c(f"e.p.{n}")
    outer = p("address") != c("address")
    place_in = F.when(c("e.across"), c("x")).otherwise(c("y"))
    both = both.where(outer | ~c("whole8") | (place_in % 2 == 0))
    intra = c("intra") | p("intra")
    strength = F.when(intra & outer, 4).when(intra, 3).when(c("coded") | p("coded"), 2).when(motion_differs(p("use0"), p("use1"), c("use0"), c("use1")), 1).otherwise(0)
    mean = lambda a, b: shift(a + b + 1, 1)
    luma = mean(c("quality"), p("quality"))
    chroma = mean(chroma_quality(c("quality"), chroma_offset), chroma_quality(p("quality"), chroma_offset))
    rows = both.withColumn("strength", strength)
    found = {k: v for k, v in thresholds(luma, c("strength"), c("alpha_offset"), c("beta_offset")).items()}
    found |= {f"chroma_{k}": v for k, v in thresholds(chroma, c("strength"), c("alpha_offset"), c("beta_offset")).items()}
    return rows.select(*picture, "x", "y", c("e.across").alias("across"), "strength", *(v.alias(k) for k, v in found.items()))


def direct_blocks(blocks: DataFrame, stream: list[str], picture: str, colocated: DataFrame) -> DataFrame:
    """blocks with direct0 and direct1, structs (x, y, ref) of both lists of spatially direct prediction.

    Vectors come from the neighbours of the macroblock's first block, as wide as the macroblock; colocated gives for (stream, picture) the
    picture `other` whose blocks may rest, at the corner block of each quarter. Blocks hold intra, use0 and use1 besides what
    coded_neighbours needs. Without a co-located block nothing rests.
    """
    c, keys = F.col, [*stream, picture, "address"]
    found = coded_neighbours(blocks, [*stream, picture], ["use0", "use1"], 4, c("block") == 0)
    sides = F.struct(*(c(f"{k}.{u}").alias(f"{u}_{k}") for u in ("use0", "use1") for k in ("left", "above", "c")))
    base = found.select(F.struct(*keys).alias("_key"), sides.alias("_n"))
    corner = F.element_at(F.array(*map(F.lit, (0, 5, 10, 15))), (F.floor(c("block") / 4) + 1).cast("int")).cast("long")
    led = colocated.select(F.struct(*stream, picture).alias("_p"), c("other").cast("long").alias("_other"))
    rows = blocks.withColumn("_p", F.struct(*stream, picture)).join(led, "_p", "left").drop("_p")
    place_of = lambda other, block: F.struct(*stream, other.cast("long").alias("p"), c("address").cast("long").alias("a"), block.cast("long").alias("b"))
    held = blocks.select(place_of(c(picture), c("block")).alias("_at"), colocated_rests(c("use0"), c("use1"), c("intra")).alias("_rests"))
    rows = rows.withColumn("_at", place_of(c("_other"), corner)).join(held, "_at", "left").withColumn("_key", F.struct(*keys)).join(base, "_key")
    side = lambda u: tuple(c(f"_n.{u}_{k}") for k in ("left", "above", "c"))
    first, second = spatial_direct(side("use0"), side("use1"), F.coalesce("_rests", F.lit(False)))
    return rows.select(*blocks.columns, first.alias("direct0"), second.alias("direct1"))
