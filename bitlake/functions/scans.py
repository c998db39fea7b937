"""Sparse blocks: (run, level) pairs into blocks in row order through scan orders, and their scaling by matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitlake.functions.blocks import SCALES
from bitlake.functions.either import Value, choose, greatest, let, quotient, scaled_down, scaled_up
from bitlake.functions.samples import SCALES_8X8, kind8

# The places in row order, 4 or 8 a row, that the scan of field blocks goes through.
FIELD_4X4 = [0, 4, 1, 8, 12, 5, 9, 13, 2, 6, 10, 14, 3, 7, 11, 15]
FIELD_8X8 = [
    0, 8, 16, 1, 9, 24, 32, 17, 2, 25, 40, 48, 56, 33, 10, 3, 18, 41, 49, 57, 26, 11, 4, 19, 34, 42, 50, 58, 27, 12, 5, 20,
    35, 43, 51, 59, 28, 13, 6, 21, 36, 44, 52, 60, 29, 14, 22, 37, 45, 53, 61, 30, 7, 15, 38, 46, 54, 62, 23, 31, 39, 47, 55, 63,
]


def diagonal_scan(n: int) -> list[int]:
    """The scan of frame blocks: diagonals from the corner on, every other one upwards."""
    order = sorted(((x + y, y if (x + y) % 2 else x, n * y + x) for y in range(n) for x in range(n)))
    return [place for _, _, place in order]


def scan(n: int, field: bool) -> list[int]:
    return (FIELD_4X4 if n == 4 else FIELD_8X8) if field else diagonal_scan(n)


def inverse_of(order: list[int]) -> list[int]:
    """By each place in row order, its place in the scan."""
    return sorted(range(len(order)), key=order.__getitem__)


def in_scan_order(pairs: Column, n: int, start: Column | int = 0) -> Column:
    """array<bigint> of n * n levels in scan order from pairs, structs of run (zeros before) and level; start 1 leaves the first place out.

    Pairs that lead beyond the block's end are left out, and null pairs are none.
    """
    state = F.struct((F.lit(start) if isinstance(start, int) else start).cast("long").alias("at"), F.array().cast("array<struct<at:bigint,level:bigint>>").alias("done"))

    def step(s: Column, p: Column) -> Column:
        at = s["at"] + p["run"]
        return F.struct((at + 1).alias("at"), F.concat(s["done"], F.array(F.struct(at.alias("at"), p["level"].cast("long").alias("level")))).alias("done"))

    done = F.aggregate(F.coalesce(pairs, F.array().cast("array<struct<run:bigint,level:bigint>>")), state, step, lambda s: F.map_from_entries(F.filter(s["done"], lambda e: e["at"] < n * n)))
    return let(done, lambda m: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n * n - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0))))


def in_row_order(levels: Column, n: int, field: Column) -> Column:
    """Levels in scan order as a block in row order, by the scan of field or of frame blocks."""
    order = F.when(field, F.array(*map(F.lit, inverse_of(scan(n, True))))).otherwise(F.array(*map(F.lit, inverse_of(scan(n, False)))))
    return let(levels, lambda held: F.transform(order, lambda i: F.get(held, i)))


def scale_table(n: int) -> list[list[int]]:
    """By quality modulo 6, the scales of a block's places in row order."""
    kind = lambda x, y: (0 if x % 2 == y % 2 == 0 else 1 if x % 2 == y % 2 == 1 else 2) if n == 4 else kind8(x, y)
    return [[row[kind(i % n, i // n)] for i in range(n * n)] for row in (SCALES if n == 4 else SCALES_8X8)]


def by_octave(v: Value, octave: Value, n: int) -> Value:
    """A level times its scale and weight, shifted by quality / 6; rounded where that is to the right."""
    places = 4 if n == 4 else 6
    return choose(octave >= places, scaled_up(v, greatest(octave - places, 0)), scaled_down(v, greatest(places - octave, 1)))


def scaled_block(levels: Column, qp: Column, matrix: Column, n: int, start: Column | int = 0) -> Column:
    """A block in row order, scaled by quality and a matrix of n * n weights, which are always in the frame's scan order.

    With start 1 the first level has been scaled already and stays.
    """
    scales = F.get(F.array(*(F.array(*map(F.lit, row)) for row in scale_table(n))), (qp % 6).cast("int"))
    weights = let(matrix, lambda m: F.transform(F.array(*map(F.lit, inverse_of(diagonal_scan(n)))), lambda i: F.get(m, i)))
    first = F.lit(start) if isinstance(start, int) else start

    def value(level: Column, i: Column, t: Column) -> Column:
        v = level * F.get(t["scales"], i) * F.get(t["weights"], i)
        return F.when((level == 0) | (i < first), level).otherwise(by_octave(v, t["octave"], n))

    held = F.struct(levels.alias("levels"), scales.alias("scales"), weights.alias("weights"), quotient(qp, 6).alias("octave"))
    return let(held, lambda t: F.transform(t["levels"], lambda level, i: value(level, i, t)))


def sparse_blocks(pairs: list[tuple[np.ndarray, np.ndarray]], n: int, start: np.ndarray, field: np.ndarray, qp: np.ndarray, matrices: np.ndarray, which: np.ndarray) -> np.ndarray:
    """What in_scan_order, in_row_order and scaled_block give, over arrays: a row of n * n scaled levels for each of many blocks.

    pairs are runs and levels of all blocks, matrices rows of weights in the frame's scan order, of which each block has one (which). Only the
    levels that are there are scaled.
    """
    orders = np.array([scan(n, False), scan(n, True)])
    scales, weights = np.array(scale_table(n)), matrices[:, inverse_of(diagonal_scan(n))]
    out, at = np.zeros((len(start), n * n), np.int64), start.astype(np.int64)
    for run, level in pairs:
        at = at + run
        own = np.flatnonzero((at >= 0) & (at < n * n) & (level != 0))
        place, quality = orders[field[own].astype(int), at[own]], qp[own]
        made = by_octave(level[own] * scales[quality % 6, place] * weights[which[own], place], quality // 6, n)
        out[own, place] = np.where(place < start[own], level[own], made)
        at = at + 1
    return out
