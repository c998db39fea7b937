"""Column expressions over blocks: scaling, inverse transforms, spatial prediction, strong filter, edge strength, weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitlake.functions.codec import six_tap, temporal_scale
from bitlake.functions.either import absolute, choose, clip, entry, greatest, quotient, scaled_down, scaled_up, shift

# Scaling of a coefficient by quality modulo 6: both places even, both odd, else.
SCALES = [[10, 16, 13], [11, 18, 14], [13, 20, 16], [14, 23, 18], [16, 25, 20], [18, 29, 23]]


def power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def scale_of(qp: Column, x: int, y: int) -> Column:
    kind = 0 if x % 2 == y % 2 == 0 else 1 if x % 2 == y % 2 == 1 else 2
    return entry([row[kind] for row in SCALES], qp % 6)


def dequantised(level: Column, qp: Column, x: int, y: int) -> Column:
    """A level of a 4x4 block at (x, y) under the flat matrix of sixteens, rounded where quality is under 24."""
    scaled, octave = level * scale_of(qp, x, y) * 16, quotient(qp, 6)
    return choose(octave >= 4, scaled_up(scaled, greatest(octave - 4, 0)), scaled_down(scaled, greatest(4 - octave, 1)))


def dequantised_chroma_dc(value: Column, qp: Column) -> Column:
    return F.shiftright(value * scale_of(qp, 0, 0) * 16 * power(F.floor(qp / 6)), 5)


def butterfly(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    even, odd, half, whole = a + c, a - c, shift(b, 1) - d, b + shift(d, 1)
    return [even + whole, odd + half, odd - half, even - whole]


def flipped(block: list[Column]) -> list[Column]:
    return [block[4 * x + y] for y in range(4) for x in range(4)]


def by_rows(block: list[Column], use) -> list[Column]:
    return [v for y in range(4) for v in use(*block[4 * y : 4 * y + 4])]


def hadamard4(block: list[Column]) -> list[Column]:
    """The 4x4 transform of the direct-current levels, rows first; entries are in row order."""
    line = lambda a, b, c, d: [a + b + c + d, a + b - c - d, a - b - c + d, a - b + c - d]
    return flipped(by_rows(flipped(by_rows(block, line)), line))


def second_half(block: list[Column]) -> list[Column]:
    """The columns' half of the inverse 4x4 transform, rounded to residuals."""
    return [shift(v + 32, 6) for v in flipped(by_rows(flipped(block), butterfly))]


def quarter_sample(taps: list[Column]) -> Column:
    return F.shiftright(taps[2] + six_tap(taps) + 1, 1)


def plane(above: list[Column], left: list[Column], corner: Column, x: int, y: int) -> Column:
    """The plane prediction of an 8x8 chroma block at (x, y) from its eight upper and left neighbours."""
    return planes(above, left, corner, [(x, y)])[0]


def planes(above: list[Column], left: list[Column], corner: Column, points: list[tuple[int, int]]) -> list[Column]:
    """The plane prediction at each of some places of a block; both slopes are the same for all."""

    def slope(side: list[Column]) -> Column:
        before = [side[2], side[1], side[0], corner]
        return shift(34 * sum((side[4 + i] - before[i]) * (i + 1) for i in range(4)) + 32, 6)

    across, down = slope(above), slope(left)
    return [clip(shift(16 * (left[7] + above[7]) + across * (x - 3) + down * (y - 3) + 16, 5), 0, 255) for x, y in points]


def strong_filter(p3: Column, p2: Column, p1: Column, p0: Column, q0: Column, q1: Column, alpha: int, beta: int) -> list[Column]:
    """(p0, p1, p2) after the filter of strength 4; without a smooth side only p0 changes."""
    smooth = (absolute(p2 - p0) < beta) & (absolute(p0 - q0) < (alpha >> 2) + 2)
    changed = [shift(p2 + 2 * (p1 + p0 + q0) + q1 + 4, 3), shift(p2 + p1 + p0 + q0 + 2, 2), shift(2 * p3 + 3 * p2 + p1 + p0 + q0 + 4, 3)]
    plain = [shift(2 * p1 + p0 + q1 + 2, 2), p1, p2]
    return [choose(smooth, a, b) for a, b in zip(changed, plain, strict=True)]


def edge_strength(intra: Column, outer: Column, coded: Column, other_picture: Column, dx: Column, dy: Column) -> Column:
    moved = other_picture | (F.abs(dx) >= 4) | (F.abs(dy) >= 4)
    return F.when(intra & outer, 4).when(intra, 3).when(coded, 2).when(moved, 1).otherwise(0)


def implicit_weights(tb: Column, td: Column) -> list[Column]:
    """Both weights of a picture by its distances; equal where pictures coincide or the scale is out of range."""
    scale = F.shiftright(temporal_scale(tb, td), 2)
    plain = (td == 0) | (scale < -64) | (scale > 128)
    return [F.when(plain, 32).otherwise(64 - scale), F.when(plain, 32).otherwise(scale)]


def least_reference(a: Column, b: Column, c: Column) -> Column:
    """The least index that is not negative of three neighbours; -1 where all are unavailable."""
    return F.coalesce(F.least(*(F.when(v >= 0, v) for v in (a, b, c))), F.lit(-1))


def predicted_mode(left: Column, up: Column) -> Column:
    return F.when(left.isNull() | up.isNull(), 2).otherwise(F.least(left, up))


def coefficient_context(left: Column, up: Column) -> Column:
    """The mean number of coefficients of the neighbours that exist; 0 without any."""
    return F.coalesce(F.shiftright(left + up + 1, 1), left, up, F.lit(0))
