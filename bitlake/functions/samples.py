"""Kernels over samples, of Columns or NumPy arrays: all spatial modes, all quarter places, the 8x8 transform and scaling, both sides of an edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitlake.functions.blocks import SCALES, strong_filter
from bitlake.functions.codec import six_tap
from bitlake.functions.either import absolute, choose, clip, entry, greatest, number, quotient, scaled_down, scaled_up, shift

# Scaling of an 8x8 coefficient by quality modulo 6: by the six kinds of places in order of 8x8 kind.
SCALES_8X8 = [[20, 18, 32, 19, 25, 24], [22, 19, 35, 21, 28, 26], [26, 23, 42, 24, 33, 31], [28, 25, 45, 26, 35, 33], [32, 28, 51, 30, 40, 38], [36, 32, 58, 34, 46, 43]]
# The two samples whose mean is the value at each quarter place (across, down): half ones across, down and both are h, v and m.
QUARTERS = {
    (1, 0): ("whole", "h"), (3, 0): ("h", "whole right"), (0, 1): ("whole", "v"), (0, 3): ("v", "whole below"), (2, 1): ("h", "m"), (2, 3): ("m", "h below"),
    (1, 2): ("v", "m"), (3, 2): ("m", "v right"), (1, 1): ("h", "v"), (3, 1): ("h", "v right"), (1, 3): ("v", "h below"), (3, 3): ("v right", "h below"),
}


def rounded(total: Column, places: int) -> Column:
    return shift(total + (1 << places - 1), places)


# Spatial prediction. A block's neighbours are one line: left ones upwards at -n to -1, the corner at 0, upper ones from 1.


class Line:
    def __init__(self, above: list[Column], left: list[Column], corner: Column):
        self.at = {0: corner} | {i + 1: v for i, v in enumerate(above)} | {-i - 1: v for i, v in enumerate(left)}
        self.above, self.left = above, left

    def mean(self, k: int) -> Column:
        return rounded(self.at[k] + self.at[k + 1], 1)

    def smooth(self, k: int) -> Column:
        """The filtered sample at k; at the line's ends the end counts in place of what follows."""
        return rounded(self.at.get(k - 1, self.at[k]) + 2 * self.at[k] + self.at.get(k + 1, self.at[k]), 2)

    def turned(self) -> "Line":
        """The line from its other end."""
        t = Line([], [], self.at[0])
        t.at = {-k: v for k, v in self.at.items()}
        return t

    def filtered(self) -> "Line":
        """The line that 8x8 blocks are predicted from."""
        return Line([self.smooth(i + 1) for i in range(len(self.above))], [self.smooth(-i - 1) for i in range(len(self.left))], self.smooth(0))


def steep(line: Line, x: int, y: int) -> Column:
    """The vertical-right mode; the horizontal-down one is the same on the turned line with x and y exchanged."""
    k, z = x - (y >> 1), 2 * x - y
    if z >= 0:
        return line.smooth(k) if z % 2 else line.mean(k)
    return line.smooth(z + 1)


def rising(left: list[Column], z: int) -> Column:
    """The horizontal-up mode by x + 2 y: along the left samples, of which the last one goes on."""
    i, n = z // 2, len(left)
    side = lambda j: left[min(j, n - 1)]
    return rounded(side(i) + 2 * side(i + 1) + side(i + 2), 2) if z % 2 else rounded(side(i) + side(i + 1), 1)


def average(above: list[Column] | None, left: list[Column] | None) -> Column:
    """The mean of the sides that are available; 128 without any."""
    samples = (above or []) + (left or [])
    return rounded(sum(samples[1:], samples[0]), len(samples).bit_length() - 1) if samples else F.lit(128)


def predicted(mode: int, line: Line, n: int) -> list[Column]:
    """The n x n block of modes 0 to 8, in row order, from 2 n upper and n left samples."""
    value = {
        0: lambda x, y: line.at[x + 1], 1: lambda x, y: line.at[-y - 1], 2: lambda x, y: average(line.above[:n], line.left),
        3: lambda x, y: line.smooth(x + y + 2), 4: lambda x, y: line.smooth(x - y), 5: lambda x, y: steep(line, x, y), 6: lambda x, y: steep(line.turned(), y, x),
        7: lambda x, y: line.smooth(x + (y >> 1) + 2) if y % 2 else line.mean(x + (y >> 1) + 1), 8: lambda x, y: rising(line.left, x + 2 * y),
    }[mode]
    return [value(x, y) for y in range(n) for x in range(n)]


def filled(above: list[Column], left: list[Column], corner: Column, n: int, has: dict[str, Column]) -> Line:
    """A block's line where sides may be missing (has: above, left, corner, right): 128 for them, the last upper sample for missing upper-right ones."""
    right = [choose(has["right"], v, above[n - 1]) for v in above[n:]]
    return Line([choose(has["above"], v, 128) for v in above[:n] + right], [choose(has["left"], v, 128) for v in left], choose(has["corner"], corner, 128))


def filled_filtered(above: list[Column], left: list[Column], corner: Column, n: int, has: dict[str, Column]) -> Line:
    """The filtered line of an 8x8 block where sides may be missing: without the corner a side's first sample counts for it, missing sides stay 128."""
    plain = filled(above, left, corner, n, has)
    of = lambda first: Line(plain.above, plain.left, choose(has["corner"], corner, first)).filtered()
    upper, lower = of(plain.above[0]), of(plain.left[0])
    return Line([choose(has["above"], v, 128) for v in upper.above], [choose(has["left"], v, 128) for v in lower.left], upper.at[0])


def mean_of_sides(above: list[Column], left: list[Column], has: dict[str, Column]) -> Column:
    """The mean of those of two sides that are there; 128 without any."""
    one = choose(has["above"], average(above, None), choose(has["left"], average(None, left), 128))
    return choose(has["above"] & has["left"], average(above, left), one)


def chroma_means(above: list[Column], left: list[Column], has: dict[str, Column]) -> list[Column]:
    """The means of the four quarters of an 8x8 chroma block: upper left, upper right, lower left, lower right.

    Beside the diagonal a quarter takes the side next to it alone, if that is there, else the other one.
    """
    a, b, c, d = above[:4], above[4:], left[:4], left[4:]
    first = lambda side, other, name: choose(has[name], average(side, None), choose(has["above" if name == "left" else "left"], average(other, None), 128))
    return [mean_of_sides(a, c, has), first(b, c, "above"), first(d, a, "left"), mean_of_sides(b, d, has)]


def slopes16(above: list[Column], left: list[Column], corner: Column) -> tuple[Column, Column]:
    """What the plane of a 16x16 block gains for each sample across and down."""

    def slope(side: list[Column]) -> Column:
        whole = [corner, *side]
        return rounded(5 * sum((whole[9 + i] - whole[7 - i]) * (i + 1) for i in range(8)), 6)

    return slope(above), slope(left)


def plane_of_slopes16(across: Column, down: Column, ends: Column) -> list[Column]:
    """The plane by its slopes and the sum of both sides' last samples."""
    return [clip(rounded(16 * ends + across * (x - 7) + down * (y - 7), 5), 0, 255) for y in range(16) for x in range(16)]


def plane16(above: list[Column], left: list[Column], corner: Column) -> list[Column]:
    """The plane prediction of a 16x16 block."""
    return plane_of_slopes16(*slopes16(above, left, corner), above[15] + left[15])


# Interpolation in a patch of 6x6 samples, of which the one in the third row and column is the whole sample's.


def fractional(patch: list[Column], x: int, y: int) -> Column:
    """The sample at x and y quarters to the right of and below the patch's third one."""
    row = lambda r: patch[6 * r : 6 * r + 6]
    column = lambda c: patch[c::6]
    raw = lambda s: s[0] - 5 * s[1] + 20 * s[2] + 20 * s[3] - 5 * s[4] + s[5]
    made = {"whole": patch[14], "whole right": patch[15], "whole below": patch[20], "h": six_tap(row(2)), "h below": six_tap(row(3)), "v": six_tap(column(2)), "v right": six_tap(column(3)), "m": clip(rounded(raw([raw(row(r)) for r in range(6)]), 10), 0, 255)}
    if x % 2 == y % 2 == 0:
        return made[{(0, 0): "whole", (2, 0): "h", (0, 2): "v", (2, 2): "m"}[x, y]]
    a, b = QUARTERS[x, y]
    return rounded(made[a] + made[b], 1)


def weighted_implicit(a: Column, b: Column, w0: Column, w1: Column) -> Column:
    return clip(rounded(a * w0 + b * w1, 6), 0, 255)


# Scaling by matrices, and the 8x8 transform.


def scaled(level: Column, qp: Column, scales: list[int], weight: Column, places: int) -> Column:
    """A level times its scale and weight, shifted by quality / 6 - places; rounded where that is to the right."""
    octave = quotient(qp, 6)
    v = level * entry(scales, qp % 6) * weight
    return choose(octave >= places, scaled_up(v, greatest(octave - places, 0)), scaled_down(v, greatest(places - octave, 1)))


def scaled4(level: Column, qp: Column, x: int, y: int, weight: Column) -> Column:
    kind = 0 if x % 2 == y % 2 == 0 else 1 if x % 2 == y % 2 == 1 else 2
    return scaled(level, qp, [row[kind] for row in SCALES], weight, 4)


def scaled_luma_dc(level: Column, qp: Column, weight: Column) -> Column:
    return scaled(level, qp, [row[0] for row in SCALES], weight, 6)


def scaled_chroma_dc(level: Column, qp: Column, weight: Column) -> Column:
    return scaled(level, qp, [row[0] for row in SCALES], weight, 5)


def kind8(x: int, y: int) -> int:
    """The kind of a place of an 8x8 block, by its coordinates modulo 4."""
    x, y = sorted((x % 4, y % 4))
    if x % 2 and y % 2:
        return 1
    if x % 2 or y % 2:
        even = x if y % 2 else y
        return 3 if even == 0 else 5
    return 0 if x == y == 0 else 2 if x == y == 2 else 4


def scaled8(level: Column, qp: Column, x: int, y: int, weight: Column) -> Column:
    return scaled(level, qp, [row[kind8(x, y)] for row in SCALES_8X8], weight, 6)


def line8(v: list[Column]) -> list[Column]:
    """One line of the inverse 8x8 transform: the even half is the 4-point one's kind, the odd half mixes quarters."""
    half = lambda c: shift(c, 1)
    quarter = lambda c: shift(c, 2)
    s, d, e, f = v[0] + v[4], v[0] - v[4], half(v[2]) - v[6], v[2] + half(v[6])
    even = [s + f, d + e, d - e, s - f]
    o = [v[5] - v[3] - v[7] - half(v[7]), v[1] + v[7] - v[3] - half(v[3]), v[7] - v[1] + v[5] + half(v[5]), v[3] + v[5] + v[1] + half(v[1])]
    odd = [o[3] - quarter(o[0]), quarter(o[1]) - o[2], o[1] + quarter(o[2]), o[0] + quarter(o[3])]
    return [a + b for a, b in zip(even, odd, strict=True)] + [a - b for a, b in zip(even[::-1], odd[::-1], strict=True)]


def by_lines(block: list[Column], n: int, use) -> list[Column]:
    return [v for at in range(0, n * n, n) for v in use(block[at : at + n])]


def across(block: list[Column], n: int) -> list[Column]:
    return [block[n * x + y] for y in range(n) for x in range(n)]


# Both sides of an edge.


def normal_filter(p: list[Column], q: list[Column], tc0: int, beta: int) -> list[Column]:
    """(p0, p1, q0, q1) after the filter of strengths 1 to 3, from three samples of each side."""
    flat = [absolute(side[2] - side[0]) < beta for side in (p, q)]
    tc = number(flat[0]) + number(flat[1]) + tc0
    move = clip(rounded((q[0] - p[0]) * 4 + (p[1] - q[1]), 3), -tc, tc)
    mid = rounded(p[0] + q[0], 1)
    second = [choose(f, side[1] + clip(shift(side[2] + mid, 1) - side[1], -tc0, tc0), side[1]) for f, side in zip(flat, (p, q), strict=True)]
    return [clip(p[0] + move, 0, 255), second[0], clip(q[0] - move, 0, 255), second[1]]


def normal_filter_chroma(p: list[Column], q: list[Column], tc0: int) -> list[Column]:
    """(p0, q0) of chroma after the filter of strengths 1 to 3."""
    move = clip(rounded((q[0] - p[0]) * 4 + (p[1] - q[1]), 3), -tc0 - 1, tc0 + 1)
    return [clip(p[0] + move, 0, 255), clip(q[0] - move, 0, 255)]


def strong_filter_both(p: list[Column], q: list[Column], alpha: int, beta: int) -> list[Column]:
    """(p0, p1, p2, q0, q1, q2) after the filter of strength 4, from four samples of each side."""
    return strong_filter(*p[::-1], q[0], q[1], alpha, beta) + strong_filter(*q[::-1], p[0], p[1], alpha, beta)


def strong_filter_chroma(p: list[Column], q: list[Column]) -> list[Column]:
    return [rounded(2 * p[1] + p[0] + q[1], 2), rounded(2 * q[1] + q[0] + p[1], 2)]
