"""Column expressions of the decoder's arithmetic: bit codes, quality, picture order, prediction, filters."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from bitlake.functions.either import clip, shift

# Chroma quality by luma quality from 30 up.
CHROMA_QP = [29, 30, 31, 32, 32, 33, 34, 34, 35, 35, 36, 36, 37, 37, 37, 38, 38, 38, 39, 39, 39, 39]


def ue_code(v: Column) -> Column:
    """The Exp-Golomb code of a number as a bit string."""
    digits = F.bin(v + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(digits) - 1), digits)


def read_u(bits: Column, n: int) -> Column:
    """The number in the first n bits of a bit string, n at most 32; null where there are fewer."""
    return F.when(F.length(bits) >= n, F.conv(F.substring(bits, 1, n), 2, 10).cast("long"))


def read_ue(bits: Column) -> Column:
    """The unsigned Exp-Golomb value at the start of a bit string; null without a whole code or with over 31 zeros before its first one."""
    zeros = F.instr(bits, "1") - 1
    return F.when((zeros >= 0) & (zeros <= 31) & (F.length(bits) > 2 * zeros), F.conv(F.substring(bits, zeros + 1, zeros + 1), 2, 10).cast("long") - 1)


def read_te(bits: Column, most: Column) -> Column:
    """The truncated value: one inverted bit where most is 1, else an unsigned Exp-Golomb value."""
    return F.when(most > 1, read_ue(bits)).otherwise(1 - read_u(bits, 1))


def more_data(bits: Column, at: Column) -> Column:
    """Whether a bit of data is left at a place of a payload's bit string, counted from 0: its last one is the stop bit."""
    return at < F.length(F.rtrim(bits, F.lit("0"))) - 1


def read_se(bits: Column) -> Column:
    """The signed value: 0, 1, -1, 2, -2, ..."""
    k = read_ue(bits)
    half = F.shiftright(k + 1, 1)
    return F.when(k % 2 == 0, -half).otherwise(half)


def chroma_qp(luma: Column, offset: int) -> Column:
    q = clip(luma + offset, 0, 51)
    return F.when(q < 30, q).otherwise(F.element_at(F.array(*map(F.lit, CHROMA_QP)), F.greatest(q - 29, F.lit(1))))


def context_state(m: Column, n: Column, qp: Column) -> Column:
    """The initial state of an arithmetic-coding context for slice quality qp."""
    pre = 2 * (F.shiftright(m * clip(qp, 0, 51), 4) + n) - 127
    pre = F.when(pre < 0, -pre - 1).otherwise(pre)
    return F.when(pre > 124, 124 + (pre % 2)).otherwise(pre)


def weighted_uni(p: Column, denom: int, weight: Column, offset: Column) -> Column:
    v = p * weight if denom == 0 else F.shiftright(p * weight + (1 << (denom - 1)), denom)
    return clip(v + offset, 0, 255)


def weighted_bi(a: Column, b: Column, denom: int, w0: Column, w1: Column, offsets: Column) -> Column:
    return clip(F.shiftright(a * w0 + b * w1 + (1 << denom), denom + 1) + F.shiftright(offsets + 1, 1), 0, 255)


def six_tap(taps: list[Column]) -> Column:
    """The half-sample value between the third and the fourth of six neighbours."""
    s = taps
    return clip(shift(s[0] - 5 * s[1] + 20 * s[2] + 20 * s[3] - 5 * s[4] + s[5] + 16, 5), 0, 255)


def bilinear(a: Column, b: Column, c: Column, d: Column, x: Column, y: Column) -> Column:
    return shift((8 - x) * (8 - y) * a + x * (8 - y) * b + (8 - x) * y * c + x * y * d + 32, 6)


def median(a: Column, b: Column, c: Column) -> Column:
    return a + b + c - F.greatest(a, b, c) - F.least(a, b, c)


def temporal_scale(tb: Column, td: Column) -> Column:
    """The scale of a co-located vector by picture distances; td is not 0. Division cuts toward zero."""
    b, d = clip(tb, -128, 127), clip(td, -128, 127)
    whole = lambda n, k: F.when((n < 0) != (k < 0), -F.floor(F.abs(n) / F.abs(k))).otherwise(F.floor(F.abs(n) / F.abs(k)))
    tx = whole(16384 + F.floor(F.abs(d) / 2), d)
    return clip(F.shiftright((b * tx + 32).cast("long"), 6), -1024, 1023)


def should_filter(p1: Column, p0: Column, q0: Column, q1: Column, alpha: int, beta: int) -> Column:
    return (F.abs(p0 - q0) < alpha) & (F.abs(p1 - p0) < beta) & (F.abs(q1 - q0) < beta)


def filtered_p0(p2: Column, p1: Column, p0: Column, q0: Column, q1: Column, q2: Column, tc0: int, beta: int) -> Column:
    """The first sample of the normal edge filter."""
    tc = F.lit(tc0) + (F.abs(p2 - p0) < beta).cast("int") + (F.abs(q2 - q0) < beta).cast("int")
    delta = F.greatest(-tc, F.least(tc, F.shiftright((q0 - p0) * 4 + (p1 - q1) + 4, 3)))
    return clip(p0 + delta, 0, 255)


def hadamard2(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    return [a + b + c + d, a - b + c - d, a + b - c - d, a - b - c + d]


def picture_order_count(lsb: str, ref: str, idr: str, by: list[str], order: str, period: int) -> Column:
    """Picture order counts of type 0: the wraps of the low part, counted over the reference pictures before."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    shown = F.when(F.col(idr), 0).when(F.col(ref), F.col(lsb))
    last = F.coalesce(F.last(shown, ignorenulls=True).over(before), F.lit(0))
    now = F.col(lsb)
    return F.when(F.col(idr), 0).when((now < last) & (last - now >= period // 2), period).when((now > last) & (now - last > period // 2), -period).otherwise(0)
