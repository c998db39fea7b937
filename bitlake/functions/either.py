"""Arithmetic that is the same over Columns and over NumPy arrays of whole numbers, so that a kernel is written once for both."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | np.ndarray


def is_array(*values: object) -> bool:
    return any(isinstance(v, np.ndarray) for v in values)


def shift(v: Value, n: int) -> Value:
    """v divided by 2**n, downwards."""
    return v >> n if is_array(v) else F.shiftright(v, n)


def scaled_up(v: Value, n: Value) -> Value:
    """v times 2**n."""
    return v << n if is_array(v, n) else v * F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def scaled_down(v: Value, n: Value) -> Value:
    """v divided by 2**n, to the nearest, n at least 1."""
    if is_array(v, n):
        return (v + (1 << (n - 1))) >> n
    return F.floor((v + scaled_up(F.lit(1), n - 1)) / scaled_up(F.lit(1), n)).cast("long")


def quotient(v: Value, n: int) -> Value:
    return v // n if is_array(v) else F.floor(v / n).cast("int")


def least(a: Value, b: Value | int) -> Value:
    return np.minimum(a, b) if is_array(a, b) else F.least(a, F.lit(b) if isinstance(b, int) else b)


def greatest(a: Value, b: Value | int) -> Value:
    return np.maximum(a, b) if is_array(a, b) else F.greatest(a, F.lit(b) if isinstance(b, int) else b)


def clip(v: Value, lo: Value | int, hi: Value | int) -> Value:
    return greatest(least(v, hi), lo)


def absolute(v: Value) -> Value:
    return np.abs(v) if is_array(v) else F.abs(v)


def choose(condition: Value, a: Value | int, b: Value | int) -> Value:
    return np.where(condition, a, b) if is_array(condition) else F.when(condition, a).otherwise(b)


def number(flag: Value) -> Value:
    return flag.astype(np.int64) if is_array(flag) else flag.cast("int")


def entry(table: list[int], at: Value) -> Value:
    """The entry of a short table at a place, from 0."""
    return np.array(table)[at] if is_array(at) else F.get(F.array(*map(F.lit, table)), at.cast("int")).cast("long")


def let(value: Column, use) -> Column:
    """use(value), with value computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
