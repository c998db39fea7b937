"""Kernels against literal values: edges, flat blocks, and rules of vectors."""

import pytest
from pyspark.sql import functions as F

from bitlake.functions import codec, motion, samples


@pytest.fixture(scope="module")
def of(spark):
    return lambda *columns: list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def lits(values):
    return [F.lit(v).cast("long") for v in values]


def test_interpolation(of):
    patch = lits([0, 0, 0, 255, 255, 255] * 6)
    assert of(*(samples.fractional(patch, x, y) for x, y in ((0, 0), (1, 0), (2, 0), (3, 0), (2, 2), (0, 2)))) == [0, 64, 128, 192, 128, 0]
    assert of(codec.bilinear(*lits([0, 255, 0, 255]), F.lit(4), F.lit(4))) == [128]


def test_transform_and_scaling(of):
    flat = samples.by_lines(samples.across(samples.by_lines(lits([640] + [0] * 63), 8, samples.line8), 8), 8, samples.line8)
    assert set(of(*(samples.rounded(v, 6) for v in flat))) == {10}
    qp = F.lit(36)
    assert of(samples.scaled8(F.lit(3), qp, 0, 0, F.lit(16)), samples.scaled8(F.lit(3), F.lit(6), 0, 0, F.lit(16)), samples.scaled_luma_dc(F.lit(4), qp, F.lit(16))) == [960, 30, 640]
    assert [samples.kind8(x, 0) for x in range(4)] == [0, 3, 4, 3] and [samples.kind8(x, 1) for x in range(4)] == [3, 1, 5, 1] and samples.kind8(2, 2) == 2


def test_edges(of):
    p, q = lits([10, 10, 10, 10]), lits([20, 20, 20, 20])
    assert of(*samples.strong_filter_both(p, q, 60, 40)) == [14, 13, 11, 16, 18, 19]
    assert of(*samples.normal_filter(p[:3], q[:3], 4, 40)) == [14, 12, 16, 17]
    assert of(*samples.normal_filter_chroma(p[:2], q[:2], 1)) == [12, 18]
    assert of(*samples.strong_filter_chroma(p[:2], q[:2])) == [13, 18]


def test_modes_of_a_flat_line(of):
    line = samples.Line(lits([7] * 16), lits([7] * 8), F.lit(7))
    assert set(of(*(v for m in range(9) for v in samples.predicted(m, line.filtered(), 8)))) == {7}
    assert of(samples.average(None, None)) == [128] and set(of(*samples.plane16(lits([9] * 16), lits([9] * 16), F.lit(9)))) == {9}


def test_vectors(of):
    v = lambda x, y, ref: F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"), F.lit(ref).cast("long").alias("ref"))
    none = F.lit(None).cast("struct<x:bigint,y:bigint,ref:bigint>")
    a, b, c = v(4, 0, 0), v(8, 2, 1), v(-2, 6, 1)
    ref = F.lit(0)
    got = of(motion.predicted_vector(a, b, c, ref), motion.predicted_vector(a, b, c, F.lit(1)), motion.predicted_vector(a, none, none, F.lit(3)), motion.predicted_vector(a, b, c, F.lit(1), "8x16", 1), motion.skipped_vector(a, none, c), motion.skipped_vector(a, b, c))
    assert [tuple(g) for g in got] == [(4, 0), (4, 2), (4, 0), (-2, 6), (0, 0), (4, 0)]
    assert of(*motion.direct_vectors(F.lit(16).cast("long"), F.lit(2), F.lit(4)), *motion.direct_vectors(F.lit(16).cast("long"), F.lit(2), F.lit(0))) == [8, -8, 16, 0]
    assert of(motion.motion_differs(a, none_use(), none_use(), a), motion.motion_differs(a, b, a, c)) == [False, True]


def none_use():
    return F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(-1).cast("long").alias("ref"))
