"""Column expressions over motion: vector prediction, skipped and direct vectors, and whether motion differs across an edge.

A neighbour is a struct of x, y and ref, null where it is not available; ref is -1 where it uses none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitlake.functions.blocks import implicit_weights, least_reference
from bitlake.functions.codec import median, temporal_scale
from bitlake.functions.either import clip

#: For the halves of a block: which neighbour decides alone if it has the block's reference.
FIRST = {("16x8", 0): "b", ("16x8", 1): "a", ("8x16", 0): "a", ("8x16", 1): "c"}


def predicted_vector(a: Column, b: Column, c: Column, ref: Column, shape: str = "16x16", part: int = 0) -> Column:
    """struct(x, y): the vector of the one neighbour with the reference, or of the first if it is the only one, else medians."""
    sides = {"a": a, "b": b, "c": c}
    same = {k: F.coalesce(v["ref"] == ref, F.lit(False)) for k, v in sides.items()}
    one = sum(s.cast("int") for s in same.values()) == 1
    vector = lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))
    zero = lambda v, k: F.coalesce(v[k], F.lit(0).cast("long"))
    middle = F.struct(*(median(*(zero(v, k) for v in sides.values())).alias(k) for k in ("x", "y")))
    first = FIRST.get((shape, part))
    out = F.when(same[first], vector(sides[first])) if first else F.when(F.lit(False), vector(a))
    for k, v in sides.items():
        out = out.when(one & same[k], vector(v))
    return out.when(b.isNull() & c.isNull() & a.isNotNull(), vector(a)).otherwise(middle)


def skipped_vector(a: Column, b: Column, c: Column) -> Column:
    """struct(x, y) of a skipped block: none without a left or an upper neighbour, or where one rests in the first reference."""
    rests = lambda v: v.isNull() | ((v["ref"] == 0) & (v["x"] == 0) & (v["y"] == 0))
    zero = F.lit(0).cast("long")
    return F.when(rests(a) | rests(b), F.struct(zero.alias("x"), zero.alias("y"))).otherwise(predicted_vector(a, b, c, F.lit(0)))


def spatial_vector(a: Column, b: Column, c: Column, rests: Column) -> Column:
    """struct(x, y, ref) of a spatially direct block: the neighbours' least reference and its predicted vector.

    Without any reference it is the first with no motion; nor does a block move whose reference is the first and whose
    co-located one rests.
    """
    least = least_reference(*(F.coalesce(v["ref"], F.lit(-1).cast("long")) for v in (a, b, c)))
    moved = predicted_vector(a, b, c, least)
    still = (least < 0) | ((least == 0) & rests)
    return F.struct(*(F.when(still, 0).otherwise(moved[k]).cast("long").alias(k) for k in ("x", "y")), F.greatest(least, F.lit(0)).cast("long").alias("ref"))


def direct_vectors(v: Column, tb: Column, td: Column) -> list[Column]:
    """One component of both lists' vectors from a co-located one: scaled by the distances, and what is left of it."""
    first = F.when(td == 0, v).otherwise(F.shiftright(temporal_scale(tb, F.when(td == 0, 1).otherwise(td)) * v + 128, 8))
    return [first, F.when(td == 0, 0).otherwise(first - v)]


def resting(v: Column) -> Column:
    """Whether a co-located vector is within one quarter sample of none in its first reference."""
    return (v["ref"] == 0) & F.abs(v["x"]).between(0, 1) & F.abs(v["y"]).between(0, 1)


def chroma_field_offset(bottom: Column, other_bottom: Column) -> Column:
    """Quarter samples that a chroma vector is shifted down where it leads to a field of the other parity."""
    return F.when(bottom == other_bottom, 0).when(bottom, 2).otherwise(-2)


def agrees(p: Column, q: Column) -> Column:
    """Whether two uses of a picture (struct of x, y and ref, a picture's number or -1) are alike: both none, or one picture and near vectors."""
    near = (F.abs(p["x"] - q["x"]) < 4) & (F.abs(p["y"] - q["y"]) < 4)
    return F.when((p["ref"] < 0) & (q["ref"] < 0), True).when((p["ref"] < 0) | (q["ref"] < 0), False).otherwise((p["ref"] == q["ref"]) & near)


def motion_differs(p0: Column, p1: Column, q0: Column, q1: Column) -> Column:
    """Whether the motion of two blocks with two lists differs: not alike in either order of the lists."""
    return ~((agrees(p0, q0) & agrees(p1, q1)) | (agrees(p0, q1) & agrees(p1, q0)))


def implicit_matrix(l0: Column, l1: Column, poc: Column) -> Column:
    """array<array<bigint>>: for each picture of l0 and each of l1, by order counts, the first one's weight; the second's is 64 less it."""
    distance = lambda a, b: clip(a - b, -128, 127)
    weight = lambda a, b: implicit_weights(distance(poc, a), F.when(a == b, 1).otherwise(distance(b, a)))[0]
    return F.transform(l0, lambda a: F.transform(l1, lambda b: F.when(a == b, 32).otherwise(weight(a, b)).cast("long")))


def direct_map(used: Column, l0: Column) -> Column:
    """The place in list l0, from 0, of the picture that a co-located block uses, by order count; 0 where the list lacks it, and for an empty list."""
    return F.greatest(F.coalesce(F.array_position(l0, used), F.lit(0)) - 1, F.lit(0))


def listed(entries: Column, index: Column) -> Column:
    """The entry of a list at an index, beyond its ends the first or the last one; null for an empty list."""
    return F.get(entries, F.greatest(F.least(index, F.size(entries) - 1), F.lit(0)).cast("int"))


def spatial_direct(first: tuple[Column, Column, Column], second: tuple[Column, Column, Column], rests: Column) -> tuple[Column, Column]:
    """Structs (x, y, ref) of both lists of a spatially direct block from its macroblock's neighbours a, b and c in each list.

    A list takes the neighbours' least reference and its predicted vector, and is not used (ref -1, no motion) without any; where
    neither list has one, both are the first reference without motion. rests: the co-located block does, and vectors to a first reference are none.
    """
    none = F.lit(-1).cast("long")
    least = [least_reference(*(F.coalesce(v["ref"], none) for v in side)) for side in (first, second)]
    neither = (least[0] < 0) & (least[1] < 0)

    def of(side: tuple[Column, Column, Column], ref: Column) -> Column:
        moved = predicted_vector(*side, ref)
        still = neither | (ref < 0) | ((ref == 0) & rests)
        return F.struct(*(F.when(still, 0).otherwise(moved[k]).cast("long").alias(k) for k in ("x", "y")), F.when(neither, 0).otherwise(ref).cast("long").alias("ref"))

    return of(first, least[0]), of(second, least[1])


def colocated_rests(use0: Column, use1: Column, intra: Column) -> Column:
    """Whether a co-located block rests: not intra, and by its first list, or its second where it has no first, within a quarter sample of none in the first reference."""
    use = F.when(use0["ref"] >= 0, use0).otherwise(use1)
    return F.coalesce(~intra & resting(use), F.lit(False))
