"""Prefix values over ordered rows of any number: rows are cut into runs, and what a run ends with is carried to the next ones.

No task holds a whole part: windows are over a run, and a second window is over the runs, one row each. Rows are written
first, since both read them. Where short() has found that no part is longer than a run, `whole` makes it one window over each part, and nothing is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlake.operators.shared import written

#: Places of the order, which need not be dense, in a run.
RUN = 65_536


def short(rows: DataFrame, part: list[str], most: int = RUN) -> bool:
    """Whether no part has more than `most` rows: a count that runs now. It holds for parts of these, and for rows made of these one by one, too."""
    return rows.groupBy(*part).count().where(F.col("count") > most).isEmpty()


def before(rows: DataFrame, part: list[str], order: str, values: dict[str, tuple[str, Column]], run: int = RUN, whole: bool = False) -> DataFrame:
    """rows with a column for each of values, over the rows of the same part that come earlier by order.

    ("sum", value) is the sum of value, 0 where none comes earlier; ("last", value) is the last one that is not null. A null
    part is a part of its own; order is a whole number, not null, and rows that share one are in no order. whole: parts are short.
    """
    names = rows.columns
    if whole:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        found = {k: F.coalesce(F.sum(v).over(w), F.lit(0)) if kind == "sum" else F.last(v, ignorenulls=True).over(w) for k, (kind, v) in values.items()}
        return rows.select(*(n for n in names if n not in values), *(v.alias(k) for k, v in found.items()))
    keyed = written(rows.withColumn("_run", F.struct(*part, F.floor(F.col(order) / run).alias("_no"))), "runs")
    inside = Window.partitionBy("_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    some = {k: F.sum(v) if kind == "sum" else F.max_by(v, F.when(v.isNotNull(), F.col(order))) for k, (kind, v) in values.items()}
    ends = keyed.groupBy("_run").agg(*(v.alias(f"_end_{k}") for k, v in some.items()))
    over = Window.partitionBy(F.struct(*(F.col(f"_run.{p}") for p in part))).orderBy("_run._no").rowsBetween(Window.unboundedPreceding, -1)
    carried = {k: F.sum(f"_end_{k}") if kind == "sum" else F.last(f"_end_{k}", ignorenulls=True) for k, (kind, _) in values.items()}
    starts = ends.select("_run", *(v.over(over).alias(f"_start_{k}") for k, v in carried.items()))
    own = {k: (F.sum(v) if kind == "sum" else F.last(v, ignorenulls=True)).over(inside) for k, (kind, v) in values.items()}
    made = keyed.withColumns({f"_own_{k}": v for k, v in own.items()}).join(starts.hint("merge"), "_run")  # a row a part: never sent whole to the driver
    zero = F.lit(0)
    found = {k: F.coalesce(f"_start_{k}", zero) + F.coalesce(f"_own_{k}", zero) if kind == "sum" else F.coalesce(f"_own_{k}", f"_start_{k}") for k, (kind, _) in values.items()}
    return made.select(*(n for n in names if n not in values), *(v.alias(k) for k, v in found.items()))


def held(rows: DataFrame, sets: DataFrame, part: list[str], order: str, value: str, run: int = RUN, whole: bool = False) -> DataFrame:
    """rows with `value`, that of the last row of sets of the same part that comes earlier by order: an as-of join, null where none does.

    Both have the columns of part and order; a null value of sets changes nothing. The rows of both are one ordered union,
    so that neither side is collected, however often a set changes.
    """
    kept = [n for n in rows.columns if n != value]
    row = F.struct(*kept)
    kind = sets.schema[value].dataType
    both = rows.select(*part, order, row.alias("_row"), F.lit(None).cast(kind).alias("_set"))
    both = both.unionByName(sets.select(*part, order, F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.col(value).alias("_set")))
    return before(both, part, order, {value: ("last", F.col("_set"))}, run, whole).where("_row is not null").select("_row.*", value)
