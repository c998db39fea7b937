"""Coded pictures: groups, display order, reference windows and lists, as windows over groups; a stream may be of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlake.functions.codec import picture_order_count


def coded_pictures(events: DataFrame) -> DataFrame:
    """Events of a user as the pictures of a stream: groups of 12, each third one a reference after the first."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    n = events.select(F.col("user_id").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"))
    p = F.col("seq") % 12
    shown = F.when(p == 0, 0).when((p - 1) % 3 == 0, p + 2).otherwise(p - 1)
    return n.select("stream_id", "seq", (p == 0).alias("idr"), ((p == 0) | ((p - 1) % 3 == 0)).alias("ref"), (2 * shown % 16).alias("lsb"))


def started(rows: DataFrame, part: list[str], by: str, value: Column, out: str) -> DataFrame:
    """rows with `out`, the sum of value over all rows of the same `part` whose `by` is smaller."""
    keyed = rows.withColumn("_place", F.struct(*part, by))  # equal where parts are null, too
    sums = keyed.groupBy("_place").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*(f"_place.{p}" for p in part)).orderBy(f"_place.{by}").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_place", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(out))
    return keyed.join(starts.hint("merge"), "_place").drop("_place")  # a row a group: never sent whole to the driver


def with_groups(pictures: DataFrame, run: int = 65_536) -> DataFrame:
    """group_no counts the instant-refresh pictures up to each picture: those of its run of pictures, and of the runs before."""
    cut = pictures.withColumn("_run", F.floor(F.col("seq") / run))
    w = Window.partitionBy("stream_id", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = started(cut, ["stream_id"], "_run", F.col("idr").cast("long"), "_start").withColumn("group_no", F.col("_start") + F.sum(F.col("idr").cast("long")).over(w))
    return counted.select(*pictures.columns, "group_no")


def with_order_counts(pictures: DataFrame) -> DataFrame:
    by = ["stream_id", "group_no"]
    before = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    step = with_groups(pictures).withColumn("step", picture_order_count("lsb", "ref", "idr", by, "seq", 16))
    msb = F.coalesce(F.sum(F.when(F.col("ref"), F.col("step")).otherwise(0)).over(before), F.lit(0)) + F.col("step")
    return step.withColumn("poc", F.when(F.col("idr"), 0).otherwise(msb + F.col("lsb")).cast("long")).drop("step")


def display_order(pictures: DataFrame) -> DataFrame:
    """shown is a picture's place in its stream: the pictures of the groups before, and its place in its group by order count."""
    w = Window.partitionBy("stream_id", "group_no").orderBy("poc", "seq")
    ordered = with_order_counts(pictures).withColumn("shown", F.row_number().over(w).cast("long"))
    return started(ordered, ["stream_id"], "group_no", F.lit(1), "_start").withColumn("shown", F.col("_start") + F.col("shown")).drop("_start")


def with_references(pictures: DataFrame, most: int = 4) -> DataFrame:
    """The order counts of the last `most` reference pictures before each picture of its group, newest last.

    References are numbered, and a picture looks back over the last `most` numbers, not over its whole group.
    """
    by = Window.partitionBy("stream_id", "group_no")
    before = by.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    held = with_order_counts(pictures).withColumn("_number", F.coalesce(F.sum(F.col("ref").cast("long")).over(before), F.lit(0)))
    last = by.orderBy("_number").rangeBetween(-most, -1)
    return held.withColumn("refs", F.collect_list(F.when(F.col("ref"), F.col("poc"))).over(last)).drop("_number")


def reference_lists(pictures: DataFrame, most: int = 4) -> DataFrame:
    """List p by falling order count; lists l0 and l1 by distance before and after the picture, swapped if equal."""
    r = with_references(pictures, most)
    up, down = F.array_sort("refs"), F.reverse(F.array_sort("refs"))
    past, future = F.filter(down, lambda x: x <= F.col("poc")), F.filter(up, lambda x: x > F.col("poc"))
    r = r.withColumn("l0", F.concat(past, future)).withColumn("l1", F.concat(future, past)).withColumn("p", down)
    return r.withColumn("l1", swapped_if_equal(F.col("l1"), F.col("l0")))


def swapped_if_equal(l1: Column, l0: Column) -> Column:
    """List l1 with its first two changed over where it has two and equals l0."""
    turned = F.concat(F.slice(l1, 2, 1), F.slice(l1, 1, 1), F.slice(l1, F.lit(3), F.size(l1)))
    return F.when((F.size(l1) > 1) & (l0 == l1), turned).otherwise(l1)


def with_numbers(pictures: DataFrame, period: int) -> DataFrame:
    """frame_num, the references before a picture of its group modulo period, and number, unwrapped from it again."""
    by = Window.partitionBy("stream_id", "group_no").orderBy("seq")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    coded = with_groups(pictures).withColumn("frame_num", F.coalesce(F.sum(F.col("ref").cast("long")).over(before), F.lit(0)) % period)
    wraps = coded.withColumn("wrap", F.coalesce(F.lag("frame_num").over(by) > F.col("frame_num"), F.lit(False)).cast("long"))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    return wraps.withColumn("number", F.sum("wrap").over(upto) * period + F.col("frame_num")).drop("wrap")


def order_count_cycle(number: Column, ref: Column, offsets: list[int], not_ref: int) -> Column:
    """Picture order counts of type 1: expected steps repeat in a cycle; pictures that are no reference are shifted."""
    n = F.when(~ref & (number > 0), number - 1).otherwise(number)
    sums = F.array(*(F.lit(sum(offsets[: i + 1])) for i in range(len(offsets))))
    expected = F.floor((n - 1) / len(offsets)) * sum(offsets) + F.element_at(sums, (F.greatest(n - 1, F.lit(0)) % len(offsets) + 1).cast("int"))
    return F.when(n > 0, expected).otherwise(0) + F.when(ref, 0).otherwise(not_ref)


def order_count_plain(number: Column, ref: Column) -> Column:
    """Picture order counts of type 2: coding order, with pictures that are no reference before the number's own place."""
    return 2 * number - F.when(ref, 0).otherwise(1)


def order_count(poc_type: Column, by_low_part: Column, number: Column, ref: Column, offsets: list[int], not_ref: int) -> Column:
    """Picture order counts by the stream's type: 0 from the coded low part, 1 by a cycle of offsets, 2 in coding order."""
    return F.when(poc_type == 0, by_low_part).when(poc_type == 1, order_count_cycle(number, ref, offsets, not_ref)).otherwise(order_count_plain(number, ref))


def with_held_frames(fields: DataFrame, most: int = 4) -> DataFrame:
    """Field pictures (stream_id, group_no, frame_no, seq, bottom, ref, number, frame_num, poc, second) with `held`: the frames that each may refer to.

    These are the last `most` frames of the group before the field's that have a reference field, with number, frame_num,
    poc (the smaller one of its reference fields) and whether top and bottom are references; a second field's own first one, if a reference,
    is the newest of them. A group's frames are numbered as references, and a frame looks back over `most` numbers.
    """
    by = ["stream_id", "group_no", "frame_no"]
    is_ref = lambda c: F.coalesce(F.bool_or(F.col("ref") & c), F.lit(False))
    frames = fields.groupBy(*by).agg(F.min("number").alias("number"), F.min("frame_num").alias("frame_num"), F.min(F.when(F.col("ref"), F.col("poc"))).alias("poc"), is_ref(~F.col("bottom")).alias("top"), is_ref(F.col("bottom")).alias("bottom"))
    kept = F.col("top") | F.col("bottom")
    group = Window.partitionBy("stream_id", "group_no")
    ranked = frames.withColumn("_at", F.coalesce(F.sum(kept.cast("long")).over(group.orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    frame = F.struct("number", "frame_num", "poc", "top", "bottom")
    ranked = ranked.withColumn("_held", F.collect_list(F.when(kept, frame)).over(group.orderBy("_at").rangeBetween(-most, -1)))
    looked = fields.alias("f").join(ranked.select(*by, "_held").alias("h"), F.struct(*(f"f.{b}" for b in by)) == F.struct(*(f"h.{b}" for b in by))).select("f.*", "_held")
    first = Window.partitionBy(*by).orderBy("seq")
    own = F.when(F.col("second"), F.lag(F.when(F.col("ref"), F.struct("number", "frame_num", "poc", (~F.col("bottom")).alias("top"), "bottom"))).over(first))
    looked = looked.withColumn("_own", own)
    held = F.when(F.col("_own").isNull(), F.col("_held")).otherwise(F.concat(F.slice("_held", F.greatest(F.size("_held") - most + 2, F.lit(1)), F.greatest(F.size("_held"), F.lit(1))), F.array("_own")))
    return looked.withColumn("held", held).drop("_held", "_own")
