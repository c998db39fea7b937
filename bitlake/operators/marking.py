"""Reference marking: which pictures a stream's pictures may refer to, by sliding window and marking operations, and changed lists.

Pictures are rows of (stream_id, group_no, seq, idr, ref, frame_num, poc, marking), marking an array of (operation, first
value, second value) as slice_headers gives it, and long_term for a refresh picture that stays as a long-term one. A
group is folded in order of seq; what is held is at most `most` pictures, whatever the group's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitlake.functions.either import let
from bitlake.operators import pictures

#: (number, order count, long-term index or -1), oldest first.
Held = list[tuple[int, int, int]]


def without_index(held: Held, index: int) -> Held:
    return [h for h in held if h[2] != index]


def operated(held: Held, op: int, first: int, second: int, frame_num: int, period: int) -> Held:
    """What is held after one of the operations 1 to 5; differences count back from frame_num modulo period."""
    number = (frame_num - first - 1) % period
    if op == 1:
        return [h for h in held if h[2] >= 0 or h[0] != number]
    if op == 2:
        return without_index(held, first)
    if op == 3:
        return [(n, p, second) if i < 0 and n == number else (n, p, i) for n, p, i in without_index(held, second)]
    if op == 4:
        return [h for h in held if h[2] < first]
    return [] if op == 5 else held


def slid(held: Held, most: int) -> Held:
    """What is held when one more picture comes: the oldest short-term ones go while `most` are held."""
    while len(held) >= max(1, most) and (short := next((h for h in held if h[2] < 0), None)):
        held = [h for h in held if h is not short]
    return held


def marked(held: Held, frame_num: int, poc: int, marking: list, most: int, period: int) -> Held:
    """What is held after a reference picture: by its operations if it has some, else by the window."""
    own = -1
    if any(op == 5 for op, _, _ in marking):  # the picture is then the first of a new numbering
        frame_num = poc = 0
    for op, first, second in marking:
        if op == 6:
            own, held = first, without_index(held, first)
        else:
            held = operated(held, op, first, second, frame_num, period)
    held = held if marking else slid(held, most)
    return [*held, (frame_num, poc, own)]


def with_marked_references(pictures: DataFrame, most: int | None = 4, period: int | None = 16) -> DataFrame:
    """(stream_id, seq, group_no, frame_num, poc, short, long): before each picture the short-term references, oldest first, and the long-term ones by index.

    short and long are arrays of (frame_num, poc) and (frame_num, poc, index). Pictures that are no references change
    nothing; a refresh picture empties its group's references first. most and period may be null, and columns max_refs and
    period of each picture then hold. A picture with operation 5 is kept as number 0 of order count 0; its group goes on.
    """
    pair = "array<struct<frame_num long, poc long>>"
    schema = f"stream_id long, seq long, group_no long, frame_num long, poc long, short {pair}, long array<struct<frame_num long, poc long, index long>>"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held = None, []
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if group != (r.stream_id, r.group_no) or r.idr:
                    group, held = (r.stream_id, r.group_no), []
                short = [{"frame_num": n, "poc": p} for n, p, i in held if i < 0]
                long = [{"frame_num": n, "poc": p, "index": i} for n, p, i in sorted(held, key=lambda h: h[2]) if i >= 0]
                rows.append((r.stream_id, r.seq, r.group_no, r.frame_num, r.poc, short, long))
                if r.ref:
                    operations = [tuple(m) for m in r.marking] if r.marking is not None else []
                    held = [(r.frame_num, r.poc, 0 if r.long_term else -1)] if r.idr else marked(held, r.frame_num, r.poc, operations, r.most, r.period)
            yield pd.DataFrame(rows, columns=["stream_id", "seq", "group_no", "frame_num", "poc", "short", "long"])

    limits = [(F.col("max_refs") if most is None else F.lit(most)).cast("long").alias("most"), (F.col("period") if period is None else F.lit(period)).cast("long").alias("period")]
    own = pictures.select("stream_id", "group_no", "seq", "idr", "ref", "frame_num", "poc", "marking", "long_term", *limits)
    return own.repartition("stream_id", "group_no").sortWithinPartitions("stream_id", "group_no", "seq").mapInPandas(fold, schema)


def lists(short: Column, long: Column, poc: Column, kind: str) -> Column:
    """array<bigint>: frame numbers of list p, l0 or l1: short-term ones by order count, then long-term ones by index.

    A list l1 of two or more that equals l0 has its first two changed over.
    """
    number = lambda v: F.transform(v, lambda x: x["frame_num"])
    ordered = F.array_sort(F.transform(short, lambda x: F.struct(x["poc"].alias("poc"), x["frame_num"].alias("frame_num"))))
    past, future = F.reverse(F.filter(ordered, lambda x: x["poc"] <= poc)), F.filter(ordered, lambda x: x["poc"] > poc)
    l0 = F.concat(number(past), number(future), number(long))
    if kind == "l1":
        return pictures.swapped_if_equal(F.concat(number(future), number(past), number(long)), l0)
    return l0 if kind == "l0" else F.concat(number(F.reverse(ordered)), number(long))


def changed(numbers: Column, operations: Column, frame_num: Column, period: int) -> Column:
    """A list of frame numbers after its changes: each operation (0 back, 1 forward, from the last one's number) puts its picture at the next place.

    The list keeps its length; an operation whose picture is not in the list, or of another kind, only takes its place.
    """
    state = F.struct(numbers.alias("list"), frame_num.cast("long").alias("last"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, op: Column) -> Column:
        kind, value = F.get(op, F.lit(0)), F.get(op, F.lit(1)) + 1
        number = F.when(kind <= 1, F.pmod(s["last"] + F.when(kind == 0, -value).otherwise(value), F.lit(period))).otherwise(s["last"])
        at = s["at"].cast("int")
        behind = F.filter(F.slice(s["list"], at + 1, F.size(s["list"])), lambda n: n != number)
        moved = F.slice(F.concat(F.slice(s["list"], F.lit(1), at), F.array(number), behind), F.lit(1), F.size(s["list"]))
        good = (kind <= 1) & F.array_contains(s["list"], number) & (at < F.size(s["list"]))
        return F.struct(F.when(good, moved).otherwise(s["list"]).alias("list"), number.alias("last"), (s["at"] + 1).alias("at"))

    return F.aggregate(operations, state, step, lambda s: s["list"])


def modified(entries: Column, operations: Column, current: Column, period: Column) -> Column:
    """A list of structs (number, long) after its changes, of its own length.

    Operations 0 and 1 count back and forward, modulo period, from the number of the one before, first from current, and
    name a short-term entry; 2 names a long-term one by its own number. Each puts its entry at the next place and takes it out
    behind; one whose entry is not in the list only takes a place. Numbers of field lists are those of field_number.
    """
    n = F.size(entries)
    state = F.struct(entries.alias("list"), current.cast("long").alias("last"), F.lit(0).alias("at"))

    def step(s: Column, op: Column) -> Column:
        kind, value, at = F.get(op, F.lit(0)), F.get(op, F.lit(1)), s["at"]
        short = F.pmod(s["last"] + F.when(kind == 0, -(value + 1)).otherwise(value + 1), period)
        number = F.when(kind == 2, value).otherwise(short)
        named = lambda e: (e["number"] == number) & (e["long"] == (kind == 2))
        first = F.filter(s["list"], named)
        behind = F.filter(F.slice(s["list"], at + 1, n), lambda e: ~named(e))
        moved = F.slice(F.concat(F.slice(s["list"], F.lit(1), at), F.slice(first, 1, 1), behind), F.lit(1), n)
        good = (kind <= 2) & (F.size(first) > 0) & (at < n)
        return F.struct(F.when(good, moved).otherwise(s["list"]).alias("list"), F.when(kind < 2, short).otherwise(s["last"]).alias("last"), (at + 1).alias("at"))

    return F.aggregate(operations, state, step, lambda s: s["list"])


def active(entries: Column, n: Column) -> Column:
    """A list of n entries: its last one is repeated where it is shorter; an empty list stays empty."""
    filled = F.concat(entries, F.array_repeat(F.element_at(entries, -1), F.greatest(n - F.size(entries), F.lit(0)).cast("int")))
    return F.when(F.size(entries) == 0, entries).otherwise(F.slice(filled, F.lit(1), n.cast("int")))


def field_number(frame_num: Column, bottom: Column, own: Column) -> Column:
    """A field's number in the lists of a field of parity own: odd for the same parity."""
    return 2 * frame_num + F.when(bottom == own, 1).otherwise(0)


def alternating(frames: Column, bottom: Column) -> Column:
    """The fields of an ordered list of frames, structs of frame_num, top and bottom (whether the field is there): array of (frame_num, bottom).

    Fields of the own and of the other parity take turns, each list in the frames' order and without the fields that are
    missing; where one is at its end, the rest of the other follows.
    """
    of = lambda all_, low: F.transform(F.filter(all_, lambda f: F.when(low, f["bottom"]).otherwise(f["top"])), lambda f: F.struct(f["frame_num"].alias("frame_num"), low.alias("bottom")))

    def taken(t: Column) -> Column:
        same, other = t["same"], t["other"]
        n = F.least(F.size(same), F.size(other))
        turns = F.flatten(F.zip_with(F.slice(same, F.lit(1), n), F.slice(other, F.lit(1), n), lambda a, b: F.array(a, b)))
        return F.concat(turns, F.slice(same, n + 1, F.size(same)), F.slice(other, n + 1, F.size(other)))

    return let(frames, lambda held: let(F.struct(of(held, bottom).alias("same"), of(held, ~bottom).alias("other")), taken))


def field_lists(frames: Column, poc: Column, bottom: Column) -> Column:
    """Lists p, l0 and l1, a struct, of a field from the frames it may refer to, structs of number, frame_num, poc, top and bottom.

    p goes by falling number (without wraps), l0 and l1 by distance of order count before and after; each then alternates
    parities, and an l1 of two or more that equals l0 has its first two changed over. Each step is computed once for a row.
    """
    by = lambda key: F.sort_array(F.transform(frames, lambda f: F.struct(f[key].alias("key"), f["frame_num"].alias("frame_num"), f["top"].alias("top"), f["bottom"].alias("bottom"))))
    sides = let(by("poc"), lambda s: F.struct(F.reverse(F.filter(s, lambda f: f["key"] <= poc)).alias("past"), F.filter(s, lambda f: f["key"] > poc).alias("future")))
    lists = lambda s: F.struct(alternating(F.concat(s["past"], s["future"]), bottom).alias("l0"), alternating(F.concat(s["future"], s["past"]), bottom).alias("l1"))
    p = alternating(F.reverse(by("number")), bottom)
    return let(let(sides, lists), lambda t: F.struct(p.alias("p"), t["l0"].alias("l0"), pictures.swapped_if_equal(t["l1"], t["l0"]).alias("l1")))


def same_parity_first(fields: Column, bottom: Column) -> Column:
    """Fields of a list, structs of frame_num and bottom: where just two neighbours share a number, that of the picture's own parity comes first."""
    numbers = F.transform(fields, lambda x: x["frame_num"])
    same = lambda i, k: F.coalesce(F.get(numbers, i) == F.get(numbers, i + k), F.lit(False))
    pair = lambda i: same(i, 1) & ~same(i, 2) & ((i == 0) | ~same(i, -1))
    turned = lambda i: pair(i) & (F.get(fields, i)["bottom"] != bottom) & (F.get(fields, i + 1)["bottom"] == bottom)
    put = lambda x, i: F.when(turned(i), F.get(fields, i + 1)).when((i > 0) & turned(F.greatest(i - 1, F.lit(0))), F.get(fields, i - 1)).otherwise(x)
    return F.transform(fields, put)
