"""From bytes to pictures: ranges of files, as-of binding, runs, epochs, frames, lists, marking and the streaming order."""

import random

import pytest
from pyspark.sql import functions as F

from bitlake.functions import scans
from bitlake.operators import assembly, grid, marking, parameters, pictures, prediction, runs
from bitlake.sources import framing, ranges
from bitlake.streaming import reorder
from tests.test_pictures import run


class Bytes:
    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        self.read = max(self.read, at + n)
        return self.data[at : at + n]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_units_of_ranges_are_those_of_the_whole(size):
    rng = random.Random(size)
    for _ in range(20):
        data = bytes(rng.choices([0, 0, 0, 1, 1, 2, 3, 255], k=rng.randrange(0, 400)))
        file, found = Bytes(data), []
        for at in range(0, len(data), size):
            found += ranges.units_in(file, len(data), at, min(at + size, len(data)), chunk=rng.choice([3, 5, 17, 1000]))
        assert [u for _, u in found] == list(framing.by_start_codes(data))
        assert [o for o, _ in found] == sorted(o for o, _ in found) and all(data[o : o + 3] == b"\0\0\1" for o, _ in found)


def test_zeros_are_only_counted_and_long_units_are_faults():
    class Sparse:  # 3 GB of zeros between two units, of which none is held
        def read_at(self, n, at):
            out = bytearray(n)
            for place, part in ((0, b"\0\0\1\x67ab"), (3 << 30, b"\0\0\1\x68c")):
                for i, b in enumerate(part):
                    if at <= place + i < at + n:
                        out[place + i - at] = b
            return bytes(out)

    size = (3 << 30) + 5
    assert list(ranges.units_in(Sparse(), size, 0, size, chunk=64 << 20)) == [(0, b"\x67ab"), (3 << 30, b"\x68c")]
    assert list(ranges.units_in(Bytes(b"\0\0\1\x67" + b"a" * 50 + b"\0\0\1\x68"), 57 + 1, 0, 58, longest=20)) == [(0, None), (54, b"\x68")]


def test_range_source(spark, tmp_path):
    place = f"file://{tmp_path}/streams"
    rows = [("a", 1, b"\0\0\1\x65abc"), ("a", 0, b"xx\0\0\1\x67\0\0\3\1"), ("a", 2, b"\0\0\1\xe5\0\0\1\0\0\0\1\x09"), ("b", 0, None), (None, 0, b"\0\0\1\x67")]
    done = ranges.written(spark.createDataFrame(rows, "name string, unit_no long, data binary"), place).collect()
    assert sorted(done) == [("a", 29), ("b", 0)]
    for n in (1, 5, 1000):
        got = ranges.units(spark, place, n).orderBy("offset").collect()
        assert [(r.offset, r.unit_type, bytes(r.payload), r.error) for r in got] == [(2, 7, b"\0\0\1", None), (10, 5, b"abc", None), (17, None, b"\xe5", "forbidden bit"), (21, None, b"", "empty unit"), (25, 9, b"", None)]
        assert [r.unit_type for r in ranges.units(spark, place, n, [5, 7]).orderBy("offset").collect()] == [7, 5]
        assert [(r.unit_no, r.unit_type) for r in ranges.numbered(ranges.units(spark, place, n)).orderBy("unit_no").collect()] == [(0, 7), (1, 5), (2, 9)]


def test_escaping_is_undone(spark):
    rng = random.Random(1)
    data = [bytes(rng.choices([0, 0, 0, 1, 2, 3, 4], k=60)) + b"\1" for _ in range(50)]
    rows = spark.createDataFrame([(d,) for d in data], "p binary").select("p", ranges.escaped(F.col("p")).alias("e")).collect()
    for r in rows:
        assert framing.unescape(bytes(r.e)) == bytes(r.p) and not any(x in bytes(r.e) for x in (b"\0\0\0", b"\0\0\1", b"\0\0\2"))


def test_prefix_values_over_runs(spark):
    rng = random.Random(5)
    rows = [(s, n, rng.choice([None, 1, 2, 3])) for s in (None, 1, 2) for n in rng.sample(range(100), 40)]
    got = runs.before(spark.createDataFrame(rows, "s long, n long, v long"), ["s"], "n", {"total": ("sum", F.col("v")), "latest": ("last", F.col("v"))}, run=7).collect()
    assert len(got) == len(rows)
    for r in got:
        earlier = [v for s, n, v in sorted(rows, key=lambda x: x[1]) if s == r.s and n < r.n and v is not None]
        assert (r.total, r.latest) == (sum(earlier), earlier[-1] if earlier else None)
    sets = spark.createDataFrame([(1, 10, "a"), (1, 30, "b"), (None, 5, "c"), (1, 31, None)], "s long, n long, w string")
    held = {(r.s, r.n): r.w for r in runs.held(spark.createDataFrame([(1, 9, 0), (1, 11, 0), (1, 99, 0), (None, 6, 0), (2, 50, 0)], "s long, n long, v int"), sets, ["s"], "n", "w", run=8).collect()}
    assert held == {(1, 9): None, (1, 11): "a", (1, 99): "b", (None, 6): "c", (2, 50): None}


def test_sets_that_change_often(spark):
    n = 20_000
    sets = spark.range(n).select(F.lit(1).cast("long").alias("stream_id"), (2 * F.col("id")).alias("unit_no"), F.col("id").alias("set"))
    rows = spark.range(n).select(F.lit(1).cast("long").alias("stream_id"), (2 * F.col("id") + 1).alias("unit_no"))
    bound = runs.held(rows, sets, ["stream_id"], "unit_no", "set", run=1000)
    assert bound.where("set = (unit_no - 1) / 2").count() == n


PIC = "stream_id long, seq long, unit_no long, slices long, idr boolean, ref boolean, field boolean, bottom boolean, frame_num long, poc_lsb long, delta_bottom long, delta_0 long, delta_1 long, marking array<array<long>>, poc_type long, lsb_period long, period long, offsets array<long>, offset_not_ref long, offset_bottom long"


def pic(seq, idr=False, ref=True, field=False, bottom=False, num=0, lsb=0, down=0, d0=0, d1=0, marks=(), kind=0, offsets=(), not_ref=0, below=0, stream=1):
    return (stream, seq, seq, 1, idr, ref, field, bottom, num, lsb, down, d0, d1, [list(m) for m in marks], kind, 16, 16, list(offsets), not_ref, below)


def counted(spark, rows):
    got = assembly.with_order_counts(spark.createDataFrame(rows, PIC)).orderBy("stream_id", "seq").collect()
    return [r.poc for r in got], [r.shown_poc for r in got], [r.epoch for r in got], [r.group_no for r in got], [r.number for r in got]


def test_order_counts(spark):
    rows = [pic(0, idr=True, lsb=9), pic(1, num=1, lsb=6), pic(2, num=2, lsb=14), pic(3, num=3, lsb=4, down=-3), pic(4, ref=False, num=4, lsb=2), pic(5, num=4, lsb=8, down=-5, marks=[(5, 0, 0)]), pic(6, num=1, lsb=7), pic(7, num=2, lsb=14), pic(8, idr=True)]
    poc, shown, epoch, group, _ = counted(spark, rows)
    # a refresh picture counts as 0, low parts wrap, a frame takes the smaller field; after the reset the low part begins at 5
    assert poc == [0, 6, 14, 17, 18, 19, 7, 14, 0] and shown == [0, 6, 14, 17, 18, 0, 7, 14, 0]
    assert epoch == [1, 1, 1, 1, 1, 1, 2, 2, 3] and group == [1, 1, 1, 1, 1, 2, 2, 2, 3]
    cycle = [pic(0, idr=True, kind=1, offsets=(2, 4)), pic(1, num=1, kind=1, offsets=(2, 4), d0=1), pic(2, num=15, ref=False, kind=1, offsets=(2, 4), not_ref=-2, below=-1), pic(3, num=1, kind=1, offsets=(2, 4), field=True, bottom=True, below=3)]
    assert counted(spark, cycle)[0] == [0, 3, 7 * 6 - 2 - 1, 8 * 6 + 2 + 3] and counted(spark, cycle)[4] == [0, 1, 15, 17]
    plain = [pic(0, idr=True, kind=2), pic(1, ref=False, num=1, kind=2), pic(2, num=1, kind=2), pic(3, num=0, kind=2)]
    assert counted(spark, plain)[0] == [0, 1, 2, 32]


def test_plain_rules(spark):
    """With compat numbers wrap, a reset keeps its count and its group, and the low part after it begins at 0."""
    rows = [pic(0, idr=True), pic(1, num=1, lsb=6), pic(2, num=2, lsb=12, down=-5, marks=[(5, 0, 0)]), pic(3, num=1, lsb=2)]
    rows += [pic(0, idr=True, kind=2, stream=2), pic(1, num=15, kind=2, stream=2), pic(2, num=3, kind=2, stream=2)]
    got = assembly.with_order_counts(spark.createDataFrame(rows, PIC), compat=True).orderBy("stream_id", "seq").collect()
    assert [(r.poc, r.shown_poc, r.group_no) for r in got] == [(0, 0, 1), (6, 6, 1), (7, 7, 1), (2, 2, 1), (0, 0, 1), (30, 30, 1), (6, 6, 1)]


def test_frames_and_display(spark):
    f = dict(field=True)
    rows = [pic(0, idr=True, **f), pic(1, num=0, lsb=1, bottom=True, **f), pic(2, num=1, lsb=8, **f), pic(3, num=1, lsb=9, bottom=True, **f), pic(4, num=2, lsb=4, ref=False, bottom=True, **f), pic(5, num=2, lsb=6), pic(6, num=3, lsb=10, **f), pic(7, num=4, lsb=12, **f)]
    made = assembly.with_order_counts(spark.createDataFrame([*rows, *(x[:0] + (None, *x[1:]) for x in rows[:2])], PIC))
    got = assembly.with_frames(made).where("stream_id = 1").orderBy("seq").collect()
    assert [(r.frame_no, r.second) for r in got] == [(0, False), (0, True), (1, False), (1, True), (2, False), (3, False), (4, False), (5, False)]
    shown = assembly.display_order(made).orderBy("shown").collect()
    assert [(r.seq, r.pictures, r.poc) for r in shown if r.stream_id == 1] == [(0, 2, 0), (4, 1, 4), (5, 1, 6), (2, 2, 8), (6, 1, 10), (7, 1, 12)]
    assert [(r.seq, r.shown) for r in shown if r.stream_id is None] == [(0, 1)]


def test_null_streams_are_kept(spark):
    rows = spark.createDataFrame([(None, 0, True, True, 0), (None, 1, False, True, 2), (1, 0, True, True, 0)], "stream_id long, seq long, idr boolean, ref boolean, lsb int")
    assert pictures.display_order(rows).count() == 3 and pictures.reference_lists(rows).count() == 3


def test_lists(spark):
    pair = "array<struct<frame_num:bigint,poc:bigint>>"
    one = lambda rows: F.array(*(F.struct(F.lit(n).cast("long").alias("frame_num"), F.lit(p).cast("long").alias("poc")) for n, p in rows)).cast(pair)
    none = F.array().cast("array<struct<frame_num:bigint,poc:bigint,index:bigint>>")
    of = lambda c: spark.range(1).select(c.alias("x")).first().x
    past = one([(0, 0), (1, 4), (2, 8)])
    assert of(marking.lists(past, none, F.lit(20), "l0")) == [2, 1, 0] and of(marking.lists(past, none, F.lit(20), "l1")) == [1, 2, 0]
    field = lambda n, b: F.struct(F.lit(n).alias("frame_num"), F.lit(b).alias("bottom"))
    put = lambda fields, own: [(x.frame_num, x.bottom) for x in of(marking.same_parity_first(F.array(*(field(*f) for f in fields)), F.lit(own)))]
    assert put([(1, True), (2, False), (1, False), (1, True)], True) == [(1, True), (2, False), (1, True), (1, False)]
    assert put([(1, False), (1, True), (1, False)], True) == [(1, False), (1, True), (1, False)]  # three are no pair
    frames = F.array(*(F.struct(F.lit(n).alias("frame_num"), F.lit(t).alias("top"), F.lit(b).alias("bottom")) for n, t, b in ((5, True, True), (4, False, True), (3, True, True), (5, False, True))))
    assert [(x.frame_num, x.bottom) for x in of(marking.alternating(frames, F.lit(True)))] == [(5, True), (5, False), (4, True), (3, False), (3, True), (5, True)]
    entry = lambda n, long: F.struct(F.lit(n).cast("long").alias("number"), F.lit(long).alias("long"))
    ops = lambda *x: F.array(*(F.array(*(F.lit(v).cast("long") for v in o)) for o in x))
    change = lambda *o: [(x.number, x.long) for x in of(marking.modified(F.array(entry(4, False), entry(3, False), entry(1, True), entry(0, True)), ops(*o), F.lit(5), F.lit(16)))]
    assert change((2, 0), (0, 1)) == [(0, True), (3, False), (4, False), (1, True)] and change((2, 7), (1, 14)) == [(4, False), (4, False), (3, False), (1, True)]
    assert of(marking.active(F.array(*map(F.lit, (1, 2))), F.lit(4))) == [1, 2, 2, 2] and of(marking.active(F.array(*map(F.lit, (1, 2, 3))), F.lit(2))) == [1, 2] and of(marking.active(F.array().cast("array<int>"), F.lit(2))) == []


def test_reset_begins_a_numbering(spark):
    assert marking.marked([(3, 6, -1), (2, 4, 1)], 4, 8, [(5, 0, 0)], 4, 16) == [(0, 0, -1)]


def test_long_headers_have_an_error_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(parameters, "HEADER_BYTES", 2)
    sps, pps = bytes([66, 0, 10, 0b11111001, 0b01001010, 0b00111100, 0b10000000]), bytes([0b11001110, 0b00111000, 0b10000000])
    rows = [(1, 0, 3, 7, sps), (1, 1, 3, 8, pps), (1, 2, 1, 1, b"\xff" * 400), (1, 3, 1, 1, None), (2, 0, 1, 1, b"\xe0")]
    got = {(r.stream_id, r.unit_no): r.error for r in parameters.slice_headers(spark.createDataFrame(rows, "stream_id long, unit_no long, ref_idc int, unit_type int, payload binary")).collect()}
    assert len(got) == 3 and got[2, 0] == "no parameter sets" and got[1, 3] is not None


def test_scans_are_permutations():
    for n in (4, 8):
        for field in (False, True):
            assert sorted(scans.scan(n, field)) == list(range(n * n)) and [scans.inverse_of(scans.scan(n, field))[p] for p in scans.scan(n, field)] == list(range(n * n))
    assert scans.diagonal_scan(4) == [0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15]


def test_sparse_blocks(spark):
    pairs = F.array(*(F.struct(F.lit(r).cast("long").alias("run"), F.lit(v).cast("long").alias("level")) for r, v in ((0, 5), (2, -3), (20, 9))))
    of = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert of(scans.in_scan_order(pairs, 4)) == [5, 0, 0, -3] + [0] * 12 and of(scans.in_scan_order(F.lit(None).cast("array<struct<run:bigint,level:bigint>>"), 4)) == [0] * 16
    assert of(scans.in_row_order(scans.in_scan_order(pairs, 4, 1), 4, F.lit(False))) == [0, 5, 0, 0, 0, -3] + [0] * 10


def test_neighbours_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(grid, "SIDE", 8)
    side = 20
    rows = spark.range(side * side).select(F.lit(None).cast("long").alias("p"), (F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y"), F.col("id").alias("v"))
    got = grid.with_neighbours(rows, ["p"], {"a": (-1, 0), "c": (F.col("v") % 5, -1)}, ["v"]).collect()
    assert len(got) == side * side
    for r in got:
        at = lambda x, y: y * side + x if 0 <= x < side and 0 <= y < side else None
        assert (r.a.v if r.a else None) == at(r.x - 1, r.y) and (r.c.v if r.c else None) == at(r.x + r.v % 5, r.y - 1)
    x, y = grid.place(F.lit(5), F.col("id"), F.lit(3))
    assert [(r.x, r.y) for r in spark.range(16).select(x.alias("x"), y.alias("y")).collect()][:6] == [(8, 4), (9, 4), (8, 5), (9, 5), (10, 4), (11, 4)]


def test_prediction_far_outside(spark):
    lines = spark.createDataFrame([(1, y, bytes([y] * 40)) for y in range(50)] + [(None, 0, b"\x07")], "plane long, y long, line binary")
    blocks = spark.createDataFrame([(1, 0, 0, -9999, 4), (1, 36, 48, 99999, 99999), (1, 4, 4, 0, 0), (None, 0, 0, 5, 7), (2, 0, 0, 0, 0)], "plane long, x long, y long, mvx long, mvy long")
    got = {}
    for r in prediction.predicted(blocks, prediction.tiles(lines)).collect():
        got.setdefault((r.plane, r.x), list(bytes(r.block)))
    rows = lambda *ys: [y for y in ys for _ in range(4)]
    assert got == {(1, 0): rows(1, 2, 3, 4), (1, 36): rows(49, 49, 49, 49), (1, 4): rows(4, 5, 6, 7), (None, 0): [7] * 16}
    chroma = prediction.predicted(blocks.where("plane = 1"), prediction.tiles(lines), chroma=True).orderBy("x").collect()
    assert [list(bytes(r.block)) for r in chroma] == [[1, 1, 2, 2], [4, 4, 5, 5], [49] * 4]


def test_stream_order_does_not_depend_on_batches(spark, tmp_path):
    """Any cut into batches gives one order; rows without a place or an order count are errors; what is missing holds up its stream."""
    counts = [0, 6, 2, 4, 12, 8, 10]
    pics = [(1, n, n % 7 == 0, counts[n % 7], False, f"m{n}") for n in range(21)] + [(1, 21, False, 0, True, None)]
    rng, orders = random.Random(2), []
    for k, cuts in enumerate(([22], [3, 4, 15])):
        rows, batches = pics[:], []
        for n in cuts:
            part, rows = rows[:n], rows[n:]
            rng.shuffle(part)
            batches.append(part)
        batches[0] += [(1, None, False, 1, False, "x"), (1, 500, False, None, False, "y")]
        got = run(spark, f"file://{tmp_path}/{k}", batches, 2)
        orders.append([(r.shown, r.seq) for r in sorted((r for r in got if r.shown), key=lambda r: r.shown)])
        assert sorted(r.error for r in got if r.error) == ["no poc", "no seq"] and len(got) == 23
    assert orders[0] == orders[1] and len(orders[0]) == 21
    gap = run(spark, f"file://{tmp_path}/gap", [[p for p in pics if p[1] not in (4,)]], 16)
    assert sorted(r.seq for r in gap) == [0, 1, 2, 3][: len(gap)]


def test_stream_state_is_bounded(monkeypatch):
    monkeypatch.setattr(reorder, "WINDOW", 5)
    order = reorder.Order(2, 0)
    order.group, order.shown, order.next, order.heap, order.out = 0, 0, 0, [], []
    order.early = [(n, False, n, False, None) for n in range(3, 10)]  # 0 to 2 are missing, and given up when over five are held
    order.drain(False)
    assert len(order.early) == 0 and order.next == 10 and len(order.heap) == 2
