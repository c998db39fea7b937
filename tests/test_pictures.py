"""Marking against literal cases, changed lists, and the streaming display order over several micro-batches."""

from collections import Counter

from pyspark.sql import functions as F

from bitlake.operators import marking, pictures
from bitlake.streaming import reorder


def test_marking_operations():
    held = [(0, 0, -1), (1, 4, -1), (2, 8, 0)]
    op = lambda *x: marking.operated(held, *x, 3, 16)
    assert op(1, 1, 0) == [(0, 0, -1), (2, 8, 0)] and op(1, 0, 0) == held  # number 2 is a long-term one
    assert op(2, 0, 0) == held[:2] and op(2, 1, 0) == held
    assert op(3, 2, 0) == [(0, 0, 0), (1, 4, -1)] and op(3, 1, 2) == [(0, 0, -1), (1, 4, 2), (2, 8, 0)]
    assert op(4, 0, 0) == held[:2] and op(4, 1, 0) == held and op(5, 0, 0) == []
    assert marking.marked(held, 3, 12, [(6, 0, 0)], 4, 16) == [(0, 0, -1), (1, 4, -1), (3, 12, 0)]
    assert marking.marked(held, 3, 12, [], 3, 16) == [(1, 4, -1), (2, 8, 0), (3, 12, -1)]
    assert marking.slid([(2, 8, 0)], 1) == [(2, 8, 0)]  # long-term pictures stay


def test_marked_pictures_and_lists(spark):
    none = []
    rows = [(1, 1, 0, True, True, 0, 0, none, False), (1, 1, 1, False, True, 1, 4, none, False), (1, 1, 2, False, False, 2, 2, none, False), (1, 1, 3, False, True, 2, 8, [[3, 0, 0]], False), (1, 1, 4, False, True, 3, 12, None, False), (1, 2, 5, True, True, 0, 0, none, True), (1, 2, 6, False, False, 1, 2, none, False)]
    df = spark.createDataFrame(rows, "stream_id long, group_no long, seq long, idr boolean, ref boolean, frame_num long, poc long, marking array<array<long>>, long_term boolean").withColumn("short", F.lit("clash"))
    out = marking.with_marked_references(df, most=2)
    got = {r.seq: ([x.frame_num for x in r.short], [(x.frame_num, x["index"]) for x in r.long]) for r in out.collect()}
    assert got == {0: ([], []), 1: ([0], []), 2: ([0, 1], []), 3: ([0, 1], []), 4: ([0, 2], [(1, 0)]), 5: ([], []), 6: ([], [(0, 0)])}
    lists = out.where("seq = 4").select(*(marking.lists(F.col("short"), F.col("long"), F.lit(4), k).alias(k) for k in ("p", "l0", "l1"))).first()
    assert (lists.p, lists.l0, lists.l1) == ([2, 0, 1], [0, 2, 1], [2, 0, 1])
    change = lambda numbers, ops: spark.range(1).select(marking.changed(F.array(*(F.lit(n).cast("long") for n in numbers)), F.array(*(F.array(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in ops)), F.lit(5), 16).alias("x")).first().x
    assert change([4, 3, 2], [(0, 2)]) == [2, 4, 3] and change([4, 3, 2], [(0, 2), (1, 0)]) == [2, 3, 4]
    assert change([4, 3, 2], [(0, 9)]) == [4, 3, 2] and change([4, 3, 2], [(0, 0), (0, 0), (0, 0), (0, 0)]) == [4, 3, 2]


def run(spark, folder, batches, depth):
    schema = "stream_id long, seq long, idr boolean, poc long, last boolean, meta string"
    query = None
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        found = reorder.in_display_order(spark.readStream.schema(schema).parquet(f"{folder}/in"), depth)
        query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


def test_streaming_order(spark, tmp_path):
    """State lasts over micro-batches; a small buffer lets the lowest go early; a late row is marked; meta follows its picture."""
    pics = [(s, seq, seq % 7 == 0, [0, 6, 2, 4, 12, 8, 10][seq % 7], False, f"{s}-{seq}") for s in (1, 2) for seq in range(14)]
    batches = [[p for p in pics if p[1] < 5][::-1], [p for p in pics if 5 <= p[1] < 14], [(1, 3, False, 4, False, None), (1, 14, False, 0, True, None)]]
    got = run(spark, f"file://{tmp_path}/a", batches, 16)
    assert [(r.seq, r.shown) for r in got if r.late] == [(3, None)]
    want = [s for g in (0, 7) for s, _ in sorted(((g + i, p) for i, p in enumerate([0, 6, 2, 4, 12, 8, 10])), key=lambda x: x[1])]
    shown = {s: [r.seq for r in sorted((r for r in got if r.stream_id == s and not r.late), key=lambda r: r.shown)] for s in (1, 2)}
    assert shown[1] == want and shown[2] == want[:7]  # the second stream has no end: its last group waits
    assert all(r.meta == f"{r.stream_id}-{r.seq}" for r in got if not r.late)
    early = [r for r in run(spark, f"file://{tmp_path}/b", [[p for p in pics if p[0] == 1]], 2)]
    assert [r.seq for r in sorted(early, key=lambda r: r.shown)][:5] == [0, 2, 3, 1, 5]


def test_long_streams_are_numbered_by_runs(spark):
    rows = spark.range(1000).select(F.lit(1).alias("stream_id"), F.col("id").alias("seq"), (F.col("id") % 12 == 0).alias("idr"))
    got = Counter(r.group_no - r.seq // 12 for r in pictures.with_groups(rows, run=7).collect())
    assert got == {1: 1000}
