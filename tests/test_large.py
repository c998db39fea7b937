"""What keeps work in proportion to the input: short parts, packed ranges, batches of bounded size."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bitlake.functions import scans
from bitlake.operators import grid, pictures, prediction, runs
from bitlake.plans import assembly_queries, catalogue, sample_queries
from bitlake.sources import framing, ranges


def test_short_parts_are_one_window(spark):
    rows = spark.range(2000).select((F.col("id") % 7).alias("k"), "id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    values = {"s": ("sum", F.col("v")), "l": ("last", F.col("v"))}
    assert not runs.short(rows, ["k"], 200) and runs.short(rows, ["k"], 300)
    whole = runs.before(rows, ["k"], "id", values, whole=True)
    assert sorted(whole.collect()) == sorted(runs.before(rows, ["k"], "id", values, run=64).collect())
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_starts_are_not_broadcast(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("k"), "id")
    for found in (runs.before(rows, ["k"], "id", {"s": ("sum", F.lit(1))}, run=64), pictures.started(rows, ["k"], "id", F.lit(1), "s")):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_small_ranges_share_tasks():
    many = [(f"f{i}", 0, 2000, 2000) for i in range(100_000)]
    tasks = ranges.packed(many)
    assert [r for t in tasks for r in t.ranges] == many and len(tasks) < 250
    assert len(ranges.packed([("a", i, i + 1, 64) for i in range(64)])) == 64 and ranges.packed([]) == []


def test_units_leave_in_bounded_batches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: seen.append(f) or self)
    framing.units(spark.createDataFrame([(1, b"")], "k long, data binary"), "k", "data")
    one = pa.RecordBatch.from_pydict({"k": pa.array([1, 2], pa.int64()), "data": pa.array([b"\0\0\1\x41" * 50_000, None], pa.binary())})
    sizes = [b.num_rows for b in seen[0](iter([one]))]
    assert sum(sizes) == 50_000 and max(sizes) <= framing.ROWS


def test_groups_of_long_texts_go_on_in_the_next_batch(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: seen.append(f) or self)
    sample_queries.of_arrays(4, sample_queries.MAKERS["edge_chroma"])(spark, "/root/testdata/sf0.001")
    one = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3], pa.int64()), "data": pa.array([b"abcd" * 40_000 + b"x", None, b""], pa.binary())})
    made = list(seen[0](iter([one])))
    rows = [r for b in made for r in b.to_pylist()]
    assert max(b.num_rows for b in made) <= sample_queries.GROUPS
    assert [(r["doc_id"], r["group_no"]) for r in rows] == [(1, i) for i in range(40_001)] + [(2, 0), (3, 0)]
    assert rows[-2]["normal"] is None and rows[-1]["normal"] is not None


@pytest.mark.parametrize("name", sorted(sample_queries.ORDERED))
def test_alike_groups_are_written_side_by_side(spark, tmp_path, name):
    """In the order of what decides them the same rows, of long, short, repeated, empty and null texts, take much less room than as the texts come."""
    rng = np.random.default_rng(7)
    words = np.array(["".join(rng.choice(list("abcdeé"), n)) for n in rng.integers(2, 9, 60)])
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(1, 120, 1500)] + ["ab " * 30_000, None, None, "", "x", *["same words again and again"] * 200]
    pq.write_table(pa.table({"doc_id": pa.array(rng.permutation(len(texts)), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    as_they_come = sample_queries.of_arrays(sample_queries.WIDTHS[name], sample_queries.MAKERS[name])(spark, str(tmp_path))
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    for df, at in ((as_they_come, "plain"), (found, "ordered")):
        df.write.parquet(str(tmp_path / at))
    plain, ordered = (sum(p.stat().st_size for p in (tmp_path / at).glob("*.parquet")) for at in ("plain", "ordered"))
    assert ordered < 0.8 * plain
    mine, theirs = (spark.read.parquet(str(tmp_path / at)) for at in ("ordered", "plain"))
    assert mine.schema == theirs.schema and mine.count() == theirs.count()
    assert mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet' where text is not null")
    columns = ", ".join(f'"{c}"' for c in mine.columns)
    own = con.sql(f"select {columns} from '{tmp_path}/ordered/*.parquet' where doc_id in (select doc_id from documents)")
    sql = con.sql(f"select {columns} from ({catalogue.SQL[name]})")
    assert con.sql("select (select count(*) from own) = (select count(*) from sql), not exists (from own except from sql)").fetchall() == [(True, True)]


def test_8x8_blocks_of_equal_left_sides_stand_together(spark, tmp_path):
    """What depends on the left samples and the corner alone changes from row to row about as seldom as it has different values."""
    rng = np.random.default_rng(11)
    groups = np.concatenate([rng.integers(97, 123, (3000, 16)), rng.integers(97, 123, (40, 9))[rng.integers(0, 40, 3000)]], axis=1).astype(np.uint8)
    texts = [g.tobytes().decode() for g in groups.reshape(100, -1)]
    pq.write_table(pa.table({"doc_id": pa.array(range(100), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    left = [r.m1 for r in catalogue.QUERIES["intra8_modes"](spark, str(tmp_path)).select("m1").collect()]
    changes = 1 + sum(a != b for a, b in zip(left, left[1:], strict=False))
    assert len(left) == 3000 and changes <= 40


def test_8x8_blocks_of_the_same_missing_sides_stand_together(spark, tmp_path):
    """Blocks that lack the same sides are one run, and where the upper ones are missing equal left ones are, too, whatever the unused samples are."""
    rng = np.random.default_rng(13)
    last = np.frombuffer(b"pqrs", np.uint8)[rng.integers(0, 4, 4000)]
    left = rng.integers(97, 123, (40, 8))[rng.integers(0, 40, 4000)]
    groups = np.concatenate([rng.integers(97, 123, (4000, 16)), left, np.full((4000, 1), 120), last[:, None]], axis=1).astype(np.uint8)
    pq.write_table(pa.table({"doc_id": pa.array(range(100), pa.int64()), "text": [g.tobytes().decode() for g in groups.reshape(100, -1)]}), tmp_path / "documents.parquet")
    rows = [(last[40 * r.doc_id + r.group_no], r.m1) for r in catalogue.QUERIES["intra8_available"](spark, str(tmp_path)).select("doc_id", "group_no", "m1").collect()]
    runs_of = lambda v: 1 + sum(a != b for a, b in zip(v, v[1:], strict=False))
    assert len(rows) == 4000 and runs_of([side for side, _ in rows]) == 4
    assert runs_of([m1 for side, m1 in rows if side == ord("q")]) <= 40
    assert runs_of([m1 for side, m1 in rows if side in b"rs"]) == 1


def test_bytes_become_text_without_a_string_a_number(monkeypatch):
    """Numbers that are all bytes are joined from a table, equal to the text of each; others are as before."""
    rng = np.random.default_rng(17)
    null = rng.integers(0, 5, 300) == 0
    for least, most in ((0, 256), (-3, 256), (0, 257)):
        values = rng.integers(least, most, (300, 64))
        values[:2, 0], values[0, -1] = (least, most - 1), 0
        want = [None if n else " ".join(map(str, v)) for v, n in zip(values.tolist(), null, strict=True)]
        assert sample_queries.column(list(values.T), null).to_pylist() == want
    monkeypatch.delattr(sample_queries.pc, "binary_join")
    values = rng.integers(0, 256, (300, 64))
    assert sample_queries.column(list(values.T), np.zeros(300, bool)).to_pylist() == [" ".join(map(str, v)) for v in values.tolist()]


def test_many_tiles_share_a_call(spark):
    blocks = spark.range(40_000).select((F.col("id") / 8).cast("long").alias("p"), (F.col("id") % 4).alias("x"), F.floor(F.col("id") % 8 / 4).alias("y"), F.col("id").alias("v"))
    found = grid.with_neighbours(blocks, ["p"], {"left": (-1, 0), "above": (0, -1)}, ["v"])
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    bad = found.where(~F.col("left.v").eqNullSafe(F.when(F.col("x") > 0, F.col("v") - 1)) | ~F.col("above.v").eqNullSafe(F.when(F.col("y") > 0, F.col("v") - 4)))
    assert found.count() == 40_000 and bad.isEmpty()


def test_only_samples_near_a_block_leave_its_strip(spark):
    """Lines meet in Spark, without a Python call a strip, and of a wide strip only the places around a block go on."""
    lines = spark.range(300).select(F.lit(1).alias("plane"), F.col("id").alias("y"), F.encode(F.repeat(F.lit("a"), 5000), "UTF-8").alias("line"))
    blocks = spark.range(100).select(F.lit(1).alias("plane"), (F.col("id") * 40).alias("x"), (F.col("id") * 2).alias("y"), F.lit(3).alias("mvx"), F.lit(2).alias("mvy"))
    found = prediction.predicted(blocks, prediction.tiles(lines))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan
    assert [bytes(r.block) for r in found.collect()] == [b"a" * 16] * 100
    assert "hashpartitioning(cast(" not in found._jdf.queryExecution().executedPlan().toString()  # strips are not shuffled again


def test_field_lists_sort_each_order_once(spark):
    plan = assembly_queries.field_lists(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") + plan.count("array_sort(") == 2


def test_whole_planes_are_arrays(spark):
    """All 64 places of a block from slopes computed once, equal to the formula at each place."""
    s = np.random.default_rng(3).integers(0, 256, (16, 500))
    before = [[s[2 - i] if i < 3 else s[7] for i in range(4)], [s[10 - i] if i < 3 else s[7] for i in range(4)]]
    slope = [34 * sum((i + 1) * (s[8 * k + 4 + i] - before[k][i]) for i in range(4)) + 32 >> 6 for k in (0, 1)]
    made = sample_queries.MAKERS["whole_intra_plane"](list(s))
    for i in range(64):
        assert (made[f"v{i}"] == np.clip(16 * (s[15] + s[7]) + slope[0] * (i % 8 - 3) + slope[1] * (i // 8 - 3) + 16 >> 5, 0, 255)).all()
    assert "MapInArrow" in catalogue.QUERIES["whole_intra_plane"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_run_level_blocks_are_arrays(spark, tmp_path):
    """Blocks come in batches of arrays, as their SQL has them where part, supplier or quality are null, too."""
    rows = [(1, 1, 7, 6, 30.0), (2, 1, 7, 6, None), (3, 2, None, 6, 30.0), (4, 1, 7, None, 1.0), (5, 1, 8, 9, 50.0)]
    table = pa.table(list(zip(*rows, strict=True)), names=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    pq.write_table(table, tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    found = catalogue.QUERIES["run_level_blocks"](spark, str(tmp_path))
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(catalogue.SQL["run_level_blocks"]).fetchall())
    rng = np.random.default_rng(5)
    pairs = [(rng.integers(0, 9, 50), rng.integers(-20, 21, 50)) for _ in range(6)]
    start, field, q, weights = rng.integers(0, 2, 50), rng.integers(0, 2, 50) == 1, rng.integers(0, 52, 50), rng.integers(1, 64, (3, 64))
    made = scans.sparse_blocks(pairs, 8, start, field, q, weights, np.arange(50) % 3)
    lists = [([{"run": int(r[i]), "level": int(v[i])} for r, v in pairs], int(start[i]), bool(field[i]), int(q[i]), weights[i % 3].tolist(), i) for i in range(50)]
    df = spark.createDataFrame(lists, "pairs array<struct<run:bigint,level:bigint>>, start long, field boolean, q long, matrix array<bigint>, i long")
    levels = scans.in_row_order(scans.in_scan_order(F.col("pairs"), 8, F.col("start")), 8, F.col("field"))
    for r in df.select("i", scans.scaled_block(levels, F.col("q"), F.col("matrix"), 8, F.col("start")).alias("b")).collect():
        assert r.b == made[r.i].tolist()
