"""Queries of block neighbours and edges, and their SQL by self-joins on coordinates: line items are the blocks of pictures, a supplier a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitlake.functions import blocks, motion
from bitlake.operators import grid


def blocks_of_items(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's items in order as blocks of pictures 1 to 9 macroblocks wide and three high, with slices that end anywhere in a row."""
    c, k = F.col, F.col("l_suppkey")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", c("l_quantity").cast("long").alias("q"), (F.row_number().over(w) - 1).cast("long").alias("place"))
    rows = rows.withColumn("width", 1 + k % 9).withColumn("in", c("place") % (c("width") * 48))
    rows = rows.withColumns({"picture": F.floor(c("place") / (c("width") * 48)), "address": F.floor(c("in") / 16), "block": c("in") % 16})
    use = lambda a, b, ref: F.struct(a.alias("x"), b.alias("y"), ref.alias("ref"))
    p, q = c("l_partkey"), c("q")
    made = {"slice": F.floor(c("address") / (2 + k % 4)), "mode": p % 9, "n": q % 17, "use0": use(p % 7 - 3, q % 5 * 2 - 4, p % 4 - 1), "use1": use(q % 6 - 2, p % 3, q % 3 - 1)}
    return rows.withColumns(made).drop("in")


def block_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours' places in their streams, and the mode, the coefficient context and the vector that they give."""
    n = grid.coded_neighbours(blocks_of_items(spark, d), ["l_suppkey", "picture"], ["place", "mode", "n", "use0"])
    v = motion.predicted_vector(F.col("left.use0"), F.col("above.use0"), F.col("c.use0"), F.col("use0.ref"))
    mode = blocks.predicted_mode(F.col("left.mode"), F.col("above.mode")).cast("long")
    own = [F.col(f"{k}.place").alias(k) for k in ("left", "above", "above_right", "above_left")]
    return n.select("l_suppkey", "place", *own, mode.alias("mode"), blocks.coefficient_context(F.col("left.n"), F.col("above.n")).cast("long").alias("context"), v["x"].alias("x"), v["y"].alias("y"))


def block_edges(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = blocks_of_items(spark, d).select("*", (c("address") % 5 == 3).alias("intra"), (c("n") > 11).alias("coded"), (c("address") % 4 == 1).alias("whole8"), (c("address") * 7 % 52).alias("quality"), (c("l_suppkey") % 13 - 6).alias("alpha_offset"), (c("l_suppkey") % 7 - 3).alias("beta_offset"))
    return grid.edges(rows, ["l_suppkey", "picture"], 2).select(*(F.col(n).cast("long").alias(n) if n != "across" else F.col(n) for n in ("l_suppkey", "picture", "x", "y", "across", "strength", "alpha", "beta", "tc0", "chroma_alpha", "chroma_beta")))


def direct_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each block as if it were spatially direct, with the picture before as the co-located one."""
    rows = blocks_of_items(spark, d).withColumn("intra", F.col("address") % 5 == 3)
    before = rows.select("l_suppkey", "picture").distinct().withColumn("other", F.col("picture") - 1)
    made = grid.direct_blocks(rows, ["l_suppkey"], "picture", before)
    return made.select("l_suppkey", "place", *(F.col(f"direct{i}.{k}").alias(f"{k}{i}") for i in (0, 1) for k in ("x", "y", "ref")))


QUERIES = {"direct_blocks": direct_blocks, "block_neighbours": block_neighbours, "block_edges": block_edges}

_BLOCKS = """WITH a AS (SELECT l_suppkey k, l_partkey p, l_quantity::BIGINT q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 place, 1 + l_suppkey % 9 width FROM lineitem),
b AS (SELECT *, place // (width * 48) picture, place % (width * 48) // 16 address, place % 16 blk FROM a),
g AS (SELECT *, address % width * 4 + [0, 1, 0, 1, 2, 3, 2, 3, 0, 1, 0, 1, 2, 3, 2, 3][blk + 1] x, address // width * 4 + [0, 0, 1, 1, 0, 0, 1, 1, 2, 2, 3, 3, 2, 2, 3, 3][blk + 1] y, address // (2 + k % 4) slice, p % 9 mode, q % 17 n,
  p % 7 - 3 x0, q % 5 * 2 - 4 y0, p % 4 - 1 r0, q % 6 - 2 x1, p % 3 y1, q % 3 - 1 r1 FROM b)"""
_NEAR = " LEFT JOIN g {0} ON {0}.k = g.k AND {0}.picture = g.picture AND {0}.x = g.x + {1} AND {0}.y = g.y + {2} AND {0}.slice = g.slice AND {0}.place < g.place"
_DIFFERS = "NOT (({0}) AND ({1}) OR ({2}) AND ({3}))".format(*(
    f"CASE WHEN o.r{i} < 0 AND g.r{j} < 0 THEN true WHEN o.r{i} < 0 OR g.r{j} < 0 THEN false ELSE o.r{i} = g.r{j} AND abs(o.x{i} - g.x{j}) < 4 AND abs(o.y{i} - g.y{j}) < 4 END" for i, j in ((0, 0), (1, 1), (0, 1), (1, 0))
))
_TABLE = {
    "alpha": "[4,4,5,6,7,8,9,10,12,13,15,17,20,22,25,28,32,36,40,45,50,56,63,71,80,90,101,113,127,144,162,182,203,226,255,255]",
    "beta": "[2,2,2,3,3,3,3,4,4,4,6,6,7,7,8,8,9,9,10,10,11,11,12,12,13,13,14,14,15,15,16,16,17,17,18,18]",
    "tc0": "CASE strength WHEN 1 THEN [0,0,0,0,0,0,0,1,1,1,1,1,1,1,1,1,1,2,2,2,2,3,3,3,4,4,4,5,6,6,7,8,9,10,11,13] WHEN 2 THEN [0,0,0,0,0,1,1,1,1,1,1,1,1,1,1,2,2,2,2,3,3,3,4,4,5,5,6,7,8,8,10,11,12,13,15,17] "
    "WHEN 3 THEN [0,1,1,1,1,1,1,1,1,1,1,2,2,2,2,3,3,3,4,4,4,5,6,6,7,8,9,10,11,13,14,16,18,20,23,25] END",
}
_AT = lambda table, q, off: f"(CASE WHEN {q} + {off} < 16 THEN 0 ELSE ({_TABLE[table]})[least(51, {q} + {off}) - 15] END)::BIGINT"
_CHROMA = lambda q: f"CASE WHEN least(51, {q} + 2) < 30 THEN least(51, {q} + 2) ELSE [29,30,31,32,32,33,34,34,35,35,36,36,37,37,37,38,38,38,39,39,39,39][least(51, {q} + 2) - 29] END"
_PICK = lambda v, i: f"CASE WHEN sa{i}::INT + sb{i}::INT + sc{i}::INT = 1 THEN CASE WHEN sa{i} THEN a{v}{i} WHEN sb{i} THEN b{v}{i} ELSE c{v}{i} END WHEN br{i} IS NULL AND cr{i} IS NULL AND ar{i} IS NOT NULL THEN a{v}{i} ELSE list_sort([coalesce(a{v}{i}, 0), coalesce(b{v}{i}, 0), coalesce(c{v}{i}, 0)])[2] END"
SQL = {
    "direct_blocks": _BLOCKS + """, g0 AS (SELECT * FROM g WHERE blk = 0), n AS (SELECT g.k, g.picture, g.address, """ + ", ".join(f"{'CASE WHEN c.k IS NULL THEN d.' + v + ' ELSE c.' + v + ' END' if s == 'c' else s + '.' + v} {s}{v}" for s in "abc" for v in ("x0", "y0", "r0", "x1", "y1", "r1")) + " FROM g0 g" + "".join(_NEAR.format(*v) for v in (("a", -1, 0), ("b", 0, -1), ("c", 4, -1), ("d", -1, -1))) + """),
m AS (SELECT *, """ + ", ".join(f"coalesce(list_min([v FOR v IN [ar{i}, br{i}, cr{i}] IF v >= 0]), -1) m{i}" for i in (0, 1)) + " FROM n), s AS (SELECT *, " + ", ".join(f"coalesce({s}r{i} = m{i}, false) s{s}{i}" for s in "abc" for i in (0, 1)) + """, m0 < 0 AND m1 < 0 neither FROM m),
t AS (SELECT g.k, g.place, s.* EXCLUDE (k), coalesce(o.address % 5 <> 3 AND CASE WHEN o.r0 >= 0 THEN o.r0 = 0 AND abs(o.x0) <= 1 AND abs(o.y0) <= 1 ELSE o.r1 = 0 AND abs(o.x1) <= 1 AND abs(o.y1) <= 1 END, false) rests
  FROM g JOIN s ON s.k = g.k AND s.picture = g.picture AND s.address = g.address LEFT JOIN g o ON o.k = g.k AND o.picture = g.picture - 1 AND o.address = g.address AND o.blk = [0, 5, 10, 15][g.blk // 4 + 1])
SELECT k l_suppkey, place, """ + ", ".join(f"CASE WHEN neither OR m{i} < 0 OR (m{i} = 0 AND rests) THEN 0 ELSE {_PICK(v, i)} END::BIGINT {v}{i}" for i in (0, 1) for v in "xy") + ", CASE WHEN neither THEN 0 ELSE m0 END::BIGINT ref0, CASE WHEN neither THEN 0 ELSE m1 END::BIGINT ref1 FROM t",
    "block_neighbours": _BLOCKS + """, j AS (SELECT g.*, a.place pa, a.mode ma, a.n na, {'x': a.x0, 'y': a.y0, 'r': a.r0} va, b.place pb, b.mode mb, b.n nb, {'x': b.x0, 'y': b.y0, 'r': b.r0} vb, c.place pc, d.place pd,
  CASE WHEN c.k IS NULL THEN {'x': d.x0, 'y': d.y0, 'r': d.r0} ELSE {'x': c.x0, 'y': c.y0, 'r': c.r0} END vc FROM g""" + "".join(_NEAR.format(*v) for v in (("a", -1, 0), ("b", 0, -1), ("c", 1, -1), ("d", -1, -1))) + """),
s AS (SELECT *, coalesce(va.r = r0, false) sa, coalesce(vb.r = r0, false) sb, coalesce(vc.r = r0, false) sc, va.r IS NOT NULL ha, vb.r IS NULL AND vc.r IS NULL lone FROM j)
SELECT k l_suppkey, place, pa "left", pb above, pc above_right, pd above_left, CASE WHEN ma IS NULL OR mb IS NULL THEN 2 ELSE least(ma, mb) END::BIGINT AS mode, coalesce((na + nb + 1) >> 1, na, nb, 0)::BIGINT context,
""" + ", ".join(f"(CASE WHEN sa::INT + sb::INT + sc::INT = 1 THEN CASE WHEN sa THEN va.{v} WHEN sb THEN vb.{v} ELSE vc.{v} END WHEN lone AND ha THEN va.{v} ELSE list_sort([coalesce(va.{v}, 0), coalesce(vb.{v}, 0), coalesce(vc.{v}, 0)])[2] END)::BIGINT {v}" for v in "xy") + " FROM s",
    "block_edges": _BLOCKS + """, e AS (SELECT g.k, g.picture, g.x, g.y, across, g.address <> o.address outer_, g.address % 5 = 3 OR o.address % 5 = 3 intra, g.n > 11 OR o.n > 11 coded, """ + _DIFFERS + """ moved, g.address % 4 = 1 whole8, g.address * 7 % 52 q, o.address * 7 % 52 p
  FROM g, (VALUES (true), (false)) v(across), g o WHERE o.k = g.k AND o.picture = g.picture AND o.x = g.x - across::INT AND o.y = g.y - (NOT across)::INT),
t AS (SELECT *, CASE WHEN intra AND outer_ THEN 4 WHEN intra THEN 3 WHEN coded THEN 2 WHEN moved THEN 1 ELSE 0 END::BIGINT strength, (p + q + 1) >> 1 luma, (""" + _CHROMA("p") + " + " + _CHROMA("q") + """ + 1) >> 1 chroma, k % 13 - 6 ao, k % 7 - 3 bo
  FROM e WHERE outer_ OR NOT whole8 OR CASE WHEN across THEN x ELSE y END % 2 = 0)
SELECT k l_suppkey, picture, x, y, across, strength, """ + f"{_AT('alpha', 'luma', 'ao')} alpha, {_AT('beta', 'luma', 'bo')} beta, CASE WHEN strength BETWEEN 1 AND 3 THEN {_AT('tc0', 'luma', 'ao')} END tc0, {_AT('alpha', 'chroma', 'ao')} chroma_alpha, {_AT('beta', 'chroma', 'bo')} chroma_beta FROM t",
}
