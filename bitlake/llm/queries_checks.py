"""Queries and SQL of operators 11, 12 and 13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlake.llm import decontaminate, merkle, turns
from bitlake.llm.common import remainder


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = decontaminate.found(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = ["doc_id", "source", "lang", "n_chars"]
    altered = merkle.leaf_digest(*map(F.col, head), F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.when(remainder(F.col("doc_id"), 2) == 0, altered)
    rows = merkle.manifest(docs, [*head, "text"], also={"tampered": tampered})
    rows = rows.withColumn("folded", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    proof = F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256")
    return rows.select("doc_id", text("leaf"), text("subroot"), text("root"), proof, text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows, some dropped, emptied, cut, repeated or given another role, as the crc32 of their id and turn says."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    out = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "n")).alias("_copy")).drop("_copy")


def op13_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.repaired(damaged(rows), rows)


#: The unsigned crc32 of an ASCII text, by its polynomial.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
  list_reduce(list_concat([xor(c, b)], range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"""
_FRAME = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
_HEAD = " || ".join(_FRAME.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op11_decontaminate": "WITH b AS (SELECT coalesce(item_id::VARCHAR, '') item, " + _WORDS.format("text") + """ w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item, unnest([array_to_string(w[i:i + 9], ' ') FOR i IN range(1, greatest(1, len(w) - 9) + 1)]) g FROM b WHERE len(w) > 0),
n AS (SELECT *, len(string_split(g, ' ')) size FROM g), sizes AS (SELECT DISTINCT size FROM n),
d AS (SELECT row_number() OVER () k, doc_id, coalesce(""" + _WORDS.format("text") + """, []) w FROM documents),
o AS (SELECT k, size, unnest(range(1, len(w) - size + 2)) i, w FROM d, sizes),
h AS (SELECT k, i, o.size, item FROM (SELECT k, i, size, array_to_string(w[i:i + size - 1], ' ') g FROM o) o JOIN n USING (g)),
x AS (SELECT k, count(DISTINCT p) n_hit FROM (SELECT k, unnest(range(i, i + size)) p FROM h) GROUP BY k),
y AS (SELECT k, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN x USING (k) LEFT JOIN y USING (k)""",
    "op12_merkle_manifest": "WITH RECURSIVE d AS (SELECT row_number() OVER () k, doc_id, coalesce('=' || source, '-') g, sha256(" + _HEAD + " || " + _FRAME.format("text") + ") leaf, CASE WHEN " + _CRC.format("doc_id::VARCHAR") + " % 2 = 0 THEN sha256(" + _HEAD + " || " + _FRAME.format("replace(text, chr(10), '')") + """) END bad FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 r, count(*) OVER (PARTITION BY g) n FROM d),
t(g, lvl, r, n, x) AS (SELECT g, 0, r, n, leaf FROM l UNION ALL SELECT g, lvl + 1, r // 3, (n + 2) // 3, sha256(string_agg(x, '' ORDER BY r)) FROM t WHERE n > 1 GROUP BY g, lvl + 1, r // 3, (n + 2) // 3),
s AS (SELECT g, x, row_number() OVER (ORDER BY g) - 1 r, count(*) OVER () n FROM t WHERE n = 1),
u(lvl, r, n, x) AS (SELECT 0, r, n, x FROM s UNION ALL SELECT lvl + 1, r // 3, (n + 2) // 3, sha256(string_agg(x, '' ORDER BY r)) FROM u WHERE n > 1 GROUP BY lvl + 1, r // 3, (n + 2) // 3),
path AS (SELECT l.k, t.lvl lvl, string_agg(o.x, '' ORDER BY o.r) FILTER (o.r < t.r) a, string_agg(o.x, '' ORDER BY o.r) FILTER (o.r > t.r) b
  FROM l JOIN t ON t.g = l.g AND t.r = l.r // (3 ** t.lvl)::BIGINT AND t.n > 1 JOIN t o ON o.g = t.g AND o.lvl = t.lvl AND o.r // 3 = t.r // 3 GROUP BY l.k, t.lvl
  UNION ALL SELECT l.k, 100 + u.lvl, string_agg(o.x, '' ORDER BY o.r) FILTER (o.r < u.r), string_agg(o.x, '' ORDER BY o.r) FILTER (o.r > u.r)
  FROM l JOIN s ON s.g = l.g JOIN u ON u.r = s.r // (3 ** u.lvl)::BIGINT AND u.n > 1 JOIN u o ON o.lvl = u.lvl AND o.r // 3 = u.r // 3 GROUP BY l.k, u.lvl),
steps AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY lvl) no, coalesce(a, '') a, coalesce(b, '') b FROM path),
proof AS (SELECT k, string_agg(a || b, '' ORDER BY no) p FROM steps GROUP BY k),
f(k, no, x) AS (SELECT k, 0, coalesce(bad, leaf) FROM l UNION ALL SELECT f.k, f.no + 1, sha256(a || f.x || b) FROM f JOIN steps ON steps.k = f.k AND steps.no = f.no + 1),
e AS (SELECT k, arg_max(x, no) folded FROM f GROUP BY k)
SELECT doc_id, leaf, s.x subroot, top.x root, sha256(coalesce(p, '')) proof_sha256, folded folded_root, folded = top.x verified
FROM l JOIN (SELECT x FROM u WHERE n = 1) top ON true JOIN s ON s.g = l.g LEFT JOIN proof USING (k) JOIN e USING (k)""",
    "op13_repair_turns": r"""WITH RECURSIVE a AS (SELECT coalesce('=' || conv_id, '-') k, conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') name FROM conversations),
c AS (SELECT *, """ + _CRC.format("name") + r""" % 20 c FROM a),
d AS (SELECT k, turn, CASE WHEN c = 4 THEN 'user' ELSE role END role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END text, unnest(range(CASE WHEN c = 3 THEN 2 ELSE 1 END)) copy FROM c WHERE c <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || ':' || text), copy) i, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') bare, left(role, 1) x FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END fault, lag(x) OVER (PARTITION BY k ORDER BY i) px FROM o),
ins(q, cost, audit, q2, lines) AS (VALUES (0, 0, '', 0, []::VARCHAR[]), (0, 3, 'I', 2, ['user:']), (0, 6, 'II', 3, ['user:', 'assistant:']), (1, 0, '', 1, []), (1, 3, 'I', 2, ['user:']), (1, 6, 'II', 3, ['user:', 'assistant:']),
  (2, 0, '', 2, []), (2, 3, 'I', 3, ['assistant:']), (2, 6, 'II', 2, ['assistant:', 'user:']), (3, 0, '', 3, []), (3, 3, 'I', 2, ['user:']), (3, 6, 'II', 3, ['user:', 'assistant:'])),
edit(q2, x, e, q3, price, said) AS (SELECT q, x, 'D', q, 4, '' FROM range(4) t(q), (VALUES ('')) v(x) UNION ALL VALUES (0, 's', 'K', 1, 0, ''), (0, 'u', 'K', 2, 0, ''), (1, 'u', 'K', 2, 0, ''), (3, 'u', 'K', 2, 0, ''), (2, 'a', 'K', 3, 0, ''),
  (0, '', 'R', 2, 3, 'user'), (1, '', 'R', 2, 3, 'user'), (3, '', 'R', 2, 3, 'user'), (2, '', 'R', 3, 3, 'assistant')),
p(k, i, q, best) AS (SELECT DISTINCT k, 0::BIGINT, 0::BIGINT, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM a UNION ALL
  SELECT p.k, p.i + 1, edit.q3, min({'cost': p.best.cost + ins.cost + price + CASE WHEN fault = 3 AND e <> 'D' THEN 3 ELSE 0 END, 'audit': p.best.audit || ins.audit || e,
    'lines': list_concat(p.best.lines, ins.lines, CASE WHEN e = 'D' THEN [] ELSE [CASE WHEN e = 'K' THEN role ELSE said END || ':' || text] END)})
  FROM p JOIN f ON f.k = p.k AND f.i = p.i + 1 JOIN ins ON ins.q = p.q JOIN edit ON edit.q2 = ins.q2 AND (e = 'D' OR fault IN (0, 3) AND (e = 'R' OR edit.x = f.x)) GROUP BY p.k, p.i, edit.q3),
n AS (SELECT k, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (fault = 1) blank, count(*) FILTER (fault = 2) dup, count(*) FILTER (fault = 3) trunc, count(*) FILTER (i > 1 AND px || x NOT IN ('su', 'ua', 'au')) illegal FROM f GROUP BY k),
r AS (SELECT p.k, min({'cost': best.cost + ins.cost, 'audit': best.audit || ins.audit, 'lines': list_concat(best.lines, ins.lines)}) best FROM p LEFT JOIN n USING (k) JOIN ins ON ins.q = p.q AND ins.q2 IN (0, 3) WHERE p.i = coalesce(n.n, 0) GROUP BY p.k)
SELECT (SELECT any_value(conv_id) FROM a WHERE a.k = r.k) conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0) blank, coalesce(dup, 0) duplicate, coalesce(trunc, 0) truncated, coalesce(illegal, 0) illegal, best.cost::BIGINT AS cost, best.audit audit,
  sha256(array_to_string(best.lines, chr(10))) repaired_sha256 FROM r LEFT JOIN n USING (k)""",
}
QUERIES = {"op11_decontaminate": op11_decontaminate, "op12_merkle_manifest": op12_merkle_manifest, "op13_repair_turns": op13_repair_turns}
