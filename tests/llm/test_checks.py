"""Operators 11 to 13: odd cases, and plain recomputations."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from bitlake.llm import decontaminate, merkle, turns

DOCS = "doc_id long, text string, items int, data int"
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    low = (text or "").encode()
    return WORDS.findall(low.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def plain_hits(text, items, gram):
    """(hit words, ids of items) by comparing every window with every place."""
    w, hit, found = words_of(text), set(), set()
    for item, t in items:
        own = words_of(t)
        n = min(gram, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == own[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add("" if item is None else str(item))
    return hit, sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_windows_are_found_as_by_comparison(spark, block):
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(["Ab", "ab", "c", "é1", "d"]) for _ in range(n))
    items = [(1, say(12)), (10, say(3)), (2, say(5)), (None, say(7)), (3, None), (4, "... "), (2, say(6))]
    docs = [(i, say(40)) for i in range(30)] + [(None, say(9)), (5, None), (6, ""), (7, "c"), (0, "x" * 5000 + " " + items[0][1].replace(" ", "--"))]
    docs += [docs[3], (None, docs[4][1])]
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.found(rows, bench, gram=5, block=block).collect()
    assert sorted(((r.doc_id, r.text), r.n_words, r.n_hit, list(r["items"])) for r in got if r.doc_id is not None and r.text is not None) == sorted(
        ((i, t), len(words_of(t)), len(plain_hits(t, items, 5)[0]), plain_hits(t, items, 5)[1]) for i, t in docs if i is not None and t is not None
    )
    assert len(got) == len(docs) and all(r.data == 2 for r in got)
    for r in got:  # the spans are the hit words' runs, and without them no hit word is left
        assert sum(s.last - s.first + 1 for s in r.spans) == r.n_hit and all(words_of((r.text or "").encode()[s.start : s.stop].decode())[0] == words_of(r.text)[s.first] for s in r.spans)


def test_removal(spark):
    rows = spark.createDataFrame([(1, "one two  THREE four, five", 7), (2, "ünd two three", 8), (3, None, 9)], "doc_id long, text string, row int")
    bench = spark.createDataFrame([("a", "two three"), ("b", "four")], "item_id string, text string")
    assert decontaminate.cleaned(rows, bench).orderBy("doc_id").collect() == [(1, "one , five", 7), (2, "ünd ", 8), (3, None, 9)]
    assert [r.doc_id for r in decontaminate.cleaned(rows, bench, remove="documents").collect()] == [3]
    assert [r.doc_id for r in decontaminate.cleaned(rows, bench, remove="documents", most=0.6).orderBy("doc_id").collect()] == [1, 3]
    assert decontaminate.found(rows.limit(0), bench).count() == 0 and decontaminate.found(rows, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    with pytest.raises(ValueError):
        decontaminate.cleaned(rows, bench, remove="words")


def test_words_beyond_a_piece(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    hasher = decontaminate.Hasher()
    text = b"\0".join([b"abc", b"x" * 500, b"abc", b"de" * 100, b"abc"])
    starts, stops, hashes = hasher.words(text)
    assert [text[a:z] for a, z in zip(starts, stops, strict=True)] == text.split(b"\0") and hashes[0] == hashes[2] == hashes[4] and len(set(hashes.tolist())) == 3


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(docs):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = sorted({d[1] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        leaves = sorted(((d[0] is not None, d[0] or 0, sha(*map(frame, d))) for d in docs if d[1] == s))
        trees[s] = ([x[:2] for x in leaves], plain_tree([x[2] for x in leaves]))
    top = plain_tree([trees[s][1][-1][0] for s in sources])
    rows = []
    for k, s in enumerate(sources):
        ids, levels = trees[s]
        for i, (there, doc_id) in enumerate(ids):
            proof = []
            for levels_, at in ((levels, i), (top, k)):
                for level in levels_[:-1]:
                    run = at - at % 3
                    proof += level[run : run + 3][: at - run] + level[run : run + 3][at - run + 1 :]
                    at //= 3
            rows.append((doc_id if there else None, levels[0][i], levels[-1][0], top[-1][0], sha(*proof)))
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 30, None: 4, "": 3, "é": 1, "b": 10}, {"x": 3}])
def test_manifest_is_the_plain_one(spark, sizes):
    docs = [(i * 7 % 31, s, None if i % 3 else "en", i, None if i == 2 else f"t\n{i}") for s, n in sizes.items() for i in range(n)]
    docs += [(None, s, None, None, "") for s in sizes if s == "b"] + [docs[0]] * 2
    rows = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, lang string, n_chars long, text string, leaf int")
    made = merkle.manifest(rows, ["doc_id", "source", "lang", "n_chars", "text"])
    text = [F.lower(F.hex(c)) for c in ("leaf", "subroot", "root")]
    got = made.select("doc_id", *text, F.sha2(merkle.siblings(F.col("proof")), 256), (merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((r[:5] for r in got), key=key) == sorted(plain_manifest(docs), key=key) and all(r.ok for r in got)


def test_manifest_of_nothing_and_altered_leaves(spark):
    rows = spark.createDataFrame([(i, "s", str(i)) for i in range(20)], "doc_id long, source string, text string")
    assert merkle.manifest(rows.limit(0), ["doc_id"]).count() == 0
    made = merkle.manifest(rows, ["doc_id", "text"], also={"bad": merkle.leaf_digest(F.lit(1))})
    assert made.where(merkle.folded(F.col("bad"), F.col("proof")) == F.col("root")).count() == 0


def test_store_holds_each_digest_once(spark, tmp_path):
    leaves = spark.createDataFrame([(g, i, 4, bytes([i])) for g in "ab" for i in range(4)], "grp string, rank long, n long, digest binary")
    merkle.store([merkle.build(leaves, "test")], f"file://{tmp_path}/store")
    held = {bytes(r.digest): [bytes(c) for c in r.children] for r in spark.read.parquet(f"file://{tmp_path}/store").collect()}
    assert len(held) == 3 and all(hashlib.sha256("".join(c.hex() for c in v).encode()).digest() == k for k, v in held.items())


NEXT, KEEP = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def plain_repair(rows):
    """(cost, audit, lines) by keeping the least (cost, audit) of each state, row by row."""
    insert = lambda found: [(c, a, s, ln) for c, a, s, ln in found] + [(c + 3, a + "I", NEXT[s], [*ln, ("assistant" if s == 2 else "user") + ":"]) for c, a, s, ln in found]
    least = lambda found: list({s: min(x for x in found if x[2] == s) for s in {x[2] for x in found}}.values())
    held, seen = [(0, "", 0, [])], set()
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        found = []
        for c, a, s, ln in least(insert(insert(held))):
            found.append((c + 4, a + "D", s, ln))
            if fault not in (1, 2):
                more = 3 * (fault == 3)
                if (s, role[:1]) in KEEP:
                    found.append((c + more, a + "K", KEEP[s, role[:1]], [*ln, f"{role}:{text}"]))
                found.append((c + 3 + more, a + "R", NEXT[s], [*ln, ("assistant" if s == 2 else "user") + f":{text}"]))
        held = least(found)
    c, a, _, ln = min(x for x in insert(insert(held)) if x[2] in (0, 3))
    return c, a, hashlib.sha256("\n".join(ln).encode()).hexdigest()


def test_repairs_are_the_plain_ones(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for conv in range(120):
        for turn in range(rng.choice([0, 1, 2, 5, 9, 700 if conv % 40 == 0 else 3])):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice([f"w{turn}.", f"v{turn}", " \t", "same!", f"x{turn}? \n"]), 5))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, key int")
    got = {r.conv_id: r for r in turns.repaired(frame, spark.range(120).select(F.col("id").cast("int").alias("conv_id"))).collect()}
    assert len(got) == 120
    for conv in range(120):
        own = [(role, text) for c, _, role, text, _ in sorted(rows) if c == conv]
        r = got[conv]
        assert (r.cost, r.audit, r.repaired_sha256) == plain_repair(own), conv
    lines = turns.repaired(frame, frame.limit(0), messages=True)
    for conv, digest in lines.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("role", F.lit(":"), "text").alias("line")))), lambda x: x["line"]), "\n"), 256)).collect():
        assert got[conv].repaired_sha256 == digest


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (1, 2, "user", "a."), (1, 5, "assistant", "b."), (1, None, "system", "c.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r[1:8] for r in turns.repaired(frame, frame).collect()}
    assert got == {None: (0, 1, 1, 0, 2, 11, "DKDI"), 1: (2, 0, 0, 0, 0, 0, "KKK")}
    assert turns.repaired(frame.limit(0), frame.limit(0)).count() == 0
    assert {r[0]: r[1:] for r in turns.repaired(frame.limit(0), frame).collect()}[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
