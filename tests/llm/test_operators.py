"""Operators of subpackage llm on small tables, against brute force and in their odd cases."""

import base64

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bitlake.llm import bpe, language, media, mixing, near_text, near_vectors, quality, rollups, toxicity, url_filter

ODD = [(1, None, "en", "a", 0), (2, "", None, None, None), (2, "", None, None, None), (None, "one two three", "en", "b", 3), (5, "x " * 30_000, "en", "a", 60_000), (6, " \n\t", "de", "a", 3), (7, "12 34 !!", None, "c", 8)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"size": F.lit("clash"), "id": F.lit("clash"), "score": F.lit("clash")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(spark, odd, none):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 37), f"s{i % 3}" if i % 5 else None) for i in range(400)], "doc_id long, text string, source string")
    out = mixing.taken(docs, block=16).toPandas()
    assert len(out) == 400 and (out.taken <= 2 * out["size"]).all()
    src = docs.toPandas().fillna({"source": "~"}).merge(out, on="doc_id")
    for _, g in src.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    assert abs(src.drop_duplicates("source").target.sum() - 1.5 * src["size"].sum()) < 1e-6
    pieces, _ = mixing.mix(docs, block=16)
    slots = pieces.select("slot", "src", "rank").distinct().toPandas()
    assert not slots.slot.duplicated().any()
    assert mixing.taken(odd).count() == len(ODD) and mixing.taken(none).count() == 0


def test_mix_follows_the_schedule(spark):
    """The registered query equals its SQL, slots of the golden-ratio sequence included; another sequence gives other slots."""
    import duckdb

    from bitlake.llm import queries_native
    from tests.conftest import DATA

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken", "pieces", "first_slot"]
    mine = queries_native.op4_mix_sources(spark, DATA).select(*names).collect()
    assert Counter(map(tuple, mine)) == Counter(con.sql(queries_native.SQL["op4_mix_sources"]).select(*names).fetchall())
    assert len({r.first_slot for r in mine}) > len(mine) / 3
    other = queries_native.SQL["op4_mix_sources"].replace("2654435769", "1234567891")
    assert Counter(map(tuple, mine)) != Counter(con.sql(other).select(*names).fetchall())


def test_url_filter(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("bad.com", "/x", "block")], "host string, path string, verdict string")
    urls = [(1, "http://A.bad.COM/xy?q"), (2, "http://nobad.com/xy"), (3, None), (3, None), (4, "nothing"), (None, "http://bad.com"), (6, "ftp://bad.com/x#y")]
    got = sorted(url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect(), key=str)
    assert sorted((r.page_id, r.rule, r.verdict) for r in got if r.page_id) == [(1, "bad.com/x", "block"), (2, "com/", "allow"), (3, None, "allow"), (3, None, "allow"), (4, None, "allow"), (6, "bad.com/x", "block")]
    assert [(r.host, r.path) for r in got if r.page_id == 1] == [("a.bad.com", "/xy")]


def test_rollup_counts_a_batch_once(spark, tmp_path):
    store = rollups.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("a", "en", 5), ("a", "en", 7), (None, None, 1)], "source string, lang string, n long")
    for _ in range(2):
        store.commit(1, rollups.change(rows, 1, "v1", "n"))
    store.commit(2, rollups.change(rows.where("n = 5"), -1, "v1", "n"))
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "v1", 1, 7), (None, None, "v1", 1, 1)}


def test_rollup_compacts_and_stays_idempotent(spark, tmp_path):
    store = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert store.totals().count() == 0
    rows = spark.createDataFrame([("a", "en", 5, "x"), ("a", "en", 7, "y")], "source string, lang string, n long, docs string")
    batch = rollups.change(rows, 1, "v1", "n")
    store.commit(1, batch)
    store.commit(2, batch.limit(0))
    store.compact()
    store.commit(1, batch)  # sent again after its compaction
    store.commit(3, rollups.change(rows.where("n = 5"), -1, "v1", "n"))
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "v1", 1, 7)}
    store.compact()
    store.commit(3, batch)
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "v1", 1, 7)}
    batch.write.parquet(f"file://{tmp_path}/r/data/lost")  # a try whose driver was lost before its log row
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "v1", 1, 7)}


def test_media_round_trip(odd, none):
    rows = media.with_media(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next((t or "" for i, t, *_ in ODD if i == r.doc_id), "")
        assert bytes(r.samples) == media.payload(text) and bytes(r.samples)[: r.n_bytes] == text.encode()
    tone = (128 + 100 * np.sin(np.arange(4096) * 2 * np.pi * 20 / media.FRAME)).astype(np.uint8).tobytes()
    assert {b for b in media.peaks(tone)[1].tolist() if 16 <= b < 48} == {20}  # other bands hold rounding noise
    assert media.with_media(none).count() == 0


def test_language(spark, odd, none):
    words = {"aa": ["babo", "bamo", "mobo"], "bb": ["kiti", "riki", "tiri"]}
    rng = np.random.default_rng(1)
    rows = [(" ".join(rng.choice(words[x], 30)), x) for x in words for _ in range(20)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.predict(["bamo babo", "riki", None, "12 !"])[0] == ["aa", "bb", "und", "und"]
    got = {r.doc_id: r.lang_pred for r in language.predicted(odd, model).collect()}
    assert got[1] == got[2] == got[6] == got[7] == "und" and language.predicted(none, model).count() == 0
    assert language.fit(spark.createDataFrame([], "text string, lang string")).predict(["babo"])[0] == ["und"]


def test_toxicity(spark, odd, none):
    assert toxicity.fold("1d10t ѕtuрid s.t.u.p.i.d 2024") == "idiot stupid stupid 2024"
    rows = [(i, "you idiot grunk" if i % 3 == 0 else "a fine day out here", int(i % 3 == 0)) for i in range(300)]
    model = toxicity.fit(spark.createDataFrame(rows, "id long, text string, y int"))
    import pandas as pd

    bad, hidden, mined, clean, excused = model.score(pd.Series(["you idiot grunk", "you 1d10t grunk", "you іdіоt grunk", "a day", "the trash can"]))
    assert min(bad, hidden, mined) >= 0.5 > max(clean, excused)
    assert toxicity.scored(odd, model).where("score >= 0 and score < 0.5").count() == len(ODD) and toxicity.scored(none, model).count() == 0
    empty = spark.createDataFrame([], "id long, text string, y int")
    assert toxicity.fit(empty).score(pd.Series(["stupid stupid idiot"]))[0] > 0.5


def brute_groups(texts: dict[int, str]) -> dict[int, int]:
    grams = {}
    for i, t in texts.items():
        w = t.split()
        grams[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
    group = {i: i for i in texts}
    for a in texts:
        for b in texts:
            x, y = grams[a], grams[b]
            if a < b and x and sum(1 / sum(max(x[u] / x[d], y[u] / y[d]) for u in x | y) for d in x if d in y) >= 0.8:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return group


def test_near_text(spark, odd, none):
    rng = np.random.default_rng(3)
    texts = {}
    for base in range(12):
        words = [f"w{k}" for k in rng.integers(0, 5000, 120)]
        for copy in range(6):
            w = list(words)
            for at in rng.integers(0, 120, copy):
                w[at] = f"v{rng.integers(0, 10**6)}"
            texts[base * 6 + copy] = " ".join(w)
    texts |= {100: "a b", 101: "a b", 102: "a", 103: "r r r r r r r r", 104: "r r r r r r r r"}
    got = {r.doc_id: r.class_id for r in near_text.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_groups(texts)
    assert near_text.near_duplicates(odd).where("kept").count() == len(ODD) and near_text.near_duplicates(none).count() == 0


def test_prob_minhash_estimates():
    h = near_text.mixed(np.arange(1, 61, dtype=np.uint64))
    a, b = (h[:50], np.ones(50)), (h[10:], np.ones(50))
    sig = [near_text.prob_minhash(x, np.zeros(len(x), np.int64), w, 1)[0] for x, w in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - 40 / 60) < 0.25


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    rows = [(i, [float(c) for c in centres[i % 20] + 0.04 * rng.standard_normal(16)], i % 2) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, None, 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, rows[1][1], None), (305, [1.0, None], 1)]
    got = {r.vec_id: r for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if i < 301]
    for i, v, y in good:
        assert got[i].n_links == sum(j != i and z == y and float(v @ u) >= 0.98 for j, u, z in good)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(301, 306))
    assert near_vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_bpe_equals_tiktoken(spark, odd, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {i: t for i, t, *_ in ODD if i} | {20: "I'll  go\n\n on ½ ² 漢字😀　x\x85y\x1c", 21: "a" * 3000, 22: "zqxjkv unbelievableness"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, cache=3, back=True), path, out="again").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.ids == own.encode_ordinary(text) and bytes(r.decoded) == bytes(r.again) == text.encode()
    some = spark.createDataFrame([(1, None), (2, []), (3, own.encode_ordinary("hi there"))], "n int, ids array<int>").withColumn("decoded", F.lit("clash"))
    assert {r.n: r.decoded and bytes(r.decoded) for r in bpe.decode(some, path).collect()} == {1: None, 2: bytearray(), 3: b"hi there"}
    assert bpe.encode(odd, path, public_tokenizers.PATTERN).count() == len(ODD) and bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_quality(spark, odd, none):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(rng.choice(["sun", "moon", "river", "stone", "cloud", "tree"], 60))
    rows = [(i, good() if i % 3 else " ".join(w + "***" for w in good().split()).upper(), "en", "s", 100) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    out = quality.score(spark.createDataFrame(rows, SCHEMA), labels).toPandas()
    assert (out.predicted == (out.doc_id % 3 != 0)).mean() > 0.97
    assert quality.score(odd, labels.limit(0)).where("score = 0.5").count() == len(ODD) and quality.score(none, labels).count() == 0


def test_tiles_find_every_link_that_joins():
    """Blocks of texts that share one bucket: the tile's links give the components of all pairs, weights included."""
    import pandas as pd

    rng = np.random.default_rng(5)
    grams = []
    for _ in range(30):
        base = rng.choice(1 << 32, 250, replace=False).astype(np.uint64)
        for first in (0, 22, 90):  # similarity to the first: 0.802 and 0.38
            one = base[first : first + 200]
            grams.append(np.sort(np.concatenate([one, rng.choice(one, 5)])).tobytes())
    n = len(grams)
    exact = np.array([[near_text.similarity(x, y) for y in grams] for x in grams])
    x, y = near_text.overlaps(grams, grams)
    with np.errstate(divide="ignore"):
        assert (exact <= near_text.bound_of_shares(x, y) + 1e-4).all()
    rows = pd.DataFrame({"blk": np.arange(n) % 2, "no": range(n), "component": range(n), "bands": [np.array([7, 100 + i]) for i in range(n)], "grams": grams})
    found = [pair for i, j in ((0, 0), (0, 1), (1, 1)) for pair in near_text.joining(rows, 7, i, j, 0.8)]
    assert all(exact[a, b] >= 0.8 for a, b in found)

    def grouped(links) -> list[int]:
        group = list(range(n))
        for a, b in links:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
        return group

    assert grouped(found) == grouped([(a, b) for a in range(n) for b in range(a) if exact[a, b] >= 0.8])
    assert near_text.joining(rows, 8, 0, 1, 0.8) == []  # they share a smaller key


def test_near_text_of_ids_with_several_texts(spark):
    """An id's texts join their groups; copies without an id are found too; one row of each group stays."""
    rng = np.random.default_rng(6)
    words = [[f"w{k}" for k in rng.integers(0, 10**6, 100)] for _ in range(3)]
    near = [" ".join([*w[:-1], "other"]) for w in words]
    a, b, c = (" ".join(w) for w in words)
    rows = [(1, a), (1, b), (2, near[0]), (3, near[1]), (None, c), (None, c), (None, near[0]), (1, a), (7, "x " * 60_000), (8, "x " * 60_000 + "y"), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit("clash"), "group": F.lit("clash")})
    for shuffled in (docs, docs.orderBy(F.rand(1)), docs.orderBy(F.rand(2))):
        got = Counter(tuple(r) for r in near_text.near_duplicates(shuffled).collect())
        assert got == Counter([(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (None, None, True), (None, None, True), (7, 7, True), (8, 7, False), (9, 9, True), (9, 9, True)])
    kept = near_text.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, min((a, b), key=lambda t: __import__("hashlib").md5(t.encode()).hexdigest())), (None, c), (7, "x " * 60_000), (9, ""), (9, ""), (None, None)])


def test_pair_table_finds_every_pair():
    from bitlake.llm import bpe

    pairs = {left * bpe.PAIR + right: left + right for left in range(0, 50_000, 97) for right in range(0, 50_000, 601)}
    shifts, slots = bpe.placed(pairs)
    for key, rank in pairs.items():
        slot = slots[key * bpe.MIX % bpe.SLOTS + shifts[(key * bpe.MIX >> 34) & (bpe.BUCKETS - 1)]]
        assert (slot >> 17, slot & (bpe.PAIR - 1)) == (key, rank)


def test_near_vectors_of_repeated_ids(spark):
    """Rows of one id are one node, of several vectors or of one; its rows show the same result. The SQL says the same."""
    import duckdb

    from bitlake.llm import queries_near

    e = lambda *hot: [1.0 if i in hot else 0.0 for i in range(6)]
    rows = [(5, e(0), 1), (5, e(1), 1), (3, e(0), 1), (4, e(1), 1), (7, e(1), 1), (8, e(2), 1), (8, e(2), 1), (9, e(3), 2), (9, e(4), 3), (2, e(4), 3), (10, [1e-200 * c for c in e(5)], 1), (11, [1e200 * c for c in e(5)], 1), (12, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"rep": F.lit("clash"), "n": F.lit("clash"), "component": F.lit("clash")})
    got = Counter(map(tuple, near_vectors.near_duplicates(df).collect()))
    assert got == Counter([(5, 3, 3, False)] * 2 + [(3, 1, 3, True), (4, 2, 3, False), (7, 2, 3, False)] + [(8, 2, 8, True)] * 2 + [(9, 1, 2, False)] * 2 + [(2, 1, 2, True), (10, 1, 10, True), (11, 1, 10, False), (12, 0, 12, True)])
    con = duckdb.connect()
    con.sql("create table embeddings (vec_id bigint, embedding double[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", [r for r in rows if r[0] not in (10, 11)])
    assert Counter(con.sql(queries_near.SQL["op2_near_vectors"]).fetchall()) == Counter({r: n for r, n in got.items() if r[0] not in (10, 11)})


def star(members: int, dim: int = 64, cosine: float = 0.982) -> np.ndarray:
    """A base and members at that cosine to it, few of them linked to each other."""
    rng = np.random.default_rng(8)
    base = np.eye(dim)[0]
    away = rng.standard_normal((members, dim))
    away[:, 0] = 0
    away /= np.linalg.norm(away, axis=1)[:, None]
    return np.concatenate([base[None, :], cosine * base + np.sqrt(1 - cosine**2) * away])


def test_near_vectors_of_a_large_star(spark):
    x = star(5_000)
    far = np.random.default_rng(9).standard_normal((500, 64))
    x = np.concatenate([x, far / np.linalg.norm(far, axis=1)[:, None]])
    ids = np.random.default_rng(10).permutation(len(x))
    rows = [(int(i), [float(c) for c in v], 0) for i, v in zip(ids, x, strict=True)]
    got = {r.vec_id: r for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links = (x @ x.T >= 0.98).sum(1) - 1
    assert links[0] == 5_000 and not links[5_001:].any()
    least = int(ids[:5_001].min())
    assert [got[int(i)].n_links for i in ids] == links.tolist()
    assert [got[int(i)].component_id for i in ids] == [least] * 5_001 + ids[5_001:].tolist()


@pytest.mark.parametrize("n", [64, 256, 320, 448, 512, 576])
def test_every_sample_is_in_a_frame(n):
    """Payloads that differ in their last samples only have different peaks; whole hops have the frames they had."""
    tone = (128 + 100 * np.sin(np.arange(64) * 2 * np.pi * 30 / media.FRAME)).astype(np.uint8).tobytes()
    quiet = bytes([128]) * n
    times, bins = media.peaks(quiet[:-64] + tone)
    assert len(media.peaks(quiet)[0]) == 0 and len(bins) and times.max() == max(0, -(-(n - media.FRAME) // media.HOP))


def test_token_totals_cover_the_whole_table(spark):
    import duckdb

    from bitlake.llm import queries_native
    from tests.conftest import DATA

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    rows = queries_native.QUERIES["op5_token_totals"](spark, DATA).select("source", "lang", "version", "docs", "tokens").collect()
    assert Counter(map(tuple, rows)) == Counter(con.sql(queries_native.SQL["op5_token_totals"]).fetchall())
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(sum(r.docs for r in rows if r.version == v) == n for v in ("words-1", "pieces-2"))


def test_token_totals_by_the_tokenizer(spark):
    import tiktoken

    from bitlake.llm import queries_bpe
    from tests.conftest import DATA

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, tokens = Counter(), Counter()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        docs[r.source, r.lang] += 1
        tokens[r.source, r.lang] += len(own.encode_ordinary(r.text or ""))
    got = queries_bpe.op5_bpe_totals(spark, DATA).collect()
    assert {(r.source, r.lang): (r.version, r.docs, r.tokens) for r in got} == {k: ("byte-bpe-50k", docs[k], tokens[k]) for k in docs}


def test_url_filter_in_odd_cases(spark):
    """Empty pages, no rules, two verdicts for one key, and columns with the names that the operator uses."""
    rules = spark.createDataFrame([("a.com", "/", "allow"), ("a.com", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/", "x"), (1, "http://a.com/", "x"), (None, "://", "x")], "page_id long, url string, host string").withColumns({"key": F.lit("clash"), "block": F.lit(1), "found": F.lit(0)})
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect())
    assert got == {(1, "a.com", "/", "a.com/", "block"): 2, (None, "", "", None, "allow"): 1}
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_more_than_64_languages(spark):
    """Languages of one word each, whose letters no other has, are all told apart; those of few rows too."""
    word = lambda i: "".join(chr(0x4E00 + 4 * i + k) for k in range(4))
    rows = [(" ".join([word(i)] * 5), f"l{i:03}") for i in range(130) for _ in range(1 if i % 2 else 2)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.predict([word(i) for i in range(130)])[0] == [f"l{i:03}" for i in range(130)]


def test_unknown_language_is_rejected(spark, none):
    """Clean documents stay, repeated rows too; other scripts, junk with a known word, and texts without a letter go."""
    import corpus_pipeline
    from tests.conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    n = docs.count()
    odd = ["Привет мир, это русский текст", "xqzjk vvwqx zzkqj qwrtpsdfg hjklzxcvb", "Привет мир, это the русский текст", "12 34 !!", "", None]
    extra = spark.createDataFrame([(-1 - i, t, None, None, 0) for i, t in enumerate(odd)], docs.schema)
    kept = corpus_pipeline.reject_unknown_language(spark, docs.unionAll(docs.limit(1)).unionAll(extra), DATA)
    assert kept.where("doc_id < 0").count() == 0 and kept.count() == n + 1
    assert corpus_pipeline.reject_unknown_language(spark, none, DATA).count() == 0
