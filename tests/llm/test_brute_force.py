"""Operators that SQL cannot express against plain recomputations: dense, naive and in one process."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bitlake.llm import common, language, media, near_text, quality, queries_media, queries_text, toxicity
from tests.conftest import DATA


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def dft_peaks(samples: bytes) -> list[tuple[int, int]]:
    """(frame, bin) of the peaks by the transform's definition, frame by frame."""
    x = [s - 128 for s in samples]
    n = media.FRAME
    x += [0] * (n - len(x) if len(x) < n else -(len(x) - n) % media.HOP)
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]
    turns = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    found = []
    for frame, at in enumerate(range(0, len(x) - n + 1, media.HOP)):
        size = np.abs(turns @ (np.array(x[at : at + n]) * window))
        for lo, hi in media.BANDS:
            best = max(range(lo, hi), key=lambda b: size[b])
            if size[best] > media.OVER * size[lo:hi].mean() + 1e-3:
                found.append((frame, best))
    return found


def test_media_columns(spark, docs):
    """All columns of the query for whole texts: bytes, digests, the file's form and the fingerprint."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries_media.op6_media(spark, DATA).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        header = b"RIFF" + (36 + len(padded)).to_bytes(4, "little") + b"WAVEfmt " + b"".join(v.to_bytes(k, "little") for v, k in ((16, 4), (1, 2), (1, 2), (media.RATE, 4), (media.RATE, 4), (1, 2), (8, 2))) + b"data" + len(padded).to_bytes(4, "little")
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(padded), len(header) + len(padded))
        assert (r.payload_sha256, r.media_sha256, r.tail_crc32) == (hashlib.sha256(padded).hexdigest(), hashlib.sha256(header + padded).hexdigest(), zlib.crc32(padded[-64:]))
        if len(padded) > 20_000:
            continue  # the definition's sums take long
        peaks = dft_peaks(padded)
        pairs = sorted((t, (b << 16) | (c << 8) | (u - t)) for i, (t, b) in enumerate(peaks) for u, c in peaks[i + 1 : i + 1 + media.FAN] if u - t < 256)
        codes = ",".join(str(t) for t, _ in pairs) + ";" + ",".join(str(p) for _, p in pairs)
        assert r.feature == f"{len(pairs)}:{hashlib.md5(codes.encode()).hexdigest()}"


def test_language_filter_equals_exact_sets(docs):
    """Counts of the bit-sliced filter are those of exact n-gram sets, up to its false positives; so are the languages."""
    rows = [(r.text, r.lang) for r in docs.where("text is not null and lang is not null").collect()]
    model = language.fit(docs.select("text", "lang").where("text is not null"))

    def grams(text: str) -> Counter:
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        return Counter(g for w in words for n in language.LENGTHS for s in [f" {w} "] for g in (s[i : i + n] for i in range(len(s) - n + 1)))

    counts = defaultdict(Counter)
    for text, lang in rows:
        counts[lang].update(grams(text))
    total = {x: sum(c.values()) for x, c in counts.items()}
    every = sum(counts.values(), Counter())
    rate = {x: {g: counts[x][g] / total[x] for g in counts[x]} for x in counts}
    top = {g: max(rate[x].get(g, 0) for x in counts) for g in every}
    sets = {x: {g for g in counts[x] if every[g] >= language.LEAST and rate[x][g] >= language.SHARE * top[g]} for x in counts}
    texts = [t for t, _ in rows]
    langs, scores, known = model.predict(texts)
    for text, lang, score, share in zip(texts, langs, scores, known, strict=True):
        n = grams(text)
        if not n:
            assert lang == "und"
            continue
        hits = {x: sum(k for g, k in n.items() if g in sets[x]) for x in sets}
        best = max(sorted(hits), key=lambda x: hits[x])
        assert lang == best
        assert abs(share - hits[best] / sum(n.values())) < 0.02 and abs(score - hits[best] / sum(hits.values())) < 0.03


def test_language_query_learns_only_what_it_may(spark):
    out = queries_text.op7_language_id(spark, DATA).toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    truth = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id").lang
    good = out[out.held_out & out.doc_id.map(truth).notna() & (out.lang_pred != "und")]
    assert (good.lang_pred == good.doc_id.map(truth)).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_samples_each_language_and_no_row_without_an_id(spark):
    rows = [(i, "text", "aa") for i in range(900)] + [(1000 + i, "text", "bb") for i in range(5)] + [(None, "text", "cc")]
    kept = language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lambda c: common.remainder(c, 4) != 2, most=100)
    n = Counter(r.lang for r in kept.collect())
    assert n["bb"] == sum(zlib.crc32(str(1000 + i).encode()) % 4 != 2 for i in range(5)) and 20 < n["aa"] < 90 and "cc" not in n


def naive_features(text: str, weights: dict[str, float]) -> tuple[float, float, float]:
    words = toxicity.WORDS.findall(toxicity.fold(text or ""))
    entries = dict(weights)
    for phrase in toxicity.EXCEPTIONS:
        if lost := sum(w for term, w in weights.items() if f" {term} " in f" {phrase} "):
            entries[phrase] = weights.get(phrase, 0) - lost
    found = [w for term, w in entries.items() for i in range(len(words)) if words[i : i + len(term.split())] == term.split()]
    total = max(0.0, sum(found))
    return math.log1p(total), total / math.sqrt(len(words) + 10), len(found) / (len(words) + 10)


def test_toxicity_equals_naive_matching_and_fitting(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    keep = lambda c: F.coalesce(common.remainder(c, 5) != 0, F.lit(False))
    labelled = toxicity.labelled_rows(docs, labels, "toxic", keep)
    model = toxicity.fit(labelled)
    rows = labelled.collect()
    half = [r for r in rows if zlib.crc32(f"half:{r.id}".encode()) % 2 == 0]
    pos, neg = sum(r.y == 1 for r in half), sum(r.y == 0 for r in half)
    if pos and neg and len(model.weights) > 1:
        a, b = Counter(), Counter()
        for r in half:
            (a if r.y else b).update({w for w in toxicity.WORDS.findall(toxicity.fold(r.text or "")) if 3 <= len(w) <= 40})
        general = {w for w in toxicity.LEXICON if w not in toxicity.COMMON} | set(toxicity.PHRASES)
        for word in set(a) | set(b):
            odds = math.log((a[word] + 0.1) / (pos + 1)) - math.log((b[word] + 0.1) / (neg + 1))
            p = (a[word] + b[word]) / (pos + neg)
            g2 = 2 * sum(k * math.log(k / e) for k, e in ((a[word], p * pos), (b[word], p * neg)) if k)
            if word in general:
                want = max(0.5, min(6.0, odds)) if a[word] + b[word] >= 5 else 3.0
            else:
                want = min(6.0, odds) if g2 >= 10 and odds >= 2 else None
            assert model.weights.get(word) == (pytest.approx(want) if want is not None else None)
    a = toxicity.automaton(model.weights)
    texts = [r.text for r in docs.collect()] + ["you 1d10t, shut up and go die", "trash can idiot trash", "son of a trash can", "", None]
    for text in texts:
        assert toxicity.features(text, a) == pytest.approx(naive_features(text, model.weights))


def test_toxicity_of_conflicting_labels(spark):
    """A document with both labels counts as toxic whatever the order of its rows; repeated rows have one score."""
    docs = spark.createDataFrame([(i, f"word{i}") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    for rows in (labels, labels.orderBy(F.desc("toxic"))):
        got = toxicity.labelled_rows(docs, rows, "toxic", lambda c: F.lit(True)).collect()
        assert {(r.id, r.y) for r in got} == {(1, 1), (2, 0)} and len(got) == 2
    model = toxicity.Model({"bad": 3.0}, [1.5, 0.5, 0.0, -3.0])
    again = spark.createDataFrame([(1, "so bad", "x"), (1, "so bad", "x"), (2, None, "x")], "doc_id long, text string, score string")
    got = [(r.doc_id, r.score) for r in toxicity.scored(again, model).collect()]
    assert len(set(got)) == 2 and len(got) == 3


def test_quality_equals_dense_newton(spark, docs):
    """Scores of all documents are those of co-training on one dense matrix for each view."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.score(docs, labels).toPandas().set_index("doc_id")
    views = quality.views(docs).toPandas()
    y = views.doc_id.map(labels.where("quality in (0, 1)").toPandas().groupby("doc_id").quality.max()).to_numpy(float)
    fit = np.array([zlib.crc32(f"part:{i}".encode()) % 4 != 0 for i in views.doc_id])
    x = [np.hstack([np.stack([np.frombuffer(b, np.float32) for b in views[c]]).astype(float), np.ones((len(views), 1))]) for c in ("content", "meta")]
    w = [np.zeros(v.shape[1]) for v in x]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def step(w, teachers):
        out = []
        for v in (0, 1):
            target, weight = np.where(fit, y, np.nan), np.ones(len(y))
            if teachers is not None:
                p = sigmoid(x[1 - v] @ teachers[1 - v])
                sure = np.isnan(y) & ((p >= 0.95) | (p <= 0.05))
                target[sure], weight[sure] = p[sure] >= 0.5, 0.3
            ok = ~np.isnan(target)
            xs, k, p = x[v][ok], weight[ok], sigmoid(x[v][ok] @ w[v])
            penalty = np.full(xs.shape[1], 1e-4 * k.sum())
            penalty[-1] = 1e-3
            hessian = (xs * (k * p * (1 - p) + 1e-6)[:, None]).T @ xs + np.diag(penalty)
            out.append(w[v] - np.linalg.solve(hessian, xs.T @ (k * (p - target[ok])) + penalty * w[v]))
        return out

    for _ in range(4):
        w = step(w, None)
    for _ in range(2):
        teachers = w
        for _ in range(2):
            w = step(w, teachers)
    z = np.stack([np.clip(x[v] @ w[v], -30, 30) for v in (0, 1)], 1)
    held = ~fit & ~np.isnan(y)
    curve = common.logistic(z[held], y[held], ridge=1e-4)
    want = sigmoid(z @ curve[:2] + curve[2])
    assert np.abs(got.score.reindex(views.doc_id).to_numpy() - want).max() < 1e-4


def test_near_text_finds_the_links_of_all_pairs(spark):
    """On all documents of sf0.01 the classes are the components of all pairs of 0.8 or more: recall is 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    grams, holders = {}, defaultdict(list)
    for i, t in texts.items():
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        grams[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
        for g in grams[i]:
            holders[g].append(i)
    shared = Counter((a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k])
    group = {i: i for i in texts}

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    links = 0
    for (a, b), n in shared.items():
        x, y = grams[a], grams[b]
        if n / min(len(x), len(y)) < 0.5:
            continue  # too few shared shingles, whatever their weights: none of the texts repeats one that often
        both = x | y
        if sum(1 / sum(max(x[u] / x[d], y[u] / y[d]) for u in both) for d in x if d in y) >= 0.8:
            links += 1
            low, high = sorted((root(a), root(b)))
            group[high] = low
    got = {r.doc_id: r.class_id for r in near_text.near_duplicates(docs).collect()}
    assert links > 20 and got == {i: root(i) for i in texts}
