"""Quality by co-training: a classifier of text content and one of page metadata label documents for each other.

Content view: shares of hashed words, word shapes and word repeats. Metadata view: source, language, size and layout
(lines, their lengths, shares of upper case, digits, punctuation). Each round, every document that carries no label
gets a pseudo-label from one view where that view is confident, and the other view is fitted anew on labels and
pseudo-labels. Both views' scores are calibrated on held-back labels and combined, and all documents are scored.

Newton's steps run over all documents: each task sums its rows' gradients and Hessians, Spark adds them up, and the
driver solves systems whose size is the number of features.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitlake.llm.common import cut, logistic

CONTENT, META, HASHED = 96, 40, 16
SHAPE = [(re.compile(r"[A-ZÀ-Þ]"), "A"), (re.compile(r"[a-zß-ÿ]"), "a"), (re.compile(r"\d"), "0")]
RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Letters and digits as classes, runs shortened: `Hello!!` is `Aa!`."""
    for pattern, c in SHAPE:
        word = pattern.sub(c, word)
    return RUN.sub(r"\1", word)[:12]


class Content:
    """Content features of texts; shapes and hashes of words are kept for a worker's later words."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, word: str) -> tuple[int, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[word] = (zlib.crc32(shape(word).encode()) % 40, 40 + zlib.crc32(word.lower().encode()) % 48)
        return found

    def row(self, text: str | None) -> np.ndarray:
        x = np.zeros(CONTENT, np.float32)
        words = text.split() if text else []
        if not words:
            x[95] = 1
            return x
        pairs = np.array([self.of(w) for w in words])
        n = len(words)
        x[:88] = np.bincount(pairs.ravel(), minlength=88)[:88] / n
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        x[88], x[89] = len(set(words)) / n, same / n
        x[90], x[91] = n < 20, min(1.0, 20 / n)
        x[92], x[93] = sum(map(len, words)) / n / 10, max(map(len, words)) / 40
        x[94] = np.log1p(n) / 10
        return x


def metadata(text: Column, lang: Column, source: Column, n_chars: Column) -> Column:
    """The metadata view as array<double>: layout measures, then hashed language and source."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    share = lambda pattern: F.coalesce(F.length(F.regexp_replace(t, pattern, "")) / n, F.lit(0.0))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    size = F.log1p(F.coalesce(n_chars, F.length(t)).cast("double")) / 10
    own = [size, size * size, F.log1p(lines) / 5, F.log1p(n / lines) / 10, 1 - share(r"\p{Lu}+"), 1 - share(r"\p{N}+"), 1 - share(r"\p{Punct}+"), 1 - share(" +")]
    hot = lambda c, seed: [F.when(F.pmod(F.xxhash64(F.lit(seed), F.coalesce(c, F.lit(""))), F.lit(HASHED)) == i, 1.0).otherwise(0.0) for i in range(HASHED)]
    return F.array(*(c.cast("double") for c in [*own, *hot(lang, "lang"), *hot(source, "source")]))


def views(docs: DataFrame) -> DataFrame:
    """(doc_id, content, meta): features of all documents as float32 bytes."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        content = Content()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": [content.row(t).tobytes() for t in pdf["text"]], "meta": [np.asarray(m, np.float32).tobytes() for m in pdf["meta"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", metadata(F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars")).alias("meta"))
    return rows.mapInPandas(extract, "doc_id long, content binary, meta binary")


def matrices(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    one = lambda col, d: np.hstack([np.frombuffer(b"".join(pdf[col]), np.float32).reshape(-1, d).astype(np.float64), np.ones((len(pdf), 1))])
    return one("content", CONTENT), one("meta", META)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def newton(rows: DataFrame, w: tuple[np.ndarray, np.ndarray], teachers: tuple[np.ndarray, np.ndarray] | None, confident: float, share: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """One Newton step of both views over all labelled and, with teachers, confidently pseudo-labelled rows."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(((d + 1) * (d + 2),)) for d in (CONTENT, META)]
        seen = np.zeros(2)
        for pdf in batches:
            x = matrices(pdf)
            y = pdf["y"].to_numpy(dtype=float, na_value=np.nan)
            fit = pdf["part"].to_numpy() != 0
            for v in (0, 1):
                target, weight = np.where(fit, y, np.nan), np.ones(len(y))
                if teachers is not None:
                    p = sigmoid(x[1 - v] @ teachers[1 - v])
                    sure = np.isnan(y) & ((p >= confident) | (p <= 1 - confident))
                    target, weight = np.where(sure, p >= 0.5, target), np.where(sure, share, 1.0)
                ok = ~np.isnan(target)
                if not ok.any():
                    continue
                xs, t, k = x[v][ok], target[ok], weight[ok]
                p = sigmoid(xs @ w[v])
                total[v][: xs.shape[1]] += xs.T @ (k * (p - t))
                total[v][xs.shape[1] :] += ((xs * (k * p * (1 - p) + 1e-6)[:, None]).T @ xs).ravel()
                seen[v] += k.sum()
        yield pd.DataFrame({"view": [0, 1], "n": seen, "sums": [t.tolist() for t in total]})

    parts = rows.mapInPandas(sums, "view int, n double, sums array<double>")
    added = parts.select("view", "n", F.posexplode("sums").alias("at", "s")).groupBy("view", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()
    out = []
    for v, d in ((0, CONTENT + 1), (1, META + 1)):
        own = added[added["view"] == v].sort_values("at")
        if own.empty or own["n"].iloc[0] == 0:
            out.append(w[v])
            continue
        s, n = own["s"].to_numpy(), own["n"].iloc[0]
        penalty = np.full(d, ridge * n)
        penalty[-1] = 1e-3
        out.append(w[v] - np.linalg.solve(s[d:].reshape(d, d) + np.diag(penalty), s[:d] + penalty * w[v]))
    return out[0], out[1]


def score(docs: DataFrame, labels: DataFrame, rounds: int = 2, steps: int = 4, confident: float = 0.95, pseudo_share: float = 0.3, ridge: float = 1e-4, calibration_rows: int = 20_000) -> DataFrame:
    """(doc_id, p_content, p_meta, score, predicted): one row for each row of docs.

    labels has doc_id and quality (0 or 1; others and nulls are no labels; the largest of a document's labels holds).
    A quarter of them, by the id's hash, calibrates: at most about calibration_rows, scored by both views, reach the
    driver. Null texts have the features of empty ones; texts of any length are read whole. Null ids carry no label.
    Repeated rows are rows each, with one score; an empty table gives an empty result; columns other than those of
    documents are not read. Without labels of both kinds every score is the share of label 1, or 0.5.
    """
    labelled = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    part = F.coalesce(F.crc32(F.concat(F.lit("part:"), F.col("doc_id").cast("string")).cast("binary")) % 4, F.lit(1))
    unnamed = views(docs.where("doc_id is null")).withColumn("y", F.lit(None).cast("double"))  # would all meet in one task of the join
    named = views(docs.where("doc_id is not null")).join(labelled, "doc_id", "left")
    rows = cut(named.unionByName(unnamed).withColumn("part", part), "quality-rows")
    w = (np.zeros(CONTENT + 1), np.zeros(META + 1))
    for _ in range(steps):
        w = newton(rows, w, None, confident, pseudo_share, ridge)
    for _ in range(rounds):
        teachers = w
        for _ in range(max(1, steps // 2)):
            w = newton(rows, w, teachers, confident, pseudo_share, ridge)

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = matrices(pdf)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "z0": x[0] @ w[0], "z1": x[1] @ w[1], "y": pdf["y"], "part": pdf["part"]})

    raw = rows.mapInPandas(scores, "doc_id long, z0 double, z1 double, y double, part long")
    held = raw.where("part = 0 and y is not null")
    n = held.count()
    if n > calibration_rows:
        held = held.where(F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(1_000_003)) < int(1_000_003 * calibration_rows / n))
    known = held.select("z0", "z1", "y").toPandas()
    y = known["y"].to_numpy(dtype=float)
    if 0 < y.sum() < len(y):
        z = np.clip(known[["z0", "z1"]].to_numpy(), -30, 30)
        one = [logistic(z[:, [v]], y, ridge=1e-4) for v in (0, 1)]
        both = logistic(z, y, ridge=1e-4)
    else:
        share = float(y.mean()) if len(y) else 0.5
        flat = np.log((share + 1e-3) / (1 - share + 1e-3))
        one, both = [np.array([0.0, flat])] * 2, np.array([0.0, 0.0, flat])
    clip = lambda c: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(c)))
    curve = lambda k, *c: 1 / (1 + F.exp(-(sum((clip(x) * float(a) for x, a in zip(c, k, strict=False)), F.lit(float(k[-1]))))))
    out = raw.select("doc_id", curve(one[0], "z0").alias("p_content"), curve(one[1], "z1").alias("p_meta"), curve(both, "z0", "z1").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
