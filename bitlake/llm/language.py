"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds every language: each of its slots has a bit a language, in as many words of 64 as the
languages need, and an n-gram's languages are the AND of its K slots. There are PER_GRAM slots or more for each n-gram
of the language that has most. A text's n-grams are looked up, the bits of each language counted, the counts corrected
for that language's false positives, and the largest decides. An n-gram belongs to a language if its relative
frequency there is at least SHARE of its largest in any language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitlake.llm.common import fresh

K, LENGTHS, SHARE, LEAST = 3, (2, 3, 4), 0.34, 2
#: Slots for each n-gram, which keep at least three in four bits of a language clear, and slots at least.
PER_GRAM, LEAST_SLOTS = 12, 1 << 16
MAX_LABELLED = 30_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_letters = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once in each worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts and each one's text number; words are lower-cased and set between spaces."""
    hashes, owners = [], []
    joined = [(" " + (t or "").lower() + " ") for t in texts]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    cp = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(joined)), sizes)
    ok = letters()[cp]
    cp = np.where(ok, cp, 32)
    keep = np.ones(len(cp), bool)
    keep[1:] = ok[1:] | ok[:-1] | (doc[1:] != doc[:-1])  # runs of other characters shrink to one space
    cp, doc = cp[keep].astype(np.uint64), doc[keep]
    for n in LENGTHS:
        if len(cp) < n:
            continue
        h = np.full(len(cp) - n + 1, n, np.uint64)
        blank = np.zeros(len(h), bool)
        for i in range(n):
            part = cp[i : len(cp) - n + 1 + i]
            h = (h ^ part) * _M1
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1:
                blank |= part == 32  # no n-gram runs over a word's end
        if n == 2:
            blank |= (cp[: len(h)] == 32) & (cp[1:] == 32)
        good = ~blank & (doc[: len(h)] == doc[n - 1 :])
        hashes.append(h[good])
        owners.append(doc[: len(h)][good])
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def slots(h: np.ndarray, of: int) -> list[np.ndarray]:
    """The K slots of each n-gram, among this many."""
    second = (h * _M2) >> np.uint64(40)
    first = h >> np.uint64(20)
    return [((first + np.uint64(i) * (second | np.uint64(1))) % np.uint64(of)).astype(np.int64) for i in range(K)]


def chunks(texts: list, size: int = 100_000) -> Iterator[tuple[int, list]]:
    """Runs of texts of about `size` characters and where each begins; memory does not follow the batch."""
    at, n, part = 0, 0, []
    for i, t in enumerate(texts):
        part.append(t)
        n += len(t or "")
        if n >= size:
            yield at, part
            at, n, part = i + 1, 0, []
    if part:
        yield at, part


class Model:
    def __init__(self, langs: list[str], words: np.ndarray):
        """words: (languages / 64, slots); language j has bit j % 64 of row j // 64."""
        self.langs, self.words = langs, words
        bits = np.array([np.count_nonzero(words[j // 64] & np.uint64(1 << j % 64)) for j in range(len(langs))])
        self.fpr = (bits / words.shape[1]) ** K if langs else np.zeros(1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and known shares: the best language's corrected count in the sum over languages, and in the text's n-grams."""
        out, scores, known = [], [], []
        for _, part in chunks(texts):
            h, doc = ngrams(part)
            at = slots(h, self.words.shape[1])
            masks = [row[at[0]] for row in self.words]
            for mask, row in zip(masks, self.words, strict=True):
                for s in at[1:]:
                    mask &= row[s]
            n = np.bincount(doc, minlength=len(part))
            hits = np.stack([np.bincount(doc, weights=(masks[j // 64] >> np.uint64(j % 64)) & np.uint64(1), minlength=len(part)) for j in range(len(self.langs))], 1) if self.langs else np.zeros((len(part), 1))
            true = np.maximum(0, (hits - n[:, None] * self.fpr) / (1 - self.fpr + 1e-9))
            best, total = true.argmax(1), true.sum(1)
            score = np.where(total > 0, true.max(1) / np.maximum(total, 1e-9), 0.0)
            out += [self.langs[b] if k and self.langs else "und" for b, k in zip(best, n, strict=True)]
            scores.append(np.clip(score, 0, 1))
            known.append(np.clip(true.max(1) / np.maximum(n, 1), 0, 1))
        return out, *(np.concatenate(x) if x else np.zeros(0) for x in (scores, known))


def fit(labelled: DataFrame) -> Model:
    """A model from (text, lang) rows, a bounded sample. Each language of the rows has a bit; none gives `und` for all."""
    langs = sorted(r["lang"] for r in labelled.where("lang is not null").select("lang").distinct().collect())
    index = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, rows in pdf.groupby("lang"):
                for _, part in chunks(rows["text"].tolist(), 4_000_000):
                    h, k = np.unique(ngrams(part)[0], return_counts=True)
                    yield pd.DataFrame({"h": h.view(np.int64), "lang": index[lang], "n": k})

    n = labelled.where(F.col("lang").isin(langs)).select("text", "lang").mapInPandas(count, "h long, lang int, n long").groupBy("h", "lang").agg(F.sum("n").alias("n")).persist()
    total = {r["lang"]: r["n"] for r in n.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.element_at(F.array(*(F.lit(float(total.get(i, 1))) for i in range(len(langs)))) if langs else F.array(F.lit(1.0)), F.col("lang") + 1)
    rates = n.withColumn("r", rate).groupBy("h").agg(F.collect_list(F.struct("lang", "r")).alias("rs"), F.max("r").alias("top"), F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    rows = max(1, -(-len(langs) // 64))

    def mask(row: int) -> Column:
        own = F.filter("rs", lambda x: (x["r"] >= F.col("top") * SHARE) & (x["lang"] >= 64 * row) & (x["lang"] < 64 * row + 64))
        bits = F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["lang"] - 64 * row)))
        return F.struct(F.lit(row).alias("row"), bits.alias("mask"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in slots(pdf["h"].to_numpy().view(np.uint64), of):
                yield pd.DataFrame({"row": pdf["row"], "slot": s, "mask": pdf["mask"]})

    own = F.filter("rs", lambda x: x["r"] >= F.col("top") * SHARE)
    most = rates.select(F.explode(own).alias("x")).groupBy("x.lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    of = max(LEAST_SLOTS, 1 << (PER_GRAM * most - 1).bit_length()) if most else LEAST_SLOTS
    masks = rates.select("h", F.explode(F.array(*(mask(row) for row in range(rows)))).alias("m")).select("h", "m.row", "m.mask").where("mask <> 0")
    filled = masks.mapInPandas(put, "row int, slot long, mask long").groupBy("row", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # `of` rows at most for each 64 languages
    words = np.zeros((rows, of), np.uint64)
    words[filled["row"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().astype(np.int64).view(np.uint64)
    n.unpersist()
    return Model(langs, words)


def training_rows(docs: DataFrame, keep, most: int = MAX_LABELLED) -> DataFrame:
    """(text, lang) of at most about `most` documents with a language for which keep(doc_id) holds, by the id's hash.

    Each language may give as many, so that a rare one has all its rows. Rows without an id, a text or a language are left out.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & keep(F.col("doc_id")))
    counts = rows.groupBy("lang").count().collect()  # one row a language
    each = max(1, most // max(1, len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "_lang string, _share double")
    chance = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_003)) / 1_000_003
    return rows.join(F.broadcast(shares), rows["lang"] == F.col("_lang")).where(chance < F.col("_share")).select("text", "lang")


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with columns lang_pred, score and known, which replace those of these names.

    `und` and 0 for null and empty texts and those without a letter. Of languages with equal counts the first by name
    is chosen; equal texts have equal results, so repeated rows do; texts of any length are read whole; an empty table
    gives an empty result.
    """
    found = fresh(docs, "found")[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double,known:double>")
    def identify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            langs, scores, known = shared.value.predict(t.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "known": known})

    return docs.withColumn(found, identify(F.col(text_col))).withColumns({c: F.col(f"{found}.{c}") for c in ("lang_pred", "score", "known")}).drop(found)
