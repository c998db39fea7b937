"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding undoes disguises: compatibility forms, accents on Latin letters kept apart from look-alikes of other scripts,
digits and signs inside words, invisible characters. Weights of the general entries below and of words found in the
labelled rows (by Dunning's likelihood ratio) are log odds; a logistic curve over the length-normalised sum, fitted
on other labelled rows than the words, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitlake.llm.common import logistic, sample_labels

# General insults and abuse.
LEXICON = """
idiot moron imbecile stupid dumb dumbass retard loser scum trash garbage filth vermin worthless pathetic disgusting
clown fool jerk bastard bitch bullshit shit crap asshole arsehole prick dickhead wanker twat cunt fuck fucker fucking
motherfucker slut whore douche douchebag scumbag lowlife degenerate pig swine cretin halfwit nitwit dimwit simpleton
subhuman parasite pervert creep freak coward liar psycho hateful kill yourself shut up go die
dummkopf vollidiot arschloch schlampe hurensohn missgeburt wichser abschaum drecksack miststück fotze scheisse
connard connasse salope enculé putain merde ordure abruti débile crétin imbécile pourriture batard
gilipollas imbécil estúpido idiota cabrón puta mierda pendejo basura maldito hijo de puta asqueroso inútil payaso
""".split()
PHRASES = ["kill yourself", "shut up", "go die", "piece of trash", "piece of shit", "hijo de puta"]
COMMON = {"kill", "yourself", "shut", "up", "go", "die", "hijo", "de", "pig", "fool", "creep", "freak", "liar", "inútil"}
#: Phrases in which an entry is no insult; their matches are taken back.
EXCEPTIONS = ["trash can", "trash bag", "trash collection", "garbage collection", "garbage collector", "garbage can", "clown fish", "guinea pig", "scum line", "pond scum", "loser bracket", "dumb waiter"]
# Look-alike letters of other scripts, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕкмтнвгԁԛѡαβεικνορτυχωηɑɡıⅼ", "aeopcyxijskmthbrdqwabeiknoptuxwnagil", strict=True))
DIGITS = dict(zip("01345789@$!€", "oieastbgasie", strict=True))
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
OTHER = str.maketrans(HOMOGLYPHS) | INVISIBLE
#: Words with a digit or sign between letters; figures by themselves stay as they are.
DISGUISED = re.compile(r"[a-zà-ÿ]+[01345789@$!€][\w@$!€]*|[01345789@$€][01345789@$!€]*[a-zà-ÿ][\w@$!€]*")
SPACED = re.compile(r"\b\w(?:[.\-_*]\w){2,}\b")
WORDS = re.compile(r"[^\W\d_]+")
MAX_LABELLED = 50_000


def fold(text: str) -> str:
    """Lower-case text with disguises undone."""
    import unicodedata

    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(OTHER)
    text = DISGUISED.sub(lambda m: "".join(DIGITS.get(c, c) for c in m[0].rstrip("!")), text)
    return SPACED.sub(lambda m: re.sub(r"[.\-_*]", "", m[0]), text)


def spread(term: str) -> str:
    """Words between double spaces, so that neighbours share none and each can match."""
    return " " + "  ".join(term.split()) + " "


def automaton(weights: dict[str, float], exceptions: list[str] = EXCEPTIONS):
    """An Aho-Corasick automaton of the entries; an exception's weight takes its entries' weights back."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, w in weights.items():
        a.add_word(spread(term), w)
    for phrase in exceptions:
        lost = sum(w for term, w in weights.items() if f" {term} " in f" {phrase} ")
        if lost:
            a.add_word(spread(phrase), weights.get(phrase, 0) - lost)
    a.make_automaton()
    return a


def features(text: str | None, a) -> tuple[float, float, float]:
    """(log of the weight found, weight a hundred words, share of words found)."""
    if not text:
        return 0.0, 0.0, 0.0
    words = WORDS.findall(fold(text))
    found = [w for _, w in a.iter(spread(" ".join(words)))]
    total, n = max(0.0, sum(found)), len(words)
    return math.log1p(total), total / math.sqrt(n + 10), len(found) / (n + 10)


class Model:
    """Entries with weights and the curve (weights of the three features and an intercept)."""

    def __init__(self, weights: dict[str, float], curve: list[float]):
        self.weights, self.curve = weights, curve

    def score(self, texts: pd.Series) -> pd.Series:
        a = automaton(self.weights)
        c = self.curve
        rows = (features(t, a) for t in texts)
        return pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, x * c[0] + y * c[1] + z * c[2] + c[3])))) for x, y, z in rows], dtype="float64")


def _mined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n = Counter()
        for text, y in zip(pdf["text"], pdf["y"], strict=True):
            n.update((w, y) for w in {w for w in WORDS.findall(fold(text or ""))})
        if n:
            yield pd.DataFrame([(w, y, k) for (w, y), k in n.items()], columns=["word", "y", "n"])


def fit(labelled: DataFrame, general: list[str] = LEXICON, least: float = 10.0) -> Model:
    """A model from (id, text, y) rows, a bounded sample; half of them weigh the words, half fit the curve.

    A word enters with a likelihood ratio of `least` or more in favour of label 1. With no labelled rows, or one label
    only, the general entries count 3 each and the curve is a default.
    """
    part = F.crc32(F.concat(F.lit("half:"), F.col("id").cast("string")).cast("binary")) % 2
    rows = labelled.withColumn("half", F.coalesce(part, F.lit(0))).repartition(labelled.sparkSession.sparkContext.defaultParallelism * 2, "id").persist()
    size = {(r["half"], r["y"]): r["n"] for r in rows.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get((0, 1), 0), size.get((0, 0), 0)
    weights = {w: 3.0 for w in general if w not in COMMON} | dict.fromkeys(PHRASES, 3.0)
    if not pos or not neg or not size.get((1, 1)) or not size.get((1, 0)):
        rows.unpersist()
        return Model(weights, [1.5, 0.5, 0.0, -3.0])
    counts = rows.where("half = 0").select("text", "y").mapInPandas(_mined, "word string, y int, n long")
    counts = counts.groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    p = (F.col("a") + F.col("b")) / F.lit(float(pos + neg))
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    ratio = 2 * (term(F.col("a"), p * pos) + term(F.col("b"), p * neg))
    odds = F.log((F.col("a") + 0.1) / F.lit(pos + 1.0)) - F.log((F.col("b") + 0.1) / F.lit(neg + 1.0))
    known = list(weights)
    found = counts.withColumn("g2", ratio).withColumn("odds", odds).where(((F.col("g2") >= least) & (F.col("odds") >= 2)) | F.col("word").isin(known))
    for r in found.orderBy(F.desc("g2"), "word").collect():
        weights[r["word"]] = min(6.0, r["odds"]) if r["word"] not in known else max(0.5, min(6.0, r["odds"])) if r["a"] + r["b"] >= 5 else 3.0

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton(weights)
        for pdf in batches:
            yield pd.DataFrame([(*features(t, a), y) for t, y in zip(pdf["text"], pdf["y"], strict=True)], columns=["f0", "f1", "f2", "y"])

    fitted = rows.where("half = 1").select("text", "y").mapInPandas(measured, "f0 double, f1 double, f2 double, y int").toPandas()
    rows.unpersist()
    curve = logistic(fitted[["f0", "f1", "f2"]].to_numpy(), fitted["y"].to_numpy().astype(float))
    return Model(weights, list(map(float, curve)))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, keep, most: int = MAX_LABELLED) -> DataFrame:
    """(id, text, y) of at most about `most` labelled documents for which keep(id) holds; their ids are broadcast.

    The largest of a document's labels holds; null ids and labels other than 0 and 1 are none; rows that repeat an id are rows each.
    """
    labels = labels.where(F.col(label).isin(0, 1) & keep(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(sample_labels(labels, most).select(F.col("doc_id").alias("id"), "y")), "id")


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with column score, which replaces one of that name.

    Null and empty texts score as texts without a match; any length is read whole; equal texts have equal scores, so
    repeated rows and ties do; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield shared.value.score(t)

    return docs.withColumn("score", score(F.col(text_col)))

