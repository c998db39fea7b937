"""Each stage of the corpus pipeline on all its input, against plain recomputations and in odd cases."""

import base64
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitlake.llm import mixing, near_text, queries_text, toxicity
from tests.conftest import DATA
from tests.llm.test_brute_force import naive_features

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None, None, None, None), (-1, None, "en", "a", 0), (-2, "", None, None, 0), (-2, "", None, None, 0), (-3, "x " * 40_000, None, "a", 80_000), (None, "one two three four five six", "en", "b", 28), (None, "one two three four five six", "en", "b", 28)]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{DATA}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    return own.unionAll(spark.createDataFrame(ODD, SCHEMA)).withColumns({"score": F.lit("clash"), "digest": F.lit("clash"), "n": F.lit("clash"), "size": F.lit("clash")})


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_empty_and_columns(spark, docs, stage):
    """An empty table gives an empty result; every stage but the last gives the columns of documents, without columns that were added."""
    out = stage[1](spark, spark.createDataFrame([], SCHEMA), DATA)
    assert out.count() == 0
    if stage[0] != "byte_bpe":
        assert out.columns == corpus_pipeline.COLUMNS and stage[1](spark, docs.limit(5), DATA).columns == corpus_pipeline.COLUMNS


def rows(df) -> Counter:
    return Counter(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()))


def test_toxicity_stage(spark, docs):
    kept = corpus_pipeline.reject_toxic(spark, docs, DATA)
    model = queries_text.toxicity_model(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    import math

    score = lambda t: 1 / (1 + math.exp(-max(-30, min(30, sum(f * c for f, c in zip((*naive_features(t, model.weights), 1.0), model.curve, strict=True))))))
    assert rows(kept) == Counter({r: n for r, n in rows(docs).items() if score(r[1]) < 0.5})
    assert isinstance(model, toxicity.Model)


def test_near_stage(spark, docs):
    """One row of each class stays, that of the smallest id; rows in no group all stay."""
    kept = rows(corpus_pipeline.drop_near_copies(spark, docs, DATA))
    classes = {r.doc_id: r.class_id for r in near_text.near_duplicates(docs).collect()}
    want = Counter()
    for r, n in rows(docs).items():
        if not (r[1] or "").split():
            want[r] = n
        elif r[0] is None or classes[r[0]] == r[0]:
            want[r] = 1
    assert kept == want


def test_mix_stage(spark, docs):
    shares = {(r.doc_id, r.size): r.taken for r in mixing.taken(docs).collect() if r.doc_id is not None and r.size}
    got = rows(corpus_pipeline.mix_sources(spark, docs, DATA))
    import re

    for r, n in rows(docs).items():
        size = len(re.findall(mixing.WORD, r[1] or ""))
        if r[0] is not None and size:
            assert got[r] == n * int(shares[r[0], size] / size + 0.5)
        else:
            assert got[r] == n
    assert rows(corpus_pipeline.mix_sources(spark, docs, DATA)) == got


def test_bpe_stage(spark, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.encode_tokens(spark, docs, DATA).collect()
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in out)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((i, tuple(own.encode_ordinary(t or ""))) for (i, t, *_), n in rows(docs).items() for _ in range(n))


def test_run_chains_the_stages(spark):
    """Each stage works on what the one before it kept; ids of the result are those of kept documents."""
    out = corpus_pipeline.run(spark, DATA).collect()
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    ids = {r.doc_id for r in out}
    assert 0.3 * n < len(ids) <= n and all(r.lossless for r in out)
