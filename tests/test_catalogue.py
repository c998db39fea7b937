"""Each registered query of the decoder's operators against its SQL, and framing against literal vectors."""

from collections import Counter

import duckdb
import pytest

from bitlake.plans import catalogue
from bitlake.sources import framing

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "supplier", "lineitem", "events", "documents", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    mine, theirs = catalogue.QUERIES[name](spark, DATA), con.sql(catalogue.SQL[name])
    names = sorted(mine.columns)
    assert names == sorted(theirs.columns)
    assert Counter(map(tuple, mine.select(*(f"`{c}`" for c in names)).collect())) == Counter(theirs.select(*(f'"{c}"' for c in names)).fetchall())


def test_framing():
    data = b"\x00\x00\x00\x01\x67\xab\x00\x00\x01\x68\xcd\x00\x00\x00\x01\x65\x00\x00\x03\x01"
    assert list(framing.by_start_codes(data)) == [b"\x67\xab", b"\x68\xcd", b"\x65\x00\x00\x03\x01"]
    assert list(framing.by_start_codes(b"no code")) == []
    assert list(framing.by_length(b"\x00\x02ab\x00\x05abc", 2)) == [b"ab"]
    assert framing.unescape(b"\x00\x00\x03\x01\xab") == b"\x00\x00\x01\xab"


def test_units_table(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x00\x00\x01\x67\x01\x00\x00\x01\x80\x01")), (2, None), (3, bytearray())], "id long, data binary")
    assert [tuple(r)[:4] for r in framing.units(df, "id", "data").collect()] == [(1, 0, 3, 7)]
    bad = framing.units(df.unionAll(spark.createDataFrame([(4, bytearray(b"\x00\x01\x41\x00\x00\x00\x09a"))], df.schema)), "id", "data", 2, errors=True)
    got = {(r.id, r.unit_no, r.error) for r in bad.where("id = 4").collect()}
    assert got == {(4, 0, None), (4, None, "empty unit"), (4, None, "truncated unit")}


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_whole_queries_read_every_byte(spark):
    """Each of the queries of samples has one over whole texts, in groups that hold all bytes of a text in order."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id").text
    for width in sorted(set(catalogue.WHOLE.values())):
        rows = catalogue.groups(spark, DATA, width).toPandas().sort_values(["doc_id", "group_no"])
        for doc, part in rows.groupby("doc_id"):
            text = docs[doc].encode()
            groups = max(1, -(-len(text) // width))
            assert part.group_no.tolist() == list(range(groups))
            assert bytes(part.iloc[:, 2:].to_numpy().ravel().tolist()) == text + b"Q" * (groups * width - len(text))
    assert {f"whole_{name}" for name, sql in catalogue.SQL.items() if sql.startswith(catalogue.BYTES)} <= set(catalogue.QUERIES)
    values = lambda name: sum(c not in ("doc_id", "group_no") for c in catalogue.QUERIES[name](spark, DATA).columns)
    assert [values(f"whole_{name}") for name in ("dequantise", "hadamard4", "intra_plane")] == [16, 16, 64]
