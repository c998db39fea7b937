"""Byte streams as rows of network abstraction units: start codes or length prefixes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch of units at most, and their payloads' bytes, which only one unit's may exceed.
ROWS, BYTES = 8192, 4 << 20
SCHEMA = "unit_no long, ref_idc int, unit_type int, payload binary"
_START = re.compile(rb"\x00\x00\x00?\x01")


def unescape(data: bytes) -> bytes:
    """Without the bytes that keep start codes out of payloads."""
    return data.replace(b"\x00\x00\x03", b"\x00\x00")


def by_start_codes(data: bytes) -> Iterator[bytes]:
    """Units between start codes; zero bytes before a start code belong to none."""
    begun = None
    for m in _START.finditer(data):
        if begun is not None:
            yield data[begun : m.start()].rstrip(b"\x00")
        begun = m.end()
    if begun is not None:
        yield data[begun:]


def by_length(data: bytes, size: int) -> Iterator[bytes]:
    """Units behind big-endian lengths of 1, 2 or 4 bytes; a cut unit ends the scan."""
    at = 0
    while size in (1, 2, 4) and at + size <= len(data):
        n = int.from_bytes(data[at : at + size], "big")
        if at + size + n > len(data):
            return
        yield data[at + size : at + size + n]
        at += size + n


def fault(unit: bytes) -> str | None:
    return "empty unit" if not unit else "forbidden bit" if unit[0] & 0x80 else None


def units(streams: DataFrame, id_col: str, data_col: str, length_size: int = 0, errors: bool = False) -> DataFrame:
    """A row for each unit: the stream's id, its number, reference class, type and unescaped payload.

    length_size 0 means start codes. Empty units, those with the forbidden bit, and what is left of a stream behind its
    last whole unit give no row; with errors they are rows of an `error`, their bytes the payload, without a number.
    Null and empty streams have no units. A stream is read whole, one at a time, and rows leave in batches of at most ROWS and about BYTES.
    """
    kind = dict(streams.dtypes)[id_col]
    names = [id_col, "unit_no", "ref_idc", "unit_type", "payload"] + ["error"] * errors

    def found(key, data: bytes) -> Iterator[tuple]:
        n, used = 0, 0
        for u in by_length(data, length_size) if length_size else by_start_codes(data):
            used += length_size + len(u)
            if (reason := fault(u)) is None:
                yield key, n, (u[0] >> 5) & 3, u[0] & 31, unescape(u[1:]), None
                n += 1
            elif errors:
                yield key, None, None, None, u, reason
        if errors and length_size and used < len(data):
            yield key, None, None, None, data[used:], "truncated unit"

    ddl = f"`{id_col}` {kind}, {SCHEMA}" + ", error string" * errors
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)], schema=schema)
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                for row in found(key.as_py(), data.as_py() or b""):
                    rows.append(row[: len(names)])
                    held += len(row[4])
                    if len(rows) == ROWS or held >= BYTES:
                        yield made()
                        rows, held = [], 0
        if rows:
            yield made()

    return streams.select(id_col, data_col).mapInArrow(scan, ddl)


def header(first_byte: Column) -> list[Column]:
    """Forbidden bit, reference class and type of a unit's first byte."""
    return [F.shiftright(first_byte, 7).alias("forbidden"), F.shiftright(first_byte, 5).bitwiseAND(3).alias("ref_idc"), first_byte.bitwiseAND(31).alias("unit_type")]
