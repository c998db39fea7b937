"""Files of start-code streams read by byte ranges, many small ones in a task, and written from units.

A range owns the units whose start code begins in it. It looks for start codes from any byte on, since one can't overlap another,
and reads on beyond its end until its last unit's is found: the seam between two ranges is the second one's first start code, and no
file, and no stream, is held whole. The files' place is a URI of any store that Arrow reads (file, hdfs, s3, gs).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bitlake.operators import runs
from bitlake.sources.framing import fault, unescape

FORMAT = "byte_stream_units"
#: Bytes of a range by default, of one read, of a batch of rows, and of a unit at most; a longer one is an error.
RANGE, CHUNK, BATCH, LONGEST = 64 << 20, 1 << 20, 4 << 20, 1 << 30
#: What a row costs besides its payload, in bytes.
ROW = 256
#: What opening a range costs, in bytes, the most that a task takes, and the tasks that a read has at least where there are as many ranges.
OPENING, TASK, TASKS = 64 << 10, 32 << 20, 64
CODE = b"\0\0\1"
SCHEMA = "path string, offset bigint, ref_idc int, unit_type int, payload binary, error string"
ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("ref_idc", pa.int32()), ("unit_type", pa.int32()), ("payload", pa.binary()), ("error", pa.string())])


class Body:
    """A unit's bytes as they come; zeros are only counted until something follows them."""

    def __init__(self, offset: int, longest: int):
        self.offset, self.longest, self.parts, self.size, self.zeros = offset, longest, [], 0, 0

    def add(self, data: bytes) -> None:
        body = data.rstrip(b"\0")
        if body:
            self.size += self.zeros + len(body)
            if self.size <= self.longest:
                self.parts += [bytes(self.zeros), body]
            self.zeros = 0
        self.zeros += len(data) - len(body)

    def ended(self, last: bool) -> tuple[int, bytes | None]:
        """(offset, bytes), None for too many; only a file's last unit keeps the zeros at its end."""
        tail = self.zeros if last else 0
        return self.offset, None if self.size + tail > self.longest else b"".join(self.parts) + bytes(tail)


def units_in(file, size: int, start: int, stop: int, chunk: int = CHUNK, longest: int = LONGEST) -> Iterator[tuple[int, bytes | None]]:
    """The units whose start codes begin from start to before stop; file has read_at(n, offset)."""
    body, carry, at = None, b"", start
    while at < size and (body is not None or at - len(carry) < stop):
        data = file.read_at(min(chunk, size - at), at)
        if not data:
            break
        window, base, i = carry + data, at - len(carry), 0
        at += len(data)
        while (found := window.find(CODE, i)) >= 0:
            if body is not None:
                body.add(window[i:found])
                yield body.ended(False)
            if base + found >= stop:
                return
            body, i = Body(base + found, longest), found + 3
        cut = len(window) if at >= size else max(i, len(window) - 2)
        if body is not None:
            body.add(window[i:cut])
        carry = window[cut:]
    if body is not None:
        body.add(carry)
        yield body.ended(True)


@dataclass
class Spans(InputPartition):
    """A task's ranges: (path below the root, start, stop, size of the file) each."""

    ranges: list[tuple[str, int, int, int]]


def packed(ranges: list[tuple[str, int, int, int]]) -> list[Spans]:
    """The ranges in order, as tasks of about equal cost, so that many small files or ranges don't make as many tasks."""
    cost = lambda r: r[2] - r[1] + OPENING
    most = min(TASK, sum(map(cost, ranges)) // TASKS)
    tasks, held = [], 0
    for r in ranges:
        if not tasks or held + cost(r) > most:
            tasks.append(Spans([]))
            held = 0
        tasks[-1].ranges.append(r)
        held += cost(r)
    return tasks


class UnitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.place, self.range = options["path"], int(options.get("range_bytes", RANGE))
        wanted = options.get("unit_types", "")
        self.types = {int(t) for t in wanted.split(",")} if wanted else None

    def partitions(self) -> list[Spans]:
        store, root = opened(self.place)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        good = [f for f in files if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))]
        head = len(root.rstrip("/")) + 1
        ranges = [(f.path[head:], at, min(at + self.range, f.size), f.size) for f in sorted(good, key=lambda f: f.path) for at in range(0, f.size, self.range)]
        return packed(ranges) or [Spans([])]

    def read(self, spans: Spans) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.place)
        rows, held = [], 0
        for name, start, stop, size in spans.ranges:
            path = f"{root.rstrip('/')}/{name}" if name else root
            with store.open_input_file(path) as file:
                for offset, unit in units_in(file, size, start, stop, max(4096, min(CHUNK, stop - start + 2))):
                    reason = f"unit of over {LONGEST} bytes" if unit is None else fault(unit)
                    if self.types is not None and (reason or unit[0] & 31 not in self.types):
                        continue
                    rows.append((path, offset, None, None, unit, reason) if reason else (path, offset, (unit[0] >> 5) & 3, unit[0] & 31, unescape(unit[1:]), None))
                    held += len(unit or b"") + ROW
                    if held >= BATCH:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)


class UnitSource(DataSource):
    """spark.read.format(FORMAT).load(uri of a file or folder): a row for each unit, or fault with its `error`.

    Options: range_bytes; unit_types, numbers with commas between them, of which alone rows are made. It is an option and no
    pushed filter because all scans of one loaded table share a reader, which would keep the filters of the last one planned.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> UnitReader:
        return UnitReader(self.options)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def opened(place: str) -> tuple[fs.FileSystem, str]:
    if urlparse(place).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(place).path).rstrip("/") or "/"
    return fs.FileSystem.from_uri(place)


def units(spark: SparkSession, place: str, range_bytes: int = RANGE, types: list[int] | None = None) -> DataFrame:
    """(path, offset, ref_idc, unit_type, payload, error) of the files at a URI: offset is where the unit's start code begins.

    Units that are empty, have the forbidden bit or are too long are rows with an error; with types, only units of these types
    are rows, and the reader passes over all others. Offsets order a stream's units as numbers do; numbered() gives numbers.
    """
    spark.dataSource.register(UnitSource)
    loaded = spark.read.format(FORMAT).option("range_bytes", str(range_bytes))
    return (loaded.option("unit_types", ",".join(map(str, types))) if types else loaded).load(place)


def numbered(found: DataFrame) -> DataFrame:
    """The units without an error, with unit_no, from 0 in each file."""
    return runs.before(found.where("error is null"), ["path"], "offset", {"unit_no": ("sum", F.lit(1))}, run=RANGE)


def escaped(payload: Column) -> Column:
    """A payload with the bytes that keep start codes out of it, as latin text's replacement."""
    text = F.decode(payload, "ISO-8859-1")
    return F.encode(F.regexp_replace(text, "\\x00\\x00(?=[\\x00-\\x03])", "\0\0\3"), "ISO-8859-1")


def written(rows: DataFrame, place: str, name_col: str = "name", order_col: str = "unit_no", data_col: str = "data") -> DataFrame:
    """Writes each name's data, in order, one behind the other, as the file of that name at a URI; gives (name, bytes), when run.

    A file is written in a stream by one task and moved to its name when it is whole, so that a task may be repeated.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = opened(place)
        store.create_dir(root, recursive=True)
        own, out, size, done = None, None, 0, []
        attempt = TaskContext.get().taskAttemptId()

        def closed() -> None:
            if out is not None:
                out.close()
                store.move(f"{root}/.{own}-{attempt}", f"{root}/{own}")
                done.append((own, size))

        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if name != own:
                    closed()
                    own, size, out = name, 0, store.open_output_stream(f"{root}/.{name}-{attempt}")
                out.write(data or b"")
                size += len(data or b"")
        closed()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["name", "bytes"])

    own = rows.where(F.col(name_col).isNotNull()).select(F.col(name_col).cast("string").alias("name"), F.col(order_col).alias("at"), F.col(data_col).alias("data"))
    return own.repartition("name").sortWithinPartitions("name", "at").mapInArrow(write, "name string, bytes bigint")
