"""Repair of a conversation's turns by cheapest edits; of equally cheap ones the least in ASCII order of their audit.

A conversation's kept roles must begin with s?(ua)+ or be none. Rows are put into order by range and sort, and cut into
segments of at most SEGMENT rows, so that no task holds a conversation: each segment gives a min-plus matrix of costs from role state
to role state, a backward scan over segments gives the costs still ahead of each, and a segment then knows its optimal arcs.
An arc is an edit, from (row, state) to (row, state); from one state no two edits have the same letter. Arcs are ranked by
the first 1, 2, 4, ... letters of the least audit that they begin: a rank of doubled length is the pair of an arc's rank and that of the arc which its
pointer, as many letters on, leads to. Ranks choose the first arc for each state that a segment may begin in, and the doubled pointers
list the arcs behind it. A last stream over rows and texts follows the state from segment to segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitlake.llm.common import cut

#: Rows of a segment, and rows times segments that one array holds.
SEGMENT, CELLS = 256, 1 << 16
#: Costs of inserting, of changing a role, of deleting, and of leaving a truncated row in.
INSERT, ROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: States: nothing yet, behind s, behind u, behind a; DEAD takes no row.
NEXT, DEAD, FAR = np.array([2, 2, 3, 2]), 4, 1 << 40
KEEP = np.array([[1, DEAD, DEAD, DEAD], [2, 2, DEAD, 2], [DEAD, DEAD, 3, DEAD], [DEAD] * 4])
#: What is inserted at a conversation's end, by its state, and costs.
TAIL = ["", "II", "I", ""]
#: Initials by number; letters of edits are D, I, K, R, in ASCII order.
INITIALS = "sua"
SPACE = r"[\x20\x09-\x0D]"


def key_of(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("="), c.cast("string")))


def digest_of(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.lit(":"), text), 256))


def ordered(rows: DataFrame) -> DataFrame:
    """(key, conv, turn, digest, n, initial, fault): equal rows of a turn as one, with their number; fault (1 blank, 2 duplicate, 3 truncated, else 0) is that of the first of them."""
    role, text = F.col("role"), F.col("text")
    bare = F.regexp_replace(text, SPACE, "")
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS)), F.substring(role, 1, 1)), F.lit(0)).cast("int")
    fault = F.when(bare == "", 1).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    marks = rows.select(key_of(F.col("conv")).alias("key"), "conv", "turn", digest_of(role, text).alias("digest"), F.pmod(initial - 1, F.lit(4)).alias("initial"), fault.alias("fault"))
    merged = cut(marks.groupBy("key", "conv", "turn", "digest").agg(F.count("*").alias("n"), F.min("initial").alias("initial"), F.min("fault").alias("fault")), "turns-rows")
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    seen = merged.groupBy("key", "digest").agg(F.min(at).alias("_first"))
    later = F.col("_first") < at
    return merged.join(seen, ["key", "digest"]).withColumn("fault", F.when((F.col("fault") != 1) & later, 2).otherwise(F.col("fault"))).drop("_first")


def costs(initial: np.ndarray, fault: np.ndarray, size: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """d[segment, row, state, k]: the cost from a row and state on, where ends[segment, state, k] is that behind the last row."""
    n, rows = initial.shape
    d = np.empty((n, rows + 1, *ends.shape[1:]), np.int64)
    d[:, rows] = ends
    for t in range(rows - 1, -1, -1):
        d[:, t] = np.where((t < size)[:, None, None], best(edits(initial[:, t], fault[:, t], d[:, t + 1])), d[:, t + 1])
    return d


def edits(initial: np.ndarray, fault: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting a row, keeping it and changing its role, by state, with what lies ahead."""
    whole = np.concatenate([ahead, np.full_like(ahead[:, :1], FAR)], axis=1)
    left = np.where(fault == 3, TRUNCATED, np.where(fault > 0, FAR, 0))[:, None, None]
    return ahead + DELETE, np.take_along_axis(whole, KEEP[initial][:, :, None], axis=1) + left, ahead[:, NEXT] + ROLE + left


def best(found: tuple) -> np.ndarray:
    """The least cost of a row by state, with up to two insertions before it."""
    c = np.minimum(np.minimum(*found[:2]), found[2])
    for _ in range(2):
        c = np.minimum(c, c[:, NEXT] + INSERT)
    return c


def least_edits(initial: np.ndarray, fault: np.ndarray, size: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """code[segment, state, row]: the least optimal audit from each state at a segment's begin, as 3 times the row's insertions plus its edit (D, K, R)."""
    n, rows = initial.shape
    d = costs(initial, fault, size, ahead[:, :, None])[..., 0]
    s, t, q = np.ogrid[:n, :rows, :4]
    node = (s * (rows + 1) + t) * 4 + q  # of (segment, row, state); those behind the last row have no arcs
    keep = KEEP[initial]
    targets = np.stack([node + 4, node - q + NEXT, node - q + 4 + np.minimum(keep, 3), node - q + 4 + NEXT], axis=3)
    price = np.where(fault == 3, TRUNCATED, np.where(fault > 0, FAR, 0))[:, :, None]
    dead = np.where(keep == DEAD, FAR, 0)
    paid = np.stack(np.broadcast_arrays(np.int64(DELETE), np.int64(INSERT), price + dead, price + ROLE), axis=3)
    paid = np.broadcast_to(paid, targets.shape)
    flat = d.reshape(-1)
    optimal = (flat[targets] + paid == d[:, :rows, :, None]) & (t < size[:, None, None])[..., None]

    arcs = np.flatnonzero(optimal.reshape(-1))  # in order of node and letter
    letter, end = arcs % 4, len(arcs)
    home = np.broadcast_to(node, (n, rows, 4)).reshape(-1)[arcs // 4]
    first = np.full(len(flat) + 1, end)
    first[home[::-1]] = np.arange(end)[::-1]  # the arc of the least letter out of each node
    rank = np.append(letter + 1, 0)
    pointers = [np.append(first[targets.reshape(-1)[arcs]], end)]
    while (pointers[-1] < end).any():
        at = pointers[-1]
        rank = np.unique(rank * (end + 5) + rank[at], return_inverse=True)[1]
        pointers.append(at[at])
    # of the arcs out of each first row's states, the one of the least rank
    out = np.full((n * (rows + 1) * 4, 4), end)
    out[home, letter] = np.arange(end)
    begin = out.reshape(n, rows + 1, 4, 4)[:, 0]
    ranked = np.where(begin < end, rank[np.minimum(begin, end)], np.iinfo(np.int64).max)
    path = np.take_along_axis(begin, ranked.argmin(axis=2)[..., None], axis=2)
    for pointer in pointers:
        path = np.concatenate([path, pointer[path]], axis=2)
    code = np.zeros((n, 4, rows), np.int64)
    taken = path < end
    i, j, _ = np.nonzero(taken)
    arc = path[taken]
    row, kind = home[arc] // 4 % (rows + 1), letter[arc]
    np.add.at(code, (i, j, row), np.array([0, 3, 1, 2])[kind])
    return code


def arrays(parts: list[list[dict]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts])
    initial, fault = np.zeros((len(parts), size.max()), np.int64), np.zeros((len(parts), size.max()), np.int64)
    for i, p in enumerate(parts):
        initial[i, : len(p)] = [r["initial"] for r in p]
        fault[i, : len(p)] = [r["fault"] for r in p]
    return initial, fault, size


def portions(sizes: list[int]) -> Iterator[slice]:
    """Runs of segments whose arrays have at most about CELLS cells."""
    at, widest = 0, 0
    for i, size in enumerate(sizes):
        if i > at and max(widest, size) * (i + 1 - at) > CELLS:
            yield slice(at, i)
            at, widest = i, 0
        widest = max(widest, size)
    if at < len(sizes):
        yield slice(at, len(sizes))


def segments(rows: DataFrame) -> DataFrame:
    """(key, conv, part, seg, rows, matrix): the ordered rows of ordered() by segments; matrix[4 * p + q] is the cost from state p to q."""
    kinds = dict(rows.dtypes)
    one = f"struct<turn {kinds['turn']}, digest binary, n bigint, initial int, fault int>"
    schema = f"key string, conv {kinds['conv']}, part int, seg bigint, rows array<{one}>, matrix array<bigint>"
    names = ["key", "conv", "part", "seg", "rows", "matrix"]
    identity = np.where(np.eye(4, dtype=bool), 0, FAR)

    def closed(part: int, done: list[tuple], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
        for own in portions([len(x[3]) for x in done]):
            some = done[own]
            initial, fault, size = arrays([x[3] for x in some])
            matrix = costs(initial, fault, size, np.broadcast_to(identity, (len(some), 4, 4)))[:, 0].reshape(len(some), 16)
            columns = [[x[0] for x in some], [x[1] for x in some], [part] * len(some), [x[2] for x in some], [x[3] for x in some], matrix.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, fields.field(k).type) for k, c in zip(names, columns, strict=True)], schema=fields)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, held, key, conv, fields = TaskContext.get().partitionId(), 0, [], None, None, None
        done: list[tuple] = []
        for batch in batches:
            if fields is None:
                of = {f.name: f.type for f in batch.schema}
                struct = pa.struct([(k, of[k]) for k in ("turn", "digest", "n", "initial", "fault")])
                fields = pa.schema([("key", pa.string()), ("conv", of["conv"]), ("part", pa.int32()), ("seg", pa.int64()), ("rows", pa.list_(struct)), ("matrix", pa.list_(pa.int64()))])
            for r in batch.to_pylist():
                if held and (r["key"] != key or len(held) == SEGMENT):
                    done.append((key, conv, seg, held))
                    seg, held = seg + 1, []
                key, conv = r["key"], r["conv"]
                held.append({k: r[k] for k in ("turn", "digest", "n", "initial", "fault")})
            yield from closed(part, done, fields)
            done = []
        if held:
            yield from closed(part, [(key, conv, seg, held)], fields)

    order = ["key", "turn", "digest"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(make, schema)


def with_ahead(found: DataFrame) -> DataFrame:
    """(part, seg, ahead): the cost behind each segment by state, from a scan over the matrices of a conversation's segments, the last first."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ahead = None, None
        for batch in batches:
            out = []
            for k, matrix in zip(batch.column("key").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                if k != key:
                    key, ahead = k, np.array([INSERT * len(t) for t in TAIL])
                out.append(ahead.tolist())
                ahead = (np.array(matrix).reshape(4, 4) + ahead).min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("seg"), pa.array(out, pa.list_(pa.int64()))], names=["part", "seg", "ahead"])

    rows = found.select("key", "part", "seg", "matrix").repartition("key").sortWithinPartitions("key", F.desc("part"), F.desc("seg"))
    return rows.mapInArrow(make, "part int, seg bigint, ahead array<bigint>")


def decided(found: DataFrame) -> DataFrame:
    """(key, turn, digest, n, initial, fault, first, codes): for each row four codes of its edits, one a state in which its segment may begin."""
    turn = found.schema["rows"].dataType.elementType["turn"].dataType.simpleString()
    schema = f"key string, turn {turn}, digest binary, n bigint, initial int, fault int, first boolean, codes bigint"
    weight = np.array([1, 1 << 8, 1 << 16, 1 << 24])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists, ahead = batch.column("key"), batch.column("rows"), batch.column("ahead").to_pylist()
            sizes = np.diff(lists.offsets.to_numpy()).tolist()
            for own in portions(sizes):
                n = own.stop - own.start
                part = lists.slice(own.start, n)
                flat, size = part.flatten(), np.array(sizes[own])
                inside = np.arange(size.max()) < size[:, None]
                initial, fault = np.zeros(inside.shape, np.int64), np.zeros(inside.shape, np.int64)
                initial[inside], fault[inside] = flat.field("initial").to_numpy(), flat.field("fault").to_numpy()
                code = least_edits(initial, fault, size, np.array(ahead[own]))
                codes = (code * weight[:, None]).sum(axis=1)[inside]
                first = np.broadcast_to(np.arange(size.max()) == 0, inside.shape)[inside]
                key = keys.slice(own.start, n).take(pa.array(np.repeat(np.arange(n), size)))
                yield pa.RecordBatch.from_arrays([key, *(flat.field(k) for k in ("turn", "digest", "n", "initial", "fault")), pa.array(first), pa.array(codes, pa.int64())], names=[x.split()[0] for x in schema.split(", ")])

    return found.mapInArrow(make, schema)


class Repair:
    """One conversation as its rows come: its counts, audit and repaired lines."""

    def __init__(self, conv: object):
        self.conv, self.state, self.entry, self.audit, self.cost, self.pending = conv, 0, 0, [], 0, None
        self.faults, self.illegal, self.last, self.seen, self.sha, self.lines = [0, 0, 0, 0], 0, None, 0, hashlib.sha256(), 0
        self.low = self.high = None
        self.turns = 0

    def said(self, role: str, text: str) -> tuple[str, str]:
        self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1
        return role, text

    def inserted(self) -> tuple[str, str]:
        role = "assistant" if self.state == 2 else "user"
        self.state = int(NEXT[self.state])
        return self.said(role, "")

    def row(self, r: dict) -> None:
        """An ordered row; its text follows."""
        n, x = r["n"], INITIALS[r["initial"]] if r["initial"] < 3 else None
        self.faults[r["fault"]] += 1
        self.faults[1 if r["fault"] == 1 else 2] += n - 1
        self.illegal += n - 1 + (self.seen > 0 and f"{self.last}{x}" not in ("su", "ua", "au"))
        self.last, self.seen = x, self.seen + n
        if r["turn"] is not None and r["turn"] != self.high:
            self.low, self.high, self.turns = r["turn"] if self.low is None else self.low, r["turn"], self.turns + 1
        self.entry = self.state if r["first"] else self.entry
        self.pending = r

    def text(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The repaired messages, with their edits, up to the row that is waiting, by its text."""
        r, self.pending = self.pending, None
        if r is None:  # a copy
            return
        before, edit = divmod(r["codes"] >> 8 * self.entry & 255, 3)
        self.audit.append("I" * before + "DKR"[edit] + "D" * (r["n"] - 1))
        for _ in range(before):
            yield *self.inserted(), "I"
        self.cost += INSERT * before + DELETE * (r["n"] - 1) + (DELETE if edit == 0 else ROLE * (edit == 2) + TRUNCATED * (r["fault"] == 3))
        if edit == 1:
            self.state = int(KEEP[r["initial"]][self.state])
            yield *self.said(role, text), "K"
        elif edit == 2:
            role = "assistant" if self.state == 2 else "user"
            self.state = int(NEXT[self.state])
            yield *self.said(role, text), "R"

    def ended(self) -> Iterator[tuple[str, str, str]]:
        tail = TAIL[self.state]
        self.audit.append(tail)
        self.cost += INSERT * len(tail)
        for _ in tail:
            yield *self.inserted(), "I"

    def summary(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
MESSAGES = "place bigint, role string, text string, edit string"


def repaired(rows: DataFrame, original: DataFrame, messages: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each conversation of `original`: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; with messages its repaired lines instead.

    rows are the conversations' rows; those of ids that original lacks are conversations too. With messages: a row for
    each repaired line: id, place from 1, role, text and its edit (I, K or R). Null roles and texts are taken as one space, so
    that such texts are blank; null ids are one conversation; null turns come first. Rows of one turn come in order of a digest of
    role and text, and equal ones are copies of the first. A role counts by its first letter; an empty one is like an
    unknown one. A conversation without rows has zeros, an empty audit and the digest of nothing; empty tables give empty
    results; other columns are not read. A conversation may have any number of rows; its audit is one value.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    kinds = dict(own.dtypes)
    found = cut(segments(ordered(own)), "turns-segments")
    acts = cut(decided(found.join(with_ahead(found), ["part", "seg"])), "turns-edits")
    there = original.select(F.col(conv_col).alias("conv")).distinct().select(key_of(F.col("conv")).alias("key"), F.lit(0).alias("kind"), "conv")
    acted = acts.select("key", F.lit(1).alias("kind"), *acts.columns[1:])
    texts = own.select(key_of(F.col("conv")).alias("key"), F.lit(2).alias("kind"), "conv", "turn", digest_of(F.col("role"), F.col("text")).alias("digest"), "role", "text")
    every = there.unionByName(acted, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    schema = f"`{conv_col}` {kinds['conv']}, " + (MESSAGES if messages else SUMMARY)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one, fields = None, None, None
        for batch in batches:
            if fields is None:
                kinds = {"bigint": pa.int64(), "string": pa.string()}
                fields = pa.schema([(conv_col, batch.schema.field("conv").type), *((x.split()[0], kinds[x.split()[1]]) for x in (MESSAGES if messages else SUMMARY).split(", "))])
            out: list[tuple] = []
            for r in batch.to_pylist():
                if one is None or r["key"] != key:
                    out += finished(one)
                    key, one = r["key"], Repair(r["conv"])
                if r["kind"] == 1:
                    one.row(r)
                elif r["kind"] == 2:
                    one.conv = r["conv"]
                    for role, text, edit in one.text(r["role"], r["text"]):
                        if messages:
                            out.append((one.conv, one.lines, role, text, edit))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(fields)], schema=fields)
        out = finished(one)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(fields)], schema=fields)

    def finished(one: Repair | None) -> list[tuple]:
        if one is None:
            return []
        tail = [(one.conv, one.lines, role, text, edit) for role, text, edit in one.ended()]
        return tail if messages else [one.summary()]

    return every.repartition("key").sortWithinPartitions("key", "turn", "digest", "kind").mapInArrow(follow, schema)
