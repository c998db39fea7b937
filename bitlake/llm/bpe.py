"""Byte-level BPE: distinct words are folded by Spark's higher-order functions; decoding concatenates binary pieces.

A text is split by the tokenizer's pattern in the JVM. Frequent words, counted on a bounded sample of texts, are
folded once and their ids kept as a table of at most CACHE words in each Python worker; the table saves time and
changes no result. The distinct other words of a text are folded in its own row. The fold merges the adjacent pair of
least rank, leftmost first, until no pair has a rank; ranks come from a map that is one literal value to the plan: a
written table of one row, read as a scalar, in whose arrays each pair has a slot. A word's bytes are read as characters
of ISO 8859-1. Words of over FOLD bytes, for which a quadratic fold is slow, are merged with a heap instead.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlake.llm.common import cut

MAPS, PAIR, FOLD, CACHE, SAMPLE = 32_768, 1 << 17, 64, 250_000, 40_000
#: The table of pairs: buckets, the modulus that gives a key its slot, and a factor below 2**29, so that no product overflows.
BUCKETS, SLOTS, MIX = 32_768, 299_993, 478_163_327
WORDS_AT_ONCE, IDS_AT_ONCE = 300_000, 50_000
#: Texts in an Arrow batch: its words and ids are in memory at once, on both sides.
BATCH = 300
#: A rank beyond all ranks, and the bits below a rank: seven of a piece's index in the word above those of an id.
NONE, PLACE = 1 << 20, 1 << 24
#: Unicode's white space, which `\s` means to the tokenizer.
SPACE = r"\u0009-\u000D \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 pieces and numbers, read where the driver runs."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def split(text: Column, pattern: str) -> Column:
    """All matches of the tokenizer's pattern in order; null as empty."""
    java = pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java), F.lit(0))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once; an element of a transform would look up its type anew in each row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, use)


def placed(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """(shifts, slots): a table in which each key has a slot of its own, by the shift of the key's bucket.

    A slot holds key * PAIR + rank, or -1. Buckets are placed from the largest to the smallest, each at the least
    shift that puts all its keys in free slots.
    """
    buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
    for key in pairs:
        buckets[(key * MIX >> 34) & (BUCKETS - 1)].append(key)
    shifts, slots = [0] * BUCKETS, [-1] * (2 * SLOTS)
    for b in sorted(range(BUCKETS), key=lambda b: -len(buckets[b])):
        at = [key * MIX % SLOTS for key in buckets[b]]
        if len(set(at)) < len(at):
            raise ValueError("two pairs of one bucket share a slot: choose another MIX")
        shift = next(s for s in range(SLOTS) if all(slots[i + s] < 0 for i in at))
        shifts[b] = shift
        for key, i in zip(buckets[b], at, strict=True):
            slots[i + shift] = key * PAIR + pairs[key]
    return shifts, slots[: SLOTS + max(shifts)]


class Fold:
    """Column expressions of the merges over one vocabulary.

    The map (slots of pairs, found by their bucket's shift; for two bytes, one array) leads from a pair of ids,
    as one number, to the rank of the two pieces put together, which is its id too. A word's state is one array, of each
    piece's id, its index and the rank of its pair with the next; its least value is the merge to do, which looks up the
    two pairs it makes.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        pairs: dict[int, int] = {}
        whole: list[dict[str, int]] = [{} for _ in range(MAPS)]
        for piece, rank in ranks.items():
            key = piece.decode("latin-1")
            whole[zlib.crc32(key.encode()) % MAPS][key] = rank
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    pairs[left * PAIR + right] = rank
        shifts, slots = placed(pairs)
        two = [ranks.get(bytes([i, j]), NONE) * PLACE for i in range(256) for j in range(256)] + [NONE * PLACE]
        maps = pa.array([list(m.items()) for m in whole], pa.map_(pa.string(), pa.int32()))
        columns = {"shifts": pa.array(shifts, pa.int64()), "slots": pa.array(slots, pa.int64()), "whole": maps, "bytes": pa.array([ranks[bytes([i])] for i in range(256)], pa.int32()), "two": pa.array(two, pa.int64())}
        row = pa.table({name: pa.ListArray.from_arrays([0, len(values)], values) for name, values in columns.items()})
        self.literal = cut(spark.createDataFrame(row), "bpe-ranks").select(F.struct(*columns)).scalar()

    def with_table(self, rows: DataFrame, name: str) -> tuple[DataFrame, Column]:
        """rows with the map as a column of this name, which the optimizer puts where it is used, once."""
        return rows.withColumn(name, self.literal), F.col(name)

    def ids(self, rows: DataFrame, word: str, out: str) -> DataFrame:
        """rows (word) and the ids of each word, array<int>; a word that is a piece is its id."""
        held, table = self.with_table(rows, "table")
        return held.select(word, _let(table, lambda t: self.of(t, F.decode(F.encode(F.col(word), "UTF-8"), "ISO-8859-1"))).alias(out))

    def each(self, rows: DataFrame, words: str, out: str) -> DataFrame:
        """rows with the ids of each word of an array, array<array<int>>, instead of the words."""
        held, table = self.with_table(rows, "table")
        found = _let(table, lambda t: F.transform(F.col(words), lambda word: self.of(t, F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"))))
        return held.select(*(c for c in rows.columns if c != words), found.alias(out))

    def of(self, table: Column, chars: Column) -> Column:
        def found(w: Column) -> Column:
            known = F.element_at(F.element_at(table["whole"], (F.crc32(w.cast("binary")) % MAPS + 1).cast("int")), w)
            return _let(known, lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(self.merged(table, w)))

        return _let(chars, found)

    def rank(self, table: Column, left: Column, right: Column) -> Column:
        def slot(key: Column) -> Column:
            shift = F.get(table["shifts"], F.shiftright(key * MIX, 34).bitwiseAND(BUCKETS - 1))
            return _let(F.get(table["slots"], key * MIX % SLOTS + shift), lambda s: F.when(F.shiftright(s, 17) == key, s.bitwiseAND(PAIR - 1)).otherwise(NONE))

        return _let(left * PAIR + right, slot)

    def merged(self, table: Column, word: Column) -> Column:
        """The ids of a word by as many merges as it has places for; a state's values are (rank, index, id) in one number."""
        each = F.transform(F.split(word, ""), lambda c: F.ascii(c))
        byte = lambda p, x, i: F.get(table["two"], x * 256 + F.coalesce(F.get(p, i + 1), F.lit(256 * 256) - x * 256)) + i * PAIR + F.get(table["bytes"], x)
        first = _let(each, lambda p: F.transform(p, lambda x, i: byte(p, x, i)))
        last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), first, lambda v, _: self.merge(table, v))
        return F.transform(last, lambda x: (x % PAIR).cast("int"))

    def merge(self, table: Column, v: Column) -> Column:
        """One merge: the least value's piece takes in the next one, and the pairs on both sides are ranked anew."""

        def joined(best: Column) -> Column:
            new = F.shiftright(best, 24)

            def put(at: Column) -> Column:
                here = self.rank(table, new, F.get(v, at + 2).bitwiseAND(PAIR - 1)) * PLACE + (best.bitwiseAND(PLACE - PAIR) + new)
                before = lambda x: self.rank(table, x.bitwiseAND(PAIR - 1), new) * PLACE + x.bitwiseAND(PLACE - 1)
                new_value = lambda x, i: F.when(i < at - 1, x).when(i > at, x - PAIR).when(i == at, here).otherwise(before(x))
                return F.transform(F.array_remove(v, F.get(v, at + 1)), new_value)

            return F.when(best >= NONE * PLACE, v).otherwise(_let(F.shiftright(best, 17).bitwiseAND(127).cast("int"), put))

        return _let(F.array_min(v), joined)


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long word by a heap of pairs and links between pieces."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    pairs: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(pairs, (rank, i, ends[i], ends[j]))

    for i in range(n):
        push(i)
    while pairs:
        _, i, middle, end = heapq.heappop(pairs)
        if not alive[i] or ends[i] != middle or after[i] >= n or ends[after[i]] != end:
            continue
        j = after[i]
        alive[j], ends[i], after[i] = False, end, after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


def gathered(starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions of the runs that begin at starts[c] and have sizes[c] values, for each code c in turn."""
    n = sizes[codes]
    ends = np.cumsum(n)
    return np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _looked_up(table, ranks):
    """Ids of known words; -1 - k stands for the k-th of the text's other words, which are listed."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_ids, known_ends = table.value
        bound = ranks.value
        for batch in batches:
            lists = batch.column("words")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            lo = 0
            while lo < len(lists):
                hi = min(len(lists), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + WORDS_AT_ONCE, "right")) - 1))
                words = lists.values.slice(offsets[lo], offsets[hi] - offsets[lo]).dictionary_encode()
                codes, distinct = words.indices.to_numpy(), words.dictionary
                at = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=known), -1))
                sizes = np.where(at >= 0, known_ends[at + 1] - known_ends[at], 1)
                starts = np.where(at >= 0, known_ends[at], 0)
                tail, missing = [], {}
                for c in np.flatnonzero(at < 0).tolist():
                    word = distinct[c].as_py()
                    raw = word.encode()
                    run = heap_merge(raw, bound) if len(raw) > FOLD else [-1 - c]
                    if len(raw) <= FOLD:
                        missing[c] = word
                    sizes[c], starts[c] = len(run), len(known_ids) + len(tail)
                    tail += run
                flat = np.concatenate([known_ids, np.array(tail, np.int32)])
                ids = flat[gathered(starts, sizes, codes)]
                per_word = np.concatenate([[0], np.cumsum(sizes[codes])])
                cuts = per_word[offsets[lo : hi + 1] - offsets[lo]]
                others = [[]] * (hi - lo)
                if missing:
                    at = np.flatnonzero(ids < 0)
                    owner = np.searchsorted(cuts, at, "right") - 1
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(at)]])
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        own, inverse = np.unique(ids[at[a:b]], return_inverse=True)
                        ids[at[a:b]] = -1 - inverse
                        others[owner[a]] = [missing[-1 - c] for c in own.tolist()]
                own = {c: batch.column(c).slice(lo, hi - lo) for c in batch.schema.names if c != "words"}
                yield pa.RecordBatch.from_pydict(own | {"ids": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)), "others": pa.array(others, pa.list_(pa.string()))})
                lo = hi

    return look


def _filled(pieces):
    """Puts the ids of the listed words in their places; with pieces, their starts, sizes and bytes, adds the text they give."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, other = batch.column("ids"), batch.column("other_ids")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)
            outer, inner = other.offsets.to_numpy().astype(np.int64), other.values.offsets.to_numpy().astype(np.int64)
            flat = np.asarray(other.values.values.to_numpy(zero_copy_only=False), np.int32)
            own = ids[offsets[0] : offsets[-1]]
            at = np.flatnonzero(own < 0)
            owner = np.searchsorted(offsets - offsets[0], at, "right") - 1
            run = outer[owner] - 1 - own[at]
            sizes, starts, values = np.ones(len(own), np.int64), np.arange(len(own)), np.concatenate([own, flat])
            sizes[at], starts[at] = inner[run + 1] - inner[run], inner[run] + len(own)
            out = values[gathered(starts, sizes, np.arange(len(own)))]
            cuts = np.concatenate([[0], np.cumsum(sizes)])[offsets - offsets[0]]
            made = {"ids": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(out.astype(np.int32)))}
            if pieces is not None:
                made["decoded"] = concatenated(out, cuts, *pieces.value)
            kept = {c: batch.column(c) for c in batch.schema.names if c not in ("ids", "other_ids")}
            yield pa.RecordBatch.from_pydict(kept | made)

    return fill


def table_of(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each id's piece starts in the bytes of all pieces, its size, and those bytes."""
    by_id = {rank: piece for piece, rank in ranks.items()}
    pieces = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
    sizes = np.array([len(p) for p in pieces], np.int64)
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(pieces), np.uint8)


def concatenated(ids: np.ndarray, cuts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """For each run of ids between two cuts the bytes of its pieces, put together."""
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])
    raw = bytearray(int(ends[-1]))
    out = np.frombuffer(raw, np.uint8)
    for lo in range(0, len(ids), IDS_AT_ONCE):
        part = ids[lo : lo + IDS_AT_ONCE]
        out[ends[lo] : ends[lo + len(part)]] = data[gathered(starts, sizes, part)]
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends[cuts].astype(np.int32)), pa.py_buffer(raw)])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cache: int = CACHE, keep_text: bool = False, back: bool = False) -> DataFrame:
    """(id, ids), with keep_text text, with back decoded: the token ids of every whole text, without special tokens; one row for each row of docs.

    decoded is what the ids decode to, as binary. Null and empty texts have no tokens; ids and repeated rows stay as
    they are; other columns are not read; an empty table gives an empty result. The session's Arrow batches are set to
    BATCH rows.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    ranks = read_ranks(path)
    fold = Fold(spark, ranks)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = docs.select(id_col).count()
    some = rows if n <= sample else rows.where(F.pmod(F.xxhash64(F.lit("words"), "id"), F.lit(1_000_003)) < int(1_000_003 * sample / n))
    counted = some.select(F.explode(split(F.col("text"), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.octet_length("word") <= FOLD) & (F.col("n") > 1))
    top = counted.orderBy(F.desc("n"), "word").limit(cache).select("word").repartition(max(8, spark.sparkContext.defaultParallelism * 2), "word")
    known = fold.ids(top, "word", "ids").toArrow()
    flat = known.column("ids").combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0) if flat.num_chunks else pa.array([], pa.list_(pa.int32()))
    table = (known.column("word").combine_chunks(), flat.values.to_numpy(zero_copy_only=False).astype(np.int32), flat.offsets.to_numpy().astype(np.int64))
    look = _looked_up(spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(ranks))
    own = {"id": kind} | ({"text": "string"} if keep_text else {})
    schema = ", ".join(f"{k} {v}" for k, v in own.items())
    looked = rows.select(*own, split(F.col("text"), pattern).alias("words")).mapInArrow(look, f"{schema}, ids array<int>, others array<string>")
    pieces = spark.sparkContext.broadcast(table_of(ranks)) if back else None
    last = {"ids": "array<int>"} | ({"decoded": "binary"} if back else {})
    out = fold.each(looked, "others", "other_ids").mapInArrow(_filled(pieces), ", ".join([schema, *(f"{k} {v}" for k, v in last.items())]))
    return out.select("id", "ids", *list(own)[1:], *list(last)[1:]).withColumnsRenamed({"id": id_col, "text": text_col})


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with column `out`, binary, which replaces one of that name: the pieces of the ids, put together; null ids give null.

    Ids beyond the vocabulary fail; an empty list gives no bytes.
    """
    pieces = rows.sparkSession.sparkContext.broadcast(table_of(read_ranks(path)))
    names = [c for c in rows.columns if c != out]
    kinds = dict(rows.dtypes)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids_col)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            made = concatenated(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]), *pieces.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pc.if_else(lists.is_valid(), made, None)], names=[*names, out])

    return rows.select(*names).mapInArrow(put, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{out}` binary"]))
