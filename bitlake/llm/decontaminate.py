"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, a scan of all document windows, removal.

Words are runs of ASCII letters and digits and of all non-ASCII bytes, A-Z lower-cased. A window is `gram` consecutive
words of an item; an item of fewer words, but not none, is one window. The set is cut into blocks of at most about
BLOCK bytes by a hash of (window, item), and only a block is broadcast at a time: one block is the usual case and takes a
single pass without a shuffle; more are scanned one after another, and their findings meet by the text's digest. A task hashes
the words of about a megabyte of text at once as arrays, looks all windows up, and compares each hit with the window's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitlake.llm.common import cut, fresh

GRAM = 10
#: Bytes of windows and item ids in a broadcast block, and of text hashed at once.
BLOCK, PIECE = 16 << 20, 1 << 20
SPANS = "array<struct<first bigint, last bigint, start bigint, stop bigint>>"
#: Each byte lower-cased, 0 where it belongs to no word.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 0 for b in range(256))
BASE, MIX, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Words of lower-cased bytes with their hashes, the same wherever a word stands."""

    def __init__(self) -> None:
        self.size = 0
        self._grow(2 * PIECE)

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size, self.up, self.down = n, powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)

    def words(self, low: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, stops, hashes) of the words; the bytes are taken in pieces that end between words."""
        parts, at = [], 0
        while at < len(low):
            end = low.find(b"\0", at + PIECE)
            end = len(low) if end < 0 else end
            parts.append(self._piece(np.frombuffer(low, np.uint8, end - at, at), at))
            at = end
        return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def _piece(self, piece: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._grow(len(piece) + 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], piece != 0, [0]]).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * self.up[: len(piece)], out=sums[1:])
        h = (sums[stops] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        return starts + at, stops + at, h ^ (h >> np.uint64(29))


def windows_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n if len(out) else 0):
        out += hashes[k : k + len(out)] * np.uint64(pow(STEP, k + 1, 1 << 64))
    return out


class Block:
    """The windows of a block: by the number of words their hashes and a table of the hashes' high bits; each window's items."""

    def __init__(self, windows: list[bytes], items: list[str]):
        self.items = sorted(set(items))
        number = {item: i for i, item in enumerate(self.items)}
        self.of: dict[bytes, list[int]] = {}
        for w, item in zip(windows, items, strict=True):
            self.of.setdefault(w, []).append(number[item])
        sized: dict[int, list[np.ndarray]] = {}
        hasher = Hasher()
        for w in self.of:
            h = hasher.words(w.replace(b" ", b"\0"))[2]
            sized.setdefault(len(h), []).append(windows_of(h, len(h)))
        self.sized = {}
        for n, found in sized.items():
            hashes = np.unique(np.concatenate(found))
            bits = min(24, max(16, int(len(hashes)).bit_length() + 4))
            table = np.zeros(1 << bits, bool)
            table[hashes >> np.uint64(64 - bits)] = True
            self.sized[n] = (hashes, table, np.uint64(64 - bits))


def grams(benchmark: DataFrame, gram: int = GRAM, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item): the distinct windows of each item, words joined by spaces; null texts have none, a null id is the empty string."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = (text or b"").translate(LOWER).replace(b"\0", b" ").split(b" ")
                words = [w for w in words if w]
                found = sorted({b" ".join(words[i : i + gram]) for i in range(max(1, len(words) - gram + 1))}) if words else []
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], names=["window", "item"])

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.encode(text_col, "UTF-8").alias("text"))
    return rows.mapInArrow(make, "window binary, item string").distinct()


def scan(rows: DataFrame, block: Broadcast, text: str) -> DataFrame:
    """rows with n_words, items and spans, by the windows of one block; column `text` is binary and is left out."""
    kept = [c for c in rows.columns if c != text]
    kinds = dict(rows.dtypes)

    def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
        """Runs of texts of about PIECE bytes."""
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= PIECE:
                yield at, i + 1
                at, size = i + 1, 0
        if at < len(texts):
            yield at, len(texts)

    def judged(texts: list[bytes], hasher: Hasher) -> tuple[np.ndarray, list, list]:
        low = b"\0".join(texts).translate(LOWER)
        begins = np.fromiter(accumulate([0, *(len(t) + 1 for t in texts[:-1])]), np.int64, len(texts))
        starts, stops, hashes = hasher.words(low)
        doc = np.searchsorted(begins, starts, "right") - 1
        items: list[set] = [set() for _ in texts]
        edge = np.zeros(len(starts) + 1, np.int32)
        for n, (wanted, table, shift) in block.value.sized.items():
            h = windows_of(hashes, n)
            at = np.flatnonzero(table[h >> shift]) if len(h) else np.zeros(0, np.int64)
            at = at[np.isin(h[at], wanted) & (doc[at] == doc[at + n - 1])]
            for i in at.tolist():
                own = block.value.of.get(b" ".join(low[a:z] for a, z in zip(starts[i : i + n].tolist(), stops[i : i + n].tolist(), strict=True)))
                if own is not None:
                    edge[i] += 1
                    edge[i + n] -= 1
                    items[doc[i]].update(own)
        hit = np.cumsum(edge[:-1]) > 0
        first_word = np.searchsorted(doc, np.arange(len(texts)))
        spans: list[list] = [[] for _ in texts]
        places = np.flatnonzero(hit)
        breaks = np.flatnonzero((np.diff(places) > 1) | (np.diff(doc[places]) > 0)) + 1
        for run in np.split(places, breaks) if len(places) else []:
            i, j, d = run[0], run[-1], doc[run[0]]
            spans[d].append({"first": int(i - first_word[d]), "last": int(j - first_word[d]), "start": int(starts[i] - begins[d]), "stop": int(stops[j] - begins[d])})
        return np.bincount(doc, minlength=len(texts)), [sorted(block.value.items[k] for k in s) for s in items], spans

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts = [t or b"" for t in batch.column(text).to_pylist()]
            for a, z in groups(texts):
                n, items, spans = judged(texts[a:z], hasher)
                own = [batch.column(c).slice(a, z - a) for c in kept]
                added = [pa.array(n, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "stop")])))]
                yield pa.RecordBatch.from_arrays([*own, *added], names=[*kept, "n_words", "items", "spans"])

    return rows.mapInArrow(make, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "n_words bigint, items array<string>", f"spans {SPANS}"]))


def joined_spans(spans: Column) -> Column:
    """Spans without overlaps or gaps of no word between them, in order."""

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        meets = (F.size(done) > 0) & (s["first"] <= F.when(F.size(done) > 0, last["last"]).otherwise(-2) + 1)
        farther = s["last"] > last["last"]
        wider = F.struct(last["first"].alias("first"), F.when(farther, s["last"]).otherwise(last["last"]).alias("last"), last["start"].alias("start"), F.when(farther, s["stop"]).otherwise(last["stop"]).alias("stop"))
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def found(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with n_words, n_hit, items and spans, which replace columns of those names: one row for each row of docs.

    A word inside any occurrence of a window is hit. items are the distinct ids, as strings in order, of items with an
    occurring window; spans are the runs of hit words: first and last word, and the bytes from start to before stop.
    Null and empty texts have no words; repeated rows are judged each; items that share an id are one, those without one
    are the item of the empty id; items without words match nothing; an empty benchmark finds nothing, empty docs give an
    empty result. Texts are scanned whole.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "items", "spans")
    windows = cut(grams(benchmark, gram, item_id, item_text), "benchmark-windows")
    size = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item") + 16)).first()[0] or 0
    n = -(-size // block) or 1

    def shared(k: int) -> Broadcast:
        own = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(n)) == k).toArrow()
        return spark.sparkContext.broadcast(Block(own.column("window").to_pylist(), own.column("item").to_pylist()))

    data, digest = fresh(docs, "data", "digest")
    if n == 1:
        out = scan(docs.withColumn(data, F.encode(text_col, "UTF-8")), shared(0), data)
    else:
        texts = docs.where(F.col(text_col).isNotNull()).select(F.sha2(text_col, 256).alias("k"), F.encode(text_col, "UTF-8").alias("data"))
        parts = None
        for k in range(n):
            held = shared(k)
            part = cut(scan(texts, held, "data").where("size(spans) > 0").distinct(), "benchmark-hits")
            held.destroy()
            parts = part if parts is None else parts.unionAll(part)
        hits = parts.groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), joined_spans(F.flatten(F.collect_set("spans"))).alias("spans"))
        none = scan(docs.withColumn(data, F.encode(text_col, "UTF-8")).withColumn(digest, F.sha2(text_col, 256)), spark.sparkContext.broadcast(Block([], [])), data).drop("items", "spans")
        out = none.join(hits.withColumnRenamed("k", digest), digest, "left").drop(digest)
        out = out.withColumns({"items": F.coalesce("items", F.array().cast("array<string>")), "spans": F.coalesce("spans", F.array().cast(SPANS))})
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1))


def without_spans(text: Column, spans: Column) -> Column:
    """text without the bytes of its spans, which are in order and apart; null stays null."""
    data = F.encode(text, "UTF-8")
    start = F.struct(F.lit(b"").alias("kept"), F.lit(0).cast("long").alias("at"))
    upto = lambda s, to: F.concat(s["kept"], F.substring(data, (s["at"] + 1).cast("int"), (to - s["at"]).cast("int")))
    left = F.aggregate(spans, start, lambda s, x: F.struct(upto(s, x["start"]).alias("kept"), x["stop"].alias("at")), lambda s: upto(s, F.octet_length(data)))
    return F.when(F.size(spans) == 0, text).otherwise(F.decode(left, "UTF-8"))


def cleaned(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", most: float = 0.0, text_col: str = "text", **options) -> DataFrame:
    """docs without contamination: remove="spans" cuts all hit spans out of the texts, remove="documents" drops documents of which more than the share `most` of words is hit.

    Columns are those of docs; documents without a hit stay as they are, those without words too.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    rows = found(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text")), benchmark, **options)
    if remove == "documents":
        return rows.where(F.col("n_hit") <= F.lit(most) * F.col("n_words")).select("row.*")
    return rows.select(*(without_spans(F.col("text"), F.col("spans")).alias(c) if c == text_col else F.col(f"row.{c}") for c in docs.columns))
