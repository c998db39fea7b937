"""Near-duplicate documents by ProbMinHash on weighted word shingles, banding and verification.

A document is a multiset of five-word shingles, weighed by their counts. Each shingle's Poisson process of rate equal
to its weight drops arrivals on HASHES components; a component keeps the shingle of its earliest arrival, and a
shingle stops once its arrivals come later than all components' earliest. Two documents agree on a component with the
probability Jaccard similarity. ROWS components make a band; documents that share a band are candidates.

Exact copies are one class with a number of its own. Within a band's bucket all classes are first verified against the
smallest. Of buckets that still hold several components, classes of which too much is found in no other class of such
buckets can link with none, and go; the others meet in tiles, blocks of the bucket against blocks, wherever the blocks'
bounds allow a link. A tile's similarities are bounded by matrix products, those that may link two components are
computed exactly, and a tile gives only the links that join components: no candidate pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitlake.llm.common import components, cut, fresh, gathered_runs

SIZE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
HASHES = BANDS * ROWS
AT_ONCE = 200_000
#: Bits of the set of candidates that each worker holds; beyond that many ids it only filters less.
FILTER = 1 << 26
#: Classes and MB of shingles in a block, about, the levels of own shares that part a large bucket, and shingles in a product.
TILE, TILE_BYTES, LEVELS, COLUMNS = 1024, 32_000_000, 8, 4096
_U = np.uint64


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, whole; null as empty."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's shingles and their document's number; a document of fewer than SIZE words is one shingle."""
    starts = np.concatenate([[0], ends[:-1]])
    n = ends - starts
    count = np.where(n == 0, 0, np.maximum(1, n - SIZE + 1))
    doc = np.repeat(np.arange(len(ends)), count)
    first = np.repeat(starts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    last = np.repeat(ends, count)
    h = np.zeros(len(doc), _U)
    for i in range(SIZE):
        at = first + i
        inside = at < last
        word = np.where(inside, words[np.minimum(at, max(len(words) - 1, 0))].view(_U) if len(words) else _U(0), _U(i))
        h = mixed(h * _U(0x9E3779B97F4A7C15) + word)
    return h, doc


def weighted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document and their counts, in order of document and hash."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


def prob_minhash(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, hashes: int = HASHES) -> np.ndarray:
    """(n_docs, hashes): for each component the 32 low bits of the shingle that arrives first; 0 for an empty document."""
    best = np.full(n_docs * hashes, np.iinfo(np.uint64).max, _U)  # time as ordered bits above, shingle below
    state, time = h.copy(), np.zeros(len(h))
    low = h & _U(0xFFFFFFFF)
    while len(state):
        state = mixed(state + _U(0x9E3779B97F4A7C15))
        u = ((state >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)
        time = time - np.log(u) / weight
        component = (mixed(state ^ _U(0xD6E8FEB86659FD93)) % _U(hashes)).astype(np.int64)
        arrival = (time.astype(np.float32).view(np.uint32).astype(_U) << _U(32)) | low
        np.minimum.at(best, doc * hashes + component, arrival)
        latest = best.reshape(n_docs, hashes).max(1)
        go = (time.astype(np.float32).view(np.uint32).astype(_U) << _U(32)) <= latest[doc]
        state, time, doc, weight, low = state[go], time[go], doc[go], weight[go], low[go]
    best[best == np.iinfo(np.uint64).max] = 0
    return (best & _U(0xFFFFFFFF)).reshape(n_docs, hashes)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.zeros((len(signature), bands), _U)
    for b in range(bands):
        h = np.full(len(signature), b + 1, _U)
        for r in range(rows):
            h = mixed(h * _U(0x9E3779B97F4A7C15) + signature[:, b * rows + r])
        keys[:, b] = h
    return keys.view(np.int64)


def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch of about AT_ONCE words: first row, last row, words, ends."""
    lists = batch.column("words")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + AT_ONCE, "right")) - 1)
        hi = min(hi, len(lists))
        yield lo, hi, values[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo]
        lo = hi


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words, ends in parts(batch):
            h, doc = shingles(words, ends)
            h, doc, n = weighted(h, doc)
            keys = band_keys(prob_minhash(h, doc, n.astype(np.float64), hi - lo))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            own = [batch.column(c).slice(lo, hi - lo) for c in ("id", "digest")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(np.concatenate([[0], ends])) == 0), bands], names=["id", "digest", "empty", "bands"])


def _sets(bits):
    """Sorted multisets of shingles of the texts whose bit is set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = bits.value
        for batch in batches:
            slot = batch.column("slot").to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array((words_of[slot >> 6] >> (slot & 63).astype(_U)) & _U(1) == 1))
            for lo, hi, words, ends in parts(batch):
                h, doc = shingles(words, ends)
                h = h[np.lexsort((h, doc))]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))]) * 8
                raw = h.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("digest").slice(lo, hi - lo), pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["digest", "grams"])

    return make


def _slot(digest: Column, id_: Column) -> Column:
    """The bit of a text; of the copies of a text, which differ in their ids, one is meant."""
    return F.pmod(F.xxhash64(digest, id_), F.lit(FILTER))


def _bits(texts: DataFrame):
    """The broadcast bit set of (digest, id): FILTER bits, however many there are."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    found = texts.select(_slot(F.col("digest"), F.col("id")).alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    words = np.zeros(FILTER >> 6, _U)
    words[found["at"].to_numpy()] = found["word"].to_numpy().astype(np.int64).view(_U)
    return texts.sparkSession.sparkContext.broadcast(words)


def similarity(a: bytes, b: bytes) -> float:
    """The probability Jaccard similarity of two sorted multisets of shingles, exactly."""
    (x, nx), (y, ny) = (np.unique(np.frombuffer(s, _U), return_counts=True) for s in (a, b))
    both, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = nx[ix].astype(float), ny[iy].astype(float)
    only_a, only_b = nx.sum() - wa.sum(), ny.sum() - wb.sum()
    if (wa == wb).all() and (wa == wa[0]).all():
        return len(both) / (len(both) + (only_a + only_b) / wa[0])
    ratio = wa / wb
    order = np.argsort(ratio)
    sorted_ratio, below_b, total_a = ratio[order], np.concatenate([[0], np.cumsum(wb[order])]), wa.sum()
    below_a = np.concatenate([[0], np.cumsum(wa[order])])
    at = np.searchsorted(sorted_ratio, ratio, "left")  # shared shingles of a smaller ratio count by their weight in b
    bound = (only_a + total_a - below_a[at]) / wa + (only_b + below_b[at]) / wb
    return float((1 / bound).sum())


def _verified(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity is threshold or more."""

    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    left = pairs.join(grams.select(F.col("no").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(grams.select(F.col("no").alias("b"), F.col("grams").alias("gb")), "b")
    return both.where(similar("ga", "gb") >= threshold).select("a", "b")


def _apart(members: DataFrame) -> DataFrame:
    """The (key, no, component, ...) of buckets that hold several components."""
    several = members.groupBy("key").agg((F.min("component") < F.max("component")).alias("several")).where("several").select("key")
    return members.join(several, "key", "left_semi")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct shingle of a class: the shingle, the class, and the shingle's share in it."""
    for batch in batches:
        for no, raw in zip(batch.column("no").to_pylist(), batch.column("grams"), strict=True):
            h, n = np.unique(np.frombuffer(raw.as_buffer(), _U), return_counts=True)
            for at in range(0, len(h), AT_ONCE):
                part = h[at : at + AT_ONCE]
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(np.full(len(part), no)), pa.array(n[at : at + AT_ONCE] / n.sum())], names=["gram", "no", "share"])


def _own(grams: DataFrame) -> DataFrame:
    """(no, own): the share of a class's shingles that no other class of grams has; without a row it is 0."""
    rows = grams.mapInArrow(_spread, "gram long, no long, share double")
    alone = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("no").alias("no"), F.min("share").alias("share")).where("n = 1")
    return alone.groupBy("no").agg(F.least(F.sum("share"), F.lit(1.0)).alias("own"))


def bound_of_shares(x, y):
    """What the similarity of two texts cannot exceed, if they share these shares of their shingles."""
    return 1 / (1 / x + 1 / y - 1)


def overlaps(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a and each of b, the share of each one's shingles that the other has."""
    sides = []
    for texts in (a, b):
        counted = [np.unique(np.frombuffer(t, _U), return_counts=True) for t in texts]
        h = np.concatenate([x for x, _ in counted])
        doc = np.repeat(np.arange(len(texts)), [len(x) for x, _ in counted])
        sides.append((h, doc, np.concatenate([n / n.sum() for _, n in counted]).astype(np.float32)))
    common = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    x, y = np.zeros((len(a), len(b)), np.float32), np.zeros((len(a), len(b)), np.float32)
    entries = []
    for h, doc, share in sides:
        at = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
        good = np.flatnonzero(common[at] == h) if len(common) else np.zeros(0, np.int64)
        good = good[np.argsort(at[good], kind="stable")]
        entries.append((at[good], doc[good], share[good]))
    for lo in range(0, len(common), COLUMNS):
        dense = []
        for (at, doc, share), texts in zip(entries, (a, b), strict=True):
            i, j = np.searchsorted(at, [lo, lo + COLUMNS])
            has, of = (np.zeros((len(texts), min(COLUMNS, len(common) - lo)), np.float32) for _ in range(2))
            has[doc[i:j], at[i:j] - lo], of[doc[i:j], at[i:j] - lo] = 1, share[i:j]
            dense.append((has, of))
        x += dense[0][1] @ dense[1][0].T
        y += dense[0][0] @ dense[1][1].T
    return x, y


def joining(rows: pd.DataFrame, key: int, i: int, j: int, threshold: float) -> list[tuple[int, int]]:
    """Links of a tile, no more than join its components: pairs of block i and block j.

    A pair that shares a smaller key of the same band is left to that bucket.
    """
    a, b = rows[rows["blk"] == i], rows[rows["blk"] == j]
    open_ = a["component"].to_numpy()[:, None] != b["component"].to_numpy()[None, :]
    if i == j:
        open_ = np.triu(open_, 1)
    for x, y in zip(np.stack(a["bands"].tolist()).T, np.stack(b["bands"].tolist()).T, strict=True):
        open_ &= (x[:, None] != y[None, :]) | (x >= key)[:, None]
    if not open_.any():
        return []
    used_a, used_b = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    a, b, open_ = a.iloc[used_a], b.iloc[used_b], open_[np.ix_(used_a, used_b)]
    ga, gb = a["grams"].tolist(), b["grams"].tolist()
    x, y = overlaps(ga, gb)
    with np.errstate(divide="ignore", invalid="ignore"):
        open_ &= np.nan_to_num(bound_of_shares(x, y)) >= threshold - 1e-4
    names, inverse = np.unique(np.concatenate([a["component"], b["component"]]), return_inverse=True)
    root = np.arange(len(names))  # of each component, itself or what it was joined to
    ca, cb = inverse[: len(a)], inverse[len(a) :]
    na, nb = a["no"].tolist(), b["no"].tolist()
    found = []
    for r in np.flatnonzero(open_.any(1)).tolist():
        for c in np.flatnonzero(open_[r]).tolist():
            p, q = root[ca[r]], root[cb[c]]
            if p != q and similarity(ga[r], gb[c]) >= threshold:
                root[root == max(p, q)] = min(p, q)
                found.append((na[r], nb[c]))
    return found


def _crossing(threshold: float):
    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (key, i, j), rows in gathered_runs(batches, ["key", "i", "j"]):
            yield pd.DataFrame(joining(rows, key, i, j, threshold), columns=["a", "b"], dtype="int64")

    return cross


def _rest(members: DataFrame, grams: DataFrame, bands: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join components of a bucket, found by exact comparison of all its classes that may have one."""
    spark = members.sparkSession
    placed = members.select("key", "no").join(found, members["no"] == found["node"], "left").select("key", "no", F.coalesce("component", "no").alias("component"))
    apart = cut(_apart(placed), "near-apart")
    left = cut(apart.select("no").distinct(), "near-left")
    grams = cut(grams.join(left, "no", "left_semi"), "near-left-grams")
    bound = 1 / threshold + 1e-9  # of 1 / x + 1 / y - 1 for shares x and y
    need = 1 / (1 - F.least(F.coalesce("own", F.lit(0.0)), F.lit(1 - 1e-6)))
    sized = grams.select("no", F.octet_length("grams").alias("bytes")).join(_own(grams), "no", "left").select("no", "bytes", need.alias("need"))
    able = cut(_apart(apart.join(sized.where(F.col("need") <= bound), "no")), "near-able")

    level = F.floor((F.col("need") - 1) / (bound - 1) * LEVELS * 0.999).cast("int")
    level = able.withColumn("level", level)
    count = lambda: F.greatest(F.lit(1), F.ceil(F.greatest(F.count("*") / F.lit(TILE), F.sum("bytes") / F.lit(TILE_BYTES)))).cast("int")
    large = level.groupBy("key").agg(count().alias("blocks")).where("blocks > 1").select("key", F.lit(1).alias("large"))
    level = level.join(large, "key", "left").withColumn("level", F.when(F.col("large").isNull(), 0).otherwise(F.col("level"))).drop("large")
    blocks = level.groupBy("key", "level").agg(count().alias("blocks"))
    rows = cut(level.join(blocks, ["key", "level"]).withColumn("blk", F.col("level") + LEVELS * F.pmod(F.xxhash64("no"), F.col("blocks"))).select("key", "blk", "no", "component", "need"), "near-blocks")
    bounds = cut(rows.groupBy("key", "blk").agg(F.min("need").alias("need"), F.min("component").alias("first"), F.max("component").alias("last")), "near-bounds")
    i, j = bounds.alias("i"), bounds.alias("j")
    several = F.least("i.first", "j.first") != F.greatest("i.last", "j.last")
    tiles = i.join(j, "key").where((F.col("i.blk") <= F.col("j.blk")) & several & (F.col("i.need") + F.col("j.need") - 1 <= bound)).select("key", F.col("i.blk").alias("i"), F.col("j.blk").alias("j"))
    sent = tiles.select("key", F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"), "i", "j")
    full = rows.select("key", "blk", "no", "component").join(sent, ["key", "blk"]).join(grams, "no").join(bands, "no")
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = ["key", "i", "j"]
    dealt = full.select(*by, "blk", "no", "component", "bands", "grams").repartition(n, *by).sortWithinPartitions(*by)
    return cut(dealt.mapInPandas(_crossing(threshold), "a long, b long"), "near-rest")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): (id, digest, empty) for each row of docs, and (digest, group_no, class_id, first_digest) for each text that is not empty.

    group_no is the same for all texts of a group; class_id is the smallest id of its rows, null if none has one, and
    first_digest the smallest digest of its texts that has that id.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(F.col(text_col).cast("binary")).alias("digest"), F.col(text_col).alias("text"))
    signed = cut(texts.select("id", "digest", word_hashes(F.col("text")).alias("words")).mapInArrow(_signed, "id long, digest string, empty boolean, bands array<long>"), "near-signed")
    full = signed.where("not empty")
    classes = cut(full.groupBy("digest").agg(F.min("id").alias("id"), F.first("bands").alias("bands")).withColumn("no", F.monotonically_increasing_id()), "near-classes")

    keys = classes.select("no", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("no").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    members = cut(keys.join(shared, "key"), "near-members")
    pairs = cut(members.where("no <> hub").select(F.col("hub").alias("a"), F.col("no").alias("b")).distinct(), "near-pairs")
    wanted = cut(classes.join(members.select("no").distinct(), "no", "left_semi").select("no", "digest", "id"), "near-wanted")
    in_groups = texts.select("digest", _slot(F.col("digest"), F.col("id")).alias("slot"), word_hashes(F.col("text")).alias("words")).mapInArrow(_sets(_bits(wanted)), "digest string, grams binary")
    grams = cut(in_groups.join(wanted.select("digest", "no"), "digest").select("no", "grams").dropDuplicates(["no"]), "near-grams")

    links = cut(_verified(pairs, grams, threshold), "near-links")
    rest = _rest(members, grams, classes.select("no", "bands"), components(links, "near-first"), threshold)
    several = full.where("id is not null").groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("id")
    of_ids = full.join(several, "id").select("id", "digest").distinct().join(classes.select("digest", "no"), "digest")
    same_id = of_ids.join(of_ids.groupBy("id").agg(F.min("no").alias("b")), "id").select(F.col("no").alias("a"), "b")
    group = components(links.unionAll(rest).unionAll(same_id), "near-last")
    placed = cut(classes.select("digest", "no", "id").join(group, classes["no"] == group["node"], "left").select("digest", "id", F.coalesce("component", "no").alias("group_no")), "near-placed")
    least = placed.groupBy("group_no").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("m"))
    return signed.select("id", "digest", "empty"), placed.select("digest", "group_no").join(least.select("group_no", F.col("m.id").alias("class_id"), F.col("m.digest").alias("first_digest")), "group_no")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, kept): one row for each row of docs; class_id is the smallest id of its group, kept that id's rows.

    Null and empty texts, and those of white space only, are in no group: their class is their id, and they are kept.
    Rows without an id are in the groups of their texts; they are kept where no row of the group has an id, and their
    class is null then. Rows that repeat an id repeat its result; an id with several texts joins their groups. Texts of
    any length count whole; an empty table gives an empty result; other columns are not read.
    """
    rows, classes = groups(docs, id_col, text_col, threshold)
    out = rows.join(classes.select("digest", "class_id", F.lit(True).alias("grouped")), "digest", "left").select("id", F.when(F.col("grouped"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"))
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group: that of its smallest id, of its first text where that id has several.

    Rows in no group all stay; among rows that repeat both id and text, any of these equal ones stays, with its other columns.
    """
    _, classes = groups(docs, id_col, text_col, threshold)
    digest, group, class_, first = fresh(docs, "digest", "group", "class", "first")
    own = classes.select(F.col("digest").alias(digest), F.col("group_no").alias(group), F.col("class_id").alias(class_), (F.col("digest") == F.col("first_digest")).alias(first))
    named = docs.withColumn(digest, F.md5(F.col(text_col).cast("binary"))).join(own, digest, "left")
    kept = cut(named.where(F.col(group).isNull() | (F.col(first) & F.col(id_col).cast("long").eqNullSafe(F.col(class_)))), "near-kept")
    single = kept.where(F.col(group).isNotNull()).dropDuplicates([group])
    return kept.where(F.col(group).isNull()).unionAll(single).select(*docs.columns)
