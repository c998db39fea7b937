"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors of a label lexicographically by the concatenated bits of random projections and compares
each block of neighbours with itself and the window before it; links found are joined within the block at once, so
that a dense block yields one row a vector. Passes are united by components. What no window held is then found
exactly: vectors are put in blocks by cells of fixed orthonormal directions, large components in blocks of their own,
and blocks are compared wherever their bounds allow a link between different components, whatever the label's size.
Last, the vectors of a component are compared, tile by tile, for the number of links of each.
Exact copies are one vector with a count throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitlake.llm.common import components, cut

PASSES, BITS, WINDOW, BLOCK, TILE = 16, 60, 64, 192, 512
#: Fixed directions that bound the distance of blocks.
AXES = 8


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes, null where they can link with nothing."""
    for pdf in batches:
        out = []
        for v in pdf["vec"]:
            x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
            good = x is not None and x.size and np.isfinite(x).all() and x.any()
            if good:
                with np.errstate(over="ignore", under="ignore"):
                    if not 1e-200 < (x * x).sum() < 1e200:  # squares that a double cannot hold
                        x = x / np.abs(x).max()
            out.append(x.tobytes() if good else None)
        yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "raw": out})


def planes(seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, BITS))


def _keyed(passes: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for pdf in batches:
            for size, part in pdf.groupby(pdf["raw"].str.len()):
                x = unit(part["raw"].tolist())
                for p in range(passes):
                    yield part.assign(no=p, key=((x @ planes(p, size // 8)) > 0) @ powers)

    return make


def joined(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric link matrix reaches."""
    own = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        low = np.where(reach, own[None, :], len(own)).min(1)
        low = low[low]
        if (low == own).all():
            return own
        own = low


def _runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Pieces of runs of rows with equal values in sorted batches, and whether a piece begins its run."""
    last = None
    for pdf in batches:
        marks = list(pdf[by].itertuples(index=False, name=None))
        at = 0
        for i in range(1, len(marks) + 1):
            if i == len(marks) or marks[i] != marks[at]:
                yield marks[at] != last, pdf.iloc[at:i]
                last, at = marks[at], i


def _windows(threshold: float):
    by = ["no", "label", "size"]

    def found(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([old, new])
        x = unit(both["raw"].tolist())
        low = joined(x @ x.T >= threshold)
        moved = low != np.arange(len(low))
        reps = both["rep"].to_numpy()
        return pd.DataFrame({"kind": 0, "part": 0, "a": reps[moved], "b": reps[low[moved]]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links (kind 0), and the partition's first and last rows (kinds 1 and 2) for the seams between partitions."""
        here = TaskContext.get().partitionId()
        tail, all_tail, n = None, None, 0
        for fresh, run in _runs(batches, by):
            if fresh:
                tail = run.iloc[:0]
            for at in range(0, len(run), BLOCK):
                new = run.iloc[at : at + BLOCK]
                yield found(tail, new)
                tail = pd.concat([tail, new]).iloc[-WINDOW:]
            if n < WINDOW:
                head = run.iloc[: WINDOW - n]
                yield head.assign(kind=1, part=here)
                n += len(head)
            all_tail = pd.concat([all_tail, run.iloc[-WINDOW:]]).iloc[-WINDOW:] if all_tail is not None else run.iloc[-WINDOW:]
        if all_tail is not None:
            yield all_tail.assign(kind=2, part=here)

    def seam(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, mark = [], None
        for _, run in _runs(batches, ["part", *by]):
            now = tuple(run.iloc[0][["part", *by]])
            if now != mark and held:
                yield found(held[0].iloc[:0], pd.concat(held))[["a", "b"]]
                held = []
            mark = now
            held.append(run)
        if held:
            yield found(held[0].iloc[:0], pd.concat(held))[["a", "b"]]

    return compare, seam


def _links(reps: DataFrame, passes: int, threshold: float) -> DataFrame:
    spark = reps.sparkSession
    fields = "no int, key long, label long, size int, rep long, raw binary"
    keyed = reps.select("label", F.octet_length("raw").alias("size"), "rep", "raw").mapInPandas(_keyed(passes), "label long, size int, rep long, raw binary, no int, key long").select("no", "key", "label", "size", "rep", "raw")
    order = ["no", "label", "size", "key", "rep"]
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    compare, seam = _windows(threshold)

    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["kind", "part", "a", "b", *[f.split()[0] for f in fields.split(", ")]]
        for pdf in compare(batches):
            if len(pdf):
                yield pdf.reindex(columns=names).astype({c: "Int64" for c in ("a", "b", "no", "key", "label", "size", "rep")})

    swept = cut(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(complete, f"kind int, part int, a long, b long, {fields}"), "vectors-swept")
    filled = [r["part"] for r in swept.where("kind = 2").select("part").distinct().orderBy("part").collect()]  # as many as partitions
    after = dict(zip(filled[1:], filled, strict=False))
    links = swept.where("kind = 0").select("a", "b")
    if after:
        before = F.element_at(F.create_map(*(F.lit(x) for pair in after.items() for x in pair)), F.col("part"))
        edges = swept.where("kind > 0").withColumn("part", F.when(F.col("kind") == 2, F.col("part")).otherwise(before)).where("part is not null").select("part", "kind", "no", "key", "label", "size", "rep", "raw")
        seams = edges.repartition(n, "part").sortWithinPartitions("part", "no", "label", "size", F.desc("kind"), "key", "rep")
        links = links.unionAll(seams.mapInPandas(seam, "a long, b long"))
    return links


def _counted(threshold: float):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, mark = [], None

        def done() -> pd.DataFrame:
            rows = pd.concat(held)
            x, n = unit(rows["raw"].tolist()), rows["n"].to_numpy()
            i, j = mark[1:]
            blk = rows["blk"].to_numpy()
            if i == j:
                linked = x @ x.T >= threshold
                np.fill_diagonal(linked, False)
                return pd.DataFrame({"rep": rows["rep"], "links": linked @ n})
            a, b = blk == i, blk == j
            linked = x[a] @ x[b].T >= threshold
            return pd.DataFrame({"rep": np.concatenate([rows["rep"][a], rows["rep"][b]]), "links": np.concatenate([linked @ n[b], n[a] @ linked])})

        for fresh, run in _runs(batches, ["component", "i", "j"]):
            if fresh and held:
                yield done()
                held = []
            mark = tuple(run.iloc[0][["component", "i", "j"]])
            held.append(run)
        if held:
            yield done()

    return count


def axes(dim: int) -> np.ndarray:
    """(dim, AXES) orthonormal directions; zeros beyond dim."""
    found = np.linalg.qr(np.random.default_rng([AXES, dim]).standard_normal((dim, min(AXES, dim))))[0]
    return np.pad(found, ((0, 0), (0, AXES - found.shape[1])))


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for size, part in pdf.groupby(pdf["raw"].str.len()):
            x = unit(part["raw"].tolist()) @ axes(size // 8)
            yield part.assign(size=size, **{f"p{k}": x[:, k] for k in range(AXES)})


def _crossing(threshold: float):
    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, mark = [], None

        def done() -> pd.DataFrame:
            """Links between components, no more than join them."""
            rows = pd.concat(held)
            x, c, blk = unit(rows["raw"].tolist()), rows["component"].to_numpy(), rows["blk"].to_numpy()
            a, b = blk == mark[2], blk == mark[3]
            i, j = np.nonzero((x[a] @ x[b].T >= threshold) & (c[a][:, None] != c[b][None, :]))
            root, kept = {}, []
            for p, q in np.unique(np.stack([c[a][i], c[b][j]], 1), axis=0).tolist():
                ends = []
                for e in (p, q):
                    while (up := root.get(e, e)) != e:
                        root[e] = root.get(up, up)
                        e = up
                    ends.append(e)
                if ends[0] != ends[1]:
                    root[max(ends)] = min(ends)
                    kept.append((p, q))
            return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

        for fresh, run in _runs(batches, ["label", "size", "i", "j"]):
            if fresh and held:
                yield done()
                held = []
            mark = tuple(run.iloc[0][["label", "size", "i", "j"]])
            held.append(run)
        if held:
            yield done()

    return cross


def _completed(reps: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """found, (node, component), with all links of different components, also those that no window held.

    The unit vectors of a link are at most `reach` apart, and so are their projections on orthonormal directions: two
    blocks with a link have bounds that are no farther apart. A block has TILE vectors or so. It is of one component
    where that is large, and such blocks of the same component are not compared.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    n = max(8, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    group = ["label", "size"]
    named = reps.join(found, reps["rep"] == found["node"], "left").select("label", "rep", F.coalesce("component", "rep").alias("component"), "raw")
    fields = ", ".join(f"p{k} double" for k in range(AXES))
    rows = cut(named.mapInPandas(_placed, f"label long, rep long, component long, raw binary, size int, {fields}"), "vectors-placed")
    large = found.groupBy("component").agg(F.count("*").alias("of")).where(F.col("of") > TILE // 2).select("component", F.col("component").alias("large"))
    used = rows.groupBy(*group).agg(F.floor(F.log2(F.greatest(F.lit(1.0), F.count("*") / TILE)) / 2).cast("int").alias("used"))  # a direction has about four cells with vectors
    cells = [F.when(F.col("used") > k, F.floor(F.col(f"p{k}") / reach)).otherwise(0) for k in range(AXES)]
    rows = rows.join(large, "component", "left").join(used, group).withColumn("cell", F.xxhash64("large", *cells))
    counts = rows.groupBy(*group, "cell").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("blocks"))
    rows = rows.join(counts, [*group, "cell"]).withColumn("blk", F.xxhash64("cell", F.pmod(F.xxhash64("rep"), F.col("blocks"))))
    rows = cut(rows.select("label", "size", "blk", "component", "raw", *(f"p{k}" for k in range(AXES))), "vectors-blocks")

    bounds = [f(f"p{k}").alias(f"{name}{k}") for k in range(AXES) for name, f in (("lo", F.min), ("hi", F.max))]
    blocks = cut(rows.groupBy(*group, "blk").agg(F.min("component").alias("first"), F.max("component").alias("last"), *bounds), "vectors-bounds")
    i, j = blocks.alias("i"), blocks.alias("j")
    gaps = [F.greatest(F.lit(0.0), F.col(f"i.lo{k}") - F.col(f"j.hi{k}"), F.col(f"j.lo{k}") - F.col(f"i.hi{k}")) for k in range(AXES)]
    near = sum((g * g for g in gaps), F.lit(0.0)) <= reach * reach
    several = F.least("i.first", "j.first") != F.greatest("i.last", "j.last")
    pairs = i.join(j, group).where((F.col("i.blk") <= F.col("j.blk")) & several & near).select(*group, F.col("i.blk").alias("i"), F.col("j.blk").alias("j"))
    pairs = cut(pairs, "vectors-tiles")
    sent = pairs.select(*group, F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"), "i", "j")
    tiles = rows.select("label", "size", "blk", "component", "raw").join(sent, [*group, "blk"])
    tiles = tiles.repartition(n, *group, "i", "j").sortWithinPartitions(*group, "i", "j")
    more = components(tiles.mapInPandas(_crossing(threshold), "a long, b long"), "vectors-rest")
    joined_up = more.select(F.col("node").alias("component"), F.col("component").alias("least"))
    old = found.join(joined_up, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return cut(old.unionAll(more.join(found, "node", "left_anti").select("node", "component")), "vectors-found")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, passes: int = PASSES) -> DataFrame:
    """(id, n_links, component_id, kept): one row for each row of df; other columns are not read.

    Only vectors of one label and one length are compared. A null id, a null label, and a vector that is null, empty,
    zero, or has null or non-finite components link with nothing; component_id is then the id itself and kept is true.
    Rows that repeat an id are one node: each shows the sum of the links of all its rows, to each other too, and the
    component that all of them reach. Exact copies link. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = cut(rows.mapInPandas(_clean, "vec_id long, label long, raw binary").withColumn("digest", F.md5("raw")), "vectors-clean")
    good = rows.where("raw is not null and label is not null and vec_id is not null")
    classes = good.groupBy("label", "digest").agg(F.count("*").alias("n"), F.first("raw").alias("raw"))
    reps = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors-classes")  # rep numbers the distinct vectors of a label

    found = _completed(reps, components(_links(reps, passes, threshold), "vectors"), threshold)
    linked = reps.join(found, reps["rep"] == found["node"])
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("blocks"))
    tiled = linked.join(sizes, "component").withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiled.select("component", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "rep", "n", "raw")
    n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tiles = tiles.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    counts = tiles.mapInPandas(_counted(threshold), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    result = reps.join(found, reps["rep"] == found["node"], "left").join(counts, "rep", "left")
    result = result.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    of_rows = good.select("vec_id", "label", "digest").join(result, ["label", "digest"])
    of_ids = cut(of_rows.groupBy("vec_id").agg(F.sum("links").alias("n_links"), F.min("component").alias("component"), F.max("component").alias("other")), "vectors-ids")
    if not of_ids.where("component < other").isEmpty():  # ids whose rows lie in several components join them
        several = of_rows.select("vec_id", F.col("component").alias("a")).join(of_ids.select("vec_id", F.col("component").alias("b")), "vec_id").where("a <> b").select("a", "b")
        joined_up = components(several, "vectors-repeated").select(F.col("node").alias("component"), F.col("component").alias("least"))
        of_ids = of_ids.join(joined_up, "component", "left").select("vec_id", "n_links", F.coalesce("least", "component").alias("component"))
    names = of_ids.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = of_ids.join(names, "component").select("vec_id", "n_links", "component_id")
    out = rows.select("vec_id").join(named, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
