"""Merkle manifest of a dataset: a content-addressed store of digest-to-children records, and proofs by descent from the root.

Leaves of a group ascend by id; every `WIDE` consecutive nodes become their digest until one is left, the group's
subroot, and the subroots in order of their groups likewise give the root. build() makes the records level by level;
they are addressed by content alone. prove() descends: at each level the nodes reached so far are joined to their records by
digest, once each however many leaves lie below them, and each child takes along the children not selected, from the
root downwards. A leaf's request meets its parent by its rank's higher digits and selects by the last; its path, reversed, is the proof.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlake.llm.common import cut

WIDE = 3
#: Levels of a descent between written cuts.
CUT = 4
#: A level of a path: which child was selected, and the others, from left to right.
STEP = "struct<place int, others array<binary>>"


def framed(value: Column) -> Column:
    """A value as `-` where null, else its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(framed, values)), 256))


def node_digest(children: Column) -> Column:
    """The digest of the children's digests as hexadecimal text, one behind the other."""
    return F.unhex(F.sha2(F.lower(F.array_join(F.transform(children, F.hex), "")), 256))


def group_key(group: Column) -> Column:
    """A group as text that is never null and sorts by its bytes, null first."""
    return F.when(group.isNull(), "-").otherwise(F.concat(F.lit("="), group.cast("string")))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (of a column grp) with rank, from 0 in order within grp, and n, the rows of the group.

    Rows are dealt into ranges of the whole order, each numbered as a stream, and the ranges' counts summed: no task has a group.
    """
    kinds = dict(rows.dtypes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for grp in batch.column("grp").to_pylist():
                last, at = grp, at + 1 if grp == last else 0
                places.append(at)
            added = [pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "range", "place"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rows.columns), "range int, place bigint"])
    dealt = cut(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).mapInArrow(number, schema), f"{name}-ranges")
    whole, before = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("grp", "range").agg(F.count("*").alias("c"))
    starts = counts.select("grp", "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(whole).alias("n"))
    return dealt.join(starts, ["grp", "range"]).withColumn("rank", F.col("place") + F.col("start")).drop("range", "start", "place")


@dataclass
class Tree:
    """roots: (grp, digest, n, depth), one a group; records: one table a level, of (digest, children), from the leaves' parents upwards."""

    roots: DataFrame
    records: list[DataFrame]


def build(leaves: DataFrame, name: str) -> Tree:
    """The trees over (grp, rank, n, digest), each group's own; equal subtrees are one record."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    level, records, roots = leaves.select("grp", "rank", "n", "digest"), [], leaves.where("n = 1").select("grp", "digest", "n", F.lit(0).alias("depth"))
    width = 1
    while width < most:
        parents = level.where(F.col("n") > width).groupBy("grp", F.expr(f"rank div {WIDE}").alias("rank"), "n").agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("c"))
        parents = parents.select("grp", "rank", "n", F.transform("c", lambda x: x["digest"]).alias("children"))
        level = cut(parents.withColumn("digest", node_digest(F.col("children"))), f"{name}-level")
        records.append(level.select("digest", "children").dropDuplicates(["digest"]))
        width *= WIDE
        roots = roots.unionAll(level.where(F.col("n") <= width).select("grp", "digest", "n", F.lit(len(records)).alias("depth")))
    return Tree(roots, records)


def descended(nodes: DataFrame, records: DataFrame, own: list[str]) -> DataFrame:
    """The children of nodes (own, rank, digest, path), with the path down to each: their place, and the children not selected."""
    held = records.select("digest", "children")
    opened = nodes.join(held, "digest").select(*own, "rank", "path", "children", F.posexplode("children").alias("place", "child"))
    return opened.select(*own, (F.col("rank") * WIDE + F.col("place")).alias("rank"), F.col("child").alias("digest"), with_step(F.col("path"), F.col("place"), F.col("children")).alias("path"))


def with_step(path: Column, place: Column, children: Column) -> Column:
    others = F.filter(children, lambda _, i: i != place)
    return F.concat(path, F.array(F.struct(place.cast("int").alias("place"), others.alias("others"))))


def paths(tree: Tree, starts: DataFrame, own: list[str], name: str, down_to: int) -> DataFrame:
    """The nodes of level `down_to` of each tree, with their paths from where starts, (own, rank, digest, path, depth), begin."""
    here = None
    for depth in range(len(tree.records), down_to - 1, -1):
        new = starts.where(F.col("depth") == depth).select(*own, "rank", "digest", "path")
        here = new if here is None else here.unionAll(new)
        if depth > down_to:
            here = descended(here, tree.records[depth - 1], own)
            if depth % CUT == 0:
                here = cut(here, f"{name}-descent")
    return here


def prove(leaves: DataFrame, tree: Tree, upper: Tree, order: DataFrame) -> DataFrame:
    """Each leaf's request, answered: leaves with subroot, root and path, a STEP for each level from the root down to the leaf.

    order holds (grp, top): the place of each group's subroot under the upper tree, which has one group.
    """
    above = upper.roots.select(F.lit(0).cast("long").alias("rank"), F.col("digest"), F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"), "depth")
    tops = paths(upper, above, ["root"], "merkle-upper", 0).select(F.col("rank").alias("top"), "root", "path")
    starts = tree.roots.join(order, "grp").join(tops, "top").select("grp", "root", F.col("digest").alias("subroot"), F.lit(0).cast("long").alias("rank"), "digest", "path", "depth")
    starts = cut(starts, "merkle-starts")
    own = ["grp", "root", "subroot"]
    lone = leaves.where("n = 1").join(starts.where("depth = 0").select("grp", "root", "subroot", "path"), "grp")
    if not tree.records:
        return lone
    parents = paths(tree, starts.where("depth > 0"), own, "merkle", 1).join(tree.records[0], "digest")
    parents = parents.select(*own, F.col("rank").alias("_parent"), "path", "children")
    asked = leaves.where("n > 1").withColumn("_parent", F.expr(f"rank div {WIDE}")).join(parents, ["grp", "_parent"])
    place = (F.col("rank") % WIDE).cast("int")
    answered = asked.withColumn("path", with_step(F.col("path"), place, F.col("children"))).drop("_parent", "children")
    return answered.unionByName(lone.select(*answered.columns))


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", also: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: (id, leaf, n leaves of its group, subroot, root, proof), digests as binary, and the columns of `also`.

    leaf is the digest of the columns in order, each framed. proof has a STEP for each level from the leaf up to the root. Ids
    ascend, null first; rows that share an id come in order of their digests, and equal rows are leaves each. Null groups are one group, the
    first; null values are framed as such, empty ones as of length 0; an empty table gives an empty result. Columns other
    than those named are not read, and `also` must not use the names of the result.
    """
    extra = also or {}
    leaf = leaf_digest(*(F.col(c) for c in columns))
    rows = docs.select(group_key(F.col(group_col)).alias("grp"), F.col(id_col).alias("id"), leaf.alias("digest"), *(c.alias(k) for k, c in extra.items()))
    leaves = cut(ranked(cut(rows, "merkle-leaves"), ["id", "digest"], "merkle"), "merkle-ranked")
    tree = build(leaves, "merkle")
    tops = tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    upper_leaves = cut(ranked(tops, ["name"], "merkle-upper"), "merkle-upper")
    upper = build(upper_leaves, "merkle-upper")
    answered = prove(leaves, tree, upper, upper_leaves.select(F.col("name").alias("grp"), F.col("rank").alias("top")))
    return answered.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "n", "subroot", "root", F.reverse("path").alias("proof"), *extra)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give: at each level the node is put between its siblings."""

    def up(node: Column, step: Column) -> Column:
        others = step["others"]
        return node_digest(F.concat(F.slice(others, F.lit(1), step["place"]), F.array(node), F.slice(others, step["place"] + 1, F.size(others))))

    return F.aggregate(proof, leaf, up)


def siblings(proof: Column) -> Column:
    """All siblings of a proof as hexadecimal text, one behind the other."""
    return F.lower(F.array_join(F.transform(F.flatten(F.transform(proof, lambda s: s["others"])), F.hex), ""))


def store(trees: list[Tree], path: str) -> None:
    """Writes the records of the trees' levels as one table of (digest, children), each digest once; trees without a level write nothing."""
    levels = [level for tree in trees for level in tree.records]
    if levels:
        reduce(DataFrame.unionAll, levels).dropDuplicates(["digest"]).write.parquet(path)
