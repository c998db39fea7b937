"""Helpers shared by the operators: written cuts of the lineage, two-level prefix sums and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where the session names none, a temporary one, and only if they run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="bitlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/bitlake-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that a lost executor costs no earlier stage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_cuts(spark: SparkSession) -> None:
    """Deletes what this application has written by cut; results that read it must have been used."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def bucketed_prefix(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds `out`, the sum of value over the rows that precede a row in its group.

    Rows are ordered by bucket, then by order. Sums inside a bucket and sums over a group's buckets are
    separate windows, so no group, however large, is sorted in one task.
    """
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_t"))
    starts = totals.select(*group, bucket, F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_start"))
    inside = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return inside.join(starts, [*group, bucket]).withColumn(out, F.col("_start") + F.col("_in")).drop("_start", "_in")


def components(edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); nodes without an edge don't appear.

    Large-star and small-star steps alternate until nothing changes. Each step joins edges with one minimum a
    node, which is aggregated before the shuffle; each round is written, so no lineage grows.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    seen = None
    for _ in range(most):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        edges = cut(small, f"{name}-round")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; the training and held-out parts of the contracts are cut by it."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def sample_labels(labels: DataFrame, most: int) -> DataFrame:
    """At most about `most` labelled rows, chosen by the id's hash: the documented bound of a training sample."""
    n = labels.count()
    if n <= most:
        return labels
    return labels.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_003)) < int(1_000_003 * most / n))


def logistic(x, y, weight=None, ridge: float = 1e-3, steps: int = 25):
    """Weights of a ridge-penalised logistic regression by Newton's method; the last weight is the intercept."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge * max(1, len(y)))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever columns it brings."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def gathered_runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The runs of rows with equal values in sorted batches, each whole: a run must be bounded by its maker."""
    held, mark = [], None
    for pdf in batches:
        marks = list(pdf[by].itertuples(index=False, name=None))
        at = 0
        for i in range(1, len(marks) + 1):
            if i == len(marks) or marks[i] != marks[at]:
                if held and marks[at] != mark:
                    yield mark, pd.concat(held)
                    held = []
                mark = marks[at]
                held.append(pdf.iloc[at:i])
                at = i
    if held:
        yield mark, pd.concat(held)
