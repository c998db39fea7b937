"""Token counts kept as rollups of signed changes, with idempotent batch commits; DataFrame operations only.

A change is an insert (+1, its tokens), a delete (-1, minus its tokens), or a revised count, which is a delete of the
old count and an insert of the new one. A commit sums a batch's changes by key, writes them to a folder of their own,
and is made by the log row that follows, so that a batch counts once however often it is sent. Totals are sums over
all batches; compaction sums batches into one folder and keeps their numbers.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from bitlake.llm.common import WORD

KEY = ["source", "lang", "version"]
#: Words and numbers, and each other visible character by itself.
PIECE = r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]"


def tokens(text: Column, version: str) -> Column:
    """The count of a text by a tokenizer version; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit({"words-1": WORD, "pieces-2": PIECE}[version])), F.lit(0)).cast("long")


def change(rows: DataFrame, sign: int, version: str, count: str) -> DataFrame:
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("long").alias("docs"), (F.lit(sign) * F.col(count)).alias("tokens"))


class Rollup:
    """Additive totals of documents and tokens by source, language and tokenizer version, below one folder.

    `data/` has a folder for each try of a commit, `log/` a row for each try that is complete: its order, its batch,
    its folder, and for a compaction the batches it holds. A try without its row, as a lost driver leaves it, does not
    count; of several tries of a batch the last one does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _entries(self) -> list[Row]:
        """The log's rows in order: one for each commit and compaction, on the driver."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log").orderBy("no", "folder").collect()
        except AnalysisException:
            if _exists(self.spark, f"{self.path}/log"):
                raise
            return []

    def _live(self) -> tuple[list[int], dict[int | None, str]]:
        """Batches that the last compaction holds; and the folder of each later batch, and of the compaction (None)."""
        held, folders = [], {}
        entries = self._entries()
        for e in entries:
            if e["batch"] is None:
                held, folders[None] = list(e["holds"]), e["folder"]
        for e in entries:
            if e["batch"] is not None and e["batch"] not in held:
                folders[e["batch"]] = e["folder"]
        return held, folders

    def _publish(self, totals: DataFrame, batch: int | None, holds: list[int]) -> None:
        folder = uuid.uuid4().hex
        totals.write.parquet(f"{self.path}/data/{folder}")
        entries = self._entries()
        row = [(1 + max((e["no"] for e in entries), default=0), batch, folder, holds)]
        self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Adds a batch of (source, lang, version, docs, tokens); the same batch again replaces itself.

        A batch that a compaction holds is settled: sending it again changes nothing. Null sources and languages are
        keys of their own; an empty batch is committed and adds nothing; other columns are not read.
        """
        if batch not in self._live()[0]:
            self._publish(changes.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), batch, [])

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) of what is left; keys without a document are gone. Without a commit, no row."""
        fields = "source string, lang string, version string, docs long, tokens long"
        folders = [f"{self.path}/data/{f}" for f in self._live()[1].values()]
        found = self.spark.read.schema(fields).parquet(*folders) if folders else self.spark.createDataFrame([], fields)
        return found.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Puts the totals of all batches into one folder that knows which batches it holds."""
        held, folders = self._live()
        self._publish(self.totals(), None, sorted({*held, *(b for b in folders if b is not None)}))


LOG = "no long, batch long, folder string, holds array<long>"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the store that Spark reads has this path."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
