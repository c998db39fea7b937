"""Written tables between the steps of a long job: in the folder that all executors share, one for each application."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The application's folder under spark.checkpoint.dir; where the session names none, a temporary one, and only if all executors are on this machine."""
    found, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="bitlake-")
        found = _LOCAL[app]
    return f"{found.rstrip('/')}/bitlake-core-{app}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is written now: what reads it twice computes it once, and a lost executor costs no earlier step."""
    place = new_folder(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def discard(spark: SparkSession) -> None:
    """Deletes the application's folder; results that read it must have been used."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
