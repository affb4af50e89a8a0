"""Tables that are kept for a job, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, as the cluster sets it; a temporary folder only where it is unset in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="variorum-shared-"))
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/variorum-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """df, written to the shared folder once and read from there: no lineage, and no executor holds the only copy."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_shuffle(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting both sides: for tables that grow with the data.

    Spark guesses a table's bytes by the share of its columns in a file's.  Next to VARIANT columns, and for texts that
    compress well, keys of millions of rows seem small enough to be sent whole to the driver and all executors.
    """
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Removes the table that materialize() wrote for df; nothing may read it any more."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
