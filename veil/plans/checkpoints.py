"""Cutting lineage: a plan's rows written once, so that later passes see the same partitions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in a session that is a single process.

    Raises ValueError where the session names none and executors run elsewhere, since they couldn't read it.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.gettempdir() + "/veil-checkpoints"


_PATHS: dict[str, list[str]] = {}


def clean(spark: SparkSession) -> None:
    """Delete the tables written in this session; frames that read them can't be read any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _PATHS.pop(spark.sparkContext.applicationId, []):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df's rows as a Parquet table in the shared folder: lost executors cost no recomputation, random tags stay as drawn.

    It stays until clean(), since the frame returned reads it.
    """
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
