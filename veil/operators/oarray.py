"""Arrays by address: the last write of each address, with a default for those never written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_all(log: DataFrame, address: Column, value: str, seq: str, size: int, default: float) -> DataFrame:
    """(address, v) for every address below size after the log of writes."""
    last = log.groupBy(address.alias("address")).agg(F.max_by(value, seq).alias("_v"))
    everything = log.sparkSession.range(size).withColumnRenamed("id", "address")
    return everything.join(last, "address", "left").select("address", F.coalesce("_v", F.lit(default)).alias("v"))


def address_walk(df: DataFrame, address: Column, levels: int) -> DataFrame:
    """df's rows for each level of a recursive array, with the address of the block that the level holds for it.

    level 0 is the root; the last level's address is the array's own.
    """
    walked = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return walked.withColumn("block", F.call_function("shiftright", address, levels - F.col("level")))


def copy_out(df: DataFrame, index: str, begin: int, end: int) -> DataFrame:
    """The rows with begin <= index < end, wherever pages begin; the bounds reach the scan as filters."""
    return df.filter((F.col(index) >= begin) & (F.col(index) < end))


def copy_in(df: DataFrame, rows: DataFrame, index: str) -> DataFrame:
    """df with the rows that replace those of the same index; other rows stay as they are."""
    kept = df.join(rows.select(index), index, "left_anti")
    return kept.unionByName(rows.select(*df.columns))


def read_many(log: DataFrame, probes: DataFrame, address: str, value: str, seq: str, default: float) -> DataFrame:
    """(address, v) for each probe."""
    last = log.groupBy(address).agg(F.max_by(value, seq).alias("_v"))
    return probes.select(address).join(last, address, "left").select(address, F.coalesce("_v", F.lit(default)).alias("v"))
