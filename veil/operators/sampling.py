"""Samples and exact quantile picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions.random_tags import MODULUS, minstd
from veil.plans.checkpoints import written
from veil.plans.global_order import GlobalOrder


def quantile_pick(df: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """Rows (k, *keys): the element at place floor(n * k / parts) of the sorted input, k = 1 .. parts - 1."""
    order = GlobalOrder(df.select(*keys), keys)
    ranked = order.ranked("_i", start=0)
    wanted = df.sparkSession.createDataFrame([(k, order.n * k // parts) for k in range(1, parts)], "k int, _i long")
    return ranked.join(F.broadcast(wanted), "_i").select("k", *keys)  # parts - 1 rows are broadcast


def bernoulli(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Each row with the given probability."""
    return df.sample(False, fraction, seed)


def bernoulli_by_key(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Each row with the given probability, drawn from its key: the same rows on every run and in every engine."""
    return df.filter(minstd(F.col(key)) < int(fraction * MODULUS))


def exact_size_by_key(df: DataFrame, key: str, n: int) -> DataFrame:
    """Exactly n rows (or all, if fewer), those of the n least tags drawn from the unique key."""
    return GlobalOrder(df, [minstd(F.col(key)), F.col(key)]).ranked("_rank").filter(F.col("_rank") <= n).drop("_rank")


def exact_size(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly n rows (or all, if fewer), each set of n equally likely: those of the n least random tags."""
    tagged = written(df.withColumn("_tag", F.rand(seed)).withColumn("_tie", F.monotonically_increasing_id()), "tagged")  # tags are drawn once
    return GlobalOrder(tagged, ["_tag", "_tie"]).ranked("_rank").filter(F.col("_rank") <= n).drop("_tag", "_tie", "_rank")
