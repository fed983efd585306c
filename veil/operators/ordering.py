"""Sorts, permutations, merges and checks in a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.random_tags import MODULUS, MULTIPLIER, minstd
from veil.plans.checkpoints import written
from veil.plans.global_order import GlobalOrder, integer_divided


def osort(df: DataFrame, keys: Sequence[str | Column], rank: str = "rk") -> DataFrame:
    """All rows with their 1-based position in the total order of keys (the last key must make it total)."""
    return GlobalOrder(df, keys).ranked(rank)


def oshuffle(df: DataFrame, seed: int, pos: str = "pos") -> DataFrame:
    """All rows with their 1-based place in a random permutation drawn from the seed."""
    tagged = written(df.withColumn("_tag", F.rand(seed)).withColumn("_tie", F.monotonically_increasing_id()), "tagged")  # tags are drawn once
    return GlobalOrder(tagged, ["_tag", "_tie"]).ranked(pos).drop("_tag", "_tie")


def shuffle_by_key(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """A reproducible permutation: the order of one generator step from each row's unique key."""
    return GlobalOrder(df, [minstd(F.col(key)), F.col(key)]).ranked(pos)


def is_sorted(df: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """One row: violations (rows whose value is less than the row before), and n."""
    pairs = GlobalOrder(df.select(*dict.fromkeys([*order, value])), list(order)).previous(value, "_prev")
    return pairs.agg(F.coalesce(F.sum(F.when(F.col(value) < F.col("_prev"), 1).otherwise(0)), F.lit(0)).cast("long").alias("violations"), F.count("*").alias("n"))


def merge_runs(df: DataFrame, run: Column, keys: Sequence[str], run_pos: str = "run_pos", pos: str = "pos") -> DataFrame:
    """Sorted runs merged: each row's 0-based place in its run and in the merge."""
    runs = df.withColumn("run", run)
    # The merge order restricted to a run is the run's own order.
    return GlobalOrder(runs, keys).add_rank(pos, start=0).add_rank_within("run", run_pos, start=0).frame()


def page_permuted_scan(df: DataFrame, key: str, page: int, pos: str = "pos") -> DataFrame:
    """Whole pages in a permuted order, rows in order within a page, the last page pinned to the end."""
    order = GlobalOrder(df, [key])
    paged = order.ranked("idx", start=0).withColumn("_page", integer_divided(F.col("idx"), page)).withColumn("_pinned", (F.col("_page") == max(order.n - 1, 0) // page).cast("int"))
    keys = [F.col("_pinned"), ((F.col("_page") + 1) * MULTIPLIER) % MODULUS, F.col("idx")]
    return GlobalOrder(paged, keys).ranked(pos, start=0).drop("_page", "_pinned")


def sort_array_by_network(values: Column) -> Column:
    """Small fixed arrays in order (the result of a sorting network)."""
    return F.array_sort(values)
