"""0/1 knapsack values per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def knapsack(df: DataFrame, group: str, weight: Column, value: Column, capacity: int) -> DataFrame:
    """(group, best): the largest total value of a group's items within the capacity.

    Items are taken in the order of (weight, value), so sums of doubles are the same on every run. A group's items are
    folded in one array of capacity + 1 values, so the items of one group must fit a task.
    """
    items = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(weight.cast("int").alias("w"), value.alias("v")))).alias("items"))

    def add(dp: Column, it: Column) -> Column:
        return F.transform(dp, lambda best, j: F.when(j >= it["w"], F.greatest(best, F.get(dp, j - it["w"]) + it["v"])).otherwise(best))

    table = F.aggregate("items", F.array_repeat(F.lit(0.0), capacity + 1), add)
    return items.select(group, F.element_at(table, capacity + 1).alias("best"))
