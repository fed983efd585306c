"""Distributed total order: global ranks, running aggregates and neighbours without a single-task window.

Pivots are drawn once, from a bounded sample of the keys. A row's range is then an expression of its own key, so every
pass sees the same ranges: the totals of the ranges, one row each, come from a scan of the keys alone, and the rows are
shuffled once, to the task of their range, where a window numbers them. Nothing is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys for each range.
SAMPLED = 40
#: Pivots that one step of the search for a key's range compares, and one.
FAN = 16
_SEED = 20


def integer_divided(a: Column, b: Column | int) -> Column:
    """The quotient of two integers without its fraction; exact beyond 2**53, unlike a division of doubles."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


class GlobalOrder:
    """df in the total order of keys; the last key must make the order total.

    Key columns must not hold null (Spark's default order would put nulls first), and must follow from a row's own
    values, since df is read more than once. The frame `rows` has df's columns, the keys and _part, the range that
    a row is in; its tasks hold one range each. n is the number of rows.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str | Column]):
        self.columns = df.columns
        self.spark = df.sparkSession
        order = [F.col(f"`{k}`") if isinstance(k, str) else k for k in keys]
        self.keys = [f"_k{i}" for i in range(len(order))]
        named = df.select("*", *[k.alias(name) for k, name in zip(order, self.keys, strict=True)])
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.n = df.count()
        self.scan = self._ranged(named)
        self.rows = self.scan.repartitionById(self.parts, F.col("_part"))

    def _ranged(self, named: DataFrame) -> DataFrame:
        """The rows with the number of pivots that aren't above their key."""
        wanted = SAMPLED * self.parts
        key = F.struct(*self.keys)
        sample = named.select(key.alias("k"))
        if self.n > wanted:
            sample = sample.sample(False, wanted / self.n, _SEED)
        # One row: pivots at equal distances in the sorted sample, of which there are SAMPLED a range or so.
        ordered = sample.agg(F.sort_array(F.collect_list("k")).alias("s"))
        at = F.transform(F.sequence(F.lit(1), F.lit(max(1, self.parts - 1))), lambda i: F.get("s", integer_divided(F.size("s") * i, self.parts).cast("int")))
        pivots = [p for p in ordered.select(F.array_distinct(at).alias("p")).first()["p"] if p is not None][: self.parts - 1]
        if not pivots:
            return named.withColumn("_part", F.lit(0))
        types = [named.schema[k].dataType for k in self.keys]
        bounds = F.array(*[F.struct(*[F.lit(p[k]).cast(t).alias(k) for k, t in zip(self.keys, types, strict=True)]) for p in pivots])
        span = 1
        while span <= len(pivots):
            span *= FAN
        out = named.withColumn("_part", F.lit(0))
        while span > 1:
            span //= FAN
            below = F.lit(0)
            for j in range(1, FAN):
                if j * span <= len(pivots):
                    below = below + F.when(F.get(bounds, F.col("_part") + (j * span - 1)) <= key, 1).otherwise(0)
            out = out.withColumn("_part", F.col("_part") + span * below)
        return out

    def _local(self, *by: str) -> Window:
        return Window.partitionBy("_part", *by).orderBy(*self.keys)

    def _named(self, *more: Column) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.columns] + list(more)

    def add_rank(self, name: str, start: int = 1) -> GlobalOrder:
        """The same order with the global rank, counted from start, as one more column."""
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        # A row a range: the broadcast is bounded by the number of partitions.
        sizes = self.scan.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        placed = self.rows.withColumn("_pos", F.row_number().over(self._local()) - 1)
        self.rows = placed.join(F.broadcast(sizes), "_part").withColumn(name, (F.col("_before") + F.col("_pos") + start).cast("long")).drop("_before", "_pos")
        self.columns = [*self.columns, name]
        return self

    def add_rank_within(self, group: str, name: str, start: int = 1) -> GlobalOrder:
        """The same order with the rank among the rows of equal group, counted from start, as one more column.

        One frequent group doesn't meet in one task: its ranges are numbered apart, and joined with how many of its
        rows stand in the ranges before, a row a group and range.
        """
        before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = self.scan.groupBy("_part", group).agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        placed = self.rows.withColumn("_pos", F.row_number().over(self._local(group)) - 1)
        joined = placed.join(sizes, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
        self.rows = joined.withColumn(name, (F.col("_before") + F.col("_pos") + start).cast("long")).drop("_before", "_pos", "_p", "_g")
        self.columns = [*self.columns, name]
        return self

    def frame(self) -> DataFrame:
        """df with the columns added so far."""
        return self.rows.select(*self._named())

    def ranked(self, name: str, start: int = 1) -> DataFrame:
        """df with the global rank, counted from start."""
        return self.add_rank(name, start).frame()

    def running_max(self, value: Column, name: str) -> DataFrame:
        """df with the maximum of value over all rows up to and including each."""
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        tops = self.rows.groupBy("_part").agg(F.max(value).alias("_top")).select("_part", F.max("_top").over(before).alias("_above"))
        out = self.rows.withColumn("_m", F.max(value).over(self._local().rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(tops), "_part")
        return out.select(*self._named(F.greatest("_m", "_above").alias(name)))

    def previous(self, column: str, name: str) -> DataFrame:
        """df with the column's value in the row before (null in the first)."""
        ends = self.scan.groupBy("_part").agg(F.max_by(column, F.struct(*self.keys)).alias("_end")).select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_last"))
        out = self.rows.withColumn("_prev", F.lag(column).over(self._local())).withColumn("_first", F.row_number().over(self._local()) == 1).join(F.broadcast(ends), "_part")
        return out.select(*self._named(F.when(F.col("_first"), F.col("_last")).otherwise(F.col("_prev")).alias(name)))

    def last_before(self, value: Column, key: str, name: str) -> DataFrame:
        """df with the last value that isn't null in an earlier row of equal key; the order must begin with the key.

        A range takes over the last such value of the ranges before it, if that has the key.
        """
        held = F.when(value.isNotNull(), F.struct(F.col(key).alias("k"), value.alias("x")))
        ends = self.rows.groupBy("_part").agg(F.max_by(held, F.when(value.isNotNull(), F.struct(*self.keys))).alias("_end"))
        earlier = F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        out = self.rows.withColumn("_own", F.last(held, ignorenulls=True).over(self._local(key).rowsBetween(Window.unboundedPreceding, -1)))
        out = out.join(F.broadcast(ends.select("_part", earlier.alias("_carried"))), "_part")
        return out.select(*self._named(F.coalesce(F.col("_own.x"), F.when(F.col("_carried.k") == F.col(key), F.col("_carried.x"))).alias(name)))
