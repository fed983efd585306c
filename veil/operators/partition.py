"""Compaction, interleaving, splits, routing, transposition and rotation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.random_tags import digits
from veil.plans.global_order import GlobalOrder, integer_divided


def compact(df: DataFrame, mark: Column, key: str, pos: str = "pos", marked_pos: str = "marked_pos") -> DataFrame:
    """Order-preserving compaction of all rows: marked ones first, in order of key; 0-based places.

    marked_pos is the place among the marked rows, null for the others: marked rows come first, so it is their pos.
    """
    marked = df.withColumn("_mark", F.coalesce(mark, F.lit(False)))
    out = GlobalOrder(marked, [F.when(F.col("_mark"), 0).otherwise(1), F.col(key)]).ranked(pos, start=0)
    return out.withColumn(marked_pos, F.when(F.col("_mark"), F.col(pos))).drop("_mark")


def reals(df: DataFrame, is_dummy: str) -> DataFrame:
    """The rows that aren't dummies."""
    return df.filter(~F.col(is_dummy))


def interleave(df: DataFrame, mark: Column, ways: int, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """k-way interleave: places read marks 0, 1, .., k-1, 0, 1, ..; rows of a mark keep the order of keys."""
    marked = df.withColumn("_mark", mark.cast("long"))
    ranked = GlobalOrder(marked, keys).add_rank_within("_mark", "_rank", start=0).frame()
    return ranked.withColumn(pos, F.col("_rank") * ways + F.col("_mark")).drop("_mark", "_rank")


def merge_split(df: DataFrame, key: str, mark: Column, ways: int, size: int) -> DataFrame:
    """`ways` buckets of exactly `size` slots: (half, slot, key), a null key is a dummy.

    Raises an arithmetic error when a bucket has more rows than slots.
    """
    spark = df.sparkSession
    slots = spark.range(ways * size).select(integer_divided(F.col("id"), size).alias("half"), (F.col("id") % size).alias("slot"))
    placed = GlobalOrder(df.select(F.col(key), mark.cast("long").alias("half")), [key]).add_rank_within("half", "slot", start=0).frame()
    fits = F.when(F.col("slot") < size, F.col("slot")).otherwise(F.raise_error(F.lit("bucket overflow")).cast("long"))
    return slots.join(placed.withColumn("slot", fits), ["half", "slot"], "left")


def pivots(df: DataFrame, keys: Sequence[str], parts: int) -> list[tuple]:
    """parts - 1 exact quantile picks of a sample, as driver rows (the caller sizes the sample)."""
    from veil.operators.sampling import quantile_pick

    rows = quantile_pick(df, keys, parts).orderBy("k").collect()
    return [tuple(r[k] for k in keys) for r in rows]


def distribute_by_pivots(df: DataFrame, sample: DataFrame, keys: Sequence[str], parts: int, part: str = "part") -> DataFrame:
    """Rows with the number of pivots below them; pivots are parts - 1 quantile picks of the sample."""
    chosen = pivots(sample, keys, parts)
    row = F.struct(*[F.col(k) for k in keys])
    below = [F.when(F.struct(*[F.lit(v).cast(df.schema[k].dataType) for k, v in zip(keys, p, strict=True)]) < row, 1).otherwise(0) for p in chosen]
    total = below[0] if below else F.lit(0)
    for b in below[1:]:
        total = total + b
    return df.withColumn(part, total.cast("long"))


def route(df: DataFrame, tag: Column, ways: Sequence[int]) -> DataFrame:
    """Rows with their bucket digit in each layer (d0, d1, ..), the mixed-radix digits of the tag."""
    for i, d in enumerate(digits(tag, list(ways))):
        df = df.withColumn(f"d{i}", d)
    return df


def padded_buckets(df: DataFrame, bucket: str, key: str, size: int) -> DataFrame:
    """Each bucket filled up to size with dummies (null keys); rows beyond size are marked as overflow.

    Output: bucket, slot, key, overflow.
    """
    real = GlobalOrder(df.select(bucket, key), [key]).add_rank_within(bucket, "slot", start=0).frame().withColumn("overflow", F.col("slot") >= size)
    fill = df.groupBy(bucket).count().filter(F.col("count") < size).select(bucket, F.explode(F.sequence(F.col("count"), F.lit(size - 1).cast("long"))).alias("slot"))
    fill = fill.withColumn(key, F.lit(None).cast(df.schema[key].dataType)).withColumn("overflow", F.lit(False))
    return real.unionByName(fill).select(bucket, "slot", key, "overflow")


def transpose(df: DataFrame, idx: Column, rows: Column | int, columns: int, pos: str = "pos") -> DataFrame:
    """The place of each element of a rows x columns matrix, stored by rows, after transposition."""
    rows = F.lit(rows) if isinstance(rows, int) else rows
    return df.withColumn(pos, ((idx % columns) * rows + integer_divided(idx, columns)).cast("long"))


def rotate_left(df: DataFrame, idx: Column, shift: int, size: int, enabled: bool = True, pos: str = "pos") -> DataFrame:
    """The place of each element after a rotation to the left by shift; unchanged unless enabled."""
    return df.withColumn(pos, F.pmod(idx - (shift if enabled else 0), F.lit(size)).cast(idx_type(df, idx)))


def idx_type(df: DataFrame, idx: Column) -> str:
    return df.select(idx.alias("i")).schema["i"].dataType.simpleString()


def rotate_array(values: Column, shift: int) -> Column:
    """An array rotated to the left."""
    n = F.size(values)
    return F.when(n > 0, F.concat(F.slice(values, F.pmod(F.lit(shift), n) + 1, n), F.slice(values, F.lit(1), F.pmod(F.lit(shift), n)))).otherwise(values)
