"""Ordered maps: bulk build, batched get, upsert, replay of an operation log, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.bits import bit_length
from veil.plans.global_order import GlobalOrder, integer_divided

LEFT, RIGHT, BALANCED = 0, 1, 2


def depth_budget(capacity: int) -> int:
    """Steps that a balanced tree of the capacity may take: floor(1.5 * log2(next power of two)) + 1."""
    return int(1.5 * (capacity + 1).bit_length()) + 1


def bulk_build(df: DataFrame, key: str) -> DataFrame:
    """A balanced search tree over unique keys: key, depth, left_idx, right_idx, balance.

    Every node finds its own range by walking the median splits from the root, an expression of log n steps, so the
    build is one ranked scan whatever the size. Indices are 0-based ranks; null where there is no child.
    """
    order = GlobalOrder(df.select(key), [key])
    ranked = order.ranked("_i", start=0)
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("l"), F.lit(order.n - 1).cast("long").alias("r"), zero.alias("d"))

    def step(s: Column, _: Column) -> Column:
        m = integer_divided(s["l"] + s["r"], 2)
        i = F.col("_i")
        return F.struct(
            F.when(i > m, m + 1).otherwise(s["l"]).alias("l"),
            F.when(i < m, m - 1).otherwise(s["r"]).alias("r"),
            F.when(i == m, s["d"]).otherwise(s["d"] + 1).alias("d"),
        )

    node = ranked.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(order.n.bit_length() + 1)), start, step))
    l, r, m = F.col("_s.l"), F.col("_s.r"), F.col("_i")
    left = F.when(m > l, integer_divided(l + m - 1, 2))
    right = F.when(r > m, integer_divided(m + 1 + r, 2))
    balance = F.when(bit_length(r - m) > bit_length(m - l), RIGHT).otherwise(BALANCED)
    return node.select(key, F.col("_s.d").alias("depth"), left.alias("left_idx"), right.alias("right_idx"), balance.alias("balance"))


def upsert_many(log: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The map after a log of inserts: key, v (the last write's value), writes."""
    return log.groupBy(key).agg(F.max_by(value, seq).alias("v"), F.count("*").alias("writes"))


def apply_log(log: DataFrame, key: str, value: str, seq: str, is_delete: Column) -> DataFrame:
    """The map after a log of inserts and deletes: key, v. A key whose last operation deletes it is absent.

    A delete of an absent key does nothing; an insert after a delete brings the key back.
    """
    last = log.select(key, F.col(value).alias("_v"), F.col(seq).alias("_s"), is_delete.alias("_gone")).groupBy(key).agg(F.max_by(F.struct("_gone", "_v"), "_s").alias("_last"))
    return last.filter(~F.col("_last._gone")).select(key, F.col("_last._v").alias("v"))


def delete_many(entries: DataFrame, key: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """The entries without those whose key is deleted."""
    return entries.join(deleted.select(F.col(deleted_key).alias("_gone")), F.col(key) == F.col("_gone"), "left_anti")


def differences(answers: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys for which a map's answers aren't those of a shadow copy, or which only one of them has: key, answer, shadow.

    Both have the columns (key, v); an empty result means that they agree.
    """
    a = answers.select(F.col(key), F.struct("v").alias("_a"))
    b = expected.select(F.col(key), F.struct("v").alias("_b"))
    both = a.join(b, key, "full")
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, F.col("_a.v").alias("answer"), F.col("_b.v").alias("shadow"))


def get_many(probes: DataFrame, probe: str, entries: DataFrame, key: str, value: str) -> DataFrame:
    """A batch of lookups as one join: k, contained, v."""
    table = entries.select(F.col(key).alias("_key"), F.col(value).alias("v"))
    joined = probes.select(F.col(probe).alias("k")).join(table, F.col("k") == F.col("_key"), "left")
    return joined.select("k", F.col("_key").isNotNull().alias("contained"), "v")


def registered(probes: DataFrame, probe: str, members: DataFrame, member: str) -> DataFrame:
    """Private contact discovery's answer for each distinct probe: 1 if it is a member, else 0."""
    known = members.select(F.col(member).alias("_m")).distinct()
    joined = probes.select(probe).distinct().join(known, F.col(probe) == F.col("_m"), "left")
    return joined.select(probe, F.when(F.col("_m").isNotNull(), 1).otherwise(0).alias("registered"))


def replay(log: DataFrame, key: str, seq: str, is_insert: Column, value: str) -> DataFrame:
    """Answers of the gets in an interleaved log: the last insert of the key before each get."""
    marked = log.select(seq, key, is_insert.alias("_ins"), F.col(value).alias("_value"))
    seen = GlobalOrder(marked, [key, seq]).last_before(F.when(F.col("_ins"), F.struct(F.col("_value").alias("x"))), key, "_set")
    return seen.filter(~F.col("_ins")).select(seq, key, F.col("_set.x").isNotNull().alias("contained"), F.col("_set.x").alias("v"))


def in_order(tree: DataFrame, key: str) -> DataFrame:
    """The keys in order with their depth."""
    return tree.select(key, "depth").orderBy(key)
