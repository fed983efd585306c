"""Connected components by alternating large-star and small-star steps on the edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


#: Edges that a task writes.
EDGES = 100_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component) for every id on an edge; component is the least id reachable, the id itself included.

    Each step links a node's neighbours to the least of them, so the work follows the edges. The least neighbour is
    aggregated before the shuffle and joined back: the join has one row a node on that side, so that adaptive
    execution may split a hub's edges over tasks. Every step
    is written to the shared folder. Loops and repeated edges are allowed; rows with a null end are left out. An
    empty edge list gives an empty result.
    """
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    now = materialise(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        # No step has more edges than the one before it; few of them aren't spread over many tasks and files.
        tasks = state[0] // EDGES + 1
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of a node is linked to the least of the node and its neighbours.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: the smaller neighbours of a node, and the node, are linked to the least of them.
        large = materialise(large.coalesce(tasks), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = materialise(small.filter("a <> b").distinct().coalesce(tasks), "small-star")
        discard(edges.sparkSession, now, large)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
