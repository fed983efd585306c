"""Access traces: tree paths, eviction, page caches, allocators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.bits import bit_length, heap_index, reverse_lexicographic
from veil.functions.random_tags import minstd
from veil.plans.checkpoints import written
from veil.plans.global_order import GlobalOrder, integer_divided


def path_indices(df: DataFrame, key: str, position: Column, levels: int) -> DataFrame:
    """(key, depth, idx): the buckets that an access to a leaf position touches, root first."""
    rows = df.select(key, position.alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_d"))
    return rows.select(key, F.col("_d").cast("long").alias("depth"), heap_index(F.col("_p"), F.col("_d"), levels).alias("idx"))


def evict_path(df: DataFrame, key: str, position: Column, path: int, levels: int, bucket: int) -> DataFrame:
    """(key, level) after a greedy deepest-first eviction to one path; -1 stays in the stash.

    With blocks in order of their deepest level, block i takes slot i + max over j <= i of (bucket * tag_j - j).
    """
    tagged = df.select(key, bit_length(position.bitwiseXOR(F.lit(path).cast("long"))).alias("_tag"))
    ranked = GlobalOrder(tagged, ["_tag", key]).add_rank("_rn", start=0)
    slotted = ranked.running_max(bucket * F.col("_tag") - F.col("_rn"), "_mx")
    level = integer_divided(F.col("_rn") + F.col("_mx"), bucket)
    return slotted.select(key, F.when(level <= levels, levels - level).otherwise(-1).alias("level"))


def path_accesses(df: DataFrame, time: str, address: Column, levels: int) -> DataFrame:
    """(time, address, position, remapped): the path that each access of a block reads, and the one it goes to.

    A block is on the path that its access before gave it, at first on one drawn from its address; the new one is drawn
    from the time.
    """
    leaves = 2**levels
    log = df.select(F.col(time).cast("long").alias("_t"), address.cast("long").alias("address"))
    seen = GlobalOrder(log, ["address", "_t"]).last_before(minstd(F.col("_t")) % leaves, "address", "_last")
    return seen.select(F.col("_t").alias(time), "address", F.coalesce("_last", minstd(F.col("address")) % leaves).alias("position"), (minstd(F.col("_t")) % leaves).alias("remapped"))


def path_cache(df: DataFrame, time: str, position: Column, levels: int, slots: int) -> DataFrame:
    """One row (hits): the buckets of every access's path, root first, read through one LRU bucket cache."""
    paths = path_indices(df, time, position, levels)
    return cache_lru(paths.withColumn("_access", F.col(time) * (levels + 1) + F.col("depth")), "_access", F.col("idx"), slots)


def ring_schedule(df: DataFrame, time: str, position: Column, levels: int, every: int, spare: int) -> DataFrame:
    """(time, depth, idx, whole) for the buckets that ring accesses touch: whole, if the access reads all of a bucket.

    time numbers the accesses from 0. A bucket gives one block an access and is read whole when it has given `spare` of
    them, which renews it. After every `every` accesses the next path in reverse-lexicographic order is evicted, which
    renews its buckets above the leaves. So of a bucket's accesses since it was last evicted, each (spare + 1)-th reads
    it whole; ranks within the bucket give their number, though the root is touched by all.
    """
    access = df.select(F.col(time).cast("long").alias("_t"), position.cast("long").alias("_p"))
    touched = access.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("evicted", F.lit(False))
    turns = access.filter((F.col("_t") + 1) % every == 0)
    leaf = reverse_lexicographic((integer_divided(F.col("_t") + 1, every) - 1) % 2**levels, levels)
    evicted = turns.withColumn("_p", leaf).withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("evicted", F.lit(True))
    events = touched.unionByName(evicted).select("_t", "depth", "evicted", heap_index(F.col("_p"), F.col("depth"), levels).alias("idx"))
    order = GlobalOrder(events, ["idx", "_t", "evicted"]).add_rank_within("idx", "_rank")
    since = order.last_before(F.when(F.col("evicted"), F.col("_rank")), "idx", "_last")
    number = F.col("_rank") - F.coalesce("_last", F.lit(0))
    return since.filter(~F.col("evicted")).select(F.col("_t").alias(time), F.col("depth").cast("long").alias("depth"), "idx", (number % (spare + 1) == 0).alias("whole"))


def cache_direct_mapped(df: DataFrame, time: str, page: Column, slots: int) -> DataFrame:
    """(accesses, hits) of a direct-mapped cache that starts empty."""
    trace = df.select(F.col(time).alias("_t"), page.alias("_pg"))
    # In the order of slots, the access before is the slot's own or another slot's, whose page differs.
    return GlobalOrder(trace, [F.col("_pg") % slots, F.col("_t")]).previous("_pg", "_prev").agg(F.count("*").alias("accesses"), F.coalesce(F.sum((F.col("_pg") == F.col("_prev")).cast("long")), F.lit(0)).alias("hits"))


def cache_lru(df: DataFrame, time: str, page: Column, slots: int, chunk: int = 8192) -> DataFrame:
    """One row (hits) of an LRU cache that starts empty, exact over the whole trace.

    The trace is cut into chunks of consecutive accesses. What the cache holds when a chunk begins is the `slots`
    pages with the latest access before it, which an aggregation gives; each chunk is then simulated on its own.
    """
    trace = GlobalOrder(df.select(F.col(time).alias("_t"), page.cast("long").alias("_pg")), ["_t"]).ranked("_i", start=0)
    trace = written(trace.select("_i", "_pg", F.floor(F.col("_i") / chunk).alias("_chunk")), "lru-trace")
    last = trace.groupBy("_chunk", "_pg").agg(F.max("_i").alias("_last"))
    # Only a chunk's own latest pages can be among the latest before the next ones.
    top = last.withColumn("_r", F.row_number().over(Window.partitionBy("_chunk").orderBy(F.desc("_last")))).filter(F.col("_r") <= slots)
    carried = _carried(top, slots)
    both = trace.withColumn("_held", F.lit(False)).unionByName(carried.select(F.col("_last").alias("_i"), "_pg", "_chunk", F.lit(True).alias("_held")))
    hits = both.groupBy("_chunk").applyInPandas(lambda p: _simulate(p, slots), "hits long")
    return hits.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def _carried(top: DataFrame, slots: int) -> DataFrame:
    """(_chunk, _pg, _last): the latest pages before each chunk, by doubling the span looked back over."""
    now = written(top.select(F.col("_chunk"), "_pg", "_last"), "lru-tops")
    chunks = (now.agg(F.max("_chunk")).first()[0] or 0) + 1
    span = 1
    # now(c) holds the latest pages of chunks c - span + 1 .. c; joined with now(c - span), of twice as many.
    while span < chunks:
        older = now.withColumn("_chunk", F.col("_chunk") + span).filter(F.col("_chunk") < chunks)
        merged = now.unionByName(older).groupBy("_chunk", "_pg").agg(F.max("_last").alias("_last"))
        ranked = merged.withColumn("_r", F.row_number().over(Window.partitionBy("_chunk").orderBy(F.desc("_last"))))
        now = written(ranked.filter(F.col("_r") <= slots).drop("_r"), "lru-tops")
        span *= 2
    return now.withColumn("_chunk", F.col("_chunk") + 1).filter(F.col("_chunk") < chunks)


def _simulate(p: pd.DataFrame, slots: int) -> pd.DataFrame:
    from collections import OrderedDict

    p = p.sort_values("_i")
    cache: OrderedDict[int, None] = OrderedDict()
    hits = 0
    for page, held in zip(p["_pg"].tolist(), p["_held"].tolist(), strict=True):
        if page in cache:
            hits += not held
            cache.move_to_end(page)
            continue
        cache[page] = None
        if len(cache) > slots:
            cache.popitem(last=False)
    return pd.DataFrame({"hits": [hits]})


def allocate(ops: DataFrame, group: str, seq: str, op: str, ident: str, size: str) -> DataFrame:
    """Best-fit allocation with coalescing frees, replayed for each group of an operation log.

    ops: op is 'alloc' or 'free', ident names the block, size is its length (alloc only). Returns (group, ident,
    offset) of every allocation.
    """
    schema = f"{group} {ops.schema[group].dataType.simpleString()}, {ident} {ops.schema[ident].dataType.simpleString()}, offset long"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        holes: dict[int, int] = {}
        live: dict = {}
        end, out = 0, []
        for kind, name, length in p.sort_values(seq)[[op, ident, size]].itertuples(index=False):
            if kind == "alloc":
                fit = min(((n, at) for at, n in holes.items() if n >= length), default=None)
                if fit is None:
                    at, end = end, end + int(length)
                else:
                    at = fit[1]
                    left = holes.pop(at) - int(length)
                    if left:
                        holes[at + int(length)] = left
                live[name] = (at, int(length))
                out.append((p[group].iloc[0], name, at))
            elif name in live:
                at, n = live.pop(name)
                after = holes.pop(at + n, 0)
                before = next((a for a, m in holes.items() if a + m == at), None)
                if before is not None:
                    n, at = n + holes.pop(before), before
                holes[at] = n + after
        return pd.DataFrame(out, columns=[group, ident, "offset"])

    return ops.groupBy(group).applyInPandas(run, schema)
