"""Operation logs as streams: the map after all writes so far, and the answers of gets in log order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.operators import omap


def upsert_stream(log: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """A running map: key, v (the last write's value), writes. For complete or update mode."""
    return omap.upsert_many(log, key, value, seq)


def windowed_writes(log: DataFrame, time: str, span: str, late: str) -> DataFrame:
    """Writes by event-time window; rows later than the watermark are left out."""
    return log.withWatermark(time, late).groupBy(F.window(time, span)).agg(F.count("*").alias("writes"))


def replay_stream(log: DataFrame, key: str, seq: str, is_insert: str, value: str) -> DataFrame:
    """(seq, key, contained, v) for every get: the last insert of its key before it, across micro-batches.

    Each key's state is its last value. Within a micro-batch a key's operations are taken in the order of seq;
    batches must arrive in that order, as files of a log do.
    """
    kind = log.schema[key].dataType.simpleString()

    def step(name, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        has, v = (True, state.get[0]) if state.exists else (False, None)
        out = []
        for at, insert, x in pd.concat(list(parts)).sort_values(seq)[[seq, is_insert, value]].itertuples(index=False):
            if insert:
                has, v = True, x
            else:
                out.append((at, name[0], has, v))
        if has:
            state.update((v,))
        yield pd.DataFrame(out, columns=["seq", "k", "contained", "v"])

    return log.groupBy(key).applyInPandasWithState(step, f"seq long, k {kind}, contained boolean, v double", "v double", "append", "NoTimeout")
