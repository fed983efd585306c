"""Near-duplicate vectors: sign hashing by random hyperplanes in several tables, exact cosine, components.

Equal vectors form one class and are compared once. Each class is filed in every table under the signs of its
products with that table's hyperplanes. Vectors that share a bucket are compared exactly, by blocks; a bucket of
more than one block is split into pairs of blocks, so no bucket has to fit one task. A pair that several tables
bring together counts in the first of them. Tasks return sums of links and a spanning set of edges, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, discard, materialise
from .components import connected_components

THRESHOLD = 0.93
#: Vectors of a bucket that one task compares with each other, or with as many others.
BLOCK = 1024
#: The chance that a pair just at the threshold shares no bucket.
MISS = 0.002
SEED = 11


def tables_for(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Hyperplanes a table and tables: buckets of about 64 unrelated vectors, and the wanted chance to miss."""
    bits = max(8, math.ceil(math.log2(max(rows, 64) / 64)))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - together)))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """The hyperplanes of all tables for vectors of a length; the same in every task."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))


def _signs(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """A row for each vector, a column for each table: the signs of the products with its hyperplanes as a number."""
    out = np.empty((len(x), planes.shape[1] // bits), dtype=np.int64)
    for at in range(0, len(x), 2048):
        positive = (x[at : at + 2048] @ planes) > 0
        out[at : at + 2048] = positive.reshape(-1, out.shape[1], bits) @ (1 << np.arange(bits, dtype=np.int64))
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector over its largest component, so that no product overflows; the signs stay."""
    x = x.astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _sign(bits: int, tables: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("embedding")
            sizes = np.asarray(column.value_lengths())
            flat = column.flatten().to_numpy()
            ends = np.append(0, np.cumsum(sizes))
            signs = np.empty((batch.num_rows, tables), dtype=np.int64)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                if dim not in planes:
                    planes[dim] = _planes(dim, bits, tables)
                signs[own] = _signs(_scaled(flat[ends[own][:, None] + np.arange(dim)]), planes[dim], bits)
            raw = [flat[a:b].astype(kind).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            signatures = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()), pa.array(signs.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("label"), batch.column("weight"), pa.array(raw, pa.binary()), signatures], names=["rep", "label", "weight", "vector", "signs"])

    return run


def _compare(kind: str, threshold: float, bits: int, tables: int):
    """Links of one bucket's block, or between two blocks of it: rows (rep, links, root).

    A pair counts in the first table that brings it together; the signs that tell are taken from the vectors again,
    and only of those with a link, so that rows needn't carry all tables' signs.
    """
    planes: dict[int, np.ndarray] = {}

    def links(group: pa.Table) -> pa.RecordBatch | None:
        rep, weight, side = (group.column(c).to_numpy() for c in ("rep", "weight", "side"))
        if len(rep) < 2:
            return None
        table, first, second = (group.column(c)[0].as_py() for c in ("table", "ci", "cj"))
        scaled = _scaled(np.array([np.frombuffer(v, kind) for v in group.column("vector").to_pylist()]))
        x = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        if table and x.shape[1] not in planes:
            planes[x.shape[1]] = _planes(x.shape[1], bits, tables)
        signs: np.ndarray | None = None
        split = first != second
        ia = np.flatnonzero(side == first) if split else np.arange(len(rep))
        ib = np.flatnonzero(side == second) if split else ia
        number, root = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))
        found = []
        for at in range(0, len(ia), 128):
            rows = ia[at : at + 128]
            near = x[rows] @ x[ib].T >= threshold
            p, q = np.nonzero(near)
            a, b = rows[p], ib[q]
            if not split:
                a, b = a[a < b], b[a < b]
            if table and len(a):
                if signs is None:
                    signs = _signs(scaled, planes[x.shape[1]][:, : table * bits], bits)
                before = np.zeros(len(a), dtype=bool)
                for earlier in range(table):
                    before |= signs[a, earlier] == signs[b, earlier]
                a, b = a[~before], b[~before]
            np.add.at(number, a, weight[b]), np.add.at(number, b, weight[a])
            if len(a):
                found.append(_forest(a, b, len(rep)))
        if not found:
            return None
        a, b = (np.concatenate(z) for z in zip(*found, strict=True))
        root = _labels(a, b, len(rep))
        hit = np.flatnonzero(number)
        # The root of each local component is the least id among its members.
        order = np.lexsort((rep[hit], root[hit]))
        lead = np.append(True, np.diff(root[hit][order]) != 0)
        name = rep[hit][order][np.flatnonzero(lead)][np.cumsum(lead) - 1]
        return pa.RecordBatch.from_arrays([pa.array(rep[hit][order]), pa.array(number[hit][order]), pa.array(name)], names=["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["table", "sign", "label", "dim", "ci", "cj"]
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            keys = np.column_stack([held.column(c).to_numpy() for c in names])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            start = 0
            for stop in cuts:
                out = links(held.slice(start, stop - start))
                start = stop
                if out is not None:
                    yield out
            held = held.slice(start)
        if held is not None:
            out = links(held)
            if out is not None:
                yield out

    return run


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Component labels of a small graph by least-label propagation with path halving."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b]), np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n edges that connect what the given ones connect."""
    label = _labels(a, b, n)
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept.

    Two vectors link if their labels are equal and not null, they have equally many components, and their cosine in
    double precision is at least the threshold. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing and are their own components. Rows without an id are left out. An id names one
    vector and yields one row: rows that repeat it count once, and where they differ a valid vector goes before one
    that links with nothing, then the one of least hash. Equal vectors link with each other. An empty table gives an
    empty result. Other columns are not carried. Labels of any type that can be compared are taken as they are.
    """
    spark = df.sparkSession
    kind = "<f8" if isinstance(df.schema[embedding].dataType.elementType, T.DoubleType) else "<f4"
    whole = isinstance(df.schema[label].dataType, T.IntegralType)
    named_label = F.col(f"`{label}`").cast("long") if whole else F.col(f"`{label}`")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"), named_label.alias("label")).filter("vec_id is not null")
    number = F.col("embedding").cast("array<double>")
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(number, lambda x: x != 0), F.lit(False))
    keyed = rows.withColumn("h1", F.when(valid, F.xxhash64("label", "embedding"))).withColumn("h2", F.when(valid, F.xxhash64(F.lit(5), "embedding", "label")))
    # One row an id: least() and min() pass over nulls, which mark vectors that link with nothing.
    ids = materialise(keyed.groupBy("vec_id").agg(F.min(F.when(F.col("h1").isNotNull(), F.struct("h1", "h2"))).alias("h")).select("vec_id", "h.h1", "h.h2"), "vector-ids")
    sizes = ids.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = keyed.filter("h1 is not null").join(sizes, (F.col("vec_id") == F.col("rep")) & (keyed["h1"] == sizes["h1"]) & (keyed["h2"] == sizes["h2"])).select(sizes["h1"], sizes["h2"], "rep", "weight", "label", "embedding")
    if rows.count() > ids.count():  # of rows that repeat an id and its vector one is taken
        classes = classes.dropDuplicates(["rep"])
    classes = materialise(classes, "vector-classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(most, threshold)
    group = F.col("label") if whole else F.xxhash64("label")
    signed = materialise(classes.select("rep", group.alias("label"), "weight", "embedding").mapInArrow(_sign(bits, tables, kind), "rep long, label long, weight long, vector binary, signs array<long>"), "signs")
    bucket = ["table", "sign", "label", "dim"]
    length = F.length("vector").cast("long").alias("dim")
    # Sizes of the buckets need no vectors; those of one vector are done.
    places = signed.select("rep", "label", length, F.posexplode("signs").alias("table", "sign"))
    shared = places.groupBy(*bucket).count().filter("count > 1")
    shared = materialise(shared.withColumn("chunks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count"), "bucket-sizes")
    shared = broadcast_if_small(shared, shared.count(), 48, 16 << 20)
    side = F.pmod(F.xxhash64("rep", "table"), F.col("chunks")).cast("int")
    filed = places.join(shared, bucket).withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    filed = filed.select("rep", *bucket, "side", F.least("side", "other").alias("ci"), F.greatest("side", "other").alias("cj"))
    units = filed.join(signed.select("rep", "weight", "vector"), "rep")
    key = [*bucket, "ci", "cj"]
    found = units.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare(kind, threshold, bits, tables), "rep long, links long, root long")
    found = materialise(found, "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct())
    discard(spark, signed, shared)
    named = classes.select("h1", "h2", "rep", "weight").join(counts, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = ids.filter("h1 is not null").join(named, ["h1", "h2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = ids.filter("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
