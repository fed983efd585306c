"""Exact Jaccard join on word shingles, and its connected components.

1. Every document's set of shingle hashes is counted against the corpus: packed, sorted hash lists go to hash
   buckets, where a hash met in two documents is shared. Equal sets form one class and go on as one
   representative. A set of n shingles can link only if at least 75 % of them are shared; other sets are done.
2. The sets left are ordered by a fixed order (frequent hashes last) and indexed by their prefixes: two sets that
   link share a hash there. In each index list the set with the largest shared part is the list's hub; every other
   one is compared with it only. The links found give first components.
3. What may still link are sets of different components. Each set's main hub is one that it is close to, the same for
   a whole group of near copies, and its answers are derived from its differences from the hub. Two sets with the
   same main hub H and overlaps x', y' with it hold at most min(x', y', |H| - missing) of its hashes both, where missing
   is a lower bound, from bit masks, of how many x or y lacks. Where that suffices for a link, they meet by their blocks
   (sizes and overlaps; whole pairs of blocks are skipped). Where it doesn't, they must share hashes that H lacks, and
   meet in an index of those only. Sets with different main hubs meet in the index lists, where lists of one
   component or one hub are skipped whole, and pairs by size and position. What remains is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, partitions, scratch, slices, tidied, tidy
from .components import connected_components
from .words import ROLL, gram_hashes, mixed, word_hashes

SHINGLE = 5
#: A link: THRESHOLD[1] * intersection >= THRESHOLD[0] * union.
THRESHOLD = (75, 100)
#: Flush points of a map task, and the text it hashes at once.
BATCH_SHINGLES = 600_000
BATCH_DOCS = 60_000
HASH_BYTES = 1 << 18
#: Buckets by setting of shuffle partitions; the counting stage has as many tasks.
BUCKETS = 2
#: Frequent hashes that get a place of their own in the order, at most; the order is valid whatever their number.
FREQUENT = 1 << 20
FREQUENT_FROM = 16
MANY = 0xFFFF


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each string, sorted, and where each string's begin (one entry more)."""
    words, bounds = word_hashes(column, lower=True)
    n = len(bounds) - 1
    counts = np.diff(bounds)
    grams = gram_hashes(words, size)
    owner = np.repeat(np.arange(n), counts)
    left = bounds[1:][owner] - np.arange(len(words))
    full = left[: len(grams)] >= size
    hashes, docs = [grams[full]], [owner[: len(grams)][full]]
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        if len(short):
            whole = np.full(len(short), k * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
            factor = 1
            for i in range(k):
                whole += words[bounds[short] + i] * np.uint64(factor)
                factor = factor * ROLL % 2**64
            hashes.append(mixed(whole))
            docs.append(short)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(n + 1))


def _pack(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes, plane by plane so that equal high bytes compress."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], dtype="<i8").tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 + 16 * len(types), []
    for i, kind in enumerate(types):
        n, width = np.frombuffer(raw, "<i8", 2, 8 + 16 * i)
        plane = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(-1) if n else np.empty(0, kind))
        at += n * width
    return out


_ROUTED = "to int, kind int, blob binary"
TOKENS, DOCS, REPLIES, HOT = range(4)


def _routed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["to", "kind", "blob"])


def _send(size: int, buckets: int):
    """Per batch and bucket the sorted 48-bit hashes with the document of each that only one of the batch has."""

    def flush(ids: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(ids)), n)
        ends = np.append(0, np.cumsum(n))
        sums = []
        for salt in (0x1234567, 0xABCDEF12345):
            total = np.append(np.uint64(0), np.cumsum(mixed(hashes ^ np.uint64(salt))))
            sums.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
        key = hashes >> np.uint64(16)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        local = np.diff(np.append(head, len(key)))
        shared = np.bincount(doc[np.repeat(local > 1, local)], minlength=len(ids)).astype(np.int32)
        key, doc = key[head], np.where(local > 1, MANY, doc[head]).astype("<u2")
        bucket = (mixed(key) % np.uint64(buckets)).astype(np.int64)
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids) + 1, dtype=np.int64)
        rank[by_id] = np.arange(len(ids))
        rows = [(int(ids[0]) % buckets, DOCS, _pack(ids, n.astype(np.int32), *sums, shared))]
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)) if len(order) else []
        for part in np.split(order, cut[1:]) if len(order) else []:
            single = doc[part] != MANY
            used = np.unique(rank[doc[part][single]])
            index = np.full(len(part), MANY, dtype="<u2")
            index[single] = np.searchsorted(used, rank[doc[part][single]])
            counts = np.minimum(local[part][~single], 2**31 - 1).astype("<u4")
            rows.append((int(bucket[part[0]]), TOKENS, _pack(np.diff(key[part], prepend=np.uint64(0)), index, np.diff(ids[by_id][used], prepend=0), counts)))
        return _routed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = docs = 0
        for batch in slices(batches, "text", HASH_BYTES):
            h, bounds = shingle_sets(batch.column("text"), size)
            ids.append(batch.column("doc_id").to_numpy()), hashes.append(h), sizes.append(np.diff(bounds))
            held, docs = held + len(h), docs + batch.num_rows
            if held >= BATCH_SHINGLES or docs >= BATCH_DOCS - 10_000:
                yield flush(np.concatenate(ids), np.concatenate(hashes), np.concatenate(sizes))
                ids, hashes, sizes, held, docs = [], [], [], 0, 0
                tidy()
        if docs:
            yield flush(np.concatenate(ids), np.concatenate(hashes), np.concatenate(sizes))

    return run


def _count(homes: int):
    """Which hashes of a bucket are shared: replies to the documents that sent them alone, and frequent hashes.

    Documents and replies meet again by the hash of the id, in one of `homes` places; a task sends each place one
    packed reply, so the rows are few whatever the number of documents.
    """

    def home(ids: np.ndarray) -> np.ndarray:
        return (mixed(ids.view(np.uint64)) % np.uint64(homes)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, kind, raw in zip(batch.column("to").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if kind == TOKENS:
                    held.setdefault(bucket, []).append(raw)
                else:
                    parts = _unpack(raw, "<i8", "<i4", "<i8", "<i8", "<i4")
                    to = home(parts[0])
                    rows = []
                    for t in np.unique(to):
                        rows.append((int(t), DOCS, _pack(*(p[to == t] for p in parts))))
                    yield _routed(rows)
        replies: list[tuple[np.ndarray, np.ndarray]] = []
        while held:  # one bucket at a time; the others stay compressed
            bucket, blobs = held.popitem()
            yield from answers(bucket, blobs, replies)
        if replies:
            ids, inverse = np.unique(np.concatenate([r[0] for r in replies]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([r[1] for r in replies])).astype(np.int32)
            to = home(ids)
            order = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(to[order]) > 0)) if len(order) else np.empty(0, np.int64)
            parts = np.split(order, cut[1:]) if len(order) else []
            if parts:
                yield _routed([(int(to[p[0]]), REPLIES, _pack(np.diff(ids[p], prepend=0), n[p])) for p in parts])

    def answers(bucket: int, blobs: list[bytes], replies: list) -> Iterator[pa.RecordBatch]:
        keys, docs, many = [], [], []
        for raw in blobs:
            key, index, ids, counts = _unpack(raw, "<u8", "<u2", "<i8", "<u4")
            single = index != MANY
            owner = np.zeros(len(index), dtype=np.int64)
            owner[single] = np.cumsum(ids)[index[single]]
            number = np.ones(len(index), dtype=np.int64)
            number[~single] = counts
            keys.append(np.cumsum(key, dtype=np.uint64)), docs.append(owner), many.append(number)
        key, doc, number = np.concatenate(keys), np.concatenate(docs), np.concatenate(many)
        keys.clear(), docs.clear(), many.clear()
        order = np.argsort(key, kind="stable")
        key, doc, number = key[order], doc[order], number[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(number, head)
        frequent = total >= FREQUENT_FROM
        if frequent.any():
            yield _routed([(bucket, HOT, _pack(key[head][frequent], np.minimum(total[frequent], 2**31 - 1).astype(np.int32)))])
        answered = (number == 1) & (np.repeat(total, np.diff(np.append(head, len(key)))) > 1)
        replies.append(np.unique(doc[answered], return_counts=True))

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their shared counts summed, and the frequent hashes."""
    docs: list[list[np.ndarray]] = []
    ids, n = [], []
    names = ["doc_id", "n", "fp1", "fp2", "shared", "token", "df"]
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
            raw = blob.as_buffer().to_pybytes()
            if kind == DOCS:
                docs.append(_unpack(raw, "<i8", "<i4", "<i8", "<i8", "<i4"))
            elif kind == REPLIES:
                some, count = _unpack(raw, "<i8", "<i4")
                ids.append(np.cumsum(some)), n.append(count)
            else:
                token, df = _unpack(raw, "<u8", "<i4")
                nulls = [pa.nulls(len(token), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())]
                yield pa.RecordBatch.from_arrays([*nulls, pa.array(token.view(np.int64)), pa.array(df)], names=names)
    if not docs:
        return
    doc, size, fp1, fp2, shared = (np.concatenate(x) for x in zip(*docs, strict=True))
    first, at = np.unique(doc, return_index=True)  # rows that repeat an id repeat its set
    shared = shared[at].astype(np.int64)
    if ids:
        np.add.at(shared, np.searchsorted(first, np.concatenate(ids)), np.concatenate(n))
    shared = np.minimum(shared, size[at]).astype(np.int32)
    columns = [pa.array(first), pa.array(size[at]), pa.array(fp1[at]), pa.array(fp2[at]), pa.array(shared), pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int32())]
    yield pa.RecordBatch.from_arrays(columns, names=names)


def counted(df: DataFrame, size: int = SHINGLE) -> DataFrame:
    """A row for each id: n, two fingerprints of the set, how many of its hashes other documents have; and rows of
    frequent hashes (token, df) without an id. Written to the shared folder."""
    spark = df.sparkSession
    buckets = BUCKETS * partitions(spark)
    sent = df.filter(F.col("doc_id").isNotNull()).mapInArrow(tidied(_send(size, buckets)), _ROUTED)
    replied = sent.repartition(2 * partitions(spark), "to").mapInArrow(tidied(_count(max(8, partitions(spark) // 2))), _ROUTED)
    schema = "doc_id long, n int, fp1 long, fp2 long, shared int, token long, df int"
    return materialise(replied.repartition(partitions(spark), "to").mapInArrow(tidied(_gather), schema), "shingles", few=True)


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent hashes and their frequency classes; whole classes, FREQUENT hashes at most."""
    klass = F.floor(F.log2("df")).cast("int")
    hot = rows.filter("token is not null").withColumn("c", klass)
    sizes = sorted(((r["c"], r["count"]) for r in hot.groupBy("c").count().collect()), reverse=True)
    least, total = None, 0
    for c, count in sizes:
        total += count
        if total > FREQUENT:
            break
        least = c
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int8)
    found = hot.filter(F.col("c") >= least).select("token", "c").toPandas().sort_values("token")
    return found["token"].to_numpy().astype(np.int64).view(np.uint64), found["c"].to_numpy().astype(np.int8)


def ordered_sets(df: DataFrame, frequent: tuple[np.ndarray, np.ndarray], size: int = SHINGLE) -> DataFrame:
    """doc_id, n, shared and tokens: the set in the global order (frequency class, hash)."""
    known, klass = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", HASH_BYTES):
            h, bounds = shingle_sets(batch.column("text"), size)
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            c = np.zeros(len(h), dtype=np.int8)
            if len(known):
                at = np.minimum(np.searchsorted(known, h >> np.uint64(16)), len(known) - 1)
                hit = known[at] == h >> np.uint64(16)
                c[hit] = klass[at[hit]]
            h = h[np.lexsort((h, c, owner))]
            tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("shared"), tokens], names=["doc_id", "n", "shared", "tokens"])

    return df.mapInArrow(tidied(run), "doc_id long, n int, shared int, tokens array<long>")


def _least_overlap(n, m):
    """The least intersection with which sets of n and m hashes link."""
    num, den = THRESHOLD
    return F.ceil((F.lit(num) * (n + m)) / F.lit(num + den))


def _sizes_fit(n, m):
    num, den = THRESHOLD
    return F.least(n, m) * den >= F.greatest(n, m) * num


def _overlaps(pairs: DataFrame, sets: DataFrame, hubs: bool = False) -> DataFrame:
    """Pairs (x, y) with n_x, n_y and their exact overlap; if y are hubs, also how x differs from them."""
    x = sets.select(F.col("doc_id").alias("x"), F.col("n").alias("n_x"), F.col("tokens").alias("t_x"))
    y = sets.select(F.col("doc_id").alias("y"), F.col("n").alias("n_y"), F.col("tokens").alias("t_y"))
    both = pairs.join(x, "x").join(y, "y").withColumn("overlap", F.size(F.array_intersect("t_x", "t_y")))
    if not hubs:
        return both.select("x", "y", "n_x", "n_y", "overlap")
    close = 2 * F.col("overlap") >= F.col("n_x")
    return both.select("x", "y", "n_x", "n_y", "overlap", *_masks(F.array_except("t_y", "t_x")), F.when(close, F.array_except("t_x", "t_y")).alias("extra"))


def _masks(missing):
    """Two 64-bit masks with a bit for each residue modulo 128 that a missing hash has."""
    part = lambda t: F.pmod(t, F.lit(128)).cast("int")
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), part(t) % 64)
    none = F.lit(0).cast("long")
    low = F.aggregate(missing, none, lambda m, t: F.when(part(t) < 64, m.bitwiseOR(bit(t))).otherwise(m))
    high = F.aggregate(missing, none, lambda m, t: F.when(part(t) >= 64, m.bitwiseOR(bit(t))).otherwise(m))
    return low.alias("m1"), high.alias("m2")


def _linked(overlap, n, m):
    num, den = THRESHOLD
    return overlap * den >= (n + m - overlap) * num


def _ends(rows: DataFrame, on: list[str], others: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows twice, with doc_id as x and y and the other columns by these suffixes."""
    x, y = (rows.select(*on, F.col("doc_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in others]) for s in "xy")
    return x, y


def _common_of_hub():
    """At most so many of their common hub's hashes do x and y both hold."""
    missing = sum((F.bit_count(F.col(f"{m}_x").bitwiseOR(F.col(f"{m}_y"))) for m in ("m1", "m2")), F.lit(0))
    return F.least("o_x", "o_y", F.col("n_main_x") - missing)


def _fits():
    """Whether x and y may link by their sizes and by what of each the corpus shares, and are not joined yet."""
    n_x, n_y = F.col("n_x"), F.col("n_y")
    return _sizes_fit(n_x, n_y) & (F.least("shared_x", "shared_y") >= _least_overlap(n_x, n_y)) & (F.col("comp_x") != F.col("comp_y"))


def _by_lists(known: DataFrame, posts: DataFrame) -> DataFrame:
    """Pairs with different main hubs that meet in an index list, and that sizes and positions don't rule out."""
    entries = posts.select("token", "doc_id", "pos").join(known.select("doc_id", "n", "shared", "main", "comp"), "doc_id")
    mixed_lists = entries.groupBy("token").agg(F.min("main").alias("lo"), F.max("main").alias("hi"), F.min("comp").alias("first"), F.max("comp").alias("last")).filter("lo <> hi and first <> last").select("token")
    entries = materialise(entries.join(mixed_lists, "token", "left_semi"), "mixed-postings", few=True)
    x, y = _ends(entries, ["token"], ["n", "shared", "main", "comp", "pos"])
    n_x, n_y = F.col("n_x"), F.col("n_y")
    by_place = F.least("pos_x", "pos_y") + F.least(n_x - F.col("pos_x"), n_y - F.col("pos_y"))
    return x.join(y, "token").filter((F.col("x") < F.col("y")) & (F.col("main_x") != F.col("main_y")) & _fits() & (by_place >= _least_overlap(n_x, n_y))).select("x", "y")


def _by_extras(known: DataFrame) -> DataFrame:
    """Pairs of one main hub that hold a hash in common that the hub lacks, and that the hub's answers don't rule out.

    A set whose overlap with the hub falls short of what a link takes must share the rest: a prefix of its other
    hashes, in the global order, holds the first that both have.
    """
    num, den = THRESHOLD
    short = F.greatest(F.lit(1), F.ceil(F.col("n") * num / den) - F.col("o"))
    prefix = F.greatest(F.lit(0), F.size("extra") - short + 1)
    columns = ["n", "shared", "comp", "o", "n_main", "m1", "m2"]
    entries = known.select("main", "doc_id", *columns, F.explode(F.slice("extra", F.lit(1), prefix.cast("int"))).alias("token"))
    mixed_lists = entries.groupBy("main", "token").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).filter("first <> last").select("main", "token")
    entries = materialise(entries.join(mixed_lists, ["main", "token"], "left_semi"), "extra-postings", few=True)
    x, y = _ends(entries, ["main", "token"], columns)
    outside = F.greatest(F.lit(0), F.least(F.col("shared_x") - F.col("o_x"), F.col("shared_y") - F.col("o_y")))
    need = _least_overlap(F.col("n_x"), F.col("n_y"))
    return x.join(y, ["main", "token"]).filter((F.col("x") < F.col("y")) & _fits() & (_common_of_hub() + outside >= need)).select("x", "y")


def _by_hubs(known: DataFrame) -> DataFrame:
    """Pairs of one main hub that may link by the hub's hashes alone.

    Sets of equal size and overlap with the hub form a block, of which there are no more than the hub's size allows,
    however large the group. Blocks that can't link, or are one component already, are skipped whole.
    """
    need = _least_overlap(F.col("n_x"), F.col("n_y"))
    key = ["n", "o"]
    blocks = known.groupBy("main", *key, "n_main").agg(F.bit_and("m1").alias("m1"), F.bit_and("m2").alias("m2"), F.max("shared").alias("shared"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    a, b = (blocks.select("main", *[F.col(c).alias(f"{c}_{s}") for c in blocks.columns if c != "main"]) for s in "xy")
    several = ~((F.col("lo_x") == F.col("hi_x")) & (F.col("lo_y") == F.col("hi_y")) & (F.col("lo_x") == F.col("lo_y")))
    in_order = F.struct(*[f"{c}_x" for c in key]) <= F.struct(*[f"{c}_y" for c in key])
    open_pairs = a.join(b, "main").filter(in_order & several & _sizes_fit(F.col("n_x"), F.col("n_y")) & (F.least("shared_x", "shared_y") >= need) & (_common_of_hub() >= need))
    open_pairs = materialise(open_pairs.select("main", *[f"{c}_{s}" for s in "xy" for c in key]), "open-blocks", few=True)
    x, y = _ends(known, ["main"], [*key, "n_main", "shared", "comp", "m1", "m2"])
    pairs = open_pairs.join(x, ["main", *[f"{c}_x" for c in key]]).join(y.drop("n_main_y"), ["main", *[f"{c}_y" for c in key]])
    return pairs.filter((F.col("x") != F.col("y")) & _fits() & (_common_of_hub() >= need)).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def links(sets: DataFrame) -> DataFrame:
    """Links (x, y) between different sets that join the same components as all links do.

    sets: one row (doc_id, n, shared, tokens) a class, tokens in the global order.
    """
    num, den = THRESHOLD
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    index = sets.select("doc_id", "n", "shared", F.posexplode(F.slice("tokens", F.lit(1), prefix.cast("int"))).alias("pos", "token"))
    # Lists of one set link nothing; the hub is the set with the largest shared part, of equal ones the least id.
    best = F.max(F.struct((F.col("shared") / F.col("n")).alias("r"), (-F.col("doc_id")).alias("h")))
    lists = index.groupBy("token").agg(F.count("*").alias("entries"), best.alias("best")).filter("entries > 1")
    posts = materialise(index.join(lists.select("token", (-F.col("best.h")).alias("hub")), "token"), "postings")
    hubs = sets.select(F.col("doc_id").alias("hub"), F.col("n").alias("n_hub"))
    star = posts.filter("doc_id <> hub").select(F.col("doc_id"), "n", "hub").distinct().join(hubs, "hub").filter(_sizes_fit(F.col("n"), F.col("n_hub")))
    answers = materialise(_overlaps(star.select(F.col("doc_id").alias("x"), F.col("hub").alias("y")), sets, hubs=True), "hub-answers", few=True)
    found = answers.filter(_linked(F.col("overlap"), F.col("n_x"), F.col("n_y"))).select("x", "y")
    first = materialise(connected_components(found, "x", "y"), "hub-components", few=True)

    # A set's main hub is the one that most sets are close to, so that a group of near copies has one; a set without a
    # close hub is its own.
    near = answers.filter("extra is not null")
    liked = near.groupBy("y").agg(F.count("*").alias("friends"))
    main = near.select("x", "y", "overlap").join(liked, "y").groupBy("x").agg(F.max(F.struct("friends", "overlap", (-F.col("y")).alias("h"))).alias("c"))
    close = near.join(main.select("x", (-F.col("c.h")).alias("y")), ["x", "y"])
    close = close.select(F.col("x").alias("doc_id"), F.col("y").alias("main"), F.col("overlap").alias("o"), F.col("n_y").alias("n_main"), "m1", "m2", "extra")
    listed = posts.select("doc_id", "n", "shared").distinct()
    known = listed.join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(close, "doc_id", "left")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    own = {"component": ("comp", F.col("doc_id")), "main": ("main", F.col("doc_id")), "o": ("o", F.col("n")), "n_main": ("n_main", F.col("n")), "m1": ("m1", zero), "m2": ("m2", zero), "extra": ("extra", none)}
    known = materialise(known.select("doc_id", "n", "shared", *[F.coalesce(F.col(c), default).alias(name) for c, (name, default) in own.items()]), "answered-sets", few=True)

    groups = known.groupBy("main").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).filter("first <> last").select("main")
    grouped = materialise(known.join(groups, "main", "left_semi"), "open-groups", few=True)
    rest = _by_lists(known, posts).union(_by_extras(grouped)).union(_by_hubs(grouped.drop("extra"))).distinct()
    done = answers.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    rest = materialise(rest.join(done, ["x", "y"], "left_anti"), "open-pairs", few=True)
    more = _overlaps(rest, sets).filter(_linked(F.col("overlap"), F.col("n_x"), F.col("n_y"))).select("x", "y")
    return first.select(F.col("id").alias("x"), F.col("component").alias("y")).union(more)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per id: doc_id, n_shingles, component_id (least id reachable by links, itself included).

    Words are runs of other than ASCII white space, A-Z lower-cased. A text with fewer words than a shingle has its
    whole word sequence as its one shingle; null, empty and word-free texts have none and link with nothing. Rows
    that repeat an id count once (an id names one text); rows without an id are left out. Exact copies are one
    component. Whole texts count, whatever their length; an empty table gives an empty result. Other columns are
    not carried.
    """
    num, den = THRESHOLD
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = counted(docs, size)
    counts = rows.filter("doc_id is not null").drop("token", "df")
    sets = ["n", "fp1", "fp2"]
    classes = materialise(counts.filter("n > 0").groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.max("shared").alias("shared")), "classes", few=True)
    able = classes.filter(F.col("shared") * den >= F.col("n") * num).select(F.col("rep").alias("doc_id"), "n", "shared")
    able = broadcast_if_small(able, able.count(), 40)
    chosen = docs.join(able, "doc_id")
    with scratch(df.sparkSession) as keep:
        found = materialise(ordered_sets(chosen.select("doc_id", "n", "shared", "text"), _frequent(rows), size), "sets")
        joined = keep(connected_components(links(found), "x", "y")).select(F.col("id").alias("rep"), F.col("component"))
    named = classes.select(*sets, "rep").join(joined, "rep", "left").select(*sets, F.coalesce("component", "rep").alias("component"))
    # Texts without words meet nowhere; copies of one text share a key, whose partition the planner may split.
    out = counts.filter("n > 0").join(named, sets).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.union(counts.filter("n = 0").select("doc_id", F.col("n").cast("long"), F.col("doc_id")))
