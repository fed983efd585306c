"""Repeated passages: every word in a 13-word window that also starts in a document with a smaller id goes.

Consecutive windows that share a minimiser (the least hash among their word triples) travel together as one
packed string of words to the minimiser's bucket. There the windows are cut out of the strings again, sorted by a
hash and compared word for word; of equal windows the least document id is the one that keeps its words. Before anything travels, equal
strings of one batch collapse into the one with the least id, so a passage that most documents share arrives
once per batch, not once per document. A minimiser that holds more windows than a bucket on average, which a first
pass finds, shares its windows out by their next least hash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, partitions, slices, texts_of, tidied, tidy
from .words import ROLL, ROLL_INVERSE, distinct_words, gram_hashes, mixed, powers, ranges, span_hashes, spans, word_hashes, word_spans

WINDOW = 13
MINIMISER = 3
#: Words that a map task gathers before it sends packed strings, and text that it hashes at once.
BATCH_WORDS = 600_000
HASH_BYTES = 1 << 18
#: Compression of packed strings, which are most of what travels.
LEVEL = 5
#: Buckets by setting of shuffle partitions; the counting stage has twice as many tasks, and counts one bucket at a time.
BUCKETS = 4


def _runs(words: np.ndarray, bounds: np.ndarray, window: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: first word, number of windows, and the key of each, the minimiser's hash.

    Windows of a hot minimiser (hot is in order) have keys of their two least hashes, so that they spread over buckets.
    Keys follow from a window's own words, so equal windows have equal keys.
    """
    n = len(words)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = low = gram_hashes(words, MINIMISER)
    span = window - MINIMISER + 1
    have = 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    starts = np.flatnonzero(left[: len(low)] >= window)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    least = low[starts]
    if len(hot):
        at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least)
        for part in np.array_split(at, len(at) // 50_000 + 1):
            all_of = grams[starts[part][:, None] + np.arange(span)]
            all_of[all_of == least[part][:, None]] = np.uint64(2**64 - 1)
            least[part] = mixed(least[part] + mixed(all_of.min(axis=1)))
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (np.diff(starts) != 1) | (least[1:] != least[:-1])
    at = np.flatnonzero(first)
    return starts[at], np.diff(np.append(at, len(starts))), least[at]


def _content(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of words[start : start + length] for each."""
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words.astype(np.uint64) * powers(ROLL, len(words)), out=sums[1:])
    return mixed((sums[start + length] - sums[start]) * powers(ROLL_INVERSE, len(words) + 1)[start] + length.astype(np.uint64))


def _packed(doc: np.ndarray, start: np.ndarray, count: np.ndarray, strings: list[bytes]) -> bytes:
    raw = struct.pack("<q", len(doc)) + np.diff(doc, prepend=0).tobytes() + start.astype("<u4").tobytes() + count.astype("<u4").tobytes() + b"\n".join(strings)
    return zstandard.ZstdCompressor(level=LEVEL).compress(raw)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Document, first word and windows of each run; the words of all runs by number, and the distinct ones."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    doc = np.cumsum(np.frombuffer(raw, np.int64, n, 8))
    start = np.frombuffer(raw, "<u4", n, 8 + 8 * n).astype(np.int64)
    count = np.frombuffer(raw, "<u4", n, 8 + 12 * n).astype(np.int64)
    data = np.frombuffer(raw, np.uint8, -1, 8 + 16 * n)
    return doc, start, count, *distinct_words(data, *spans(data))


def _equal(codes: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether codes[a : a + length] are codes[b : b + length], for each."""
    differ = np.append(0, np.cumsum(codes[ranges(a, length)] != codes[ranges(b, length)]))
    ends = np.cumsum(length)
    return differ[ends] == differ[ends - length]


def _by_doc(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row a document: its ranges, packed as pairs of 32-bit numbers."""
    order = np.lexsort((start, doc))
    doc, pairs = doc[order], np.column_stack([start[order], end[order]]).astype("<u4")
    cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, np.int64)
    blobs = [p.tobytes() for p in np.split(pairs, cut[1:])] if len(doc) else []
    return pa.RecordBatch.from_arrays([pa.array(doc[cut], pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "ranges"])


def _frequent(window: int, buckets: int):
    """Minimisers that hold more than a bucket's fair share of a batch's windows, or half of it, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def counted() -> pa.RecordBatch:
            words, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            _, count, least = _runs(words, np.append(0, np.cumsum(sizes)), window, np.empty(0, np.uint64))
            keys, at = np.unique(least, return_inverse=True)
            n = np.bincount(at, count).astype(np.int64)
            often = n * 2 * buckets > n.sum()
            return pa.RecordBatch.from_arrays([pa.array(np.append(keys[often].view(np.int64), 0)), pa.array(np.append(n[often], n.sum())), pa.array(np.append(np.zeros(often.sum(), bool), True))], names=["key", "n", "total"])

        for batch in slices(batches, "text", HASH_BYTES):
            hashes, bounds = word_hashes(batch.column("text"))
            parts.append((hashes, np.diff(bounds)))
            held += len(hashes)
            if held >= BATCH_WORDS:
                yield counted()
                held = 0
                tidy()
        if parts:
            yield counted()

    return run


def hot_minimisers(df: DataFrame, window: int, buckets: int) -> np.ndarray:
    """Minimisers of more windows than a bucket holds on average, in order: fewer than there are buckets.

    They are met in some batch as often as half of that, or they are hot nowhere and in no place at once.
    """
    found = df.mapInArrow(tidied(_frequent(window, buckets)), "key long, n long, total boolean").groupBy("total", "key").agg(F.sum("n").alias("n"))
    # The total, then the most frequent: fewer than buckets can hold more than a bucket's share.
    rows = found.orderBy(F.desc("total"), F.desc("n"), "key").limit(buckets + 1).collect()
    hot = [r["key"] for r in rows if not r["total"] and r["n"] * buckets > rows[0]["n"]]
    return np.sort(np.array(hot, dtype=np.int64).view(np.uint64))


def _send(window: int, buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in slices(batches, "text", HASH_BYTES):
            data, start, end, bounds = word_spans(batch.column("text"))
            parts.append((batch.column("doc_id").to_numpy(), np.diff(bounds), data, start, end, span_hashes(data, start, end)))
            held += len(start)
            if held >= BATCH_WORDS:
                yield from sent(parts)
                parts, held = [], 0
                tidy()
        if held:
            yield from sent(parts)

    def sent(parts: list) -> Iterator[pa.RecordBatch]:
        at = np.cumsum([0] + [len(p[2]) for p in parts])
        doc, size, data, begin, end, hashes = (np.concatenate(x) for x in zip(*[(p[0], p[1], p[2], p[3] + a, p[4] + a, p[5]) for p, a in zip(parts, at, strict=False)], strict=True))
        parts.clear()
        codes, _ = distinct_words(data, begin, end)
        order = np.argsort(doc, kind="stable")  # so that of equal strings the first has the least id
        if (order[1:] < order[:-1]).any():
            before = np.cumsum(size) - size
            take = ranges(before[order], size[order])
            begin, end, hashes, codes = begin[take], end[take], hashes[take], codes[take]
            doc, size = doc[order], size[order]
        bounds = np.append(0, np.cumsum(size))
        start, count, least = _runs(hashes, bounds, window, hot)
        if not len(start):
            return
        owner = np.searchsorted(bounds, start, side="right") - 1
        own_doc, own_start = doc[owner], start - bounds[owner]
        length = count + window - 1
        content = _content(hashes, start, length)
        order = np.argsort(content, kind="stable")
        head = np.append(True, content[order][1:] != content[order][:-1])
        first = np.empty(len(start), dtype=np.int64)
        first[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        known = np.flatnonzero((own_doc > own_doc[first]) & (length == length[first]))
        if len(known):  # the whole string starts in an earlier document of this batch too, word for word
            known = known[_equal(codes, start[known], start[first[known]], length[known])]
            rows = _by_doc(own_doc[known], own_start[known], own_start[known] + length[known])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows.num_rows) % buckets, pa.int32()), rows.column("doc_id"), rows.column("ranges")], names=["bucket", "doc_id", "blob"])
        keep = np.setdiff1d(np.arange(len(start)), known)
        bucket = (mixed(least[keep]) % np.uint64(buckets)).astype(np.int64)
        keep = keep[np.argsort(bucket, kind="stable")]
        bucket = np.sort(bucket)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        raw = data.tobytes()
        blobs = []
        for part in np.split(keep, cut[1:]):
            strings = [raw[a:b] for a, b in zip(begin[start[part]].tolist(), end[start[part] + length[part] - 1].tolist(), strict=True)]
            blobs.append(_packed(own_doc[part], own_start[part], count[part], strings))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.nulls(len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "doc_id", "blob"])

    return run


def _count(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            answered = pc.is_valid(batch.column("doc_id"))
            if pc.any(answered).as_py():
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(answered) for c in ("doc_id", "blob")], names=["doc_id", "ranges"])
            sent = batch.filter(pc.invert(answered))
            for bucket, blob in zip(sent.column("bucket").to_pylist(), sent.column("blob").to_pylist(), strict=True):
                held.setdefault(bucket, []).append(blob)
        while held:  # one bucket at a time; the others stay compressed
            yield from counted([_unpacked(blob) for blob in held.popitem()[1]])

    def counted(parts: list) -> Iterator[pa.RecordBatch]:
        doc, start, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
        merged = pa.concat_arrays([p[4] for p in parts]).dictionary_encode().indices.to_numpy()
        firsts = np.cumsum([0] + [len(p[4]) for p in parts])
        codes = np.concatenate([merged[p[3] + f] for p, f in zip(parts, firsts, strict=False)])  # equal for equal words of this bucket, and for no others
        parts.clear()
        length = count + window - 1
        at = ranges(np.cumsum(length) - length, count)  # where each window starts among the codes
        run_of = np.repeat(np.arange(len(doc)), count)
        own = doc[run_of]
        key = _content(codes.astype(np.uint64), at, np.full(len(at), window, dtype=np.int64))
        order = np.lexsort((own, key))
        new = np.append(True, key[order][1:] != key[order][:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = own[order] > own[order][head]
        check = np.flatnonzero(later)
        same = np.ones(len(check), dtype=bool)
        for k in range(window):  # the keys only sort; equality is decided by the words
            same &= codes[at[order[check]] + k] == codes[at[order[head[check]]] + k]
        if not same.all():
            groups: dict[bytes, int] = {}
            touched = np.flatnonzero(np.isin(head, head[check[~same]]))
            text = [codes[at[order[i]] : at[order[i]] + window].tobytes() for i in touched]
            for i, t in zip(touched, text, strict=True):
                groups[t] = min(groups.get(t, own[order[i]]), own[order[i]])
            later[touched] = [own[order[i]] > groups[t] for i, t in zip(touched, text, strict=True)]
        gone = np.zeros(len(at), dtype=bool)
        gone[order] = later
        hit = np.flatnonzero(gone)
        if not len(hit):
            return
        first = np.ones(len(hit), dtype=bool)
        first[1:] = (np.diff(hit) != 1) | (run_of[hit[1:]] != run_of[hit[:-1]])
        begin = np.flatnonzero(first)
        many = np.diff(np.append(begin, len(hit)))
        head = hit[begin]
        run_start = np.cumsum(count) - count
        from_word = start[run_of[head]] + head - run_start[run_of[head]]
        yield _by_doc(own[head], from_word, from_word + many + window - 1)

    return run


def repeated_ranges(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of doc_id and packed word ranges that windows of earlier documents cover; several rows a document."""
    bounded_batches(df.sparkSession)
    buckets = BUCKETS * partitions(df.sparkSession)
    named = df.filter(F.col("doc_id").isNotNull())
    sent = named.mapInArrow(tidied(_send(window, buckets, hot_minimisers(named.select("text"), window, buckets))), "bucket int, doc_id long, blob binary")
    return sent.repartition(2 * partitions(df.sparkSession), "bucket").mapInArrow(tidied(_count(window)), "doc_id long, ranges binary")


def removed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """df's rows with n_words, n_removed, kept_sha256 and, if asked for, kept_text; the text column is dropped.

    Words are runs of other than ASCII white space, compared unchanged; kept words are joined by one space. Null
    and empty texts have no words; a document with fewer words than a window keeps all. An id names one text:
    rows that repeat it are compared with other ids only and get equal results. Rows without an id keep all their
    words. Whole texts count, whatever their length; an empty table gives an empty result. Hashes only route and
    sort windows; what is removed is decided by the words themselves.
    """
    added = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    others = [c for c in df.columns if c not in (doc_id, text, *added)]
    plain = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    by_doc = repeated_ranges(plain, window).groupBy("doc_id").agg(F.collect_list("ranges").alias("_ranges"))
    rows = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    joined = rows.join(by_doc, rows["_id"].cast("long") == by_doc["doc_id"], "left").drop("doc_id")
    schema = T.StructType([df.schema[doc_id], *(df.schema[c] for c in others), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept_text", T.StringType())] * with_text)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            n, gone, digest, kept = [], [], [], []
            for string, blobs in zip(texts_of(batch, "_text"), batch.column("_ranges").to_pylist(), strict=True):
                words = string.encode().split()
                n.append(len(words))
                if blobs:
                    words = _kept(words, blobs)
                gone.append(n[-1] - len(words))
                joined = b" ".join(words)
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept.append(joined.decode())
            columns = [batch.column("_id"), *(batch.column(c) for c in others), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                columns.append(pa.array(kept, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[doc_id, *others, *added])

    return joined.mapInArrow(tidied(finish), schema)


def _kept(words: list[bytes], blobs: list[bytes]) -> list[bytes]:
    pairs = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 2).astype(np.int64)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, pairs[:, 0], 1)
    np.add.at(depth, pairs[:, 1], -1)
    return [w for w, d in zip(words, np.cumsum(depth[:-1]).tolist(), strict=True) if not d]
