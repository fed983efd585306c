"""Quality scores by compression: dictionaries of good and of bad labelled text, and a calibrated difference.

Each text is cut into blocks (all of it); every block is compressed with either dictionary and with none. The
difference of the two sums over the larger of them, and the text's own compressed share, go through a logistic
curve fitted on labelled rows that the dictionaries haven't seen.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import logistic
from .common import bounded_batches, slices, texts_of, tidied

BLOCK = 1024
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
#: Labelled rows of each class that the model is fitted on at most, whole texts.
SAMPLE_ROWS = 4000


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries and curve. Without labelled rows of both classes there are none, and every score is prior."""

    good: bytes = b""
    bad: bytes = b""
    curve: tuple[float, ...] = ()
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()
    prior: float = 0.5

    def sizer(self) -> Sizer:
        return Sizer(self.good, self.bad)

    def scores(self, x: np.ndarray, empty: np.ndarray) -> np.ndarray:
        """Scores of feature rows; a text without bytes gets the labelled rows' share of good ones."""
        if not self.curve or not len(x):
            return np.full(len(x), self.prior)
        raw = np.clip(x, self.low, self.high) @ np.array(self.curve[:-1]) + self.curve[-1]
        return np.where(empty, self.prior, 1 / (1 + np.exp(-np.clip(raw, -35, 35))))


class Sizer:
    """Features of a text: the normalised compressed-size difference, and the log of its own compressed share."""

    def __init__(self, good: bytes, bad: bytes):
        self.with_good, self.with_bad, self.plain = _compressor(good), _compressor(bad), _compressor(b"")

    def __call__(self, data: bytes) -> tuple[float, float]:
        good = bad = plain = 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            good += len(self.with_good.compress(block))
            bad += len(self.with_bad.compress(block))
            plain += len(self.plain.compress(block))
        return (bad - good) / max(bad, good, 1), math.log((plain + 1) / (len(data) + 1))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**options)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, **options)


def _dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary; of too few blocks to train on, their raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on at most sample_rows labelled rows of each class, those with the smallest hash of the id.

    One half of them makes the dictionaries, the other the curve; class weights restore the classes' shares among
    all labelled rows. Rows that are held out, and labels other than 0 and 1, take no part. A sampled id counts once,
    however often it stands in either table: with its least label, and of several texts the least.
    """
    usable = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    totals = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if len(totals) < 2:
        return QualityModel(prior=float(next(iter(totals), 0.5)))
    prior = totals[1] / (totals[0] + totals[1])
    hashed = usable.withColumn("_h", F.xxhash64("doc_id", F.lit(17)))
    chosen = [hashed.filter(F.col("label") == y).orderBy("_h", "doc_id").limit(sample_rows) for y in (0, 1)]
    rows = sorted({(r["doc_id"], int(r["label"]), r["_h"] & 1) for c in chosen for r in c.collect()})  # bounded by sample_rows
    # A sampled id may fit one row only, so that repeated labels don't multiply its text.
    sample = docs.sparkSession.createDataFrame(list({r[0]: r for r in reversed(rows)}.values()), "doc_id long, label int, part long")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "label", "part").agg(F.min("text").alias("text"))  # an id names one text

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple[int, int, bytes]] = []
            for i, y, string in zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), texts_of(batch), strict=True):
                data = string.encode()
                out += [(i, y, data[s : s + BLOCK]) for s in range(0, len(data), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["doc_id", "label", "block"])

    found = sorted((r["doc_id"], i, r["label"], bytes(r["block"])) for i, r in enumerate(texts.filter("part = 0").mapInArrow(tidied(blocks), "doc_id long, label int, block binary").collect()))
    # The trainer looks at blocks epoch by epoch, and neighbours of one text or id range alone make poor dictionaries.
    random.Random(17).shuffle(found)
    by_class = {y: [b for _, _, k, b in found if k == y] for y in (0, 1)}
    if not by_class[0] or not by_class[1]:
        return QualityModel(prior=prior)
    good, bad = _dictionary(by_class[1]), _dictionary(by_class[0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(good, bad)
        for batch in slices(batches):
            data = [x.encode() for x in texts_of(batch)]
            x = [sizer(d) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), pa.array([len(d) for d in data], pa.int64())], names=["doc_id", "label", "difference", "share", "size"])

    measured = texts.filter("part = 1").mapInArrow(tidied(measure), "doc_id long, label int, difference double, share double, size long")
    pairs = sorted((r["doc_id"], r["label"], r["difference"], r["share"]) for r in measured.filter("size > 0").collect())
    y = np.array([p[1] for p in pairs], dtype=float)
    if not len(y) or y.min() == y.max():
        return QualityModel(prior=prior)
    x = np.array([p[2:] for p in pairs])
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    curve = logistic(x, y, weight)
    return QualityModel(good, bad, tuple(map(float, curve)), tuple(x.min(0).tolist()), tuple(x.max(0).tolist()), prior)


def score(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs' rows with score (0 to 1, higher: label 1 likelier) and predicted (1 from the threshold on) added.

    Columns of these names are replaced. Null and empty texts get the labelled rows' share of label 1. Whole texts
    are scored, whatever their length; repeated rows get equal scores; an empty table gives an empty result. The
    score depends on the text alone.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = model.sizer()
        for batch in slices(batches, text):
            data = [x.encode() for x in texts_of(batch, text)]
            x = np.array([sizer(d) for d in data] if model.curve else np.zeros((len(data), 2)))
            s = model.scores(x, np.array([not d for d in data]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    return rows.mapInArrow(tidied(run), schema)
