"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python tasks work on slices of at most so much text and so many rows, so a worker's memory doesn't follow the batch size.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 8192
#: Rows and bytes of an Arrow batch where the session names no number: whole texts and packed blobs in large batches fill
#: workers and the buffers of executors, which keep them.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

#: Partitions of a shuffle to a file of a small table.
FEWER = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut so that each slice has one row or at most max_bytes in the column, and SLICE_ROWS."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + SLICE_ROWS, max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def tidy() -> None:
    """Give freed memory back to the system: idle Python workers stay alive beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map over batches, with the worker's memory tidied when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a session that is a single process.

    Raises ValueError where the session names none and executors run elsewhere, since they couldn't read it.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    ours = spark.sparkContext.getCheckpointDir()
    if ours:
        return ours.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile  # one process: its own folder is shared by all that runs

    return "file://" + tempfile.gettempdir() + "/veil-checkpoints"


def bounded_batches(spark: SparkSession) -> None:
    """Give the session BATCHES, once, unless it has set them; results don't depend on them."""
    for name, value in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def materialise(df: DataFrame, what: str = "step", few: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage is cut, and lost executors cost nothing.

    few: one more shuffle gathers the rows in a FEWER-th of the shuffle's partitions first, for tables far smaller than
    what they are made of. Without Hadoop's native library a local folder costs a process for each file and each checksum.
    """
    spark = df.sparkSession
    if few:
        df = df.repartition(max(1, partitions(spark) // FEWER))
    path = f"{shared_dir(spark)}/veil-{what}-{uuid.uuid4().hex}"
    bounded_batches(spark)
    df.write.parquet(path)
    _written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


_PATHS: dict[str, list[str]] = {}


def _written(spark: SparkSession) -> list[str]:
    return _PATHS.setdefault(spark.sparkContext.applicationId, [])


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _written(spark).remove(path)


def _read_by(spark: SparkSession, frame: DataFrame) -> set[str]:
    """The written tables that a frame reads."""
    names = {part for f in frame.inputFiles() for part in f.split("/") if part.startswith("veil-")}
    return {path for path in _written(spark) if path.rsplit("/", 1)[-1] in names}


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what materialise() wrote for these frames; call it only when no later plan reads them."""
    _delete(spark, set().union(*(_read_by(spark, frame) for frame in frames)))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that materialise() writes within it are deleted at its end, but for those that a kept frame reads.

    It gives the function that marks a frame as kept, and returns it.
    """
    before, kept = set(_written(spark)), set()

    def keep(frame: DataFrame) -> DataFrame:
        kept.update(_read_by(spark, frame))
        return frame

    try:
        yield keep
    finally:
        _delete(spark, [path for path in _written(spark) if path not in before and path not in kept])


def clean(spark: SparkSession) -> None:
    """Delete all that materialise() wrote in this session; frames returned so far can't be read any more."""
    _delete(spark, list(_written(spark)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only when the counted rows prove it small; beyond that the planner shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit_bytes else df
