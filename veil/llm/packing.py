"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Every document becomes pieces of at most `capacity` tokens. How many pieces there are of each length is a
table of at most `capacity` rows, whatever the corpus size; the branch and bound runs on that table on the
driver and yields patterns with multiplicities. Pieces are then numbered within their length (by salted
counts, so no length meets in one task) and each finds its sequence and offset from its number.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, slices, texts_of, tidied

#: Bins that the branch and bound tries, and undominated fillings that it weighs for each.
BACKTRACKS = 5_000
FILLINGS = 50


class TokenIds:
    """Little-endian 32-bit ids of a text, as the tokenizers library gives them without added special tokens.

    A byte-level vocabulary whose ids are its merge ranks is run by the faster rank-based library; texts that
    hold a special token's string, and other vocabularies, go through the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.fast = _by_ranks(spec, set(self.special))

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special) and not _LONG_SPACE(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


#: Fixed value: the pre-token pattern of byte-level BPE.
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: The rank library's pattern backtracks over runs of white space, and gives up on very long ones.
_LONG_SPACE = re.compile(r"\s{1000}").search


def _by_ranks(spec: dict, special: set[str]):
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model["type"] != "BPE" or model.get("ignore_merges"):
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [a + b for a, b in merges]
    if [model["vocab"][x] for x in made] != list(range(256, 256 + len(made))):
        return None
    import tiktoken

    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("bytes", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(df: DataFrame, tokenizer_path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", separator: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TokenIds(tokenizer_path)
        end = np.array([separator], dtype="<u4")
        for batch in slices(batches, text):
            docs, number, starts, lengths, sums, ids = [], [], [], [], [], []
            for doc, string in zip(batch.column(doc_id).to_pylist(), texts_of(batch, text), strict=True):
                tokens = np.concatenate([encode(string), end])
                first = len(tokens) % capacity or capacity
                bounds = [0, *range(first, len(tokens) + 1, capacity)]
                raw = memoryview(tokens.tobytes())
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    part = raw[4 * a : 4 * b]
                    docs.append(doc), number.append(i), starts.append(a), lengths.append(b - a), sums.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(bytes(part))
            columns = [pa.array(docs, pa.int64()), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    doc_id, text = "doc_id", "text"
    return rows.mapInArrow(tidied(run), PIECES + (", ids binary" if with_ids else ""))


Pattern = tuple[list[tuple[int, int]], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing takes: pieces over capacity - k stand alone, and what is at least k long must find
    room beside the halves; the best bound over all k."""
    number, tokens = np.zeros(capacity + 2, dtype=np.int64), np.zeros(capacity + 2, dtype=np.int64)
    for size, n in counts.items():
        number[size], tokens[size] = n, size * n
    number, tokens = np.cumsum(number), np.cumsum(tokens)  # of pieces up to each size
    half = capacity // 2
    best = 0
    for k in range(half + 1):
        alone = number[capacity] - number[capacity - k]
        large, large_tokens = number[capacity - k] - number[half], tokens[capacity - k] - tokens[half]
        small = tokens[half] - (tokens[k - 1] if k else 0)
        best = max(best, int(alone + large + max(0, -(-(small - (large * capacity - large_tokens)) // capacity))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the table: each piece, the largest first, goes to the fullest sequence with room for it."""
    bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}  # by room left
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in bins if r >= size), default=capacity)
            uses, times = bins[room].pop() if room in bins else ([], -(-n // (capacity // size)))
            if room in bins and not bins[room]:
                del bins[room]
            copies = room // size
            full = min(times, n // copies)
            rest = n - full * copies if full < times else 0
            parts = [(copies, full), (rest, 1 if rest else 0), (0, times - full - (1 if rest else 0))]
            for c, t in parts:
                if t:
                    bins.setdefault(room - c * size, []).append(([*uses, (size, c)] if c else uses, t))
            n -= full * copies + rest
    return [(uses, times) for group in bins.values() for uses, times in group if uses]


def plan_patterns(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns [(size, copies), ...] with multiplicities that use every piece once, in few sequences.

    Best-fit decreasing gives the incumbent. The branch and bound looks for a packing of one sequence less until none
    is left, the lower bound is met, or BACKTRACKS bins have been tried; then the incumbent stands.
    """
    least, total = lower_bound(counts, capacity), sum(s * n for s, n in counts.items())
    best = best_fit(counts, capacity)
    bins, left = sum(m for _, m in best), BACKTRACKS
    while bins > least and left > 0:
        found, left = _search(counts, capacity, (bins - 1) * capacity - total, left)
        if found is None:
            break
        best, bins = found, sum(m for _, m in found)
    return best


def _fillings(free: np.ndarray, below: np.ndarray, rem: int, perfect: bool) -> list[list[tuple[int, int]]]:
    """Undominated fillings of rem, least waste first: no used piece, nor none, has a free larger one that fits in its
    place. perfect: only the first one met that leaves no waste, if any."""
    found: list[tuple[int, list[tuple[int, int]]]] = []
    budget = 20 * FILLINGS

    def larger(size: int, left: int, used: dict[int, int]) -> bool:
        other = int(below[min(size + left, len(below) - 1)])
        while other > size:
            if free[other] > used.get(other, 0):
                return True
            other = int(below[other - 1])
        return False

    def walk(rem: int, cap: int, chosen: list[tuple[int, int]]) -> bool:
        nonlocal budget
        budget -= 1
        used = dict(chosen)
        if not rem or not perfect and not any(larger(size, rem, used) for size in (0, *used)):
            found.append((rem, chosen[:]))
            if perfect:
                return True
        size = int(below[min(rem, cap)])
        while size and budget > 0 and len(found) < FILLINGS:
            for copies in range(min(int(free[size]), rem // size), 0, -1):
                chosen.append((size, copies))
                if walk(rem - size * copies, size - 1, chosen):
                    return True
                chosen.pop()
            size = int(below[size - 1])
        return False

    walk(rem, rem, [])
    return [filling for _, filling in sorted(found, key=lambda f: f[0])]


def _search(counts: dict[int, int], capacity: int, allowed: int, nodes: int):
    """Patterns with at most the allowed waste, by branch and bound over undominated fillings, and the nodes left.

    Each bin is begun with the largest free piece, since that must go somewhere. A branch ends where its waste passes
    what a better packing may waste. None if the nodes end before, or none is met.
    """
    free = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        free[size] = n
    sizes = np.arange(capacity + 1)

    def choices(free: np.ndarray, waste: int):
        """The next bin's fillings with the largest free piece, as often as they fit and then less often."""
        below = np.maximum.accumulate(np.where(free > 0, sizes, 0))
        top = int(below[capacity])
        rest = free.copy()
        rest[top] -= 1
        own = np.maximum.accumulate(np.where(rest > 0, sizes, 0))
        tried: list[list[tuple[int, int]]] = []
        for perfect in (True, False):
            for filling in _fillings(rest, own, capacity - top, perfect):
                if filling in tried:
                    continue
                tried.append(filling)
                uses = {top: 1}
                for size, copies in filling:
                    uses[size] = uses.get(size, 0) + copies
                lost = capacity - sum(s * c for s, c in uses.items())
                times = min(int(free[s]) // c for s, c in uses.items())
                if lost:
                    times = min(times, (allowed - waste) // lost)
                while times:
                    after = free.copy()
                    for s, c in uses.items():
                        after[s] -= c * times
                    yield after, waste + times * lost, (sorted(uses.items(), reverse=True), times)
                    times //= 2

    if not free.any():
        return [], nodes
    stack, patterns = [choices(free, 0)], []
    while stack and nodes > 0:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if patterns:
                patterns.pop()
            continue
        nodes -= 1
        after, waste, pattern = step
        patterns.append(pattern)
        if not after.any():
            return patterns, nodes
        stack.append(choices(after, waste))
    return None, nodes


def pack(df: DataFrame, tokenizer_path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", separator: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset added.

    Null or empty text: one piece that holds the separator alone. Repeated rows are packed each. Documents
    longer than the capacity are cut into whole pieces, of which the first may be shorter; no others are cut.
    An empty table gives an empty result. Other columns are not carried.
    """
    spark = df.sparkSession
    pieces = materialise(cut(df, tokenizer_path, capacity, doc_id, text, separator, with_ids), "pieces")
    salts = max(8, partitions(spark))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    shares = salted.groupBy("length", "_salt").count()
    before = shares.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).drop("count")
    counts = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    patterns = plan_patterns(counts, capacity)

    # By size: the first number that a pattern takes, copies a sequence, the pattern's first sequence, offset.
    taken: dict[int, int] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    base = 0
    for uses, times in patterns:
        at = 0
        for size, copies in uses:
            rows.append((size, taken.get(size, 0), copies, base, at))
            taken[size] = taken.get(size, 0) + copies * times
            at += size * copies
        base += times
    lookup = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    firsts = np.searchsorted(lookup[:, 0], np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                part = lookup[firsts[size] : firsts[size + 1]]
                at = part[np.searchsorted(part[:, 1], rank[own], side="right") - 1]
                local = rank[own] - at[:, 1]
                sequence[own] = at[:, 3] + local // at[:, 2]
                offset[own] = at[:, 4] + local % at[:, 2] * size
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_n", number).join(before, ["length", "_salt"]).withColumn("_rank", (F.col("_before") + F.col("_n")).cast("long"))
    columns = pieces.columns
    return ranked.select(*columns, "_rank").mapInArrow(tidied(place), PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long")
