"""Words of many documents at once: positions and 64-bit hashes, by numpy over the Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20_240_229)
#: A random number for each byte; words are polynomials of them modulo 2**64.
BYTES = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
BASE = int(_RNG.integers(2**62, 2**63, dtype=np.uint64)) | 1
INVERSE = pow(BASE, -1, 2**64)
ROLL = int(_RNG.integers(2**62, 2**63, dtype=np.uint64)) | 1
ROLL_INVERSE = pow(ROLL, -1, 2**64)

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_POWERS: dict[int, np.ndarray] = {}
#: Powers that a worker keeps of a base; longer runs of them are made anew.
KEPT_POWERS = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(1024, 1 << max(n - 1, 0).bit_length()), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have, dtype=np.uint64)
        if len(have) <= KEPT_POWERS:
            _POWERS[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total, dtype=np.int64)


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings' bytes, where the words `[^\\x20\\x09-\\x0D]+` begin and end in them, and each string's first word.

    The last array has one entry more than there are strings. Null counts as empty.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    start, end = spans(data, offsets)
    return data, start, end, np.searchsorted(start, offsets)


def spans(data: np.ndarray, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; no word goes over an offset."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    if offsets is not None:
        edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end]."""
    if not len(start):
        return np.empty(0, np.uint64)
    terms = BYTES[data]
    terms *= powers(BASE, len(data))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    return mixed((sums[end] - sums[start]) * powers(INVERSE, len(data))[start] + (end - start).astype(np.uint64))


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all strings in order, and each string's first word. lower: A-Z as a-z."""
    data, start, end, bounds = word_spans(column)
    return span_hashes(_LOWER[data] if lower else data, start, end), bounds


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each data[start:end], equal exactly for equal bytes, and the bytes that the numbers stand for.

    start and end are in order, and what they bound doesn't overlap.
    """
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[start] += 1
    inside[end] -= 1
    dense = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.append(0, np.cumsum(end - start)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(dense)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` consecutive words; entry i is the run that starts at word i."""
    if len(words) < size:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    factor = 1
    for i in range(size):
        out += words[i : i + len(out)] * np.uint64(factor)
        factor = factor * ROLL % 2**64
    return mixed(out)
