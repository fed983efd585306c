"""Reproducible random columns: one step of the minimal standard generator from a row's own key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the minimal standard generator.
MULTIPLIER, MODULUS = 48271, 2147483647


def minstd(key: Column) -> Column:
    """The generator's next state from key + 1."""
    return ((key + 1) * MULTIPLIER) % MODULUS


def digits(tag: Column, ways: list[int]) -> list[Column]:
    """Mixed-radix digits of a tag, the first way's first: the bucket a row takes in each routing layer."""
    out, scale = [], 1
    for way in ways:
        out.append((tag if scale == 1 else F.call_function("div", tag, F.lit(scale))) % way)
        scale *= way
    return out
