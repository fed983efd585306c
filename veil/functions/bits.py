"""Bit and index expressions: lengths, reversals, reverse-lexicographic leaf order, tree indices, unsigned order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_length(x: Column) -> Column:
    """Bits of a non-negative number; 0 for 0. Exact, unlike a logarithm."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def ceil_log2(x: Column) -> Column:
    """The least n with 2**n >= x, for x >= 1."""
    return bit_length(x - 1)


def next_power_of_two(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), ceil_log2(x).cast("int"))


def reversed_bits(x: Column, bits: int) -> Column:
    """The low `bits` bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(x.bitwiseAND(F.lit((1 << bits) - 1))), bits, "0")), 2, 10).cast("long")


def reverse_lexicographic(x: Column, bits: int) -> Column:
    """The leaf that eviction x visits: complemented reversed low bits."""
    return F.lit((1 << bits) - 1).cast("long") - reversed_bits(x, bits)


def heap_index(position: Column, depth: Column, levels: int) -> Column:
    """Array index of the node at a depth on the path to a leaf position."""
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, depth.cast("int")) - 1 + F.call_function("shiftright", position, (levels - depth).cast("int"))


def place_of(index: Column, levels: int) -> tuple[Column, Column]:
    """Depth of a heap index, and the least leaf position below the node."""
    depth = bit_length(index + 1) - 1
    return depth, F.call_function("shiftleft", index - F.call_function("shiftleft", F.lit(1).cast("long"), depth) + 1, levels - depth)


def pack_index(position: Column, depth: Column, levels: int, per_pack: int) -> tuple[Column, Column]:
    """Where packs of `per_pack` levels hold the node at a depth on a path: the pack's number, and the place in it.

    Packs are complete subtrees, numbered in level order from the root's; places too, from the pack's root.
    """
    within = depth % per_pack
    root = depth - within
    one = F.lit(1).cast("long")
    above = F.call_function("div", F.call_function("shiftleft", one, root.cast("int")) - 1, F.lit(2**per_pack - 1).cast("long"))
    pack = above + F.call_function("shiftright", position, (levels - root).cast("int"))
    below = F.call_function("shiftright", position, (levels - depth).cast("int")).bitwiseAND(F.call_function("shiftleft", one, within.cast("int")) - 1)
    return pack, F.call_function("shiftleft", one, within.cast("int")) - 1 + below


def paths_meet(first: Column, second: Column, depth: Column, levels: int) -> Column:
    """Whether the paths to two leaf positions go through one node at a depth; false for a null position (a dummy)."""
    return F.coalesce(heap_index(first, depth, levels) == heap_index(second, depth, levels), F.lit(False))


def shallowness(position: Column, path: Column) -> Column:
    """Levels above the leaf where two paths first meet: the bit length of their difference."""
    return bit_length(position.bitwiseXOR(path))


def unsigned_key(x: Column) -> Column:
    """A key that orders a long as an unsigned 64-bit number."""
    return x.bitwiseXOR(F.lit(-(2**63)))


def large_mod(digits: Column, modulus: int) -> Column:
    """A decimal string of any length modulo a number, by Horner's rule."""
    return F.aggregate(F.split(digits, ""), F.lit(0).cast("long"), lambda acc, d: F.when(d == "", acc).otherwise((acc * 10 + d.cast("long")) % modulus))


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1).cast("long"), lambda acc, x: acc * x)


def divide_round_up(a: Column, b: int) -> Column:
    """The quotient of non-negative integers, rounded up."""
    return F.call_function("div", a + (b - 1), F.lit(b))


def tree_levels(capacity: int) -> int:
    """Levels below the root of a tree with at least capacity leaves."""
    return max(0, math.ceil(math.log2(capacity))) if capacity > 1 else 0
