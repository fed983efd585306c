"""Euler walks of small multigraphs, by Hierholzer's method (driver-side; at most a few vertices)."""

from __future__ import annotations

from collections.abc import Iterable


def euler_walk(edges: Iterable[tuple[int, int]], start: int) -> list[int] | None:
    """Vertices of a walk from start that takes every undirected edge once; None if there is none."""
    ends: dict[int, list[tuple[int, int]]] = {}
    edges = list(edges)
    for i, (a, b) in enumerate(edges):
        ends.setdefault(a, []).append((b, i))
        ends.setdefault(b, []).append((a, i))
    used = [False] * len(edges)
    stack, walk = [start], []
    while stack:
        here = ends.get(stack[-1], [])
        while here and used[here[-1][1]]:
            here.pop()
        if here:
            to, i = here.pop()
            used[i] = True
            stack.append(to)
        else:
            walk.append(stack.pop())
    return walk[::-1] if len(walk) == len(edges) + 1 and _is_walk(walk, edges) else None


def _is_walk(walk: list[int], edges: list[tuple[int, int]]) -> bool:
    steps = sorted(tuple(sorted(p)) for p in zip(walk, walk[1:], strict=False))
    return steps == sorted(tuple(sorted(e)) for e in edges)
