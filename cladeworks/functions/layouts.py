"""Coordinates of trees and circular splits, as plain geometry."""

from __future__ import annotations

import math

from cladeworks.functions.networks import Edge, children, root_of, topological


def rectangular(edges: list[Edge], by_weight: bool = True) -> dict[int, tuple[float, float]]:
    """x: distance from the root (or, without weights, height above the deepest leaf); y: leaves in order, inner nodes between their children."""
    down, order, root = children(edges), topological(edges), root_of(edges)
    weight = {(p, c): w for p, c, w in edges}
    x, y, n = {root: 0.0}, {}, 0
    if by_weight:
        for v in order:
            for c in down[v]:
                x[c] = x[v] + weight[v, c]
    else:
        for v in reversed(order):
            x[v] = min((x[c] for c in down[v]), default=0.0) - (1 if down[v] else 0)
    stack = [root]
    while stack:
        v = stack.pop()
        if not down[v]:
            y[v], n = float(n), n + 1
        stack += reversed(down[v])
    for v in reversed(order):
        if down[v]:
            y[v] = (y[down[v][0]] + y[down[v][-1]]) / 2
    return {v: (x[v], y[v]) for v in order}


def circular(edges: list[Edge], by_weight: bool = True) -> dict[int, tuple[float, float]]:
    """The rectangular layout bent round: angle from y, radius from x."""
    xy = rectangular(edges, by_weight)
    leaves = sum(not c for c in children(edges).values())
    low = min(x for x, _ in xy.values())
    return {v: ((x - low) * math.cos(2 * math.pi * y / leaves), (x - low) * math.sin(2 * math.pi * y / leaves)) for v, (x, y) in xy.items()}


def radial(edges: list[Edge]) -> dict[int, tuple[float, float]]:
    """Unrooted drawing: each subtree gets a wedge in proportion to its leaves, an edge runs along the middle of its wedge."""
    down, order, root = children(edges), topological(edges), root_of(edges)
    weight = {(p, c): w for p, c, w in edges}
    size: dict[int, int] = {}
    for v in reversed(order):
        size[v] = sum(size[c] for c in down[v]) or 1
    at, wedge = {root: (0.0, 0.0)}, {root: 0.0}
    for v in order:
        a = wedge[v]
        for c in down[v]:
            span = 2 * math.pi * size[c] / size[root]
            mid = a + span / 2
            at[c] = (at[v][0] + weight[v, c] * math.cos(mid), at[v][1] + weight[v, c] * math.sin(mid))
            wedge[c] = a
            a += span
    return at


def equal_angle(cycle: list[int], splits: list[tuple[int, float]]) -> dict[int, tuple[float, float]]:
    """Points of the taxa for circular splits (mask without taxon 1, weight): a split moves its side along the middle angle of its interval."""
    n = len(cycle)
    at = {t: i for i, t in enumerate(cycle)}
    out = {t: [0.0, 0.0] for t in cycle}
    for mask, w in splits:
        side = [t for t in cycle if mask >> (t - 1) & 1]
        i = [at[t] for t in side]
        a = math.pi * (min(i) + max(i) + 1) / n
        for t in side:
            out[t][0] += w * math.cos(a)
            out[t][1] += w * math.sin(a)
    return {t: (x, y) for t, (x, y) in out.items()}


def outline(spans: list[tuple[int, int, float]], n: int) -> list[tuple[float, float, int | None]]:
    """Corners (x, y, place or None) of the outline of splits given as intervals of places 0..n-1 (never place 0) with weights."""
    x = y = 0.0
    out: list[tuple[float, float, int | None]] = []
    for i in range(n):
        closing = sorted((s for s in spans if s[1] == i - 1), key=lambda s: (-s[0], s[2]))
        opening = sorted((s for s in spans if s[0] == i), key=lambda s: (-s[1], s[2]))
        for (lo, hi, w), sign in [(s, -1) for s in closing] + [(s, 1) for s in opening]:
            a = math.pi * (lo + hi + 1) / n
            x, y = x + sign * w * math.cos(a), y + sign * w * math.sin(a)
            out.append((x, y, None))
        if out and out[-1][2] is None:
            out[-1] = (x, y, i)
        else:
            out.append((x, y, i))
    for lo, hi, w in sorted((s for s in spans if s[1] == n - 1), key=lambda s: -s[0]):
        a = math.pi * (lo + hi + 1) / n
        x, y = x - w * math.cos(a), y - w * math.sin(a)
        out.append((x, y, None))
    return out


def triangular(edges) -> dict[int, tuple[float, float]]:
    """Leaves at x = 0, one apart; an inner node above the middle of its leaves, to the left by half their span, so edges are straight and slanted."""
    down: dict[int, list[int]] = {}
    for p, c, *_ in edges:
        down.setdefault(p, []).append(c)
    top = next(iter(set(down) - {c for _, c, *_ in edges}))
    span: dict[int, tuple[float, float]] = {}
    order, stack, leaves = [], [top], 0
    while stack:
        v = stack.pop()
        order.append(v)
        stack += reversed(down.get(v, []))
    for v in order:
        if v not in down:
            span[v] = (leaves, leaves)
            leaves += 1
    for v in reversed(order):
        if v in down:
            span[v] = (min(span[c][0] for c in down[v]), max(span[c][1] for c in down[v]))
    return {v: (-(b - a) / 2, (a + b) / 2) for v, (a, b) in span.items()}
