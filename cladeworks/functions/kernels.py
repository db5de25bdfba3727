"""Sequential algorithms on small aggregated inputs, in plain NumPy. A kernel gets one group (matrix, split system, tree)."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np

# ---------------------------------------------------------------- splits


def _order(masks, weights):
    return sorted(range(len(masks)), key=lambda i: (-weights[i], -masks[i].bit_count(), masks[i]))


def compatible(a: int, b: int) -> bool:
    c = a & b
    return c == 0 or c == a or c == b


def weakly_compatible(a: int, b: int, c: int, full: int) -> bool:
    na, nb, nc = full ^ a, full ^ b, full ^ c
    return not ((a & b & c and a & nb & nc and na & b & nc and na & nb & c) or (na & nb & nc and na & b & c and a & nb & c and a & b & nc))


def greedy_compatible(masks, weights, ntax):
    kept: list[int] = []
    for i in _order(masks, weights):
        if all(compatible(masks[i], k) for k in kept):
            kept.append(masks[i])
    return kept


def greedy_weakly_compatible(masks, weights, ntax):
    full, kept = (1 << ntax) - 1, []
    for i in _order(masks, weights):
        if all(weakly_compatible(masks[i], a, b, full) for a, b in combinations(kept, 2)):
            kept.append(masks[i])
    return kept


def _or(masks):
    out = 0
    for m in masks:
        out |= m
    return out


# PQ-tree as nested tuples (kind, mask, children): "P" children in any order, "Q" in the given order or its reverse


def _node(kind: str, parts: list):
    return parts[0] if len(parts) == 1 else ("P" if len(parts) == 2 else kind, _or(x[1] for x in parts), tuple(parts))


def _linear(node, s: int) -> list | None:
    """Parts of the node from those outside the set to those inside, or None."""
    kind, m, parts = node
    if not m & s or not m & ~s:
        return [node]
    out, partial = [x for x in parts if not x[1] & s], [x for x in parts if x[1] & s and x[1] & ~s]
    if len(partial) > 1:
        return None
    if kind == "P":
        full = [x for x in parts if not x[1] & ~s]
        mid = _linear(partial[0], s) if partial else []
        return None if mid is None else ([_node("P", out)] if out else []) + mid + ([_node("P", full)] if full else [])
    if parts[0][1] & s and (parts[-1][1] & ~s or not parts[0][1] & ~s):
        parts = parts[::-1]
    rank = [0 if not x[1] & s else 1 if x[1] & ~s else 2 for x in parts]
    if rank != sorted(rank):
        return None
    flat = []
    for x in parts:
        if (mid := _linear(x, s)) is None:
            return None
        flat += mid
    return flat


def _reduce(node, s: int):
    """The PQ-tree of the orders in which also the set ``s`` is an interval, or None."""
    kind, m, parts = node
    if not m & s or not m & ~s:
        return node
    hit = [i for i, x in enumerate(parts) if x[1] & s]
    if len(hit) == 1 and parts[hit[0]][1] & ~s:
        inner = _reduce(parts[hit[0]], s)
        return None if inner is None else (kind, m, (*parts[: hit[0]], inner, *parts[hit[0] + 1 :]))
    partial = [i for i in hit if parts[i][1] & ~s]
    if kind == "P":
        if len(partial) > 2:
            return None
        ends = [_linear(parts[i], s) for i in partial]
        if None in ends:
            return None
        full = [parts[i] for i in hit if i not in partial]
        row = (ends[0] if ends else []) + ([_node("P", full)] if full else []) + (ends[1][::-1] if len(ends) > 1 else [])
        return _node("P", [x for x in parts if not x[1] & s] + [_node("Q", row)])
    if hit != list(range(hit[0], hit[-1] + 1)) or any(hit[0] < i < hit[-1] for i in partial):
        return None
    row = []
    for i, x in enumerate(parts):
        mid = _linear(x, s) if i in partial else [x]
        if mid is None:
            return None
        row += mid[::-1] if i == hit[-1] else mid
    return _node("Q", row)


def _free(ntax: int):
    return _node("P", [("P", 1 << t, ()) for t in range(1, ntax)])


def _frontier(node) -> list[int]:
    return [node[1].bit_length()] if not node[2] else [t for x in node[2] for t in _frontier(x)]


def circular_order(masks, ntax: int) -> list[int] | None:
    """A cycle of taxa 1..ntax in which every split (side without taxon 1) is an interval, or None."""
    if ntax < 3:
        return list(range(1, ntax + 1))
    tree = _free(ntax)
    for m in sorted(set(masks), key=lambda m: (-m.bit_count(), m)):
        if (tree := _reduce(tree, m)) is None:
            return None
    return [1, *_frontier(tree)]


def greedy_circular(masks, weights, ntax):
    """By a PQ-tree of the taxa but the first, into which each kept split is reduced; exact."""
    if ntax < 3:
        return list(masks)
    kept: list[int] = []
    tree = _free(ntax)
    for i in _order(masks, weights):
        if (t := _reduce(tree, masks[i])) is not None:
            tree = t
            kept.append(masks[i])
    return kept


def _conflicts(masks) -> list[set[int]]:
    n = len(masks)
    adj: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if not compatible(masks[i], masks[j]):
                adj[i].add(j)
                adj[j].add(i)
    return adj


def dimension_filter(masks, weights, ntax, most: int = 4):
    """Drops the worst split (lightest by weight times compatible share) of each clique of more than ``most`` until none is left."""
    adj = _conflicts(masks)
    alive = set(range(len(masks)))

    def clique(chosen, pool):
        """Some clique of ``most + 1`` that extends the chosen ones into the pool, or None; every possibility is tried."""
        if len(chosen) > most:
            return chosen
        if len(chosen) + len(pool) <= most:
            return None
        for v in sorted(pool, key=lambda x: (-len(adj[x] & pool), x)):
            if found := clique([*chosen, v], pool & adj[v]):
                return found
            pool = pool - {v}
            if len(chosen) + len(pool) <= most:
                return None
        return None

    # removing nodes never makes a clique, so each node is settled once
    for v in sorted(alive, key=lambda x: (-len(adj[x]), x)):
        while v in alive and (c := clique([v], adj[v] & alive)):
            alive.discard(min(c, key=lambda x: (weights[x] / (1 + len(adj[x] & alive)), masks[x])))
    return [masks[i] for i in sorted(alive)]


def clique_compatible(masks, weights, ntax):
    """Pairwise compatible splits of the largest total weight (then those first by weight and mask), by branch and bound.

    The bound of a branch is a partition of the open splits into mutually incompatible ones, of which one can be taken each.
    """
    order = [i for i in _order(masks, weights) if weights[i] > 0]
    adj = _conflicts(masks)
    best: tuple[float, list[int]] = (0.0, [])

    def bound(pool):
        total, classes = 0.0, []
        for v in pool:
            for c in classes:
                if all(u in adj[v] for u in c):
                    c.append(v)
                    break
            else:
                classes.append([v])
                total += weights[v]
        return total

    stack = [(0.0, [], order)]
    while stack:
        got, chosen, pool = stack.pop()
        free = [v for v in pool if not adj[v].intersection(pool)]
        got, chosen, pool = got + sum(weights[v] for v in free), chosen + free, [v for v in pool if v not in set(free)]
        if not pool:
            if got > best[0] + 1e-12:
                best = (got, chosen)
            continue
        if got + bound(pool) <= best[0] + 1e-12:
            continue
        v = pool[0]
        stack.append((got, chosen, pool[1:]))
        stack.append((got + weights[v], [*chosen, v], [u for u in pool[1:] if u not in adj[v]]))
    return [masks[i] for i in sorted(best[1])]


def clique_circular(masks, weights, ntax, cycle):
    """Compatible splits of the largest total weight among those that are intervals of the cycle: a dynamic program over intervals."""
    n, at = ntax, {t: i for i, t in enumerate(cycle)}
    own: dict[tuple[int, int], list[int]] = {}
    full = (1 << n) - 1
    for i, m in enumerate(masks):
        side = full ^ m if m >> (cycle[0] - 1) & 1 else m
        p = sorted(at[t + 1] for t in range(n) if side >> t & 1)
        if p and p[-1] - p[0] + 1 == len(p) and weights[i] > 0:
            own.setdefault((p[0], p[-1]), []).append(i)
    w = np.zeros((n, n))
    for (a, b), found in own.items():
        w[a, b] = sum(weights[i] for i in found)
    best, cut = np.zeros((n + 1, n + 1)), np.zeros((n + 1, n + 1), int)
    for size in range(1, n):
        for a in range(1, n - size + 1):
            b = a + size - 1
            if size > 1:
                k = np.arange(a, b)
                v = best[a, a:b] + best[k + 1, b]
                j = int(np.argmax(v))
                best[a, b], cut[a, b] = v[j], a + j
            best[a, b] += w[a, b]
    out, stack = [], [(1, n - 1)] if n > 1 else []
    while stack:
        a, b = stack.pop()
        out += own.get((a, b), [])
        if a < b:
            stack += [(a, cut[a, b]), (cut[a, b] + 1, b)]
    return [masks[i] for i in sorted(out)]


def splits_cycle(masks, ntax: int) -> list[int]:
    """A cycle for splits: exact if there is one in which all are intervals, else the ordering of the numbers of separating splits."""
    if (c := circular_order(masks, ntax)) is not None:
        return c
    on = np.array([[m >> t & 1 for t in range(ntax)] for m in masks], float).reshape(len(masks), ntax)
    d = on.T @ (1 - on)
    c = neighbor_net_cycle(d + d.T)
    k = c.index(0)
    return [t + 1 for t in c[k:] + c[:k]]


# ---------------------------------------------------------------- trees from distances: (parent, child, length), leaves 0..n-1


def upgma(d: np.ndarray) -> list[tuple[int, int, float]]:
    n = len(d)
    m = d.astype(float).copy()
    np.fill_diagonal(m, np.inf)
    ids, sizes, height, edges = list(range(n)), [1] * n, [0.0] * n, []
    nxt = n
    while len(ids) > 1:
        k = len(ids)
        i, j = divmod(int(np.argmin(m)), k)
        i, j = min(i, j), max(i, j)
        h = m[i, j] / 2
        edges += [(nxt, ids[i], h - height[i]), (nxt, ids[j], h - height[j])]
        row = (m[i] * sizes[i] + m[j] * sizes[j]) / (sizes[i] + sizes[j])
        m[i], m[:, i] = row, row
        m[i, i] = np.inf
        ids[i], sizes[i], height[i] = nxt, sizes[i] + sizes[j], h
        m = np.delete(np.delete(m, j, 0), j, 1)
        del ids[j], sizes[j], height[j]
        nxt += 1
    return edges


def neighbor_joining(d: np.ndarray, bio: bool = False) -> list[tuple[int, int, float]]:
    """Neighbor joining, or with ``bio`` its variant that weights the reduction by variances (taken equal to distances)."""
    n = len(d)
    m, v = d.astype(float).copy(), d.astype(float).copy()
    ids, edges, nxt = list(range(n)), [], n
    while len(ids) > 2:
        k = len(ids)
        r = m.sum(1)
        q = (k - 2) * m - r[:, None] - r[None, :]
        q[np.tril_indices(k)] = np.inf
        i, j = divmod(int(np.argmin(q)), k)
        li = m[i, j] / 2 + (r[i] - r[j]) / (2 * (k - 2))
        lj = m[i, j] - li
        edges += [(nxt, ids[i], li), (nxt, ids[j], lj)]
        lam = 0.5
        if bio and v[i, j] > 0:
            rest = [x for x in range(k) if x not in (i, j)]
            lam = min(1.0, max(0.0, 0.5 + (v[j, rest] - v[i, rest]).sum() / (2 * (k - 2) * v[i, j])))
        row = lam * (m[i] - li) + (1 - lam) * (m[j] - lj) if bio else (m[i] + m[j] - m[i, j]) / 2
        var = lam * v[i] + (1 - lam) * v[j] - lam * (1 - lam) * v[i, j]
        for x, new in ((m, row), (v, var)):
            x[i], x[:, i] = new, new
            x[i, i] = 0
        m, v = (np.delete(np.delete(x, j, 0), j, 1) for x in (m, v))
        ids[i] = nxt
        del ids[j]
        nxt += 1
    if len(ids) == 2:
        edges.append((ids[1], ids[0], float(m[0, 1])) if ids[1] >= n else (ids[0], ids[1], float(m[0, 1])))
    return edges


def midpoint_root(edges: list[tuple[int, int, float]], leaves: list[int]) -> list[tuple[int, int, float]]:
    """The tree rooted in the middle of its longest path between leaves."""
    nb: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in edges:
        nb.setdefault(a, []).append((b, w))
        nb.setdefault(b, []).append((a, w))

    def far(s):
        dist, prev, stack = {s: 0.0}, {}, [s]
        while stack:
            x = stack.pop()
            for y, w in nb.get(x, []):
                if y not in dist:
                    dist[y], prev[y] = dist[x] + w, x
                    stack.append(y)
        return dist, prev

    d0, _ = far(leaves[0])
    a = max(leaves, key=lambda x: (d0[x], -x))
    da, prev = far(a)
    b = max(leaves, key=lambda x: (da[x], -x))
    half, x = da[b] / 2, b
    while x != a and da[prev[x]] >= half:
        x = prev[x]
    root = max(nb) + 1
    out = []
    if x == a or abs(da[x] - half) < 1e-15:
        root = x
    else:
        p = prev[x]
        w = da[x] - da[p]
        nb[x] = [(root, da[x] - half) if y == p else (y, z) for y, z in nb[x]]
        nb[p] = [(root, w - (da[x] - half)) if y == x else (y, z) for y, z in nb[p]]
        nb[root] = [(x, da[x] - half), (p, w - (da[x] - half))]
    stack, seen = [root], {root}
    while stack:
        x = stack.pop()
        for y, w in nb[x]:
            if y not in seen:
                seen.add(y)
                out.append((x, y, w))
                stack.append(y)
    return out


def min_spanning_tree(d: np.ndarray) -> list[tuple[int, int, float]]:
    n = len(d)
    inside, best, link, edges = {0}, d[0].copy(), [0] * n, []
    while len(inside) < n:
        j = min((x for x in range(n) if x not in inside), key=lambda x: (best[x], x))
        edges.append((link[j], j, float(d[link[j], j])))
        inside.add(j)
        for x in range(n):
            if d[j, x] < best[x]:
                best[x], link[x] = d[j, x], j
    return edges


def min_spanning_network(d: np.ndarray, epsilon: float = 0.0) -> list[tuple[int, int, float]]:
    """All pairs at each distinct distance, ascending, until epsilon beyond the value that connects everything."""
    n = len(d)
    top = max((w for _, _, w in min_spanning_tree(d)), default=0.0)
    return [(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n) if d[i, j] <= top + epsilon]


# ---------------------------------------------------------------- circular splits


def neighbor_net_cycle(d: np.ndarray) -> list[int]:
    """Circular order by agglomeration of components of one or two nodes (0-based), in O(n^3) with vectorised steps.

    A component is its two end nodes (the same one twice while it is single). Distances of end nodes are kept in ``m``, means
    between components in ``a``; a step picks the components, then the ends to be joined, and replaces three or four nodes in a
    row by two (reductions with the published weights 2/3, 1/3 and 1/2, 1/3, 1/6).
    """
    n = len(d)
    if n <= 3:
        return list(range(n))
    m = d.astype(float).copy()
    ends = np.stack([np.arange(n), np.arange(n)], 1)
    a = m.copy()
    neighbours: list[list[int]] = [[] for _ in range(n)]

    def means(x):
        """Means of the node's distances to the components."""
        return (m[x, ends[:, 0]] + m[x, ends[:, 1]]) / 2

    while len(ends) > 1:
        k = len(ends)
        i, j = 0, 1
        if k > 2:
            r = a.sum(1)
            q = (k - 2) * a - r[:, None] - r[None, :]
            q[np.tril_indices(k)] = np.inf
            i, j = divmod(int(np.argmin(q)), k)
        p, q = sorted((list(dict.fromkeys(ends[c].tolist())) for c in (i, j)), key=len)
        rest = np.ones(k, bool)
        rest[[i, j]] = False
        nodes = p + q
        if len(nodes) == 2:
            x, y = nodes
            new = (x, y)
        else:
            far = {v: means(v)[rest].sum() + sum(m[v, u] for u in nodes if u != v) for v in nodes}
            outer = k - 2 + len(nodes)
            x, y = min(((u, v) for v in q for u in p), key=lambda o: (outer - 2) * m[o] - far[o[0]] - far[o[1]])
            z = next(v for v in q if v != y)
            others = np.unique(ends[rest])
            if len(p) == 1:
                inner = (m[x, z] + m[y, z] + m[x, y]) / 3
                xs, zs = (2 * m[x, others] + m[y, others]) / 3, (2 * m[z, others] + m[y, others]) / 3
                new = (x, z)
            else:
                u = next(v for v in p if v != x)
                inner = (m[x, y] + m[x, u] + m[x, z] + m[y, u] + m[y, z] + m[u, z]) / 6
                xs, zs = m[u, others] / 2 + m[x, others] / 3 + m[y, others] / 6, m[z, others] / 2 + m[y, others] / 3 + m[x, others] / 6
                new = (u, z)
            for v, row in zip(new, (xs, zs)):
                m[v, others] = m[others, v] = row
            m[new[0], new[1]] = m[new[1], new[0]] = inner
        neighbours[x].append(y)
        neighbours[y].append(x)
        ends = np.concatenate([ends[rest], [new]])
        a = a[np.ix_(rest, rest)]
        row = (means(new[0]) + means(new[1]))[:-1] / 2
        a = np.block([[a, row[:, None]], [row[None, :], np.zeros((1, 1))]])
    loose = [v for v in range(n) if len(neighbours[v]) == 1]
    if len(loose) == 2:
        neighbours[loose[0]].append(loose[1])
        neighbours[loose[1]].append(loose[0])
    cycle, seen = [0], {0}
    while len(cycle) < n:
        nxt = next(v for v in sorted(neighbours[cycle[-1]]) if v not in seen)
        cycle.append(nxt)
        seen.add(nxt)
    return cycle


class CircularSplits:
    """All splits of a cycle of n positions, as pairs of cuts p < q (a side holds positions p..q-1, never position 0).

    A split separates two positions if one cut lies between them. So distances from weights, and sums over pairs from values,
    are row sums less block sums of a symmetric matrix: O(n^2) by cumulative sums, without a design matrix.
    """

    def __init__(self, n: int):
        self.n = n
        self.low, self.high = np.triu_indices(n + 1, 1)
        keep = self.low > 0
        self.low, self.high = self.low[keep], self.high[keep]
        self.size = self.high - self.low

    @staticmethod
    def _crossing(x: np.ndarray) -> np.ndarray:
        """For all a <= b: sum of x[i, j] over i in a+1..b and j outside (1-based rows of a symmetric matrix)."""
        c = np.zeros((len(x) + 1, len(x) + 1))
        c[1:, 1:] = x.cumsum(0).cumsum(1)
        r = c[:, -1]
        diag = np.diagonal(c)
        return (r[None, :] - r[:, None]) - (diag[None, :] - c - c.T + diag[:, None])

    def distances(self, w: np.ndarray) -> np.ndarray:
        """Distances between positions (n x n) from the weights of the splits."""
        x = np.zeros((self.n, self.n))
        x[self.low - 1, self.high - 1] = w
        x += x.T
        y = self._crossing(x)[: self.n, : self.n]
        y = np.triu(y, 1)
        return y + y.T

    def sums(self, y: np.ndarray) -> np.ndarray:
        """For each split the sum of y over the pairs it separates."""
        return self._crossing(y)[self.low, self.high]

    def gram(self, i: np.ndarray) -> np.ndarray:
        """Numbers of pairs that two of the splits both separate."""
        p, q = self.low[i], self.high[i]
        k = (q - p).astype(float)
        both = np.maximum(np.minimum(q[:, None], q[None, :]) - np.maximum(p[:, None], p[None, :]), 0).astype(float)
        only, other = k[:, None] - both, k[None, :] - both
        return both * (self.n - both - only - other) + only * other


def circular_weights(d: np.ndarray, tolerance: float = 1e-7) -> tuple[CircularSplits, np.ndarray]:
    """Non-negative least-squares weights of the splits of the cycle 0..n-1 for the distances, to the optimality conditions.

    Active set: splits with the steepest gradients enter in blocks, the normal equations of those inside are solved with
    their closed-form Gram matrix, and negative ones leave (all at once if that still improves the fit, else up to the first
    bound, as Lawson and Hanson do). Ends when no split outside has a gradient above the tolerance.
    """
    n = len(d)
    s = CircularSplits(n)
    b = s.sums(d)
    scale = np.sqrt(s.size * (n - s.size).astype(float))
    bar = tolerance * max(float(np.abs(b / scale).max(initial=0)), 1e-300)
    x = np.zeros(len(b))
    inside = (s.size == 1) | (s.size == n - 1)
    entered, reached = n, np.inf
    while True:
        while True:
            i = np.flatnonzero(inside)
            g, bi, now = s.gram(i), b[i], x[i]
            value = lambda z: 0.5 * z @ (g @ z) - bi @ z  # noqa: B023, E731
            z = np.linalg.solve(g, bi)
            down = z < 0
            if not down.any():
                x[i] = z
                break
            bent = np.maximum(z, 0)
            if value(bent) < (before := value(now)) - 1e-13 * abs(before):
                x[i] = bent
                inside = x > 0
            else:
                step = np.min(now[down] / (now[down] - z[down]))
                x[i] = np.maximum(now + step * (z - now), 0)
                blocked = i[down & (now <= step * (now - z) * (1 + 1e-12))]
                x[blocked] = 0
                inside[blocked] = False
        got = 0.5 * x[i] @ (g @ x[i]) - bi @ x[i]
        if got >= reached - 1e-14 * abs(got):
            if entered == 1:
                return s, x
            entered = max(1, entered // 4)
        reached = min(got, reached)
        gradient = (b - s.sums(s.distances(x))) / scale
        gradient[inside] = -np.inf
        worst = np.argsort(-gradient)[:entered]
        worst = worst[gradient[worst] > bar]
        if not len(worst):
            return s, x
        inside[worst] = True


def neighbor_net(d: np.ndarray, least: float = 1e-4) -> tuple[list[int], list[tuple[int, float]]]:
    """Cycle (1-based) and splits ``(mask without taxon 1, weight)``: those above ``least`` and all trivial ones."""
    n = len(d)
    cycle = neighbor_net_cycle(d)
    if n < 2:
        return [c + 1 for c in cycle], []
    at = cycle.index(0)
    cycle = cycle[at:] + cycle[:at]
    s, x = circular_weights(d[np.ix_(cycle, cycle)].astype(float))
    upto = [0]
    for t in cycle:
        upto.append(upto[-1] | 1 << t)
    keep = np.flatnonzero((x > least) | (s.size == 1) | (s.size == n - 1))
    return [c + 1 for c in cycle], [(upto[s.high[k]] ^ upto[s.low[k]], float(x[k])) for k in keep]


def pcoa(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (columns by falling eigenvalue, positive ones only) and eigenvalues of the doubly centred squared distances."""
    n = len(d)
    j = np.eye(n) - 1 / n
    b = -0.5 * j @ (d**2) @ j
    val, vec = np.linalg.eigh(b)
    o = np.argsort(-val)
    val, vec = val[o], vec[:, o]
    keep = val > 1e-10
    vec = vec * np.where(vec[np.abs(vec).argmax(0), np.arange(n)] < 0, -1, 1)
    return vec[:, keep] * np.sqrt(val[keep]), val


def isolation_splits(d: np.ndarray, buneman: bool = False) -> list[tuple[int, float]]:
    """Splits with a positive isolation index (Buneman: with min in place of max), added taxon by taxon; weights are the indices."""
    n = len(d)
    pick = min if buneman else max

    def index(a, b):
        best = math.inf
        for i in a:
            for j in a:
                if j < i:
                    continue
                for k in b:
                    for m in b:
                        if m < k:
                            continue
                        x = (pick(d[i, k] + d[j, m], d[i, m] + d[j, k]) - d[i, j] - d[k, m]) / 2
                        if x < best:
                            best = x
                            if best <= 1e-7:
                                return 0.0
        return best

    splits: list[tuple[int, float]] = []
    for t in range(1, n):
        all_, new = list(range(t + 1)), []
        cands = {1 << t} | {m | e for m, _ in splits for e in (0, 1 << t)}
        for m in cands:
            a, b = [x for x in all_ if m >> x & 1], [x for x in all_ if not m >> x & 1]
            if a and b and (w := index(a, b)) > 0:
                new.append((m, w))
        splits = new
    return sorted(splits)


def to_matrix(t1, t2, d) -> tuple[np.ndarray, list[int]]:
    taxa = sorted({*t1, *t2})
    at = {t: i for i, t in enumerate(taxa)}
    m = np.zeros((len(taxa), len(taxa)))
    for a, b, x in zip(t1, t2, d):
        m[at[a], at[b]] = m[at[b], at[a]] = x
    return m, taxa


def tree_splits(edges: list[tuple[int, int, float]], n: int) -> list[tuple[int, float]]:
    """Splits (side without leaf 0) of a tree with leaves 0..n-1; equal ones summed."""
    kids: dict[int, list[tuple[int, float]]] = {}
    for p, c, w in edges:
        kids.setdefault(p, []).append((c, w))
    roots = set(kids) - {c for _, c, _ in edges}
    out: dict[int, float] = {}
    full = (1 << n) - 1

    def below(v: int) -> int:
        stack, order = [v], []
        while stack:
            x = stack.pop()
            order.append(x)
            stack += [c for c, _ in kids.get(x, [])]
        mask: dict[int, int] = {}
        for x in reversed(order):
            mask[x] = (1 << x if x < n else 0) | _or(mask[c] for c, _ in kids.get(x, []))
            for c, w in kids.get(x, []):
                m = full ^ mask[c] if mask[c] & 1 else mask[c]
                if m not in (0, full):
                    out[m] = out.get(m, 0.0) + w
        return mask[v]

    for r in roots:
        below(r)
    return sorted(out.items())


def newick(edges: list[tuple[int, int, float]], names: dict[int, str]) -> str:
    kids: dict[int, list[tuple[int, float]]] = {}
    for p, c, w in edges:
        kids.setdefault(p, []).append((c, w))
    root = next(iter(set(kids) - {c for _, c, _ in edges}), 0)
    text: dict[int, str] = {}
    stack = [(root, False)]
    while stack:
        v, done = stack.pop()
        if not done:
            stack.append((v, True))
            stack += [(c, False) for c, _ in kids.get(v, [])]
        else:
            inner = ",".join(f"{text[c]}:{w:g}" for c, w in kids.get(v, []))
            text[v] = (f"({inner})" if inner else "") + names.get(v, "")
    return text[root] + ";"


def split_newick(splits: list[tuple[int, float]], names: list[str], cycle: list[int]) -> str:
    """Circular splits as text: the heaviest compatible ones as a Newick tree with leaves in the order of the cycle, each other
    split k as marks ``<k|`` before the first and ``|k:weight>`` behind the last leaf of its side without the first leaf."""
    n, at = len(names), {t: i for i, t in enumerate(cycle)}
    full, spans = (1 << n) - 1, {}
    for m, w in splits:
        side = full ^ m if m >> (cycle[0] - 1) & 1 else m
        p = sorted(at[t + 1] for t in range(n) if side >> t & 1)
        if not p or p[-1] - p[0] + 1 != len(p):
            raise ValueError("a split is no interval of the cycle")
        spans[m] = (p[0], p[-1] + 1, w)
    tree = set(greedy_compatible([m for m, _ in splits], [w for _, w in splits], n))
    opens, closes = [""] * n, [""] * n
    for k, (lo, hi, w) in enumerate(sorted(v for m, v in spans.items() if m not in tree), 1):
        opens[lo] += f"<{k}|"
        closes[hi - 1] += f"|{k}:{w:.10g}>"
    weight = {(spans[m][0], spans[m][1]): spans[m][2] for m in tree}

    def text(lo: int, hi: int, inner) -> str:
        w = weight.get((lo, hi), 0.0)
        if hi - lo == 1:
            return f"{opens[lo]}{names[cycle[lo] - 1]}{closes[lo]}:{w:.10g}"
        return f"({','.join(inner)}):{w:.10g}"

    # innermost spans first; each takes the pieces it covers
    pieces: dict[int, tuple[int, str]] = {i: (i + 1, text(i, i + 1, ())) for i in range(n)}
    for lo, hi in sorted((x for x in weight if x[1] - x[0] > 1), key=lambda x: x[1] - x[0]):
        parts, i = [], lo
        while i < hi:
            parts.append(pieces[i][1])
            i = pieces[i][0]
        pieces[lo] = (hi, text(lo, hi, parts))
    parts, i = [], 0
    while i < n:
        parts.append(pieces[i][1])
        i = pieces[i][0]
    return f"({','.join(parts)});"
