"""Kernels on rooted networks and plain networks, as lists of edges. Leaves are nodes with a taxon."""

from __future__ import annotations

import heapq
from itertools import product

import numpy as np

Edge = tuple[int, int, float]


def children(edges: list[Edge]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for p, c, *_ in edges:
        out.setdefault(p, []).append(c)
        out.setdefault(c, [])
    return out


def parents(edges: list[Edge]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for p, c, *_ in edges:
        out.setdefault(c, []).append(p)
        out.setdefault(p, [])
    return out


def root_of(edges: list[Edge]) -> int:
    up = parents(edges)
    roots = [v for v in up if not up[v]]
    if len(roots) != 1:
        raise ValueError("a rooted network has one root")
    return roots[0]


def topological(edges: list[Edge]) -> list[int]:
    down, need = children(edges), {v: len(p) for v, p in parents(edges).items()}
    ready, out = [v for v in need if not need[v]], []
    while ready:
        v = ready.pop()
        out.append(v)
        for c in down[v]:
            need[c] -= 1
            if not need[c]:
                ready.append(c)
    if len(out) != len(need):
        raise ValueError("the network has a directed cycle")
    return out


def stable_ancestors(edges: list[Edge]) -> dict[int, int]:
    """Lowest stable ancestor (immediate dominator) of every node but the root."""
    order, up = topological(edges), parents(edges)
    at = {v: i for i, v in enumerate(order)}
    dom: dict[int, int] = {order[0]: order[0]}
    for v in order[1:]:
        a = up[v][0]
        for b in up[v][1:]:
            while a != b:
                if at[a] > at[b]:
                    a = dom[a]
                else:
                    b = dom[b]
        dom[v] = a
    dom.pop(order[0])
    return dom


def smooth(edges: list[Edge], keep: set[int]) -> list[Edge]:
    """Without leaves outside ``keep`` and without nodes of in- and out-degree 1; a root of out-degree 1 goes too."""
    e = {(p, c): w for p, c, w in edges}
    while True:
        up, down = parents([(p, c, w) for (p, c), w in e.items()]), children([(p, c, w) for (p, c), w in e.items()])
        dead = next((v for v in down if not down[v] and v not in keep), None)
        if dead is not None:
            for p in up[dead]:
                e.pop((p, dead), None)
            if not up[dead]:
                return [(p, c, w) for (p, c), w in e.items()]
            continue
        thin = next((v for v in down if v not in keep and len(down[v]) == 1 and len(up[v]) <= 1), None)
        if thin is None:
            return [(p, c, w) for (p, c), w in e.items()]
        c = down[thin][0]
        w = e.pop((thin, c))
        if up[thin]:
            p = up[thin][0]
            w += e.pop((p, thin))
            e[p, c] = min(w, e.get((p, c), w))


def lsa_tree(edges: list[Edge], leaves: set[int]) -> list[Edge]:
    """Every node hung below its lowest stable ancestor; weights are differences of mean heights below the root."""
    dom = stable_ancestors(edges)
    depth = {v: 0.0 for v in children(edges)}
    up: dict[int, list[tuple[int, float]]] = {}
    for p, c, w in edges:
        up.setdefault(c, []).append((p, w))
    for v in topological(edges):
        if v in up:
            depth[v] = sum(depth[p] + w for p, w in up[v]) / len(up[v])
    return smooth([(p, v, depth[v] - depth[p]) for v, p in dom.items()], leaves)


def below(edges: list[Edge], leaves: dict[int, int]) -> dict[int, int]:
    """Taxa below each node as a bit mask (taxon t is bit t - 1)."""
    down, out = children(edges), {}
    for v in reversed(topological(edges)):
        m = 1 << (leaves[v] - 1) if v in leaves else 0
        for c in down[v]:
            m |= out[c]
        out[v] = m
    return out


def visible(edges: list[Edge], leaves: set[int]) -> set[int]:
    """Nodes that all paths from the root to some leaf pass."""
    dom, out = stable_ancestors(edges), {root_of(edges)}
    for x in leaves:
        v = x
        while v in dom:
            out.add(v)
            v = dom[v]
    return out


def normalize(edges: list[Edge], leaves: set[int]) -> list[Edge]:
    """Cover graph of the visible nodes."""
    keep, down = visible(edges, leaves), children(edges)
    reach: dict[int, set[int]] = {}
    for v in reversed(topological(edges)):
        reach[v] = set().union(*(reach[c] | {c} for c in down[v])) if down[v] else set()
    out = [(p, c, 1.0) for p in keep for c in reach[p] & keep if not any(c in reach[m] for m in reach[p] & keep if m != c)]
    return smooth(out, leaves)


def contained_trees(edges: list[Edge], leaves: dict[int, int], distinct: bool = True) -> list[list[Edge]]:
    """Trees obtained by keeping one edge into each reticulation, cleaned; ``distinct``: different sets of clusters only."""
    up = parents(edges)
    hybrids = sorted(v for v in up if len(up[v]) > 1)
    weight = {(p, c): w for p, c, w in edges}
    out, seen = [], set()
    for choice in product(*(sorted(up[v]) for v in hybrids)):
        pick = dict(zip(hybrids, choice))
        tree = smooth([(p, c, w) for (p, c), w in weight.items() if c not in pick or pick[c] == p], set(leaves))
        key = frozenset(below(tree, leaves).values())
        if not distinct or key not in seen:
            seen.add(key)
            out.append(tree)
    return out


def network_class(edges: list[Edge], leaves: set[int]) -> str:
    """``tree``, ``normal``, ``tree_child``, ``tree_based`` or ``network``: the first that holds."""
    up, down = parents(edges), children(edges)
    if all(len(p) <= 1 for p in up.values()):
        return "tree"
    child = all(any(len(up[c]) == 1 for c in down[v]) for v in down if down[v])
    if child:
        reach: dict[int, set[int]] = {}
        for v in reversed(topological(edges)):
            reach[v] = set().union(*(reach[c] | {c} for c in down[v])) if down[v] else set()
        short = any(any(c in reach[m] for m in down[p] if m != c) for p in down for c in down[p])
        return "tree_child" if short else "normal"
    # tree-based: every inner node can keep a child that keeps it (matching of inner nodes into children)
    match: dict[int, int] = {}

    def place(v, seen):
        for c in down[v]:
            if c not in seen:
                seen.add(c)
                if c not in match or place(match[c], seen):
                    match[c] = v
                    return True
        return False

    inner = [v for v in down if down[v]]
    return "tree_based" if all(place(v, set()) for v in inner) else "network"


def path_multiplicities(edges: list[Edge], leaves: dict[int, int]) -> list[tuple[int, ...]]:
    """Sorted vectors of the numbers of paths from each node to each taxon."""
    down, order = children(edges), sorted(set(leaves.values()))
    out: dict[int, tuple[int, ...]] = {}
    for v in reversed(topological(edges)):
        own = [1 if leaves.get(v) == t else 0 for t in order]
        out[v] = tuple(a + sum(out[c][i] for c in down[v]) for i, a in enumerate(own))
    return sorted(out.values())


def displays(network: list[Edge], tree: list[Edge], net_leaves: dict[int, int], tree_leaves: dict[int, int]) -> bool:
    want = set(below(tree, tree_leaves).values())
    return any(want == set(below(t, net_leaves).values()) for t in contained_trees(network, net_leaves))


def blob_tree(edges: list[Edge], leaves: set[int]) -> list[Edge]:
    """Biconnected parts with cycles contracted to their top node."""
    nb: dict[int, set[int]] = {}
    for p, c, _ in edges:
        nb.setdefault(p, set()).add(c)
        nb.setdefault(c, set()).add(p)
    order, low, at, bridges = {}, {}, 0, set()
    root = root_of(edges)
    stack = [(root, None, iter(sorted(nb[root])))]
    order[root] = low[root] = at
    while stack:
        v, p, it = stack[-1]
        for w in it:
            if w not in order:
                at += 1
                order[w] = low[w] = at
                stack.append((w, v, iter(sorted(nb[w]))))
                break
            if w != p:
                low[v] = min(low[v], order[w])
        else:
            stack.pop()
            if stack:
                u = stack[-1][0]
                low[u] = min(low[u], low[v])
                if low[v] > order[u]:
                    bridges.add(frozenset((u, v)))
    comp: dict[int, int] = {}
    for v in topological(edges):
        if v in comp:
            continue
        todo, comp[v] = [v], v
        while todo:
            x = todo.pop()
            for y in nb[x]:
                if y not in comp and frozenset((x, y)) not in bridges:
                    comp[y] = v
                    todo.append(y)
    return smooth([(comp[p], comp[c], w) for p, c, w in edges if comp[p] != comp[c]], leaves)


def shortest(edges: list[Edge], s: int) -> dict[int, float]:
    nb: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in edges:
        nb.setdefault(a, []).append((b, w))
        nb.setdefault(b, []).append((a, w))
    dist, heap = {}, [(0.0, s)]
    while heap:
        x, v = heapq.heappop(heap)
        if v in dist:
            continue
        dist[v] = x
        for y, w in nb.get(v, []):
            if y not in dist:
                heapq.heappush(heap, (x + w, y))
    return dist


def stretch_filter(edges: list[Edge], taxa: list[int], percent: float) -> list[Edge]:
    """Heaviest edges dropped as long as no path between taxa gets longer than (1 + percent/100) times its first length."""
    base = {s: shortest(edges, s) for s in taxa}
    kept = list(edges)
    for e in sorted(edges, key=lambda x: (-x[2], x[0], x[1])):
        trial = [x for x in kept if x is not e]
        ok = True
        for s in taxa:
            d = shortest(trial, s)
            if any(t not in d or d[t] > base[s][t] * (1 + percent / 100) + 1e-12 for t in taxa if t != s and t in base[s]):
                ok = False
                break
        if ok:
            kept = trial
    return kept


def z_closure(parts: list[tuple[int, int]], ntax: int) -> list[tuple[int, int]]:
    """Full splits implied by partial ones: wherever sides meet in three of four ways, the two are extended; those of all taxa remain."""
    full = (1 << ntax) - 1
    norm = lambda a, b: (a, b) if a & -a < b & -b or b == 0 else (b, a)
    splits = {norm(a, b) for a, b in parts if a and b}
    todo = True
    while todo:
        todo = False
        for s in sorted(splits):
            for t in sorted(splits):
                if s == t or s not in splits or t not in splits:
                    continue
                for (a1, b1), (a2, b2) in product((s, s[::-1]), (t, t[::-1])):
                    if a1 & a2 and a2 & b1 and b1 & b2 and not a1 & b2:
                        x, y = norm(a1, b1 | b2), norm(a1 | a2, b2)
                        if {x, y} != {s, t}:
                            splits -= {s, t}
                            splits |= {x, y}
                            todo = True
                            break
    return sorted(p for p in splits if p[0] | p[1] == full)


def _site_distances(a: np.ndarray, b: np.ndarray, weights: list[float]) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j, w in enumerate(weights):
        out += w * (a[:, j, None] != b[None, :, j])
    return out


def _feasible_links(d: np.ndarray, ids: np.ndarray, epsilon: float) -> list[tuple[int, int, float]]:
    """Links of rows: at each distance ascending, pairs not yet joined by links shorter than it by more than epsilon."""
    n, near = len(d), d[0].copy()
    todo, level = np.ones(n, bool), 0.0
    todo[0] = False
    for _ in range(n - 1):  # the longest edge of a spanning tree: pairs longer by more than epsilon are joined
        v = int(np.argmin(np.where(todo, near, np.inf)))
        level, todo[v] = max(level, near[v]), False
        near = np.minimum(near, d[v])
    i, j = np.nonzero(np.triu(d <= level + epsilon, 1))
    w = d[i, j]
    by = np.lexsort((ids[j], ids[i], w))
    i, j, w = i[by], j[by], w[by]
    comp, out, at = np.arange(n), [], 0
    cuts = [0, *(np.flatnonzero(w[1:] != w[:-1]) + 1).tolist(), len(w)] if len(w) else []
    for s, e in zip(cuts, cuts[1:]):
        x = float(w[s])
        while at < len(out) and out[at][2] < x - epsilon:
            p, q = comp[out[at][0]], comp[out[at][1]]
            if p != q:
                comp[comp == p] = q
            at += 1
        keep = comp[i[s:e]] != comp[j[s:e]]
        out += [(p, q, x) for p, q in zip(i[s:e][keep].tolist(), j[s:e][keep].tolist())]
    return out


def median_joining(rows: dict[int, str], weights: list[float], epsilon: float = 0.0) -> tuple[dict[int, str], list[Edge]]:
    """Nodes (negative ids are medians) and edges of the median-joining network of different sequences, however many.

    Ends when no median is obsolete and no candidate is left. A set of sequences met again (medians added and dropped in
    turn, which would never end) is an error.
    """
    ids = np.array(sorted(rows), np.int64)
    codes = np.array([[ord(c) for c in rows[v]] for v in ids.tolist()], np.uint32).reshape(len(ids), len(weights))
    d, cost_of = _site_distances(codes, codes, weights), np.array(weights, float)
    text = lambda row: "".join(map(chr, row))
    nxt, met = -1, set()
    while True:
        found = _feasible_links(d, ids, epsilon)
        nb: list[list[int]] = [[] for _ in ids]
        for a, b, _ in found:
            nb[a].append(b)
            nb[b].append(a)
        gone = np.array([v < 0 and len(n) <= 2 for v, n in zip(ids.tolist(), nb)], bool)
        if gone.any():
            ids, codes, d = ids[~gone], codes[~gone], d[np.ix_(~gone, ~gone)]
            continue
        have, cands, least = {r.tobytes() for r in codes}, {}, float("inf")
        for v, n in enumerate(nb):
            x = codes[v]
            for k, a in enumerate(n[:-1]):
                y, z = codes[a], codes[n[k + 1 :]]
                m = np.where(y == z, y, x)
                cost = ((m != x) @ cost_of) + ((m != y) @ cost_of) + ((m != z) @ cost_of)
                for c, r in zip(cost[cost <= least + epsilon].tolist(), m[cost <= least + epsilon]):
                    if (key := r.tobytes()) not in have:
                        least = min(least, c)
                        cands[key] = min(c, cands.get(key, c))
        if not cands:
            name = ids.tolist()
            return dict(zip(name, map(text, codes.tolist()))), [(name[a], name[b], w) for a, b, w in found]
        state = hash(frozenset(have))
        if state in met:
            raise ValueError("median joining does not end: the same medians are added and dropped in turn")
        met.add(state)
        new = np.array(sorted(np.frombuffer(k, np.uint32).tolist() for k, c in cands.items() if c <= least + epsilon), np.uint32)
        across = _site_distances(codes, new, weights)
        d = np.block([[d, across], [across.T, _site_distances(new, new, weights)]])
        ids, codes = np.concatenate([ids, np.arange(nxt, nxt - len(new), -1)]), np.concatenate([codes, new])
        nxt -= len(new)


def parsimony_splits(rows: list[str], gap: str = "-", missing: str = "?") -> list[tuple[int, int]]:
    """Splits with a positive parsimony score, added taxon by taxon; the score of a split is the least over its quartets.

    A quartet's score is the number of sites that show its split less the larger number of sites that show one of the two
    others. Sites with a gap, a missing character or an ambiguity code in the quartet are not counted.
    """
    unread = set((gap + missing + "rywskmbdhvn").lower()) if _nucleotides(rows) else set((gap + missing).lower())
    codes = np.array([[0 if c in unread else ord(c) for c in r.lower()] for r in rows], np.int64).reshape(len(rows), -1)
    same = np.array([[(codes[i] == codes[j]) & (codes[i] > 0) for j in range(len(rows))] for i in range(len(rows))])
    known = codes > 0
    scores: dict[tuple[int, int, int, int], int] = {}

    def score(i, j, k, m):
        key = (i, j, k, m)
        if key not in scores:
            seen = known[i] & known[j] & known[k] & known[m]
            own = int((same[i, j] & same[k, m] & ~same[i, k] & seen).sum())
            first = int((same[i, k] & same[j, m] & ~same[i, j] & seen).sum())
            second = int((same[i, m] & same[j, k] & ~same[i, j] & seen).sum())
            scores[key] = own - max(first, second)
        return scores[key]

    def weight(a, b):
        best = None
        for x, i in enumerate(a):
            for j in a[x:]:
                for y, k in enumerate(b):
                    for m in b[y:]:
                        s = score(i, j, k, m)
                        best = s if best is None else min(best, s)
                        if best <= 0:
                            return 0
        return best or 0

    splits: list[tuple[int, int]] = []
    for t in range(1, len(rows)):
        new = []
        for m in sorted({1 << t} | {m | e for m, _ in splits for e in (0, 1 << t)}):
            a, b = [x for x in range(t + 1) if m >> x & 1], [x for x in range(t + 1) if not m >> x & 1]
            if a and b and (w := weight(a, b)) > 0:
                new.append((m, w))
        splits = new
    return splits


def _nucleotides(rows: list[str]) -> bool:
    """Whether most letters are bases, so that other letters are ambiguity codes."""
    letters = [c for r in rows for c in r.lower() if c.isalpha()]
    return bool(letters) and sum(c in "acgtu" for c in letters) > 0.5 * len(letters)


def simplify(edges: list[Edge], keep: set[int]) -> list[Edge]:
    """Without loops, parallel edges (the lightest stays) and ends outside ``keep``; chains of such nodes of degree 2 become one edge."""
    nb: dict[int, dict[int, float]] = {}
    for a, b, w in edges:
        nb.setdefault(a, {})
        nb.setdefault(b, {})
        if a != b:
            nb[a][b] = nb[b][a] = min(w, nb[a].get(b, w))
    todo = sorted(nb)
    while todo:
        v = todo.pop()
        if v in keep or v not in nb or len(nb[v]) > 2:
            continue
        near = sorted(nb.pop(v).items())
        for u, _ in near:
            del nb[u][v]
        if len(near) == 2:
            (a, x), (b, y) = near
            nb[a][b] = nb[b][a] = min(x + y, nb[a].get(b, x + y))
        todo += [u for u, _ in near]
    return [(a, b, w) for a in sorted(nb) for b, w in sorted(nb[a].items()) if a < b]


def leaf_order(edges: list[Edge], leaves: dict[int, int], by: str) -> list[int]:
    """Leaves in the order met when children are taken in the wanted order."""
    down = children(edges)
    size, tip, height = {}, {}, {}
    weight = {(p, c): w for p, c, w in edges}
    for v in reversed(topological(edges)):
        c = down[v]
        size[v] = sum(size[x] for x in c) if c else 1
        tip[v] = min((tip[x] for x in c), default=leaves.get(v, 0))
        height[v] = max((height[x] + weight[v, x] for x in c), default=0.0)
    keys = {
        "taxon": lambda v: (tip[v],), "size": lambda v: (size[v], tip[v]), "size_down": lambda v: (-size[v], tip[v]),
        "height": lambda v: (height[v], tip[v]), "height_down": lambda v: (-height[v], tip[v]), "alternate": lambda v: (size[v], tip[v]),
    }
    out, stack = [], [(root_of(edges), 0)]
    while stack:
        v, depth = stack.pop()
        c = list(dict.fromkeys(down[v]))
        if by in keys:
            c.sort(key=keys[by])
        if by == "reverse" or by == "alternate" and depth % 2:
            c.reverse()
        if not c and v in leaves:
            out.append(v)
        stack += [(x, depth + 1) for x in reversed(c)]
    return list(dict.fromkeys(out))


def species(edges: list[Edge], leaves: dict[int, int], value: dict[int, str]) -> dict[str, list[list[int]]]:
    """``tight``, ``loose`` and ``lacy`` species of a tree: lists of taxa, for the taxa with a value."""
    down, up = children(edges), parents(edges)
    taxa, values = {}, {}
    for v in reversed(topological(edges)):
        own = {leaves[v]} if v in leaves and leaves[v] in value else set()
        taxa[v] = own.union(*(taxa[c] for c in down[v]))
        values[v] = {value[t] for t in taxa[v]}
    members: dict[str, set[int]] = {}
    for t, x in value.items():
        members.setdefault(x, set()).add(t)
    top = lambda ok: sorted(sorted(taxa[v]) for v in taxa if taxa[v] and ok(v) and not any(ok(p) for p in up[v]))
    tight = top(lambda v: len(values[v]) == 1)
    closed = {v for v in taxa if taxa[v] and all(members[x] & set(value) <= taxa[v] for x in values[v])}
    least = [v for v in closed if not any(c in closed for c in _under(down, v))]
    loose = sorted(sorted(taxa[v]) for v in least)
    rest = set(value) - {t for s in loose for t in s}
    loose += [[t] for t in sorted(rest)]
    lacy: list[set[int]] = []
    for s in map(set, tight):
        near = [x for x in lacy if {value[t] for t in x} & {value[t] for t in s}]
        lacy = [x for x in lacy if x not in near] + [s.union(*near)]
    return {"tight": tight, "loose": loose, "lacy": sorted(sorted(x) for x in lacy)}


def _under(down: dict[int, list[int]], v: int) -> set[int]:
    out, stack = set(), list(down[v])
    while stack:
        x = stack.pop()
        if x not in out:
            out.add(x)
            stack += down[x]
    return out


def _all_taxa(clusters: list[tuple[int, float]], ntax: int, whole: bool) -> int:
    full = (1 << ntax) - 1
    if whole:
        return full
    out = 0
    for m, _ in clusters:
        out |= m
    return out


def cluster_network(clusters: list[tuple[int, float]], ntax: int, whole: bool = True) -> tuple[list[Edge], dict[int, int]]:
    """Edges and leaves of the cover graph of the clusters, all taxa (of the clusters, without ``whole``) and their whole; a node of several parents gets an edge of its own."""
    full = _all_taxa(clusters, ntax, whole)
    weight = dict(clusters)
    sets = sorted({m for m, _ in clusters if m} | {1 << i for i in range(ntax) if full >> i & 1} | {full}, key=lambda m: (m.bit_count(), m))
    ids = {m: (m.bit_length() - 1 if m.bit_count() == 1 else ntax + i) for i, m in enumerate(sets)}
    out, nxt = [], ntax + len(sets)
    for i, m in enumerate(sets):
        above = [x for x in sets[i + 1 :] if x & m == m]
        covers = [x for x in above if not any(y & m == m and x & y == y and y not in (x, m) for y in above)]
        w = float(weight.get(m, 0.0))
        if len(covers) > 1:
            out += [(ids[x], nxt, 0.0) for x in covers] + [(nxt, ids[m], w)]
            nxt += 1
        else:
            out += [(ids[x], ids[m], w) for x in covers]
    return out, {i: i + 1 for i in range(ntax) if full >> i & 1}


def clusters_to_edges(clusters: list[tuple[int, float]], ntax: int, whole: bool = True) -> list[Edge]:
    """Tree of compatible clusters (bit masks) by nesting; node t - 1 is the leaf of taxon t, inner nodes follow, the root is last.

    Its leaves are all taxa; without ``whole`` only those of the clusters.
    """
    full = _all_taxa(clusters, ntax, whole)
    sets = sorted({m for m, _ in clusters} | {1 << i for i in range(ntax) if full >> i & 1} | {full}, key=lambda m: (m.bit_count(), m))
    weight = dict(clusters)
    ids = {m: (m.bit_length() - 1 if m.bit_count() == 1 else ntax + i) for i, m in enumerate(sets)}
    out = []
    for i, m in enumerate(sets[:-1]):
        up = next(x for x in sets[i + 1 :] if x & m == m)
        out.append((ids[up], ids[m], float(weight.get(m, 0.0))))
    return out


def reroot(edges: list[Edge], outgroup: set[int]) -> list[Edge]:
    """The tree rooted on the edge that best separates the out-group leaves from all others, in its middle."""
    down = children(edges)
    size: dict[int, frozenset] = {}
    for v in reversed(topological(edges)):
        size[v] = frozenset().union(*(size[c] for c in down[v])) if down[v] else frozenset([v])
    leaves = size[root_of(edges)]
    p, c, w = min(edges, key=lambda e: (min(len(size[e[1]] ^ outgroup), len((leaves - size[e[1]]) ^ outgroup)), e[1]))
    nb: dict[int, list[tuple[int, float]]] = {}
    for a, b, x in edges:
        if (a, b) != (p, c):
            nb.setdefault(a, []).append((b, x))
            nb.setdefault(b, []).append((a, x))
    top = max(down) + 1
    out, seen, stack = [(top, p, w / 2), (top, c, w / 2)], {p, c}, [p, c]
    while stack:
        v = stack.pop()
        for y, x in nb.get(v, []):
            if y not in seen:
                seen.add(y)
                out.append((v, y, x))
                stack.append(y)
    return smooth(out, set(leaves))
