from itertools import combinations, permutations

import numpy as np
import pytest

from cladeworks.functions import kernels as K

# additive distances of the tree (((a:1,b:1):3,c:1):1,d:1,e:1)
F1 = np.array([[0, 2, 5, 6, 6], [2, 0, 5, 6, 6], [5, 5, 0, 3, 3], [6, 6, 3, 0, 2], [6, 6, 3, 2, 0]], float)
SPLITS = {0b00010: 1, 0b00100: 1, 0b01000: 1, 0b10000: 1, 0b11110: 1, 0b11100: 3, 0b11000: 1}


@pytest.mark.parametrize("bio", [False, True])
def test_additive_matrix_is_recovered(bio):
    got = {m: w for m, w in K.tree_splits(K.neighbor_joining(F1, bio), 5) if w > 1e-9}
    assert got.keys() == SPLITS.keys() and all(abs(got[m] - SPLITS[m]) < 1e-9 for m in got)


def test_upgma_heights():
    e = K.upgma(F1)
    up = {c: (p, w) for p, c, w in e}

    def height(v):
        return 0 if v not in up else up[v][1] + height(up[v][0])

    assert all(abs(height(i) - 17 / 6) < 1e-9 for i in range(5))


def test_neighbor_net_on_additive_matrix():
    cycle, splits = K.neighbor_net(F1)
    got = {m: round(w, 6) for m, w in splits if w > 1e-6}
    assert got == SPLITS and sorted(cycle) == [1, 2, 3, 4, 5] and cycle[0] == 1


def test_circular_weights_meet_the_optimality_conditions():
    rnd = np.random.default_rng(0)
    for n in (3, 4, 9, 40):
        d = rnd.random((n, n))
        d = np.triu(d, 1) + np.triu(d, 1).T
        s, x = K.circular_weights(d)
        a = np.array([[(p <= i < q) != (p <= j < q) for p, q in zip(s.low, s.high)] for i in range(n) for j in range(i + 1, n)], float)
        b = np.array([d[i, j] for i in range(n) for j in range(i + 1, n)])
        assert np.allclose([s.distances(x)[i, j] for i in range(n) for j in range(i + 1, n)], a @ x) and np.allclose(s.sums(d), a.T @ b)
        assert np.allclose(s.gram(np.arange(len(x))), a.T @ a)
        g = a.T @ (a @ x - b)
        assert (x >= 0).all() and g.min() > -1e-5 and abs(g[x > 0]).max(initial=0) < 1e-8


def test_neighbor_net_of_256_taxa():
    import time

    d = np.random.default_rng(2).random((256, 256))
    d = np.triu(d, 1) + np.triu(d, 1).T
    began = time.time()
    cycle, splits = K.neighbor_net(d)
    assert time.time() - began < 20 and sorted(cycle) == list(range(1, 257))
    assert len({m for m, _ in splits}) == len(splits) > 256 and max(m.bit_length() for m, _ in splits) > 200


def test_isolation_indices():
    assert {m: round(w, 9) for m, w in K.isolation_splits(F1)} == SPLITS
    assert {m: round(w, 9) for m, w in K.isolation_splits(F1, buneman=True)} == SPLITS


def test_pcoa_reproduces_euclidean_distances():
    p = np.random.default_rng(1).normal(size=(7, 3))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    xy, _ = K.pcoa(d)
    assert np.allclose(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)), d)


def test_midpoint():
    e = K.midpoint_root(K.neighbor_joining(F1), list(range(5)))
    up = {c: (p, w) for p, c, w in e}

    def height(v):
        return 0 if v not in up else up[v][1] + height(up[v][0])

    top = sorted((height(i) for i in range(5)), reverse=True)
    assert abs(top[0] - 3) < 1e-9 and abs(top[1] - 3) < 1e-9


def test_spanning_network():
    assert sum(w for *_, w in K.min_spanning_tree(F1)) == 12
    assert {(i, j) for i, j, _ in K.min_spanning_network(F1)} == {(0, 1), (3, 4), (2, 3), (2, 4), (0, 2), (1, 2)}


def interval_orders(masks, n):
    for p in permutations(range(1, n)):
        at = {t: i for i, t in enumerate(p)}
        if all(max(q) - min(q) + 1 == len(q) for m in masks if (q := [at[i] for i in range(1, n) if m >> i & 1])):
            return True
    return False


def test_circular_order_against_all_orders():
    rnd = np.random.default_rng(3)
    for k in range(300):
        n = 6 + k % 2
        masks = [int(x) << 1 for x in rnd.integers(1, 2 ** (n - 1), rnd.integers(1, 5))]
        got = K.circular_order(masks, n)
        assert (got is not None) == interval_orders(masks, n)
        if got:
            at = {t: i for i, t in enumerate(got)}
            for m in masks:
                p = [at[t + 1] for t in range(n) if m >> t & 1]
                assert sorted(got) == list(range(1, n + 1)) and max(p) - min(p) + 1 == len(p)


def test_circular_systems_are_never_rejected():
    rnd = np.random.default_rng(5)
    for _ in range(400):
        n = int(rnd.integers(4, 10))
        order = [0, *(rnd.permutation(n - 1) + 1).tolist()]
        masks = []
        for _ in range(int(rnd.integers(1, 9))):
            i, j = sorted(rnd.choice(np.arange(1, n + 1), 2, replace=False).tolist())
            masks.append(sum(1 << order[t] for t in range(i, j)))
        masks = sorted(set(masks))
        assert K.circular_order(masks, n) is not None
        assert sorted(K.greedy_circular(masks, rnd.random(len(masks)).tolist(), n)) == masks


def test_cliques_against_brute_force():
    rnd = np.random.default_rng(6)
    for _ in range(60):
        n = 6
        masks = sorted({int(x) << 1 for x in rnd.integers(1, 31, 7)})
        w = dict(zip(masks, rnd.random(len(masks))))
        ok = lambda t: all(K.compatible(a, b) for a, b in combinations(t, 2))
        best = max((t for k in range(len(masks) + 1) for t in combinations(masks, k) if ok(t)), key=lambda t: sum(w[m] for m in t))
        assert sorted(K.clique_compatible(masks, list(w.values()), n)) == sorted(best)
        inside = [m for m in masks if (p := [i for i in range(n) if m >> i & 1]) and p[-1] - p[0] + 1 == len(p)]
        best = max((t for k in range(len(inside) + 1) for t in combinations(inside, k) if ok(t)), key=lambda t: sum(w[m] for m in t))
        assert sorted(K.clique_circular(masks, list(w.values()), n, list(range(1, n + 1)))) == sorted(best)


def test_dimension_filter_leaves_no_clique():
    rnd = np.random.default_rng(7)
    for _ in range(40):
        masks = sorted({int(x) << 1 for x in rnd.integers(1, 127, 14)})
        left = K.dimension_filter(masks, rnd.random(len(masks)).tolist(), 8, 2)
        assert all(not all(not K.compatible(a, b) for a, b in combinations(t, 2)) for t in combinations(left, 3))


def test_greedy_and_dimension():
    masks, weights = [0b0110, 0b1100, 0b1010, 0b0010], [3.0, 2.0, 1.0, 1.0]
    assert K.greedy_compatible(masks, weights, 5) == [0b0110, 0b0010]
    left = K.dimension_filter(masks, weights, 5, 2)
    assert 0b1010 not in left and 0b0110 in left
    assert all(not all(not K.compatible(a, b) for a, b in combinations(t, 2)) for t in combinations(left, 3))
