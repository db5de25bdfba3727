from itertools import combinations, permutations

import numpy as np
import pytest

from cladeworks import reference_queries as R
from cladeworks.functions import kernels as K

SF = "/root/testdata/sf0.001"


def common_order(masks, n):
    for p in permutations(range(1, n)):
        at = [[i for i, t in enumerate(p) if m >> t & 1] for m in masks]
        if all(x[-1] - x[0] + 1 == len(x) for x in at):
            return True
    return False


def test_greedy_circular_against_all_orders():
    rnd = np.random.default_rng(6)
    for n in (4, 5, 6, 7):
        for _ in range(60):
            p, masks = rnd.permutation(np.arange(1, n)), set()
            for _ in range(rnd.integers(2, 10)):
                a, b = sorted(rnd.choice(n, 2, replace=False))
                masks.add(sum(1 << int(t) for t in p[a:b]) if rnd.random() < 0.7 else int(rnd.integers(1, 1 << (n - 1))) << 1)
            masks, want = sorted(masks), []
            for i in K._order(masks, [1.0] * len(masks)):
                if common_order([*want, masks[i]], n):
                    want.append(masks[i])
            assert K.greedy_circular(masks, [1.0] * len(masks), n) == want


@pytest.mark.parametrize("kind", ["weakly_compatible", "circular"])
def test_greedy_queries_decide_on_all_splits(spark, kind):
    full = (1 << R.NTAX) - 1
    given = {r["mask"]: r["weight"] for r in R._splits(spark, SF).collect()}
    kept = {r["mask"]: r["weight"] for r in R.QUERIES[f"splits_greedy_{kind}"](spark, SF).collect()}
    inner = [m for m in kept if 1 < m.bit_count() < R.NTAX - 1]
    assert kept.items() <= given.items() and len(inner) > 2 and len(kept) < len(given)
    assert all(K.weakly_compatible(*t, full) for t in combinations(kept, 3))
    if kind == "weakly_compatible":
        assert all(any(not K.weakly_compatible(m, a, b, full) for a, b in combinations(kept, 2)) for m in given.keys() - kept)
    else:
        assert all(K.greedy_circular([*kept, m], [2.0] * len(kept) + [1.0], R.NTAX).count(m) == 0 for m in given.keys() - kept)
