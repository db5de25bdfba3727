import random

import pytest

from cladeworks.llm import edit_dups as E
from tests.llm.test_edit_dups import brute, found


@pytest.mark.parametrize("k", [3, 8, 9])
def test_runs_do_not_depend_on_the_rest_of_the_text(k):
    rnd = random.Random(k)
    for _ in range(100):
        a, b = ("".join(rnd.choice("acgté" if rnd.random() < 0.3 else "acgt") for _ in range(rnd.randrange(k, 60))) for _ in range(2))
        if k <= 8:
            want = {a[i : i + k] for i in range(len(a) - k + 1)} & {b[i : i + k] for i in range(len(b) - k + 1)}
            assert len(set(E.runs(a, k).tolist()) & set(E.runs(b, k).tolist())) == len(want)
        assert len(E.runs(a, k)) == len({a[i : i + k] for i in range(len(a) - k + 1)})


@pytest.mark.parametrize("k", [5, 8])
def test_one_foreign_character_keeps_the_pair(spark, k):
    rnd = random.Random(1)
    a, b = ("".join(rnd.choice("acgt") for _ in range(150)) for _ in range(2))
    texts = [(1, a), (2, a[:70] + "é" + a[71:]), (3, a + "é"), (4, b), (5, "é" + b[1:])]
    want = brute(texts, 0.6, k)
    assert {(1, 2), (1, 3), (2, 3), (4, 5)} == want and found(spark, texts, 0.6, k) == want
