import random

import numpy as np
from pyspark.sql import functions as F

from cladeworks.llm import edit_dups as E
from cladeworks.llm import set_join as J


def shingles(t, k):
    return {t[i : i + k] for i in range(len(t) - k + 1)}


def brute(texts, t, k):
    ids = sorted(i for i, x in texts if i is not None and x and len(x) >= k)
    by = {i: shingles(x, k) for i, x in texts if i in ids and x and len(x) >= k}
    ids = sorted(by)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(by[a] & by[b]) >= t * len(by[a] | by[b]) - 1e-12}


def edited(rnd, s):
    s = list(s)
    for _ in range(rnd.randrange(5)):
        i = rnd.randrange(len(s))
        s[i : i + 1] = rnd.choice([[], [rnd.choice("acgt")], [s[i], rnd.choice("acgt")]])
    return "".join(s)


def corpus(seed, n):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("acgt") for _ in range(rnd.randrange(60, 200))) for _ in range(n // 4)]
    return [(i, edited(rnd, rnd.choice(base))) for i in range(n)]


def found(spark, texts, t, k):
    df = spark.createDataFrame(texts, "id long, text string")
    return {(r.id_a, r.id_b) for r in J.expand(*E.near_duplicates(df, t, k)).collect()}


def test_against_brute_force(spark):
    texts = corpus(1, 240)
    want = brute(texts, 0.6, 8)
    assert len(want) > 100 and found(spark, texts, 0.6, 8) == want


def test_branching_giants_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "LIMIT", 4)
    monkeypatch.setattr(E, "GIANT", 60)
    monkeypatch.setattr(E, "DEPTH", 1)
    texts = corpus(2, 120)
    assert found(spark, texts, 0.6, 8) == brute(texts, 0.6, 8)


def test_defined_cases(spark):
    a = "acgtacgtgg" * 3
    texts = [(1, a), (2, a), (2, a), (None, a), (3, None), (4, ""), (5, "acg"), (6, a + "t"), (7, "é" * 20), (8, "é" * 30), (9, "x" * 200_000 + a)]
    assert found(spark, texts, 0.6, 8) == brute(texts, 0.6, 8) | {(7, 8)}
    assert found(spark, [], 0.6, 8) == set()


def test_cleaning(spark):
    df = spark.createDataFrame([("ACGU-nN?a", "-", "N"), ("AC.gt", ".", None), (None, "-", "?")], "m string, gap string, missing string")
    got = [r.t for r in df.select(E.clean_sequence(F.col("m"), F.col("gap"), F.col("missing")).alias("t")).collect()]
    assert got == ["acgt?a", "acgt", None]


def test_minwise_estimates_similarity():
    rnd = random.Random(7)
    a = "".join(rnd.choice("acgt") for _ in range(600))
    b = a[:450] + "".join(rnd.choice("acgt") for _ in range(150))
    j = len(shingles(a, 8) & shingles(b, 8)) / len(shingles(a, 8) | shingles(b, 8))
    v = np.array([E.minwise(a, 8), E.minwise(b, 8)])
    assert abs((v[0] == v[1]).mean() - j) < 0.15
