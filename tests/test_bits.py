import random

import pytest
from pyspark.sql import functions as F

from cladeworks.functions import bits as B
from cladeworks.operators import distances as M
from cladeworks.operators import networks as W
from cladeworks.operators import splits as S
from cladeworks.operators import trees as T

NS = [63, 64, 65, 200]


@pytest.mark.parametrize("n", NS)
def test_set_operators(spark, n):
    rnd = random.Random(n)
    pairs = [({t for t in range(1, n + 1) if rnd.random() < p}, {t for t in range(1, n + 1) if rnd.random() < q}) for p in (0, 0.02, 0.5, 1) for q in (0.02, 0.5, 1)]
    pairs += [({n}, {n, 1}), ({1}, {n}), (set(range(2, n + 1)), {n - 1})]
    x = B.bits(n)
    value = lambda s: x.to_value(sum(1 << (t - 1) for t in s))
    df = spark.createDataFrame([(i, value(a), value(b)) for i, (a, b) in enumerate(pairs)], f"i int, a {x.ddl}, b {x.ddl}")
    a, b = F.col("a"), F.col("b")
    taxa = lambda c: B.taxa_of(x, c, n)
    rows = df.select(
        "i", taxa(x.both(a, b)).alias("both"), taxa(x.either(a, b)).alias("either"), taxa(x.differ(a, b)).alias("differ"), taxa(x.minus(a, b)).alias("minus"), taxa(x.differ(x.full(), a)).alias("rest"),
        x.size(a).alias("size"), x.empty(a).alias("empty"), B.subset(x, a, b).alias("sub"), B.meet(x, a, b).alias("meet"), B.overlap(x, a, b).alias("over"), taxa(S.canonical(a, n)).alias("can"), S.compatible(a, b, n).alias("comp"),
    ).collect()
    whole = set(range(1, n + 1))
    for r in rows:
        a, b = pairs[r.i]
        assert (set(r.both), set(r.either), set(r.differ), set(r["minus"]), set(r.rest)) == (a & b, a | b, a ^ b, a - b, whole - a)
        assert (r["size"], r.empty, r.sub, r.meet, r.over) == (len(a), not a, a <= b, bool(a & b), bool(a & b) and not a <= b and not b <= a)
        assert set(r.can) == (whole - a if 1 in a else a) and r.comp == (not r.over)


@pytest.mark.parametrize("n", NS)
def test_splits_and_trees_of_many_taxa(spark, n):
    rnd = random.Random(n)
    cells = [(t, s) for s in range(12) for t in range(1, n + 1) if rnd.random() < 0.5]
    got = S.with_taxa(S.presence_splits(spark.createDataFrame(cells, "taxon int, site int"), n), n).collect()
    want = {}
    for s in range(12):
        side = {t for t, x in cells if x == s}
        side = set(range(1, n + 1)) - side if 1 in side else side
        key = ",".join(map(str, sorted(side)))
        want[key] = want.get(key, 0) + 1
    assert {r.taxa: r.weight for r in got} == want
    # two caterpillars that share the clusters of the first half
    trees = [[set(range(1, k + 1)) for k in range(2, n)], [set(range(1, k + 1)) for k in range(2, n // 2)] + [set(range(k, n + 1)) for k in range(n // 2, n)]]
    x = B.bits(n)
    rows = [(i, x.to_value(sum(1 << (t - 1) for t in c)), 1.0) for i, t in enumerate(trees, 1) for c in t + [{k} for k in range(1, n + 1)]]
    df = spark.createDataFrame(rows, f"tree_id int, mask {x.ddl}, weight double")
    can = lambda c: frozenset(set(range(1, n + 1)) - c if 1 in c else c)
    one, two = ({can(c) for c in t + [{k} for k in range(1, n + 1)]} for t in trees)
    assert T.robinson_foulds(df, n).collect()[0].d == len(one ^ two)
    assert T.consensus_splits(df, n, 99.0).count() == len(one & two)
    stats = {r.tree_id: r.n_taxa for r in T.tree_statistics(df, n).collect()}
    assert stats == {1: n, 2: n}
    d = {(r.t1, r.t2): r.d for r in T.average_distances(df, n, topological=True).collect()}
    assert d[1, n] == (sum((1 in s) != (n in s) for s in one) + sum((1 in s) != (n in s) for s in two)) / 2
    tree = W.tree_clusters(W.cluster_tree(df.filter("tree_id = 1").select("mask", "weight"), n), n)
    assert {frozenset(map(int, r.taxa.split(","))) for r in S.with_taxa(tree, n).collect()} == {frozenset(c) for c in trees[0]} | {frozenset({k}) for k in range(1, n + 1)}


def test_taxa_beyond_the_form_are_errors(spark):
    df = spark.createDataFrame([(64, 1)], "taxon int, site int")
    with pytest.raises(Exception, match="63"):
        S.presence_splits(df, 63).collect()
    with pytest.raises(Exception, match="taxon beyond"):
        S.presence_splits(df.selectExpr("200 as taxon", "site"), 100).collect()


def test_neighbor_net_of_many_taxa(spark):
    n = 70
    d = spark.createDataFrame([(i, j, float(j - i)) for i in range(1, n + 1) for j in range(i + 1, n + 1)], "t1 int, t2 int, d double")
    got = S.with_taxa(M.neighbor_net(d, ntax=n).filter("weight > 0.001"), n).collect()
    assert len(got) == n - 1 and all(abs(r.weight - 1) < 1e-6 for r in got)
    with pytest.raises(Exception, match="63"):
        M.neighbor_net(d).collect()
