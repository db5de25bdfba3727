import math

import pytest

from cladeworks.functions import networks as N
from cladeworks.operators import networks as W

# root 0 -> 1, 2; 1 -> 3(a), 4; 2 -> 4, 5(c); 4 -> 6(b): one reticulation, node 4
NET = [(0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0), (2, 4, 1.0), (2, 5, 1.0), (4, 6, 1.0)]
LEAVES = {3: 1, 6: 2, 5: 3}
TREE = [(0, 1, 1.0), (0, 5, 1.0), (1, 3, 1.0), (1, 6, 1.0)]


def clusters(edges, leaves=LEAVES):
    return set(N.below(edges, leaves).values())


def test_kernels_on_one_reticulation():
    assert N.stable_ancestors(NET)[4] == 0 and N.stable_ancestors(NET)[6] == 4
    assert N.network_class(NET, set(LEAVES)) == "normal" and N.network_class(TREE, set(LEAVES)) == "tree"
    assert clusters(N.lsa_tree(NET, set(LEAVES))) == {1, 2, 4, 7}
    assert clusters(N.blob_tree(NET, set(LEAVES))) == {1, 2, 4, 7}
    got = [clusters(t) for t in N.contained_trees(NET, LEAVES)]
    assert {1, 2, 4, 3, 7} in got and {1, 2, 4, 6, 7} in got and len(got) == 2
    assert N.displays(NET, TREE, LEAVES, LEAVES) and not N.displays(NET, [(0, 1, 1), (0, 6, 1), (1, 3, 1), (1, 5, 1)], LEAVES, LEAVES)
    assert clusters(N.normalize(NET, set(LEAVES))) == clusters(NET)
    assert (1, 2, 1) in N.path_multiplicities(NET, LEAVES)


def test_classes():
    # two reticulations below one node: neither tree-child nor normal, but tree-based
    e = [(0, 1, 1), (0, 2, 1), (1, 3, 1), (1, 4, 1), (2, 3, 1), (2, 4, 1), (3, 5, 1), (4, 6, 1)]
    assert N.network_class(e, {5, 6}) == "tree_based"
    short = [(0, 1, 1), (0, 2, 1), (1, 2, 1), (1, 3, 1), (2, 4, 1), (0, 5, 1)]
    assert N.network_class(short, {3, 4, 5}) == "tree_child"


def test_cycles_are_errors():
    with pytest.raises(ValueError):
        N.topological([(0, 1, 1), (1, 2, 1), (2, 1, 1)])


def test_reroot_keeps_lengths():
    t = N.reroot(TREE, {6})
    assert clusters(t) == {1, 2, 4, 5, 7} and math.isclose(sum(w for *_, w in t), 4.0)


def test_stretch():
    e = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 2.0), (3, 4, 1.0)]
    assert sorted(N.stretch_filter(e, [1, 2, 3, 4], 0)) == [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)]


def test_z_closure():
    # two overlapping partial trees on 5 taxa that fit one tree
    full = 0b11111
    got = N.z_closure([(0b00011, 0b01100), (0b00110, 0b11000), (0b00011, 0b11000)], 5)
    assert all(a | b == full and not a & b for a, b in got)
    assert N.z_closure([(0b00011, 0b11100)], 5) == [(0b00011, 0b11100)]


def test_median_joining_finds_the_median():
    rows = {1: "aaa", 2: "abb", 3: "bab"}
    seqs, edges = N.median_joining(rows, [1.0] * 3)
    assert "aab" in seqs.values() and len(edges) == 3 and all(w == 1 for *_, w in edges)
    assert N.median_joining({1: "aa", 2: "ab"}, [1.0] * 2)[1] == [(1, 2, 1.0)]


def test_parsimony_splits():
    got = dict(N.parsimony_splits(["aaca", "aacc", "cgca", "cgcc", "cgcc"][:4]))
    assert 0b1100 in got and got[0b1100] >= 1


def test_clusters_to_edges():
    e = N.clusters_to_edges([(0b0011, 2.0), (0b0111, 1.0)], 4)
    assert {m for m in N.below(e, {i: i + 1 for i in range(4)}).values()} == {1, 2, 4, 8, 3, 7, 15}


def test_operators_run_by_network(spark):
    rows = [(k, p, c, w, LEAVES.get(c)) for k, net in ((1, NET), (2, TREE)) for p, c, w in net]
    df = spark.createDataFrame(rows, W.EDGES)
    assert {(r.net_id, r["class"]) for r in W.classes(df).collect()} == {(1, "normal"), (2, "tree")}
    assert {r.net_id for r in W.class_filter(df, "tree").collect()} == {2}
    t = W.contained_trees(df).select("net_id", "tree_no").distinct().collect()
    assert {(r.net_id, r.tree_no) for r in t} == {(1, 1), (1, 2), (2, 1)}
    for f in (W.lsa_trees, W.blob_trees, W.normalized):
        assert {r.taxon for r in f(df).filter("net_id = 1 and taxon is not null").collect()} == {1, 2, 3}


def test_sketch_search_and_ancestor(spark):
    from cladeworks.operators import sketches as K

    df = spark.createDataFrame([(20, list("abcdefgh")), (2, list("abcdefgx")), (3, list("abcdxyzw")), (4, list("abcdefgh")), (40, []), (60, ["q"])], "id int, tokens array<string>")
    x = K.search(df, df.filter("id % 20 = 0"), 1, 0.5, 25)
    want = sorted((round(-math.log(2 * j / (1 + j)), 9), i) for i, j in ((2, 7 / 9), (4, 1.0), (3, 4 / 12)) if -math.log(2 * j / (1 + j)) <= 0.5)
    assert [(round(r.d, 9), r.id) for r in x.orderBy("rank").collect()] == [(abs(d), i) for d, i in want] and {r["query"] for r in x.collect()} == {20}
    paths = spark.createDataFrame([(2, [1, 7, 2]), (4, [1, 7, 4]), (3, [9, 3])], "node int, path array<int>")
    assert [(r.n, r.ancestor) for r in K.lowest_common(x.filter("id <> 3"), paths).collect()] == [(2, 7)]
    assert [r.ancestor for r in K.lowest_common(x.filter("id <> 3").unionByName(x.filter("id = 2").withColumn("id", (x.id + 1))), paths).collect()] == [None]


def test_bloom(spark):
    from cladeworks.operators import sketches as K

    df = spark.createDataFrame([("a",), ("b",), ("c",)], "h string")
    words = K.bloom_filter(df, 1024, 3)
    hits = {r.h: r.hit for r in K.bloom_contains(spark.createDataFrame([(c,) for c in "abcdefgh"], "h string"), words, 1024, 3).collect()}
    assert hits["a"] and hits["b"] and hits["c"] and sum(hits.values()) <= 4
    s = K.bloom_statistics(spark.createDataFrame([(1, "0F"), (2, "ff"), (3, None), (4, "")], "i int, f string"), "i", "f").collect()
    assert {(r.id, r.bits, r.ones, r.estimate is None) for r in s} == {(1, 8, 4, False), (2, 8, 8, True)}
