import random

from cladeworks.operators import hierarchy as H


def brute(parent):
    on, out = {}, {}
    for n in parent:
        seen, x = [], n
        while x is not None and x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen:
            cyc = seen[seen.index(x) :]
            if n in cyc:
                on[n] = min(cyc)
        else:
            out[n] = seen[::-1]
    return on, out


def links(spark, parent):
    return spark.createDataFrame([(a, b) for a, b in parent.items()], "node long, parent long")


def check(spark, parent):
    on, paths = brute(parent)
    df = links(spark, parent)
    assert {r.node: r.cycle_id for r in H.find_cycles(df).collect()} == on
    rows = {r.node: r for r in H.build_hierarchy(df).collect()}
    assert {n: list(r.path) for n, r in rows.items()} == paths
    for n, r in rows.items():
        below = {m for m, p in paths.items() if n in p}
        assert r["size"] == len(below) and r.depth == len(paths[n]) - 1 and r.root == paths[n][0]
        assert {m for m in rows if rows[m].root == r.root and r["first"] <= rows[m]["first"] <= r["last"]} == below
    pairs = {(r.ancestor, r.descendant, r.distance) for r in H.descendants(H.build_hierarchy(df)).collect()}
    assert pairs == {(a, n, len(p) - 1 - i) for n, p in paths.items() for i, a in enumerate(p[:-1])}


def test_random_forest_with_loops(spark):
    rnd = random.Random(4)
    parent = {i: (rnd.randrange(max(1, i - 4), i) if i > 3 else None) for i in range(1, 60)}
    parent |= {70: 71, 71: 72, 72: 70, 73: 70, 74: 73, 80: 80, 90: 999, 91: 90}
    check(spark, parent)


def test_star_and_chain(spark):
    check(spark, {1: None} | {i: 1 for i in range(2, 30)} | {i: i - 1 for i in range(30, 45)})


def test_only_loops_and_empty(spark):
    df = links(spark, {1: 2, 2: 1, 3: 1})
    assert {(r.node, r.cycle_id) for r in H.find_cycles(df).collect()} == {(1, 1), (2, 1)}
    assert H.build_hierarchy(df).count() == 0
    assert H.find_cycles(df.limit(0)).count() == 0 and H.build_hierarchy(df.limit(0)).count() == 0


def test_in_force(spark):
    rows = [(1, 0, "2020-01-01", "x"), (1, 5, "2021-01-01", "y"), (1, 5, "2021-01-01", "y"), (2, None, None, None), (None, 1, "2020-01-01", None), (3, 2, None, None), (3, 1, "2019-01-01", None)]
    df = spark.createDataFrame(rows, "taxon_id int, parent_id int, loaded_at string, node string").selectExpr("taxon_id", "parent_id", "cast(loaded_at as timestamp_ntz) loaded_at", "node as path")
    assert {(r.node, r.parent) for r in H.in_force(df).collect()} == {(1, 5), (2, None), (3, 1)}
