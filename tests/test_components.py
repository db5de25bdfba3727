import random

from cladeworks.operators.components import components


def test_against_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(20)] + [(300, 300), (None, 1)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            up[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {x: find(x) for x in up}
    assert components(df.limit(0)).count() == 0
