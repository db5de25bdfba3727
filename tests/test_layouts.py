import math

from cladeworks.functions import layouts as L

TREE = [(4, 3, 1.0), (4, 2, 3.0), (3, 0, 2.0), (3, 1, 1.0)]


def test_rectangular():
    xy = L.rectangular(TREE)
    assert xy[4][0] == 0 and xy[0] == (3.0, 0.0) and xy[1] == (2.0, 1.0) and xy[2] == (3.0, 2.0) and xy[3] == (1.0, 0.5)
    assert {v: x for v, (x, _) in L.rectangular(TREE, by_weight=False).items()} == {0: 0, 1: 0, 2: 0, 3: -1, 4: -2}


def test_circular_keeps_radii():
    assert {v: round(math.hypot(*p), 9) for v, p in L.circular(TREE).items()} == {4: 0, 3: 1, 0: 3, 1: 2, 2: 3}


def test_radial_keeps_lengths():
    at = L.radial(TREE)
    assert all(math.isclose(math.dist(at[p], at[c]), w) for p, c, w in TREE)


def test_equal_angle_matches_tables(spark):
    from cladeworks.operators import networks as W

    splits = [(0b0110, 2.0), (0b0010, 1.0), (0b1100, 0.5)]
    want = L.equal_angle([1, 2, 3, 4], splits)
    got = {r.taxon: (r.x, r.y) for r in W.equal_angle(spark.createDataFrame(splits, "mask long, weight double"), [1, 2, 3, 4]).collect()}
    assert want[1] == (0.0, 0.0) and all(math.dist(want[t], got[t]) < 1e-9 for t in got) and set(got) == {2, 3, 4}
