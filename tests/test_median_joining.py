from cladeworks.functions import networks as N


def cube(k):
    """All sequences of k two-state sites, and three that only medians join to them by steps of one site."""
    seqs = [format(x, f"0{k}b") + "000" for x in range(2**k)] + ["0" * k + e for e in ("011", "101", "110")]
    return {i: s for i, s in enumerate(sorted(seqs), 1)}


def test_medians_are_made_beyond_2000_sequences():
    for k in (2, 11):
        rows = cube(k)
        seqs, edges = N.median_joining(rows, [1.0] * (k + 3))
        assert {s for v, s in seqs.items() if v < 0} == {"0" * k + e for e in ("001", "010", "100", "111")}
        # the hypercube of k sites, and that of the last three sites, which share a node
        assert len(edges) == k * 2 ** (k - 1) + 12 and {w for *_, w in edges} == {1.0}
        assert all(seqs[v] == s for v, s in rows.items())
