from cladeworks import bridge as B
from cladeworks import reference_queries as R
from cladeworks.functions import networks as N


def test_repeated_columns_count_each_time(spark, monkeypatch):
    # the first column occurs three times; counted once, the splits or their weights differ
    sites = ["aaccc"] * 3 + ["aacac", "acaac", "acgtt"]
    rows = [(t + 1, i, col[t]) for i, col in enumerate(sites) for t in range(5)]
    monkeypatch.setattr(B, "dna", lambda spark, sf: spark.createDataFrame(rows, "taxon int, site int, ch string"))
    got = {r["mask"]: r["weight"] for r in R.QUERIES["char_parsimony_splits"](spark, "").collect()}
    want = {m: float(w) for m, w in N.parsimony_splits(["".join(s[t] for s in sites) for t in range(5)])}
    once = {m: float(w) for m, w in N.parsimony_splits(["".join(s[t] for s in sorted(set(sites))) for t in range(5)])}
    assert got == want != once
