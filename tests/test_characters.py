import math

import pytest
from pyspark.sql import functions as F

from cladeworks.operators import bootstrap as Z
from cladeworks.operators import char_distances as D
from cladeworks.operators import characters as C
from cladeworks.operators import distances as M


def chars(spark, rows):
    return spark.createDataFrame([(t, i + 1, c) for t, s in rows.items() for i, c in enumerate(s)], "taxon int, site int, ch string")


def one(df):
    return {(r.t1, r.t2): r.d for r in df.collect()}


def test_binary_distances(spark):
    n = D.binary_counts(C.pair_counts(chars(spark, {1: "1100", 2: "1010"}), gap="0"))
    assert one(D.dice(n)) == {(1, 2): 0.5} == one(D.gene_sharing(n)) == one(D.jaccard(n, compat=True))
    assert math.isclose(one(D.jaccard(n))[1, 2], 2 / 3)


def test_hamming_and_ambiguity(spark):
    p = C.pair_counts(chars(spark, {1: "acgtn-", 2: "acgaRa"}))
    assert one(D.hamming(p)) == {(1, 2): 1.0} and one(D.p_distance(p)) == {(1, 2): 0.25}
    assert math.isclose(one(D.jukes_cantor(p))[1, 2], 0.471457, abs_tol=1e-6)  # n against r counts as 2/8 of an equal site
    assert math.isclose(one(D.jukes_cantor(C.pair_counts(chars(spark, {1: "acgtr-", 2: "acgaRa"}))))[1, 2], -0.75 * math.log(1 - 0.2 / 0.75), abs_tol=1e-9)
    aa = C.pair_counts(chars(spark, {1: "NNXA", 2: "NDAA"}))
    assert one(D.hamming(aa, data_type="protein")) == {(1, 2): 1.0} and one(D.hamming(aa)) == {(1, 2): 1.0}
    q = C.pair_counts(chars(spark, {1: "ar", 2: "ag"}))
    assert one(D.hamming(q)) == {(1, 2): 0.0} and one(D.hamming(q, match_ambiguity=False)) == {(1, 2): 1.0}


@pytest.mark.parametrize("top, large", [(0.7, 1.0), (3.2, 4.0), (47.0, 60.0)])
def test_repair(spark, top, large):
    d = spark.createDataFrame([(1, 2, top), (1, 3, None)], "t1 int, t2 int, d double")
    assert one(D.repair(d)) == {(1, 2): top, (1, 3): large}


def test_models_agree_where_they_must(spark):
    a = "acgtacgtacgtacgtaacc"
    p = C.pair_counts(chars(spark, {1: a, 2: "gcgtacataagtacgtaacc"}))
    jc = one(D.jukes_cantor(p))[1, 2]
    assert math.isclose(one(D.felsenstein81(p))[1, 2], jc)
    # equal exchangeabilities and frequencies: the likelihood is that of one parameter
    import numpy as np

    assert math.isclose(one(D.ml_distance(p, np.ones((4, 4)), (0.25,) * 4))[1, 2], jc, abs_tol=1e-4)
    assert math.isclose(one(D.kimura2(p))[1, 2], one(D.felsenstein84(p))[1, 2], rel_tol=1e-9)
    assert one(D.gtr(p))[1, 2] > 0 and one(D.log_det(C.pair_counts(chars(spark, {1: a, 2: a}))))[1, 2] == pytest.approx(0, abs=1e-9)


def test_site_filters(spark):
    df = chars(spark, {1: "aac-", 2: "aagc", 3: "acgc"})
    s = {r.site: r for r in C.site_statistics(df, 3).collect()}
    assert s[1].constant and s[2].uninformative and s[3].uninformative and s[4].gaps == 1
    left = lambda **k: sorted({r.site for r in C.characters_filter(df, 3, **k).collect()})
    assert left(constant=True) == [2, 3, 4] and left(gap_sites=True) == [1, 2, 3] and left(codon_positions=(1,)) == [2, 3]


def test_tajima_and_haplotypes(spark):
    df = chars(spark, {1: "aaaa", 2: "aaac", 3: "aacc", 4: "aaaa"})
    t = C.tajima_d(df, 4).collect()[0]
    assert (t.sites, t.segregating) == (4, 2) and math.isclose(t.pi, (1 + 2 + 0 + 1 + 1 + 2) / 6)
    assert {(r.taxon, r.haplotype, r["size"]) for r in C.haplotypes(df).collect()} == {(1, 1, 2), (4, 1, 2), (2, 2, 1), (3, 3, 1)}


def test_phi(spark):
    same = C.phi_test(chars(spark, {t: s for t, s in enumerate(["a" * 12, "a" * 12, "c" * 12, "c" * 12, "g" * 12, "g" * 12], 1)}), window=2).collect()[0]
    assert same.informative == 12 and same.phi == 0
    assert C.phi_test(chars(spark, {1: "acgt", 2: "acgt"})).count() <= 1


def test_delta_of_four_taxa(spark):
    d = spark.createDataFrame([(1, 2, 3.0), (1, 3, 3.0), (2, 3, 4.0), (1, 4, 4.0), (2, 4, 3.0), (3, 4, 3.0)], "t1 int, t2 int, d double")
    assert {r.delta for r in M.delta_scores(d).collect()} == {1.0}
    groups = d.selectExpr("1 as rep", "*").unionByName(d.selectExpr("2 as rep", "*"))
    assert groups.transform(lambda x: M.upgma(x, ("rep",))).groupBy("rep").count().count() == 2


def test_bootstrap(spark):
    sites = spark.createDataFrame([(i,) for i in range(200)], "site int")
    d = Z.draws(sites, 5)
    assert {r.s for r in d.groupBy("rep").sum("times").toDF("rep", "s").collect()} == {200}
    p = Z.poisson(sites, 5).groupBy("rep").sum("times").toDF("rep", "s").collect()
    assert len(p) == 5 and all(130 < r.s < 270 for r in p)
    masks = spark.createDataFrame([(i, 2 if i < 190 else 4) for i in range(200)], "site int, mask long")
    got = {r["mask"]: r.confidence for r in Z.split_support(masks, d, 5).collect()}
    assert got[2] == 100.0


def test_draws_are_not_broadcast(spark):
    key = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(key, str(4 << 20))
    try:
        d = Z.draws(spark.range(20000).toDF("site"), 20).groupBy("rep").agg(F.sum("times").alias("s"), F.max("site")).collect()
    finally:
        spark.conf.unset(key)
    assert sorted(r.rep for r in d) == list(range(1, 21)) and {r.s for r in d} == {20000}


def test_samples_are_not_broadcast(spark):
    key = "spark.sql.maxBroadcastTableSize"
    masks = spark.range(2000000).filter("id < 20000").selectExpr("id as site", "2L as mask")
    spark.conf.set(key, str(4 << 20))
    try:
        got = Z.split_support(masks, Z.poisson(spark.range(20000).toDF("site"), 20), 20).collect()
    finally:
        spark.conf.unset(key)
    assert [(r["mask"], r.n, r.confidence) for r in got] == [(2, 20, 100.0)] and 19000 < got[0].weight < 21000
