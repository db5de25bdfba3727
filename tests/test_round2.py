import json
import math
import time

import pytest
from pyspark.sql import functions as F

from cladeworks.functions import layouts as L
from cladeworks.functions import networks as N
from cladeworks.operators import bootstrap as Z
from cladeworks.operators import char_distances as D
from cladeworks.operators import characters as C
from cladeworks.operators import distances as M
from cladeworks.operators import networks as W
from cladeworks.operators import splits as S
from cladeworks.operators import trees as T
from cladeworks.operators.numbering import numbered
from cladeworks.sources import parse as P
from cladeworks.sources import read as R
from cladeworks.sources import write as O


def test_numbered_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("v"), F.lit("x").alias("no_"))
    got = sorted((r.v, r.no) for r in numbered(df.repartition(7), "v").collect())
    assert [n for _, n in got] == list(range(1000)) and numbered(df.limit(0), "v").count() == 0


def chars(spark, rows):
    return spark.createDataFrame([(t, i + 1, c) for t, s in rows.items() for i, c in enumerate(s)], "taxon int, site int, ch string")


def test_bootstrap_pipeline(spark):
    df = chars(spark, {1: "aaaaaaaaaa", 2: "aaaaaaaaat", 3: "ttttttttta", 4: "tttttttttt", 5: "tttttaaaat"})
    sample = Z.draws(df.select("site").distinct(), 6)
    reps = Z.bootstrap_pipeline(df, sample, D.p_distance)
    assert reps.select("rep").distinct().count() == 6
    got = {r["mask"]: r for r in Z.bootstrap_tree_splits(reps, 6).collect()}
    assert all(got[m].n == 6 for m in (2, 4, 8, 16, 30)) and all(0 < r.confidence <= 100 for r in got.values())
    # one replicate by hand: the same sites repeated
    one = sample.filter("rep = 1")
    rows = df.join(one, "site").select("taxon", F.explode(F.sequence(F.lit(1), "times")).alias("k"), "site", "ch")
    flat = rows.select("taxon", F.concat_ws("-", "site", "k").alias("site"), "ch")
    want = {r["mask"]: round(r.weight, 9) for r in M.tree_splits_of(D.p_distance(C.pair_counts(flat))).collect()}
    assert {r["mask"]: round(r.weight, 9) for r in reps.filter("rep = 1").collect()} == want
    assert Z.bootstrap_pipeline(df, sample, D.jukes_cantor, M.neighbor_net).count() > 0


def test_haplotype_groups_and_traits(spark):
    g = C.haplotype_groups(chars(spark, {1: "acgt", 2: "ac-t", 3: "acct", 4: "ttgt", 5: "acgt"}))
    rows = {r.taxon: (r.haplotype, r["size"]) for r in g.collect()}
    assert rows == {1: (1, 4), 2: (1, 4), 3: (1, 4), 5: (1, 4), 4: (4, 1)}  # 3 by way of 2
    t = spark.createDataFrame([(1, "n", "2"), (2, "n", "3"), (4, "n", "1"), (5, "place", "sea"), (1, "place", "sea")], "taxon int, trait string, value string")
    assert {(r.haplotype, r.trait, r.value) for r in C.haplotype_traits(g, t).collect()} == {(1, "n", 5.0), (4, "n", 1.0), (1, "place=sea", 2.0)}


def trees(spark, rows):
    return spark.createDataFrame([(i, sum(1 << (t - 1) for t in c), 1.0) for i, cs in rows.items() for c in cs], "tree_id int, mask long, weight double")


def test_tree_operators(spark):
    base = [[t] for t in range(1, 6)]
    df = trees(spark, {i: base + [[1, 2], [1, 2, 3]] for i in range(1, 21)} | {21: base + [[3, 4], [3, 4, 5]]})
    assert T.sample_trees(df, 3).select("tree_id").distinct().count() == 3 and T.sample_trees(df, 99).count() == df.count()
    kept = {(r.tree_id, r["mask"]) for r in T.triple_contraction(df, 5).collect()}
    assert (1, 3) in kept and (1, 7) in kept and (21, 12) not in kept and (21, 4) in kept
    out = {r["mask"]: r.weight for r in T.consensus_outline(df, 5).collect()}
    assert 28 in out and 24 in out  # without taxon 1: 3, 4, 5 and 4, 5
    names = spark.createDataFrame([(1, "one"), (2, "two")], "tree_id int, name string")
    gone = spark.createDataFrame([("two", 1)], "name string, weight int")
    assert {r.tree_id for r in T.trees_by_name(df.filter("tree_id < 4"), names, gone).collect()} == {1, 3}
    two = trees(spark, {1: [[1, 2], [3, 4]], 2: [[1, 3], [2, 4]], 3: [[1, 2], [3, 4]]})
    assert {(r.t1, r.t2): r.d for r in T.robinson_foulds(two, 5).collect()} == {(1, 2): 4.0, (1, 3): 0.0, (2, 3): 4.0}


def test_networks():
    e = [(10, 11, 1.0), (11, 1, 1.0), (11, 2, 1.0), (10, 12, 1.0), (12, 3, 1.0), (12, 4, 1.0)]
    leaves = {1: 1, 2: 2, 3: 3, 4: 4}
    got = N.species(e, leaves, {1: "a", 2: "a", 3: "a", 4: "b"})
    assert got["tight"] == [[1, 2], [3], [4]] and got["lacy"] == [[1, 2, 3], [4]] and [4] in got["loose"]
    assert N.leaf_order(e, leaves, "taxon") == [1, 2, 3, 4] and N.leaf_order(e, leaves, "reverse") == [4, 3, 2, 1]
    s = N.simplify([(1, 9, 1.0), (9, 8, 2.0), (8, 2, 1.0), (8, 7, 5.0), (7, 6, 5.0), (3, 3, 1.0)], {1, 2, 3})
    assert s == [(1, 2, 4.0)]
    edges, tips = N.cluster_network([(0b0011, 1.0), (0b0110, 2.0)], 4)
    assert len({c for _, c, _ in edges if sum(d == c for _, d, _ in edges) > 1}) == 1 and set(N.below(edges, tips).values()) >= {0b0011, 0b0110, 0b1111}


def test_filtered_super_network(spark):
    full = 0b11111
    rows = [(i, a, full & ~a) for i in (1, 2, 3) for a in (0b00011, 0b00111)] + [(4, 0b00110, full & ~0b00110)]
    df = spark.createDataFrame(rows, "tree_id int, a long, b long")
    got = {r["mask"]: r.weight for r in W.filtered_super_network(df, 5, min_trees=2, max_distortion=1).collect()}
    assert got[full & ~0b00011] == 3.0 and 0b00110 not in got


def test_outline_places_taxa_like_equal_angle(spark):
    rows = [(0b0110, 2.0), (0b1100, 1.0), (0b0010, 0.5), (0b1110, 1.5)]
    df = spark.createDataFrame(rows, "mask long, weight double")
    cycle = [1, 2, 3, 4]
    a = {r.taxon: (r.x, r.y) for r in W.outline(df, cycle).collect() if r.taxon}
    b = {r.taxon: (r.x, r.y) for r in W.equal_angle(df, cycle).collect()} | {}
    for t in (2, 3, 4):
        assert math.isclose(a[t][0], b[t][0], abs_tol=1e-9) and math.isclose(a[t][1], b[t][1], abs_tol=1e-9)
    assert a[1] == (0.0, 0.0)
    last = L.outline([(1, 2, 2.0), (3, 3, 1.0)], 4)[-1]
    assert abs(last[0]) < 1e-9 and abs(last[1]) < 1e-9


def test_split_filters(spark):
    df = spark.createDataFrame([(0b0110, 3.0), (0b1100, 2.0), (0b1010, 1.0), (0b0010, 1.0)], "mask long, weight double")
    assert {r["mask"] for r in S.filtered(df, 5, "closest_tree").collect()} == {0b0110, 0b0010}
    assert {r["mask"] for r in S.filtered(df, 5, "blob").collect()} == {0b0010}
    assert {r["mask"] for r in S.filtered(df, 5, threshold=2.0).collect()} == {0b0110, 0b1100}
    assert sorted(r.taxon for r in S.splits_cycle(df, 5).collect()) == [1, 2, 3, 4, 5]
    assert S.confidence_filter(df.withColumn("confidence", F.col("weight")), 2.0).count() == 2


def test_parsimony_of_missing_and_ambiguity():
    a = ["aaccg", "aaccg", "ttcag", "ttcag"]
    b = ["aaccn", "aacc-", "ttca?", "ttcar"]
    assert N.parsimony_splits(a) == N.parsimony_splits(b) and dict(N.parsimony_splits(a))[0b1100] == 3


def test_split_newick():
    leaves, splits = P.split_newick("(A:0,(B:0.5,((<2|C:0.25,<1|D:1):2,(E|1:3>|2:4>:5,F:6):7):8):9);")
    assert leaves == list("ABCDEF")
    got = {"".join(leaves[i] for i in s): w for s, w in splits}
    assert got["DE"] == 3 and got["CDE"] == 4 and got["CD"] == 2 and got["E"] == 5 and got["EF"] == 7 and got["C"] == 0.25
    with pytest.raises(P.FormatError):
        P.split_newick("(A,<1|B);")


def test_genome_and_network_blocks():
    text = "#NEXUS\nBEGIN GENOMES;\nDIMENSIONS ntax=2;\nFORMAT labels=yes accessions=yes multiPart=yes;\nMATRIX\n 'a b' X1 6 2 4 'file:///x/y,z.fa' 17 2 AC,\n c X2 3 1 3 ACG\n;\nEND;\n"
    assert P.nexus_genomes(text) == [("a b", "X1", 6, [("/x/y,z.fa", 17, 4, None), (None, None, 2, "AC")]), ("c", "X2", 3, [(None, None, 3, "ACG")])]
    net = "#NEXUS\nBEGIN NETWORK;\nVERTICES\n id=1 label='a' x=2.5,\n id=2\n;\nEDGES\n id=1 sid=1 tid=2 weight='0.5' color=red\n;\nEND;\n"
    assert P.nexus_network(net) == ([(1, "a", {"x": "2.5"}), (2, None, {})], [(1, 2, 0.5, {"color": "red"})])
    assert P.nexus_sets("#NEXUS\nBEGIN SETS;\nCHARSET c = 1-7\\3;\nEND;")[-1] == ("charset", "c", "7")


def test_many_genomes_in_linear_time():
    rows = ",\n".join(f"\t'it''s, {i}' X{i} 6 2 4 'file:///x/y,z{i}.fa' {i} 2 AC" for i in range(20000))
    text = f"#NEXUS\nBEGIN GENOMES;\nFORMAT labels=yes accessions=yes multiPart=yes; [a, b; 'c]\nMATRIX\n{rows}\n;\nEND;\n"
    began = time.process_time()
    got = P.nexus_genomes(text)
    assert time.process_time() - began < 20
    assert len(got) == 20000 and got[-1] == ("it's, 19999", "X19999", 6, [("/x/y,z19999.fa", 19999, 4, None), (None, None, 2, "AC")])
    assert list(P.nexus_genome_rows(text[:5000])) == list(P.nexus_genome_rows([text[:5000]]))  # cut at each character


def test_genome_labels_of_taxa_block():
    taxa, genomes = "BEGIN TAXA;\nTAXLABELS 'a b' c;\nEND;\n", "BEGIN GENOMES;\nMATRIX\n 2 AC,\n 3 ACG\n;\nEND;\n"
    for text in (taxa + genomes, genomes + taxa):
        assert P.nexus_genomes("#NEXUS\n" + text) == [("a b", None, 2, [(None, None, 2, "AC")]), ("c", None, 3, [(None, None, 3, "ACG")])]


def test_genomes_block_in_batches(spark, tmp_path):
    n = 25000  # more than a batch of rows, and of lines
    g = spark.range(n).selectExpr("cast(id as int) as taxon", "concat('t ', id) as name", "concat('X', id) as accession", "9 as length", "array(named_struct('file', 'f,', 'offset', id, 'length', 9, 'seq', cast(null as string))) as parts")
    O.nexus_genomes(g).coalesce(1).write.text(str(tmp_path / "g"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = R.genomes(spark, str(tmp_path / "g")).selectExpr("taxon", "name", "accession", "parts[0].offset as o").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(tuple(r) for r in got) == [(i + 1, f"t {i}", f"X{i}", i) for i in range(n)]


def test_cli(spark, tmp_path):
    from cladeworks.plans import cli

    fa = tmp_path / "a.fasta"
    fa.write_text(">x\nacgt\n>y\nacga\n>z\nttga\n")
    spec = tmp_path / "s.json"
    spec.write_text(json.dumps([{"name": "p", "op": "pair_counts", "from": ["c"]}, {"name": "d", "op": "p_distance", "from": ["p"]}, {"name": "t", "op": "upgma", "from": ["d"]}]))
    cli.main([str(spec), "--sequences", f"c={fa}", "--export", f"t={tmp_path}/out", "--export", f"d={tmp_path}/csv", "--format", "csv", "--methods"], spark)
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 3 and spark.read.csv(f"{tmp_path}/out", header=True).count() == 4


def test_log_det_options(spark):
    p = C.pair_counts(chars(spark, {1: "acgtacgtacg-", 2: "acgtacttac?a"}))
    plain, fudged = (D.log_det(p, fudge=f).collect()[0].d for f in (False, True))
    import numpy as np

    m = np.diag([3.0, 3.0, 1.0, 2.0])
    m[2, 3] = 1

    def ld(f):
        f = f / f.sum()
        x, y = f.sum(1), f.sum(0)
        return -(1 - (((x + y) / 2) ** 2).sum()) / 3 * (np.log(np.linalg.eigvals(f).real).sum() - (np.log(x) + np.log(y)).sum() / 2)

    assert math.isclose(plain, ld(m), abs_tol=1e-9)
    row, col = np.array([0, 0, 1 / 2, 0]), np.array([1 / 3, 0, 0, 0])
    assert math.isclose(fudged, ld(m * (1 + row[:, None] + col[None, :])), abs_tol=1e-9)
    filled = m * (1 + row[:, None] + col[None, :])
    filled[filled < 0.5] = 0.5
    assert math.isclose(D.log_det(p, fudge=True, fill_zeros=True).collect()[0].d, ld(filled), abs_tol=1e-9)


def test_block_details():
    text = (
        "#NEXUS\nBEGIN TAXA;\nDIMENSIONS NTAX=2;\nTAXLABELS a 'b c';\nTAXINFO 'first one' null;\nDISPLAYLABELS null '<i>b</i>';\nEND;\n"
        "BEGIN CHARACTERS;\nDIMENSIONS NCHAR=3;\nCHARWEIGHTS 1 2.5 1;\nCHARSTATELABELS 1 eye / red blue, 3 leg;\nMATRIX\na 010\n'b c' 111\n;\nEND;\n"
        "BEGIN SPLITS;\nPROPERTIES FIT=98.5 circular;\nCYCLE 1 2;\nMATRIX\n[1, size=1]\t1.0\t2,\n;\nEND;\n"
        "BEGIN TREES;\nPROPERTIES partialTrees=yes rooted=no;\nTREE t = (a,b);\nEND;\n"
        "BEGIN TRAITS;\nDIMENSIONS NTRAITS=2;\nTRAITLATITUDE 53 43.7;\nTRAITLONGITUDE 16 -5;\nTRAITCOLOR red '';\nTRAITLABELS x y;\nMATRIX\na 1 2\n;\nEND;\n"
    )
    assert P.nexus_taxa_details(text) == [("a", "first one", None), ("b c", None, "<i>b</i>")]
    assert P.nexus_sites(text) == [(1, 1.0, "eye", ["red", "blue"]), (2, 2.5, None, []), (3, 1.0, "leg", [])]
    assert P.nexus_split_properties(text) == (98.5, "circular", None, [1, 2]) and P.nexus_tree_properties(text) == (True, False, False)
    assert P.nexus_trait_details(text) == [("x", 53.0, 16.0, "red"), ("y", 43.7, -5.0, None)]
    assert P.nexus_split_properties("#NEXUS\n") is None


def test_trees_of_splits_and_support(spark):
    base = [[t] for t in range(1, 6)]
    df = trees(spark, {i: base + [[2, 3], [2, 3, 4]] for i in (1, 2, 3)} | {4: base + [[3, 4], [3, 4, 5]]})
    for method, n in (("strict", 0), ("majority", 2), ("greedy", 2)):
        t = W.consensus_tree(df, 5, method)
        got = {r["mask"] for r in T.tree_splits(W.tree_clusters(t, 5), 5).collect()} - {2, 4, 8, 16, 30}
        assert len(got) == n and got <= {6, 14}
    support = T.consensus_splits(df, 5, 0.0).select("mask", "confidence")
    rows = W.with_support(W.consensus_tree(df, 5), support, 5).collect()
    assert {r.confidence for r in rows if r.taxon} == {100.0} and 75.0 in {r.confidence for r in rows}
    assert {r["mask"] for r in T.selected_splits(df, 5, 4).collect()} >= {12, 28} and T.tree_shapley(df, 5).count() == 5
    xy = {r.node: (r.x, r.y) for r in W.layouts(W.consensus_tree(df, 5), "triangular").collect()}
    assert sum(x == 0 for x, _ in xy.values()) == 5


def test_sketch_files(spark, tmp_path):
    from cladeworks.operators import sketches as K

    seqs = spark.createDataFrame([("g1", "acgtacgtaacc"), ("g2", "acgtacgtttgg"), ("g2", None)], "genome string, seq string")
    s = K.sketch(seqs, 5, 4)
    K.sketch_lines(s).write.text(f"{tmp_path}/s")
    back = {r.genome: r.tokens for r in K.read_sketches(spark, f"{tmp_path}/s").collect()}
    assert back == {g: sorted(r.h[:16] for r in s.collect() if r.genome == g) for g in ("g1", "g2")} and len(back["g1"]) == 4
