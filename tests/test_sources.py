import pytest

from cladeworks.sources import parse as P
from cladeworks.sources import read as R
from cladeworks.sources import write as W

ROWS = [(1, "a_1", "ACGT-ACGTA"), (2, "b", "ACGTTACGTA"), (3, "c c", "AC?TTACGTA")]


def chars(spark, rows=ROWS[:2]):
    return spark.createDataFrame(rows, "taxon int, name string, seq string")


def text(df):
    return "\n".join(r.value for r in df.collect()) + "\n"


@pytest.mark.parametrize("kind, make", [("fasta", W.fasta), ("phylip", W.phylip_sequences), ("clustal", lambda c: W.clustal(c, 4)), ("nexus", W.nexus_characters)])
def test_round_trip_of_sequences(spark, tmp_path, kind, make):
    rows = ROWS if kind in ("nexus", "fasta") else ROWS[:2]
    f = tmp_path / "x.txt"
    f.write_text(text(make(chars(spark, rows))))
    assert P.sniff(f.read_text()) == kind
    got = [(r.taxon, r.name, r.seq) for r in R.characters(spark, str(f)).orderBy("taxon").collect()]
    assert got == rows


def test_fasta_records(spark, tmp_path):
    f = tmp_path / "x.fa"
    f.write_text(">a one\nAC\nGT\n>b\r\nA\r\n\n>c\n")
    assert [(r.name, r.seq) for r in R.fasta_records(spark, str(f)).collect()] == [("a one", "ACGT"), ("b", "A"), ("c", "")]


def test_ragged_is_an_error(spark, tmp_path):
    f = tmp_path / "x.fa"
    f.write_text(">a\nAC\n>b\nA\n")
    with pytest.raises(Exception, match="different lengths"):
        R.characters(spark, str(f)).collect()


def test_other_alignments():
    assert P.stockholm("# STOCKHOLM 1.0\n#=GF x\na AC\nb GT\n\na A\nb C\n//\n") == [("a", "ACA"), ("b", "GTC")]
    assert P.msf("x MSF: 4\n Name: a Len: 4\n Name: b Len: 4\n//\na AC GT\nb A.~T\n") == [("a", "ACGT"), ("b", "A--T")]
    assert P.phylip_sequences("2 6\na ACG\nb TTT\n\nTTT\nCCC\n") == [("a", "ACGTTT"), ("b", "TTTCCC")]
    rows, options = P.nexus_characters("#NEXUS\nbegin data;\ndimensions ntax=2 nchar=4;\nformat datatype=dna interleave matchchar=.;\nmatrix\na AC\nb .G\n\na GT\nb ..\n;\nend;")
    assert rows == [("a", "ACGT"), ("b", "AGGT")] and options["datatype"] == "dna"


D = [("a", "b", 3.0), ("a", "c", 3.0), ("b", "c", 4.0)]


@pytest.mark.parametrize("make", [W.phylip_distances, W.nexus_distances])
def test_round_trip_of_distances(spark, tmp_path, make):
    f = tmp_path / "d.txt"
    f.write_text(text(make(spark.createDataFrame(D, "name1 string, name2 string, d double"))))
    assert sorted(tuple(r)[1:] for r in R.distances(spark, str(f)).collect()) == D


def test_distance_dialects():
    assert sorted(P.phylip_distances("3\na\nb 3\nc 3 4\n")) == D
    assert sorted(P.csv_distances("# x\n,a,b,c\na,0,3,3\nb,3,0,4\nc,3,4,0\n")) == D
    assert sorted(P.csv_distances("3\na,0,3,3\nb,3,0,4\nc,3,4,0\n")) == D
    assert sorted(P.csv_distances("0,3\n3,0\n")) == [("t1", "t2", 3.0)]
    low = "#nexus\nbegin taxa;\ntaxlabels a b c;\nend;\nbegin distances;\nformat triangle=lower nodiagonal labels=no;\nmatrix\n3\n3 4\n;\nend;"
    assert sorted(P.nexus_distances(low)) == D


def test_trees(spark, tmp_path):
    f = tmp_path / "t.tre"
    f.write_text("((a:1,b:2):3,'c d':4);\n((a:1,(x:1)h#H1:1):2,(h#H1:0.5,b:1):1);\n")
    t = R.trees(spark, str(f))
    e = R.tree_edges(t)
    one = {(r.label, r.weight) for r in e.filter("tree_no = 1").collect()}
    assert one == {("a", 1.0), ("b", 2.0), (None, 3.0), ("c d", 4.0)}
    ret = e.filter("tree_no = 2 and reticulate").collect()
    assert len(ret) == 2 and len({r.child for r in ret}) == 1 and {r.weight for r in ret} == {1.0, 0.5}
    assert [r.value for r in W.newick(e.filter("tree_no = 1")).collect()] == ["((a:1,b:2):3,c d:4);"]
    nx = "#NEXUS\nbegin trees;\ntranslate 1 a, 2 b, 3 'c c';\ntree x = [&R] ((1:1,2:2):1,3:1);\nend;"
    assert P.nexus_trees(nx) == [("x", "((a:1,b:2):1,'c c':1);")]
    with pytest.raises(P.FormatError):
        P.newick("((a,b);")


def test_splits_traits_sets_gml(spark, tmp_path):
    s = spark.createDataFrame([(6, 2.5), (2, 1.0)], "mask long, weight double")
    f = tmp_path / "s.nex"
    f.write_text(text(W.nexus_splits(s, ["a", "b", "c"])))
    assert [(list(r.side), r.weight) for r in R.splits(spark, str(f)).orderBy("split_id").collect()] == [([2], 1.0), ([2, 3], 2.5)]
    assert [r.value for r in W.splits_fasta(s, ["a", "b", "c"]).orderBy("value").collect()] == [">a\n00", ">b\n11", ">c\n01"]
    assert P.nexus_traits("#nexus\nbegin traits;\nformat labels=yes separator=comma;\ntraitlabels p q;\nmatrix\na 1,2\nb 3,4\n;\nend;") == [("a", "p", "1"), ("a", "q", "2"), ("b", "p", "3"), ("b", "q", "4")]
    assert P.nexus_sets("#nexus\nbegin sets;\ntaxset x = a b;\ncharset y = 2-4;\nend;") == [("taxset", "x", "a"), ("taxset", "x", "b"), ("charset", "y", "2"), ("charset", "y", "3"), ("charset", "y", "4")]
    nodes = spark.createDataFrame([(1, "a"), (2, None)], "id int, label string")
    edges = spark.createDataFrame([(1, 2, 0.5)], "src int, dst int, weight double")
    g = W.gml(nodes, edges).collect()[0].value
    assert P.gml(g) == ([(1, "a"), (2, "")], [(1, 2, 0.5)])


def test_nexml(spark, tmp_path):
    f = tmp_path / "t.xml"
    f.write_text('<nex xmlns="x"><trees><tree id="t"><node id="a"/><edge source="a" target="b" length="2"/><edge source="a" target="c"/></tree></trees></nex>')
    assert [(r.tree, r.source, r.target, r.length) for r in R.nexml_trees(spark, str(f)).collect()] == [("t", "a", "b", 2.0), ("t", "a", "c", None)]
