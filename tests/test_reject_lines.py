from cladeworks.operators.reject_lines import parse_lines, rejects, valid_rows

G = "12,ABC_000000001.1,,https://a.example/x"
CASES = [
    ("genomes", G, True), ("genomes", G + "\r", True), ("genomes", G + "\r\r", False), ("genomes", '"12","ABC_000000001.1","5","null"', True), ("genomes", "12,ABC_000000001.1,,", True),
    ("genomes", "0,ABC_000000001.1,,", False), ("genomes", "2147483648,ABC_000000001.1,,", False), ("genomes", " 12,ABC_000000001.1,,", False), ("genomes", "12,ABC_00000001.1,,", False),
    ("genomes", "12,ABC_000000001.1,,FTP://h-1.x:99999/%41#~", True), ("genomes", "12,ABC_000000001.1,,ftp://h/%4", False), ("genomes", "12,ABC_000000001.1,,ftp://-h/", False), ("genomes", "12,ABC_000000001.1,,ftp://h", False),
    ("genomes", '12,ABC_000000001.1,,"https://a/x,y"', True), ("genomes", '12,ABC_000000001.1,,"https://a/x', False), ("genomes", '12,A"C,,', False), ("genomes", "1,2,3", False), ("genomes", "1,2,3,4,5", False), ("genomes", "", False), ("genomes", None, False),
    ("characters", "3,Name,DNA,4,acgt,AC-?", True), ("characters", "3,Name,dna,4,ACGT,ac gt", True), ("characters", '3,"a ""b"",\n c",DNA,4,acgt,acgt', True), ("characters", "3, ,DNA,4,acgt,acgt", False), ("characters", "3,N,AA,4,acgt,acgt", False),
    ("characters", "3,N,DNA,5,acgt,acgt", False), ("characters", "3,N,DNA,4,acgA,acga", False), ("characters", "3,N,DNA,4,,acgt", False), ("characters", "3,N,DNA,4,acg,acgt", False), ("characters", "3,N,Standard,3,01,012", False), ("characters", "3,N,Standard,2,01,0\t1", False),
    ("characters", "3,N,Protein,1,k,K", False), ("other", "1,2", False), (None, "1,2", False),
]


def frame(spark):
    rows = [(i, f, t, "x", "y") for i, (f, t, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "line_id long, feed string, line string, ok string, reason string")


def test_each_case(spark):
    got = {r.line_id: r for r in parse_lines(frame(spark)).collect()}
    assert {i: got[i].ok for i in got} == {i: ok for i, (*_, ok) in enumerate(CASES)}
    assert all(bool(r.faults) != r.ok for r in got.values())


def test_typed_rows_and_reasons(spark):
    p = parse_lines(frame(spark)).persist()
    g = {r.line_id: r for r in valid_rows(p, "genomes").collect()}
    assert g[0].taxon_id == 12 and g[0].genome_size is None and g[3].fasta_url is None and g[13].fasta_url == "https://a/x,y"
    c = {r.line_id: r for r in valid_rows(p, "characters").collect()}
    names = {c[i].taxon_name for i in c}
    assert 'a "b",\n c' in names and {"acgt", "AC-?"} <= {c[i].matrix for i in c}
    why = {(r.line_id, r.field, r.reason) for r in rejects(p).collect()}
    assert (16, None, "column count: 4 wanted, 3 found") in why and (14, None, "quoting") in why and (19, None, "null line") in why


def test_empty_and_repeated(spark):
    assert parse_lines(frame(spark).limit(0)).count() == 0
    one = spark.createDataFrame([(1, "genomes", G)] * 3, "line_id long, feed string, line string")
    assert [r.ok for r in parse_lines(one).collect()] == [True] * 3


def test_very_long_line(spark):
    n = 3_000_000
    df = spark.createDataFrame([(1, "characters", f"3,N,DNA,{n},acgt," + "acgta" * (n // 5)), (2, "genomes", G)], "line_id long, feed string, line string")
    assert all(r.ok for r in parse_lines(df).select("ok").collect())
