import json

import pytest

from cladeworks.plans import pipeline as P
from cladeworks.streaming import loads as L

SPEC = [
    {"name": "pairs", "op": "pair_counts", "from": ["characters"]},
    {"name": "d", "op": "hamming", "from": ["pairs"], "options": {"normalize": True}},
    {"name": "fixed", "op": "repair", "from": ["d"]},
    {"name": "tree", "op": "neighbor_joining", "from": ["fixed"]},
]


def chars(spark):
    rows = {1: "aacc", 2: "aaca", 3: "ccca", 4: "ccaa"}
    return spark.createDataFrame([(t, i, c) for t, s in rows.items() for i, c in enumerate(s)], "taxon int, site int, ch string")


def test_pipeline(spark):
    out = P.run(json.dumps(SPEC), {"characters": chars(spark)})
    assert {(r.t1, r.t2): r.d for r in out["fixed"].collect()}[1, 4] == 1.0 and out["tree"].count() == 5
    assert P.methods(SPEC).splitlines()[1].startswith("d: hamming of pairs (normalize = True).")


@pytest.mark.parametrize("step, message", [
    ({"name": "x", "op": "nothing", "from": []}, "no operator"), ({"name": "x", "op": "upgma", "from": ["characters"]}, "lacks t1"), ({"name": "x", "op": "fits", "from": ["characters"]}, "2 inputs"),
    ({"name": "characters", "op": "pair_counts", "from": ["characters"]}, "new name"), ({"name": "x", "op": "pair_counts", "from": ["y"]}, "no input"), ({"name": "x", "op": "pair_counts", "from": ["characters"], "options": {"z": 1}}, "z"),
])
def test_errors_come_before_jobs(spark, step, message):
    with pytest.raises(P.PipelineError, match=message):
        P.run([step], {"characters": chars(spark)})


def test_streams(spark, tmp_path):
    rows = [(1, "genomes", "12,ABC_000000001.1,,", "2024-01-01"), (2, "genomes", '1,"x', "2024-01-01"), (3, "characters", "3,N,DNA,4,acgt,acgt", "2024-01-02")]
    df = spark.createDataFrame(rows, "line_id long, feed string, line string, t string").selectExpr("line_id", "feed", "line", "cast(t as timestamp) received_at")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = L.write_judged(stream(), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "ok/genomes")).count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    q = L.reject_counts(stream()).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.feed, r.n, r.n_rejected) for r in spark.table("counts").collect()} == {("genomes", 2, 1), ("characters", 1, 0)}
    got = []
    refs = spark.createDataFrame([("t", 1, "2024-01-05"), ("t", 2, "2024-01-05")], "ref_table string, ref_id long, d string").selectExpr("ref_table", "ref_id", "cast(d as timestamp) at")
    refs.write.parquet(str(tmp_path / "refs"))
    parents = spark.createDataFrame([(1, "2024-01-01")], "taxon_id int, d string").selectExpr("taxon_id", "cast(d as timestamp) loaded_at", "cast(null as timestamp) deleted_at")
    q = L.check_stream(spark.readStream.schema(refs.schema).parquet(str(tmp_path / "refs")), lambda: parents, lambda o, n: got.extend(o.collect()), str(tmp_path / "cp2"))
    q.processAllAvailable()
    q.stop()
    assert [(r.ref_id, r.status) for r in got] == [(2, "missing")]
