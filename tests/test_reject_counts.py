from datetime import datetime

from cladeworks.streaming import loads as L
from tests.test_reject_lines import CASES


def test_every_kind_of_reject_is_counted(spark, tmp_path):
    day = [datetime(2024, 1, 1 + i % 2, 12) for i in range(len(CASES) + 1)]
    lines = [(f, t, d) for (f, t, _), d in zip(CASES, day)] + [("characters", "3,a\nb,DNA,4,acgt,acgt", day[-1])]
    good = [ok for *_, ok in CASES] + [False]
    spark.createDataFrame(lines, "feed string, line string, received_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("feed string, line string, received_at timestamp").parquet(str(tmp_path / "in"))
    q = L.reject_counts(stream).writeStream.outputMode("complete").format("memory").queryName("every_kind").start()
    q.processAllAvailable()
    q.stop()
    want = {}
    for (feed, _, d), ok in zip(lines, good):
        n, bad = want.get((d.day, feed), (0, 0))
        want[d.day, feed] = (n + 1, bad + (not ok))
    assert {(r.start.day, r.feed): (r.n, r.n_rejected) for r in spark.table("every_kind").collect()} == want
    assert (sum(b for _, b in want.values()), len(lines)) == (26, 35)


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "feed string, line string, received_at timestamp"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = None
    for day in (10, 1, 11):
        spark.createDataFrame([("genomes", "1,2,3", datetime(2024, 1, day, 12))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = q or L.reject_counts(stream).writeStream.outputMode("update").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
    q.stop()
    assert {(r.start.day, r.n, r.n_rejected) for r in spark.table("late").collect()} == {(10, 1, 1), (11, 1, 1)}
