import random

from cladeworks.operators import orphans as O


def ts(d):
    return None if d is None else f"2024-01-{d:02d} 00:00:00"


def run(spark, refs, parents):
    r = spark.createDataFrame([(k, ts(t), "x") for k, t in refs], "taxon_id int, at string, status string").selectExpr("taxon_id", "cast(at as timestamp_ntz) loaded_at", "status")
    p = spark.createDataFrame([(k, ts(s), ts(e), "y") for k, s, e in parents], "taxon_id int, s string, e string, day string").selectExpr("taxon_id", "cast(s as timestamp_ntz) loaded_at", "cast(e as timestamp_ntz) deleted_at", "day")
    return O.check_references(O.references("t", r, "taxon_id"), p)


def want(k, t, parents):
    mine = [(s, e) for q, s, e in parents if q == k and s is not None]
    before = [(s, e) for s, e in mine if t is not None and s <= t]
    if any(e is None or e > t for s, e in before):
        return "valid"
    return "deleted" if before else "late" if mine else "missing"


def test_random(spark):
    rnd = random.Random(1)
    parents = [(rnd.randint(1, 5), rnd.choice([None, *range(1, 28)]), rnd.choice([None, *range(1, 28)])) for _ in range(40)]
    refs = [(rnd.choice([None, 0, *range(1, 8)]), rnd.choice([None, *range(1, 28)])) for _ in range(300)]
    got = {(r.ref_id, None if r["at"] is None else r["at"].day): (r.status, r.n_refs) for r in run(spark, refs, parents).collect()}
    exp = {}
    for k, t in refs:
        if k:
            exp[k, t] = (want(k, t, parents), exp.get((k, t), (0, 0))[1] + 1)
    assert got == exp


def test_report_and_empty(spark):
    x = run(spark, [(1, 5), (1, 5), (2, 6), (3, 1)], [(1, 1, None), (2, 1, 3), (3, 4, None)])
    assert {(r.ref_id, r.status, r.n_refs) for r in O.orphans(x).collect()} == {(2, "deleted", 1), (3, "late", 1)}
    r = O.orphan_report(x).collect()[0]
    assert (r.load_month, r.n_refs, r.n_valid, r.n_missing, r.n_deleted, r.n_late) == ("2024-01", 4, 2, 0, 1, 1)
    assert run(spark, [(1, 1)], [(1, 1, 1)]).collect()[0].status == "deleted"
    e = run(spark, [(1, 1)], [(1, 1, 1)]).limit(0)
    assert O.orphans(e).count() == 0
