import random

from cladeworks.llm import set_join as J


def brute(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if any(x and y and len(x & y) >= t * len(x | y) - 1e-12 for x in sets[a] for y in sets[b])}


def pairs(spark, rows, t, kind="array<long>"):
    df = spark.createDataFrame(rows, f"taxon int, vals {kind}, id string, tokens string, cid string")
    return {(r.id_a, r.id_b) for r in J.expand(*J.similar_classes(J.encode_sets(df, "taxon", "vals"), t)).collect()}


def rows_of(sets):
    return [(k, list(v), "x", "y", "z") for k, vs in sets.items() for v in vs]


def random_sets(rnd, n):
    out = {}
    for i in range(n):
        if i and rnd.random() < 0.6:
            base = set(rnd.choice(list(out.values()))[0])
            for _ in range(rnd.randrange(4)):
                base.discard(rnd.randrange(60)) if rnd.random() < 0.5 else base.add(rnd.randrange(60))
            out[i] = [base or {1}]
        else:
            out[i] = [{rnd.randrange(60) if rnd.random() < 0.6 else rnd.randrange(3) for _ in range(rnd.randrange(1, 14))}]
    return out


def test_against_brute_force(spark):
    for seed, t in ((1, 0.5), (2, 0.8), (3, 0.34)):
        sets = random_sets(random.Random(seed), 90)
        assert pairs(spark, rows_of(sets), t) == brute(sets, t)


def test_long_lists_and_heavy_values(spark, monkeypatch):
    monkeypatch.setattr(J, "LONG", 3)
    monkeypatch.setattr(J, "FULL", 5)
    monkeypatch.setattr(J, "HEAVY", 20)
    sets = random_sets(random.Random(5), 80)
    assert pairs(spark, rows_of(sets), 0.5) == brute(sets, 0.5)


def test_nulls_repeats_versions_ties(spark):
    rows = rows_of({1: [{1, 2}], 2: [{2, 1}], 3: [{1, 2, 3, 4}], 4: [{9}, {1, 2, 3}]})
    rows += [(1, [2, 1, 1, None], "", "", ""), (None, [1, 2], "", "", ""), (5, None, "", "", ""), (6, [], "", "", ""), (7, [None], "", "", "")]
    sets = {1: [{1, 2}], 2: [{1, 2}], 3: [{1, 2, 3, 4}], 4: [{9}, {1, 2, 3}]}
    assert pairs(spark, rows, 0.5) == brute(sets, 0.5) == {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)}
    assert pairs(spark, [], 0.5) == set()


def test_words_and_long_sets(spark):
    big = [f"w{i}" for i in range(20000)]
    rows = [(1, big, "", "", ""), (2, big[:15000], "", "", ""), (3, big[:100], "", "", ""), (4, ["w1"], "", "", "")]
    assert pairs(spark, rows, 0.7, "array<string>") == {(1, 2)}


def test_hex(spark):
    a, b = "00000000000000ff", "FFFFFFFFFFFFFFFF"
    df = spark.createDataFrame([(1, a + b), (2, f"{b.lower()}, {a.upper()};{a}"), (3, ""), (4, None), (None, a), (5, " ")], "taxon_id int, mash_sketch string")
    got = {r.id: bytes(r.tokens) for r in J.parse_hex_sets(df, "taxon_id", "mash_sketch").collect()}
    assert set(got) == {1, 2} and got[1] == got[2] and len(got[1]) == 16


def test_link_counts(spark):
    df = spark.createDataFrame(rows_of({1: [{1, 2}], 2: [{1, 2}], 3: [{1, 2, 3}], 4: [{7}]}), "taxon int, vals array<long>, id string, tokens string, cid string")
    got = J.link_counts(*J.similar_classes(J.encode_sets(df, "taxon", "vals"), 0.5)).collect()
    assert {(r.id, r.n_links) for r in got} == {(1, 2), (2, 2), (3, 2), (4, 0)} and len({r.cid for r in got}) == 3


def test_merge_skip():
    rnd = random.Random(0)
    for _ in range(200):
        lists = [sorted(rnd.sample(range(30), rnd.randrange(0, 12))) for _ in range(rnd.randrange(1, 7))]
        for need in (1, 2, 3):
            want = sorted({x for x in range(30) if sum(x in v for v in lists) >= need})
            assert J.merge_skip(lists, need) == want


def test_values_are_cut_from_each_part(spark):
    v = "0123456789abcdef"
    rows = [(1, v + v.upper()), (2, f"{v}, {v[::-1]}"), (3, v[:8] + " " + v[8:]), (4, v + "ff"), (5, ""), (6, "--"), (7, None), (None, v), (8, v[:8] + ";" + v + "00;" + v[:6])]
    df = spark.createDataFrame(rows, "taxon int, sketch string")
    got = {r.id: len(r.tokens) // 8 for r in J.parse_hex_sets(df, "taxon", "sketch").collect()}
    assert got == {1: 1, 2: 2, 4: 1, 8: 1}
    assert {(r.id, r.n_values, r.n_digits_left) for r in J.damaged_sets(df, "taxon", "sketch").collect()} == {(3, 0, 16), (4, 1, 2), (8, 1, 16)}


def test_runs_in_a_stream():
    import pyarrow as pa

    from cladeworks.llm.stream import whole_runs

    rnd = random.Random(8)
    for most in (None, 3, 10):
        for _ in range(100):
            keys = sorted(rnd.choice([1, 2, 3, 9]) for _ in range(rnd.randrange(30)))
            batches, at = [], 0
            while at < len(keys):
                n = rnd.randrange(5)
                batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n], pa.int64())], ["k"]))
                at += n
            out = [(t.column("k").to_pylist(), long) for t, long in whole_runs(iter(batches), "k", most)]
            assert [k for part, _ in out for k in part] == keys
            for part, long in out:
                if long:
                    assert len(set(part)) == 1 and keys.count(part[0]) > most
                else:
                    assert all(part.count(k) == keys.count(k) and (most is None or keys.count(k) <= most) for k in part)
