import random

from cladeworks.llm import mixing as X
from cladeworks.llm import packing as K
from cladeworks.llm import tokens as T


def valid(rows, items, capacity):
    room, seen = {}, {}
    for r in rows:
        if r.container_no is not None:
            room[r.container_no] = room.get(r.container_no, 0) + r.n_tokens
        seen.setdefault(r.id, []).append((r.piece, r.first_token, r.n_tokens))
    assert max(room.values(), default=0) <= capacity
    for i, n in items:
        parts = sorted(seen.pop(i))
        assert sum(p[2] for p in parts) == n and (len(parts) == 1 or n > capacity)
        assert [p[1] for p in parts] == [k * capacity for k in range(len(parts))]
    assert not seen
    return room


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(K, "PART", 5)
    rnd = random.Random(3)
    items = [(i, rnd.choice([0, 1, 7, 7, 7, 7, 10, 50, 99, 100, 101, 230, rnd.randrange(1, 100)])) for i in range(400)]
    df = spark.createDataFrame(items, "id long, n_tokens int")
    for rule in ("shortest", "best"):
        rows = K.pack(df, 100, rule).collect()
        room = valid(rows, items, 100)
        assert sum(room.values()) / (100 * len(room)) > 0.95
        assert sorted(room) and all(r.container_no is None for r in rows if r.n_tokens == 0)
    assert K.pack(df.limit(0), 100).count() == 0


def test_plan_covers_each_rank_once():
    rnd = random.Random(1)
    for _ in range(50):
        h = {rnd.randrange(1, 64): rnd.randrange(1, 200) for _ in range(rnd.randrange(1, 20))}
        rows, total = K.plan(h, 64)
        fill = [0] * total
        for n, lo, hi, base, per in rows:
            for r in range(lo, hi + 1):
                fill[base + (r - lo) // per] += n
        assert max(fill) <= 64 and min(fill) > 0 and sum(fill) == sum(n * c for n, c in h.items())
        for n, c in h.items():
            got = sorted((lo, hi) for m, lo, hi, *_ in rows if m == n)
            assert got[0][0] == 0 and got[-1][1] == c - 1 and all(a[1] + 1 == b[0] for a, b in zip(got, got[1:]))


def test_token_counts(spark):
    enc = T.encoder()
    texts = [(1, "Hello world"), (2, None), (3, ""), (4, "x" * 50_000), (5, "a b " * 30_000), (None, "é ü"), (6, "<|endoftext|>")]
    got = {r.id: r.n_tokens for r in T.with_token_counts(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[5] == len(enc.encode_ordinary("a b " * 30_000)) and got[4] > 0 and got[6] > 1 and got[None] == len(enc.encode_ordinary("é ü"))


def test_documents_into_containers(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 13 % 700), "x") for i in range(60)], "doc_id long, text string, id string")
    lengths = K.token_lengths(docs)
    packed = K.pack_documents(lengths, [("small", 128), ("large", 1024)])
    items = [(r.id, r.n_tokens) for r in lengths.collect()]
    for c, n in (("small", 128), ("large", 1024)):
        valid(packed.filter(f"container = '{c}'").collect(), items, n)
    u = {r.container: r for r in K.utilisation(packed).collect()}
    assert u["small"].n_tokens == u["large"].n_tokens == sum(n for _, n in items) and 0.5 < u["large"].used_share <= 1


def test_mixing(spark):
    rows = [(i, s, n) for i, (s, n) in enumerate([("A", 10)] * 500 + [("b", 5)] * 2000 + [(None, 7)] * 9 + [("other", 3)] * 5 + [("c", 100)] * 40)]
    tokens = spark.createDataFrame(rows, "id long, source string, n_tokens int").selectExpr("id", "lower(source) source", "n_tokens")
    targets = spark.createDataFrame([("a", 0.5, 3), ("B", 0.25, 2), ("c", 0.2, 1), ("none", 0.05, 4), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    rates = X.rates(tokens, targets)
    want = min(3 * 5000 / 0.5, 2 * 10000 / 0.25, 1 * 4000 / 0.2)
    got = {r.source: r for r in rates.collect()}
    assert abs(got["a"].rate - 0.5 * want / 5000) < 1e-9 and got["c"].rate == 1.0 and got["none"].rate == 0.0
    mixed = X.mix(tokens, rates)
    copies = {}
    for r in mixed.collect():
        copies.setdefault(r.id, []).append(r.copy)
    for i, s, _ in rows:
        r = got[s.lower()].rate if s and s.lower() in got else 0
        assert sorted(copies.get(i, [])) == list(range(1, len(copies.get(i, [])) + 1)) and int(r) <= len(copies.get(i, [])) <= int(r) + (r % 1 > 0)
    share = {r.source: r for r in X.reached(mixed, tokens, rates).collect()}
    assert abs(share["a"].share / share["b"].share - 2) < 0.2 and share["none"].n_copies == 0 and share["other"].target_share == 0 and share[None].n_records == 9
    assert abs(sum(r.share for r in share.values()) - 1) < 1e-9
    assert X.mix(tokens.limit(0), X.rates(tokens.limit(0), targets)).count() == 0


def test_source_spelling(spark):
    docs = spark.createDataFrame([(1, "a b", " Web-Crawl"), (2, "c", "WEB_CRAWL"), (3, None, "web crawl "), (4, "d", None)], "doc_id long, text string, source string")
    assert {(r.id, r.source) for r in X.source_tokens(docs).collect()} == {(1, "web_crawl"), (2, "web_crawl"), (3, "web_crawl"), (4, None)}
