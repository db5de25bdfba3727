import random

import numpy as np

from cladeworks.llm import repeats as R
from cladeworks.llm import spam as S

PROSE = "The reader expects Newick and stops at the first of the distances. It seems that a parsimony score handles them well, but we have not tested it. "
RND = random.Random(5)
KEYS, MORE, HOSTS, PARTS = ["gel trays", "lab coats", "tree maker", "cold boxes", "cover slips", "silica beads"], ["cheap", "buy", "best", "online", "price", "used"], ["aba", "bebe", "cici"], ["read", "topics", "tools"]
pick = RND.choice
name = lambda k: "".join(pick(["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu"]) for _ in range(k))


def test_kinds_of_pages():
    spam = [
        "Cheap gloves, lab coats, cheap gloves, LAB COATS, cheap-gloves, lab coats, cheap gloves, lab coats",
        ", ".join(f"{pick(MORE)} {pick(KEYS)}" for _ in range(60)),
        "\n".join("#" + pick(KEYS).replace(" ", "") for _ in range(30)),
        "\n".join(f'<a href="https://{pick(HOSTS)}.example/{pick(PARTS)}{RND.randrange(999)}">{pick(KEYS)} {pick(MORE)}</a>' for _ in range(20)),
        "\n".join(f"https://{pick(HOSTS)}.example/{pick(PARTS)}/{pick(PARTS)}{RND.randrange(999)}" for _ in range(20)),
        " ".join(f"[{pick(KEYS)}] [{pick(['Aus', 'Bus', 'Cus', 'Dus'])}] {RND.random() * 90:.2f}" for _ in range(40)),
        PROSE + "buy tree maker, tree maker price, " * 30,
    ]
    page = [
        PROSE, PROSE + "\nSee also:\nhttps://a.example/x\nhttps://b.example/y",
        "Checklist of Aus\n" + "\n".join(f"{name(4).title()}us {name(4)}ensis, {i % 40} sheets" for i in range(300)),
        "\n".join(f"Aus plate {i} well B{i}: {i * 37} reads kept, {i * 3} dropped." for i in range(1, 40)),
        PROSE + "\n" + "\n".join(f"{name(4)}   " + "".join(pick("ACGT-") for _ in range(60)) for _ in range(10)),
        PROSE * 3, PROSE * 40,
    ]
    score, cover = S.spam_scores(spam + page)
    assert (score > 0.5).tolist() == [True] * len(spam) + [False] * len(page)
    assert cover[0] > 0.9 and cover[len(spam)] == 0
    # a page's verdict does not depend on the others of its batch
    assert np.allclose(score, [S.spam_scores([t])[0][0] for t in spam + page])


def test_longest_repeats_against_brute_force():
    rnd = random.Random(1)
    for trial in range(120):
        pages = ["".join(rnd.choice("abcdefgh"[: 2 + trial % 7]) for _ in range(rnd.randrange(60))) * rnd.choice([1, 1, 2, 3]) for _ in range(4)]
        codes = np.concatenate([np.array([ord(c) for c in p] + [0], np.int64) for p in pages])
        order, common = R.sorted_suffixes(codes, np.repeat(np.arange(4), [len(p) + 1 for p in pages]))
        for times in (2, 3, 4):
            got, at = R.longest_repeats(order, common, times), 0
            for p in pages:
                for i in range(len(p)):
                    want = max((k for k in range(len(p) - i + 1) if sum(p.startswith(p[i : i + k], j) for j in range(len(p))) >= times), default=0)
                    assert got[at + i] == want or want < 6
                at += len(p) + 1


def test_odd_texts():
    score, cover = S.spam_scores([None, "", "  ", "!!!", "a", "\ud800 abc", "x\0y", "\U0001f600 " * 9, "日本語の文章です。"])
    assert (score == 0).all() and np.isfinite(cover).all()


def test_repeats_are_counted_over_the_whole_of_a_long_page():
    rnd = random.Random(4)
    keys = [f"key{chr(97 + i // 10)}{chr(97 + i % 10)}word" for i in range(100)]
    page = "\n".join(", ".join(rnd.choice(keys) for _ in range(100)) for _ in range(3000))
    assert len(page) > 1.5 * S.BATCH
    assert S.spam_scores([page])[0][0] > 0.5
    assert S.spam_scores(["\n".join(PROSE for _ in range(12000))])[0][0] == 0


def test_fit_leaves_out_wrong_labels():
    rnd = np.random.default_rng(1)
    m = rnd.random((600, len(S.MEASURES)))
    spam = (m[:, 0] > m[:, 3]).astype(float)
    wrong = spam.copy()
    wrong[:12] = 1 - wrong[:12]
    b = S.fit(m, wrong)
    assert ((S._terms(m) @ b > 0) == (spam > 0)).mean() > 0.97


def test_table(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "cheap gloves, " * 50, 1.0), (3, PROSE, 1.0), (None, "cheap gloves, " * 50, 1.0), (4, "cheap gloves " * 200_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spam_score double")
    assert sorted((r.id or 0) for r in S.spam_pages(df).collect()) == [0, 3, 4]
    assert S.score_pages(df).count() == len(rows) and S.score_pages(df.limit(0)).count() == 0


def test_fit_labelled(spark):
    texts = [(i, ", ".join(f"{pick(MORE)} {pick(KEYS)}" for _ in range(20 + i))) if i % 2 else (i, PROSE + " ".join(name(3) for _ in range(20 + i)) + " and so on, and so on") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "spam" if i % 2 else "page") for i in range(40)] + [(1, "page"), (3, None), (None, "spam"), (5, "spam")], "doc_id long, label string")
    b = S.fit_labelled(docs, labels, 30)
    m = S.page_measures([t for _, t in texts])
    assert (((S._terms(m[:, :-1]) @ b > 0) & S._open(m)) == np.array([i % 2 == 1 for i in range(40)])).mean() > 0.9
