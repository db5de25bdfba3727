import random
import re

from cladeworks.llm import tokens as T


def test_counts_are_those_of_the_encoder():
    enc, rnd = T.encoder(), random.Random(1)
    short = re.compile("[\t-\r \x85\xa0  -     　]{2,}")
    texts = ["abcde," * 2000, "日本語" * 5000, "a b" * 3000, "", " ", "x" + " " * 40]
    texts += ["".join(rnd.choice(["a", "don't", " ", "  ", "\n", "\t \n", "12", "…", "　", "\x1f", "é", "--"]) for _ in range(60)) for _ in range(400)]
    for t in texts:
        want = len(enc.encode_ordinary(t))
        assert T.count_tokens(enc, t) == want
        assert T.count_tokens(enc, t, short) == want


def test_runs_beyond_the_stack():
    enc = T.encoder()
    assert T.count_tokens(enc, "a" + "\n" * 1_000_000 + "b") > 2
    assert T.count_tokens(enc, "abcde," * 200_000) == 600_000
