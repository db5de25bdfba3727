"""Pages made of repeated keywords, link lists or product tags instead of sentences.

Method. The states of each page's suffix automaton (:mod:`cladeworks.llm.repeats`) give for every character the longest
substring starting there that the page holds two or three times. Those maximal repeats, as they are and cut back to whole
words, cover shares of the page's characters. The *coverage* is combined with measures of missing *clause structure* that need no word
list: how many words stand in unbroken runs of at least ``RUN`` words (clauses have such runs, lists of links, tags or
names have not), how many different words a stretch of ``WINDOW`` words has, how many the page has for its length, how long words are, how
much is punctuation or numbers, and how much stands in lines that recur with other numbers (records of a table or log). One
score, a logistic function of coverage and these measures and their products, decides on all kinds of pages alike; a page
without covered characters, with most words in clauses, or of ever new words, is never found. Case is ignored and each number reads as one 0.

The coefficients were fitted by :func:`fit` on ``page_labels`` (see ``FITTED``); pages are then judged alike, whatever table
they come from.

Scale. A narrow map over whole texts, in batches of about ``BATCH`` characters, without a shuffle; cost grows with n log n
of a page's length, and nothing is cut off or switched at any length.

Defined results: a null or empty text, or one without words, has score 0 and no coverage; one document's rows are judged one
by one, so repeated ids and texts give repeated rows; texts may be of any length, though a page has to fit one task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.functions.hashes import Prefixes
from cladeworks.llm.repeats import longest_repeats, sorted_suffixes

#: Characters of pages whose states are built together.
BATCH = 100_000
#: Least length of a repeat in characters, of a clause in words, and the stretch of words in which different ones are counted.
LEAST, RUN, WINDOW = 8, 6, 24
#: Least length of a repeat that need not be of whole words.
SHORT = 6
#: Share of words in clauses beyond which a page, however much of it is repeated, is made of sentences.
CLAUSES = 0.6
#: Tenths of different words to the root of all words beyond which a page lists too many things to be a keyword list.
TYPES = 0.8
#: Most labelled pages that :func:`fit_labelled` brings to the driver.
LABELS = 20_000

MEASURES = ("cover", "cover_2", "cover_3", "variety", "clauses", "records", "numbers", "punctuation", "types", "length", "letters")
OTHER, LETTER, DIGIT, BLANK, LINE, JOIN = range(6)


def _kind(c: str) -> int:
    if c in "\n\r":
        return LINE
    if c in "'’":
        return JOIN
    if c.isspace():
        return BLANK
    if c.isdigit():
        return DIGIT
    return LETTER if c.isalpha() or unicodedata.category(c)[0] == "M" else OTHER


@lru_cache(1)
def _kinds() -> np.ndarray:
    return np.array([_kind(chr(i)) for i in range(0x3000)], np.uint8)


def _kinds_of(codes: np.ndarray) -> np.ndarray:
    table = _kinds()
    out = table[np.minimum(codes, len(table) - 1)]
    high = codes >= len(table)
    if high.any():
        values, at = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([_kind(chr(v)) if v < 0x110000 else OTHER for v in values.tolist()], np.uint8)[at]
    return out


def _before(x: np.ndarray, first) -> np.ndarray:
    return np.concatenate([[first], x[:-1]])


def _earlier(key: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each item the index of the one before it with the same key on the same page, or -1."""
    o = np.lexsort([key, page])
    same = np.concatenate([[False], (key[o][1:] == key[o][:-1]) & (page[o][1:] == page[o][:-1])]) if len(o) else np.zeros(0, bool)
    out = np.full(len(key), -1, np.int64)
    out[o[same]] = o[np.flatnonzero(same) - 1]
    return out


def _mean(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    return num / np.maximum(den, 1)


def page_measures(texts: list[str]) -> np.ndarray:
    """One row of ``MEASURES`` per text and, as last column, its number of words."""
    p = len(texts)
    joined = "\0".join(t.lower().replace("\0", " ") for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(codes == 0, np.uint8(LINE), _kinds_of(codes))
    digit = kind == DIGIT
    keep = ~(digit & _before(digit, False))  # each number is one 0
    codes, kind = np.where(digit, np.uint32(48), codes)[keep], kind[keep]
    del digit, keep
    end = codes == 0
    page = np.cumsum(end) - end
    sums = lambda values, where: np.bincount(where, values, p)
    size = np.bincount(page[~end], minlength=p)

    # words
    word = (kind == LETTER) | (kind == DIGIT)
    start, stop = np.flatnonzero(word & ~_before(word, False)), np.flatnonzero(~word & _before(word, False))
    owner = page[start]
    words = np.bincount(owner, minlength=p)
    hashed = Prefixes(codes)
    name = hashed.of(start, stop - start)
    last = _earlier(name, owner)
    types = sums((last < 0).astype(float), owner)
    numeral = (kind[start] == DIGIT) | (kind[stop - 1] == DIGIT)

    # variety: words that are the first of their kind within each stretch, at every third of it
    n, step = len(start), WINDOW // 3
    begin = np.searchsorted(owner, np.arange(p))
    place = np.arange(n) - begin[owner] if n else np.zeros(0, np.int64)
    room = words[owner] - place if n else np.zeros(0, np.int64)
    head = np.flatnonzero((place % step == 0) & ((room >= WINDOW) | (place == 0)))
    width = np.minimum(WINDOW, room[head])
    fresh = np.zeros(len(head))
    for d in range(WINDOW):
        i = head + np.minimum(d, width - 1)
        fresh += (last[i] < head) & (d < width)
    variety = _mean(sums(fresh / np.maximum(width, 1), owner[head]), sums(np.ones(len(head)), owner[head]))

    # records: lines that recur with other numbers; a word with a digit is a number
    lines = np.cumsum(kind == LINE)
    digits = np.concatenate([[0], np.cumsum(kind == DIGIT)])
    figure = digits[stop] > digits[start]
    line, first = np.unique(lines[start], return_index=True)
    count = np.diff(np.append(first, n))
    line_name = Prefixes(np.where(figure, np.uint64(0), name)).of(first, count)
    figures = np.concatenate([[0], np.cumsum(figure)])
    before = _earlier(line_name, owner[first])
    twice = before >= 0
    twice[before[before >= 0]] = True
    records = sums(np.where(twice & (figures[first + count] > figures[first]), count, 0).astype(float), owner[first])

    # coverage by the automaton's maximal repeats, from word to word, outside records
    record = np.repeat(twice & (figures[first + count] > figures[first]), count)
    present = np.zeros(int(codes.max()) + 1, bool)
    present[codes] = True
    order, common = sorted_suffixes(np.cumsum(present)[codes] - 1, page)
    word_end = np.maximum.accumulate(np.where(~word & _before(word, False), np.arange(len(codes)), 0))
    inside = np.repeat(record, stop - start)
    outside = np.ones(len(codes), bool)
    outside[np.repeat(start - np.concatenate([[0], np.cumsum(stop - start)[:-1]]), stop - start)[inside] + np.flatnonzero(inside)] = False
    cover = []
    for times in (2, 3):
        deep = longest_repeats(order, common, times)
        if times == 2:  # any repeats, also of parts of words
            good = np.flatnonzero((deep >= SHORT) & outside)
            marks = np.zeros(len(codes) + 1, np.int64)
            np.add.at(marks, good, 1)
            np.add.at(marks, good + deep[good], -1)
            cover.append(_mean(np.bincount(page[(np.cumsum(marks)[:-1] > 0) & ~end], minlength=p), size))
        deep = deep[start]
        to = np.minimum(word_end[np.minimum(start + deep, len(codes) - 1)], start + deep)
        good = (to - start >= LEAST) & ~record
        marks = np.zeros(len(codes) + 1, np.int64)
        np.add.at(marks, start[good], 1)
        np.add.at(marks, to[good], -1)
        covered = np.cumsum(marks)[:-1] > 0
        cover.append(_mean(np.bincount(page[covered & ~end], minlength=p), size))

    # clauses: unbroken runs of words, without words used shortly before
    breaks = np.cumsum((kind == OTHER) | (kind == LINE) | (kind == DIGIT))
    plain = np.flatnonzero(kind[start] == LETTER)
    run, first = np.unique(breaks[start[plain]], return_index=True)
    length = np.diff(np.append(first, len(plain)))
    clause = np.repeat(length >= RUN, length) & ((last[plain] < 0) | (last[plain] < plain - WINDOW))
    clauses = sums(clause.astype(float), owner[plain])

    marks = sums((kind == OTHER).astype(float), page)
    return np.stack([*cover, variety, _mean(clauses, words), _mean(records, words), _mean(sums(numeral.astype(float), owner), words), _mean(marks, size), types / np.sqrt(np.maximum(words, 1)) / 10, np.minimum(np.log10(words + 1), 4.0), _mean(sums((stop - start).astype(float), owner), words) / 10, words], 1)


def _terms(m: np.ndarray) -> np.ndarray:
    """Measures, their products, and 1."""
    k = m.shape[1]
    return np.hstack([m, *(m[:, i : i + 1] * m[:, i:] for i in range(k)), np.ones((len(m), 1))])


#: Coefficients of the terms, fitted once by :func:`fit` on 3,456 labelled pages (limit LABELS); not tuned by hand.
FITTED = np.array([
    5.794, 3.089, 3.132, -0.7455, 0.996, -1.511, -1.823, 17.69, -0.6222, 2.315, 4.747, 1.512, 0.0683, 0.5681, 4.976, 0.04546, -1.796, 0.9047, 27.37,
    2.758, 0.5092, 2.171, -1.253, -0.6332, 2.577, -8.319, 92.61, -2.869, 22.86, 0.7358, -0.157, 2.076, -0.5343, 3.369, -8.882, 35.3, 26.52, 25.12, 4.116,
    0.0482, 3.144, -4.082, -1.823, -3.324, -23.54, 11.46, -3.226, -2.5, -2.335, -4.263, -161.0, -8.179, -51.63, -1.66, -1.12, 3.787, -2.131, -3.976,
    -35.58, 2.268, -0.5992, -3.653, 22.25, -27.07, 21.92, 0.2854, -60.41, 53.82, 13.68, 4.254, 27.0, -2.765, -1.461, -8.219, -0.7469, -3.202, 3.006,
    0.4072,
])


def _open(m: np.ndarray) -> np.ndarray:
    """Pages that the score decides: with words, repeats, not made of clauses, and not of ever new words."""
    return _repeating(m) & (m[:, 8] <= TYPES)


def _repeating(m: np.ndarray) -> np.ndarray:
    """Pages that the fit may learn from: as :func:`_open`, whatever the number of different words."""
    return (m[:, -1] > 0) & (m[:, 0] > 0) & (m[:, 4] <= CLAUSES)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(measures: np.ndarray, spam: np.ndarray, penalty: float = 1e-4, rounds: int = 60, refits: int = 5) -> np.ndarray:
    """Coefficients of the score for labelled pages (measures without the number of words; 1 for spam), by Newton steps.

    Some labels are wrong: rows of which the last fit is surer than 0.9 of the opposite are left out of the next one.
    """
    a = _terms(measures)
    scale = a.std(0)
    scale[scale == 0] = 1
    a = a / scale
    keep = np.ones(len(a), bool)
    for _ in range(refits):
        x, y, b = a[keep], spam[keep], np.zeros(a.shape[1])
        for _ in range(rounds):
            q = _logistic(x @ b)
            h = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + penalty * len(x) * np.eye(len(b))
            b += np.linalg.solve(h, x.T @ (y - q) - penalty * len(x) * b)
        keep = np.abs(_logistic(a @ b) - spam) < 0.9
    return b / scale


def fit_labelled(docs: DataFrame, labels: DataFrame, bound: int = LABELS) -> np.ndarray:
    """:func:`fit` on the documents with one undisputed label, at most ``bound`` of them (those first by a hash of the id)."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    rows = docs.select("doc_id", "text").join(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "doc_id").select("text", "label").collect()
    m = page_measures([r.text or "" for r in rows])
    known = _repeating(m)
    return fit(m[known, :-1], np.array([r.label == "spam" for r in rows], float)[known])


def spam_scores(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Score from 0 to 1, and the share of characters covered by repeats, of each text."""
    score, cover = np.zeros(len(texts)), np.zeros(len(texts))
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= BATCH):
            size += len(texts[to] or "")
            to += 1
        m = page_measures([t or "" for t in texts[at:to]])
        p = _logistic(_terms(m[:, :-1]) @ FITTED)
        score[at:to] = np.where(_open(m), p, 0)
        cover[at:to] = m[:, 0]
        at = to
    return score, cover


def score_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spam_score, repeat_share`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, cover = spam_scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(cover)], ["id", "spam_score", "repeat_share"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, spam_score double, repeat_share double")


def spam_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Documents whose score is above ``least``."""
    return score_pages(docs, id_col, text_col).filter(F.col("spam_score") > least)
