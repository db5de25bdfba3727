"""Near-duplicate texts that differ by small edits: all pairs whose sets of k-character runs have Jaccard >= ``threshold``.

Method: chosen-path similarity join. A text is the minwise hash vector of its runs. Each of ``trees`` independent trees
splits all texts: a node picks every position of the vector with probability 1 / (threshold * positions), chosen by the
node's own hash, and each picked position sends its texts to children by their minwise value there. Nodes of at most
``LIMIT`` texts are compared exhaustively on 2-bit minwise sketches; larger ones branch again. A pair at the threshold
meets in one tree's children with probability 0.63 (0.47 and 0.38 after one and two more levels), so 16 trees miss it
with probability 1e-7 (4e-5, 5e-4). What passes the sketch filter is then checked exactly on the runs themselves.

Equal texts are one class first, so copies never meet in a node. Texts are compared whole.

Scale. Minwise values are computed once and written, 512 bytes a class; each level reads them. A level is one shuffle of rows (node, class, sketch) of 56 bytes. A node is read as a sorted stream and given up
to the next level as soon as it has more than ``LIMIT`` rows; nodes with more than 1/2000 of a level's rows (there can be
at most 2000) are found before the shuffle by counts per task and branch without being gathered at all. Nodes still too
large after ``DEPTH`` levels (a multitude of texts alike) are cut into blocks, each pair of blocks being a task, so none
is dropped. Only ids travel with candidates; texts are joined to them for the exact check.

Defined results: null ids and null texts take no part, nor do texts of fewer than ``k`` characters after cleaning; an id
with several different texts stands for each; ties at the threshold are pairs; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.set_join import collapse
from cladeworks.llm.stream import bounds, column, whole_runs
from cladeworks.scratch import stage

POSITIONS = 128
#: Texts of a node from which it branches instead of being compared. The most frequent minwise value of a position is held
#: by (runs of a text / different runs of the language) of all texts, so smaller limits only add levels.
LIMIT = 1000
DEPTH = 3
#: A node is split before the shuffle if it has more than this share of a level's rows.
GIANT = 2000
#: Standard deviations below the threshold at which the sketch filter lets a pair pass.
SLACK = 4.5
BITS = ("b0", "b1", "b2", "b3")

_rng = np.random.default_rng(20260101)
_MULT = _rng.integers(0, 2**32, POSITIONS, dtype=np.int64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, POSITIONS, dtype=np.int64).astype(np.uint32)
_SALT = _rng.integers(0, 2**63, POSITIONS, dtype=np.int64).astype(np.uint64)


def clean_sequence(text: Column, *dropped: Column) -> Column:
    """Lower case, without the characters of ``dropped`` (in any case), ``u`` read as ``t``."""
    out = F.lower(text)
    for d in dropped:
        gone = F.lower(F.coalesce(d, F.lit("")))
        # one character (the usual case) is replaced as a whole string, several are translated one by one
        out = F.when(F.char_length(gone) <= 1, F.replace(out, gone, F.lit(""))).otherwise(F.call_function("translate", out, gone, F.lit("")))
    return F.replace(out, F.lit("u"), F.lit("t"))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(text: str, k: int) -> np.ndarray:
    """Distinct runs of ``k`` characters as 64-bit values; exact for runs of up to 8 ASCII characters, whatever the rest of the text holds."""
    if k == 8 and text.isascii():
        a = np.frombuffer(text.encode(), np.uint8)
        out = np.sort(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(a, 8)).view(np.uint64)[:, 0])
        return out[np.concatenate([[True], out[1:] != out[:-1]])]
    if k < 8 and text.isascii():
        return np.unique(_packed(np.frombuffer(text.encode(), np.uint8).astype(np.uint64), k))
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.full(len(a) - k + 1, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(k):
        out = mix(out + a[i : len(a) - k + 1 + i] * np.uint64(0x9E3779B97F4A7C15))
    out |= np.uint64(1 << 63)
    if k <= 8:
        plain = np.lib.stride_tricks.sliding_window_view(a, k).max(axis=1) < 128
        out[plain] = _packed(a, k)[plain]
    return np.unique(out)


def _packed(a: np.ndarray, k: int) -> np.ndarray:
    """Runs of ``k`` <= 8 ASCII characters as numbers: for 8 the first character is the lowest byte, else the highest."""
    out = np.zeros(len(a) - k + 1, np.uint64)
    for i in range(k):
        out |= a[i : len(a) - k + 1 + i] << np.uint64(8 * (i if k == 8 else k - 1 - i))
    return out


def minwise(text: str, k: int) -> np.ndarray:
    """Minwise values (32 bits) of a text at all positions; long texts are read in slices of their runs."""
    x = (mix(runs(text, k)) >> np.uint64(32)).astype(np.uint32)
    best = np.full(POSITIONS, 2**32 - 1, np.uint32)
    for s in range(0, len(x), 4096):
        best = np.minimum(best, (_MULT[:, None] * x[None, s : s + 4096] + _ADD[:, None]).min(axis=1))
    return best


def sketch(values: np.ndarray) -> np.ndarray:
    """Two bits of each position's minwise value (rows of vectors), as four 64-bit words."""
    two = (mix(values) & np.uint64(3)).reshape(len(values), 4, 32)
    return (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _picked(node: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the positions that each node branches on."""
    h = mix(node.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + _SALT[None, :])
    return np.nonzero(h < np.uint64(int(2.0**64 / (threshold * POSITIONS))))


def signatures(texts: DataFrame, k: int) -> DataFrame:
    """``cid, values``: the minwise values of each text (512 bytes), which all levels read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([minwise(x, k).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["cid", "values"])

    return texts.select("cid", "text").mapInArrow(run, "cid bigint, values binary")


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("values").to_pylist()), np.uint32).reshape(b.num_rows, POSITIONS)


def _children(df: DataFrame, threshold: float, trees: int, giants: np.ndarray | None, want: str) -> DataFrame:
    """``node, cid, b0..b3`` of the children's rows. ``df``: ``cid, values, node``; a null node stands for all roots.

    ``want``: ``rows`` (of nodes not in ``giants``), ``giants`` (those in it, without sketch), ``counts`` (per task).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = np.arange(1, trees + 1).astype(np.uint64)
        root_row, root_pos = _picked(roots, threshold)
        seen = []
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                values = _vectors(part)
                cid, root = column(part, "cid"), np.asarray(part.column(2).is_null())
                node = part.column(2).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
                all_rows = np.flatnonzero(root)
                row = np.repeat(all_rows, len(root_pos))
                pos, parent = np.tile(root_pos, len(all_rows)), np.tile(roots[root_row], len(all_rows))
                r, p = _picked(node[~root], threshold)
                row, pos = np.concatenate([row, np.flatnonzero(~root)[r]]), np.concatenate([pos, p])
                parent = np.concatenate([parent, node[~root][r]])
                key = mix(mix(parent * np.uint64(POSITIONS + 1) + pos.astype(np.uint64)) + values[row, pos]).view(np.int64)
                if want == "counts":
                    seen.append(key)
                    if sum(map(len, seen)) > 4_000_000:
                        yield _counted(seen)
                        seen = []
                    continue
                hot = np.isin(key, giants)
                keep = ~hot if want == "rows" else hot
                words = sketch(values)[row[keep]] if want == "rows" else np.zeros((int(keep.sum()), 4), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(cid[row[keep]])] + [pa.array(np.ascontiguousarray(words[:, i])) for i in range(4)], ["node", "cid", *BITS])
        if seen:
            yield _counted(seen)

    kind = "node bigint, c bigint, total bigint" if want == "counts" else "node bigint, cid bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint"
    return df.select("cid", "values", "node").mapInArrow(run, kind)


def _counted(seen: list[np.ndarray]) -> pa.RecordBatch:
    v, c = np.unique(np.concatenate(seen), return_counts=True)
    keep = c >= max(2, c.sum() / GIANT)
    return pa.RecordBatch.from_arrays([pa.array(np.append(v[keep], 0)), pa.array(np.append(c[keep], 0)), pa.array(np.append(np.zeros(keep.sum(), np.int64), c.sum()))], ["node", "c", "total"])


def _giants(df: DataFrame, threshold: float, trees: int) -> np.ndarray:
    """Nodes with more than 1 / GIANT of the rows: at most GIANT of them. Such a node is as frequent in at least one task."""
    sums = _children(df, threshold, trees, None, "counts").groupBy("node").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))
    sums = stage(sums, "counts")
    total = sums.agg(F.sum("total")).first()[0] or 0
    got = sums.filter((F.col("c") > total / GIANT) & (F.col("c") > LIMIT)).select("node").collect()
    return np.array(sorted(r.node for r in got), np.int64)


def _close(words: list[np.ndarray], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows have at least ``least`` positions with equal two bits."""
    differ = np.zeros(len(i), np.int64)
    for w in words:
        x = w[i] ^ w[j]
        differ += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
    return POSITIONS - differ >= least


def _least(threshold: float) -> float:
    p = threshold + (1 - threshold) / 4
    return POSITIONS * (p - SLACK * (p * (1 - p) / POSITIONS) ** 0.5)


_PAIRS = "a bigint, b bigint, node bigint"


def _pairs_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    both = both[both[:, 0] != both[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.nulls(len(both), pa.int64())], ["a", "b", "node"])


def _within(cid: np.ndarray, words: list[np.ndarray], first: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs among rows of the same run; ``first``: the run's first row for each row."""
    at_a, at_b = [], []
    mine = np.arange(len(cid))
    d, i = 1, mine[mine - 1 >= first]
    while len(i):
        ok = i[_close(words, i, i - d, least)]
        at_a.append(cid[ok])
        at_b.append(cid[ok - d])
        d += 1
        i = i[i - d >= first[i]]
    none = np.zeros(0, np.int64)
    return (np.concatenate(at_a), np.concatenate(at_b)) if at_a else (none, none)


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: close pairs in small nodes; ``a, node`` with null ``b``: rows of nodes with more than LIMIT rows."""
    least = _least(threshold)

    def run(batches):
        for x, large in whole_runs(batches, "node", LIMIT):
            cid, node = column(x, "cid"), column(x, "node")
            if large:
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.nulls(len(cid), pa.int64()), pa.array(node)], ["a", "b", "node"])
                continue
            b = bounds(node)
            yield _pairs_of(*_within(cid, [column(x, w).view(np.uint64) for w in BITS], np.repeat(b[:-1], np.diff(b)), least))

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, _PAIRS)


def _blocks(over: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Close pairs of rows of the same node, by pairs of blocks of its rows."""
    least = _least(threshold)
    sizes = over.groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    cut = over.join(sizes, "node").withColumn("blocks", F.ceil(F.col("c") / LIMIT).cast("int"))
    cut = cut.select("node", F.col("a").alias("cid"), "blocks", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"))
    words = _sketches(signed.join(over.select(F.col("a").alias("cid")).distinct(), "cid", "left_semi"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = cut.join(words, "cid").select("node", "cid", *BITS, "block", other)
    tasks = tasks.select("cid", *BITS, "block", F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("task"), (F.col("block") == F.col("other")).alias("same"))

    def run(batches):
        for x, _ in whole_runs(batches, "task"):
            cid, task, block, same = (column(x, c) for c in ("cid", "task", "block", "same"))
            words = [column(x, w).view(np.uint64) for w in BITS]
            b = bounds(task)
            for s, e in zip(b[:-1].tolist(), b[1:].tolist()):
                if same[s]:
                    part = [w[s:e] for w in words]
                    yield _pairs_of(*_within(cid[s:e], part, np.zeros(e - s, np.int64), least))
                    continue
                left = np.flatnonzero(block[s:e] == block[s]) + s
                right = np.flatnonzero(block[s:e] != block[s]) + s
                for i in left:
                    ok = right[_close(words, np.full(len(right), i), right, least)]
                    if len(ok):
                        yield _pairs_of(np.full(len(ok), cid[i]), cid[ok])

    return tasks.repartition("task").sortWithinPartitions("task", "block").mapInArrow(run, _PAIRS)


def _sketches(signed: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            words = sketch(_vectors(b))
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(np.ascontiguousarray(words[:, i])) for i in range(4)], ["cid", *BITS])

    return signed.select("cid", "values").mapInArrow(run, "cid bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint")


def candidates(texts: DataFrame, k: int, threshold: float, trees: int) -> DataFrame:
    """``a, b`` (a < b, distinct): pairs of classes that met in a small node and look similar. ``texts``: ``cid, text``."""
    signed = stage(signatures(texts, k), "minwise")
    found, level, now = [], 0, signed.withColumn("node", F.lit(None).cast("bigint"))
    while True:
        giants = _giants(now, threshold, trees)
        met = stage(_compare(_children(now, threshold, trees, giants, "rows"), threshold), "met")
        found.append(met.filter("b is not null").select("a", "b"))
        over = met.filter("b is null").select("a", "node")
        if len(giants):
            over = over.unionByName(_children(now, threshold, trees, giants, "giants").select(F.col("cid").alias("a"), "node"))
        level += 1
        if not len(giants) and over.isEmpty():
            break
        over = stage(over.distinct(), "over")
        if level > DEPTH:
            found.append(_blocks(over, signed, threshold).select("a", "b"))
            break
        now = over.select(F.col("a").alias("cid"), "node").join(signed, "cid").select("cid", "values", "node")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def verify(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """``a, b, common, either`` of the pairs whose runs reach the threshold exactly."""
    one = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for x in batches:
            known: dict[str, np.ndarray] = {}

            def of(text):
                if text not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[text] = runs(text, k)
                return known[text]

            common, either = [], []
            for s, t in zip(x.column(2).to_pylist(), x.column(3).to_pylist()):
                p, q = of(s), of(t)
                c = len(np.intersect1d(p, q, assume_unique=True))
                common.append(c)
                either.append(len(p) + len(q) - c)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(common, pa.int32()), pa.array(either, pa.int32())], ["a", "b", "common", "either"])

    return both.mapInArrow(run, "a bigint, b bigint, common int, either int").filter(F.col("common") >= F.lit(threshold) * F.col("either") - 1e-9)


def near_duplicates(texts: DataFrame, threshold: float = 0.8, k: int = 8, trees: int = 16) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of different texts (``cid_a, cid_b, common, either``) and members (``id, cid``). ``texts``: ``id, text``."""
    kept = texts.filter(F.col("id").isNotNull() & (F.char_length("text") >= k))
    classes, members = collapse(kept, "text")
    members = stage(members, "members")
    own = classes.select("cid", "text")
    pairs = verify(candidates(own, k, threshold, trees), own, k, threshold)
    return pairs.select(F.col("a").alias("cid_a"), F.col("b").alias("cid_b"), "common", "either"), members
