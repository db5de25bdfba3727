"""All pairs of records whose sets of 64-bit values have a Jaccard similarity of at least ``threshold``; exact.

Method: T-occurrence list merging. Values get one global order, rarest first. A record probes the inverted lists of its
first ``r - T + k`` shared values (the short lists), which arrive from the tasks that hold the lists; a heap merges them,
skipping what cannot reach ``k`` occurrences. Its other values belong to the longest lists: they are never merged, a
candidate's membership in them is found by binary search among the candidate's own sorted values, and pairs that reach
the overlap required for their sizes are emitted.

Steps. (1) Rows with the same set become one class, found by the set's digest; classes are written once. (2) Values
carried by more than a 1/20000 of all entries are *heavy*; at most 20000 of them exist, so that table may be broadcast.
They come last in the order and are never shuffled as list entries of step 3. (3) Other values go to the task of the
value, which counts them; values of one class only are dropped there (they cannot overlap). Back at the class, a class
with fewer shared values than T = ceil(threshold * size) is dropped. (4) Short lists are built, again by value; each
member is sent the part of the list before it, thinned by size, residual and position bounds. A list of more than
``LONG`` entries is cut into blocks, and pairs of blocks become tasks of their own. (5) Merge at the probe; (6) binary
search at the candidate. Every shuffled row is a few dozen bytes but for step 6, which ships a probe's shared values
once for each candidate.

Defined results: null ids and null or empty sets take no part; repeated rows and repeated or unordered values change
nothing; an id given with two different sets stands for both; ties (similarity equal to the threshold) are pairs.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.stream import binary, bounds, column, pieces, whole_runs
from cladeworks.scratch import stage, unstage

#: Share of all entries from which a value is heavy, as 1 / HEAVY: there are at most HEAVY such values.
HEAVY = 20000
#: Entries of a list up to which they are counted; longer ones take one place in the order from rare to frequent.
FULL = 1_000_000
#: Entries of a short list from which it is cut into blocks.
LONG = 2000


def required(t: float, na, nb):
    """Smallest overlap of sets of these sizes with Jaccard >= t."""
    return np.ceil(t / (1 + t) * (na + nb) - 1e-9).astype(np.int64)


_OTHER = re.compile(r"[^0-9a-fA-F]+")


def hex_values(text: str) -> tuple[bytes, int]:
    """The values of 16 hexadecimal digits in a text, and how many digits are left over.

    Anything but a digit separates. Values are cut from each part by itself, so digits of two parts never make one value.
    """
    parts = _OTHER.split(text)
    if not any(n % 16 for n in set(map(len, parts))):
        return bytes.fromhex("".join(parts)), 0
    return bytes.fromhex("".join(p[: len(p) // 16 * 16] for p in parts)), sum(len(p) % 16 for p in parts)


def parse_hex_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, tokens``: values of 16 hexadecimal digits, in any case and with any separators, as sorted distinct 8-byte pieces.

    Digits left over at the end of a part belong to no value: see :func:`damaged_sets`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.unique(np.frombuffer(hex_values(text)[0], ">i8").astype(np.int64))
                if len(v):
                    ids.append(i)
                    out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "tokens"])

    return _texts(df, id_col, text_col).mapInArrow(run, "id bigint, tokens binary")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return src.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))


def damaged_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n_values, n_digits_left``: the rows with digits that make no whole value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, *hex_values(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            got = [(i, len(v) // 8, n) for i, v, n in got if n]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["id", "n_values", "n_digits_left"])

    return _texts(df, id_col, text_col).mapInArrow(run, "id bigint, n_values int, n_digits_left int")


def encode_sets(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """``id, tokens`` from an array column: integers as they are, other values by their 64-bit hash; null elements are ignored."""
    kind = df.schema[array_col].dataType.elementType.typeName()
    whole = kind in ("long", "integer", "short", "byte")
    value = (lambda x: x.cast("bigint")) if whole else (lambda x: F.xxhash64(x))
    vals = F.array_sort(F.array_distinct(F.transform(F.filter(F.col(array_col), lambda x: x.isNotNull()), value)))

    def run(batches):
        for b in batches:
            out = [np.asarray(v, np.int64).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "tokens"])

    src = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), vals.alias("v")).filter(F.size("v") > 0)
    return src.mapInArrow(run, "id bigint, tokens binary")


def collapse(sets: DataFrame, payload: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Classes of equal payload: ``cid, digest, payload`` (written) and members ``id, cid`` (lazy, distinct)."""
    digest = F.unhex(F.md5(F.col(payload).cast("binary"))).alias("digest")
    keyed = sets.select("id", digest, payload)
    one = keyed.groupBy("digest").agg(F.first(payload).alias(payload))
    classes = stage(one.select(F.monotonically_increasing_id().alias("cid"), "digest", payload), "classes")
    members = keyed.select("id", "digest").distinct().join(classes.select("digest", "cid"), "digest").select("id", "cid")
    return classes, members


def _heavy(classes: DataFrame) -> np.ndarray:
    """The heavy values, from the rarer to the more frequent. A value that is heavy at all is so in at least one task."""

    def local(batches):
        parts = [pieces(b.column(0))[0] for b in batches if b.num_rows]
        if not parts:
            return
        v, c = np.unique(np.concatenate(parts), return_counts=True)
        keep = c >= max(2, c.sum() / HEAVY)
        n = int(c.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(v[keep], 0)), pa.array(np.append(c[keep], n)), pa.array(np.append(np.zeros(keep.sum(), bool), True))], ["token", "c", "total"])

    got = classes.select("tokens").mapInArrow(local, "token bigint, c bigint, total boolean").groupBy("token", "total").agg(F.sum("c").alias("c"))
    got = stage(got, "heavy")
    entries = got.filter("total").agg(F.sum("c")).first()[0] or 0
    rows = got.filter(~F.col("total") & (F.col("c") >= max(entries / HEAVY, 64))).select("token", "c").collect()
    return np.array([r.token for r in sorted(rows, key=lambda r: (r.c, r.token))], np.int64)


def _records(classes: DataFrame, heavy: np.ndarray, t: float) -> DataFrame:
    """``cid, n, tokens``: values that occur in other classes too, in the global order, of the classes that can have a partner."""
    order = np.argsort(heavy)
    by_value = heavy[order]

    def explode(batches):
        for b in batches:
            data, off = pieces(b.column(1))
            n = np.diff(off)
            cid = column(b, "cid")
            at = np.searchsorted(by_value, data)
            hot = by_value[np.minimum(at, len(by_value) - 1)] == data if len(by_value) else np.zeros(len(data), bool)
            rows = np.repeat(np.arange(len(cid)), n)
            heads = []
            rank = order[at[hot]] if len(by_value) else np.zeros(0, np.int64)
            hot_rows = rows[hot]
            o = np.lexsort([rank, hot_rows])
            hot_off = np.searchsorted(hot_rows[o], np.arange(len(cid) + 1))
            heads = binary(data[hot][o], hot_off)
            none = pa.nulls(int((~hot).sum()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([data[~hot], np.zeros(len(cid), np.int64)])), pa.array(np.concatenate([cid[rows[~hot]], cid])), pa.array(np.concatenate([np.zeros(len(none), np.int32), n.astype(np.int32)])), pa.concat_arrays([none, heads])],
                ["token", "cid", "n", "hot"],
            )

    entries = classes.select("cid", "tokens").mapInArrow(explode, "token bigint, cid bigint, n int, hot binary")

    def count(batches):
        for x, long in whole_runs(batches, "token", FULL):
            if long:  # not held: all lists beyond FULL rank alike, then by value
                yield pa.RecordBatch.from_arrays([pa.array(column(x, "cid")), pa.array(np.full(x.num_rows, FULL, np.int32)), pa.array(column(x, "token"))], ["cid", "df", "token"])
                continue
            b = bounds(column(x, "token"))
            size = np.diff(b)
            df = np.repeat(size, size)
            keep = df > 1
            yield pa.RecordBatch.from_arrays([pa.array(column(x, "cid")[keep]), pa.array(df[keep].astype(np.int32)), pa.array(column(x, "token")[keep])], ["cid", "df", "token"])

    light = entries.filter("n = 0").select("token", "cid").repartition("token").sortWithinPartitions("token").mapInArrow(count, "cid bigint, df int, token bigint")
    head = classes.select("cid", "tokens").mapInArrow(explode, "token bigint, cid bigint, n int, hot binary").filter("n > 0").select("cid", (-F.col("n")).alias("df"), F.lit(0).cast("bigint").alias("token"), "hot")
    both = light.withColumn("hot", F.lit(None).cast("binary")).unionByName(head).repartition("cid").sortWithinPartitions("cid", "df", "token")

    def gather(batches):
        for x, _ in whole_runs(batches, "cid"):
            cid, df, token, hot = column(x, "cid"), column(x, "df"), column(x, "token"), x.column("hot").to_pylist()
            b = bounds(cid)
            ids, sizes, out = [], [], []
            for i, j in zip(b[:-1].tolist(), b[1:].tolist()):
                n = -int(df[i])
                tail = hot[i] or b""
                if j - i - 1 + len(tail) // 8 >= math.ceil(t * n - 1e-9):
                    ids.append(int(cid[i]))
                    sizes.append(n)
                    out.append(token[i + 1 : j].tobytes() + tail)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["cid", "n", "tokens"])

    return both.mapInArrow(gather, "cid bigint, n int, tokens binary")


def _possible(t, na, ra, pa_, nb, rb, pb):
    """Which pairs (a the larger) that meet at these positions of their shared values can still be similar."""
    need = required(t, na, nb)
    most = np.minimum(pa_, pb) + 1 + np.minimum(ra - pa_, rb - pb) - 1
    return (nb >= np.ceil(t * na - 1e-9)) & (need <= np.minimum(ra, rb)) & (need <= most)


def _sent(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Rows for the probes: ``cid`` and the sorted ids of one list before it."""
    o = np.lexsort([x["cid"][j], i])
    i, j = i[o], j[o]
    b = bounds(i) if len(i) else np.zeros(1, np.int64)
    none = [pa.nulls(len(b) - 1, pa.int64())] + [pa.nulls(len(b) - 1, pa.int32())] * 3
    return pa.RecordBatch.from_arrays([pa.array(x["cid"][i[b[:-1]]] if len(i) else np.zeros(0, np.int64)), binary(x["cid"][j], b), *none], ["cid", "ids", "token", "n", "r", "pos"])


_LISTS = "cid bigint, ids binary, token bigint, n int, r int, pos int"


def _lists(records: DataFrame, t: float, k: int) -> DataFrame:
    """``cid, ids``: for each record and short list of it, the list's ids before it that can be partners."""

    def prefixes(batches):
        for b in batches:
            data, off = pieces(b.column(2))
            n = column(b, "n").astype(np.int64)
            r = np.diff(off)
            need = np.ceil(t * n - 1e-9).astype(np.int64)
            size = np.minimum(r, r - need + np.minimum(k, need))
            rows = np.repeat(np.arange(len(n)), size)
            pos = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([pa.array(data[off[rows] + pos]), pa.array(column(b, "cid")[rows])] + [pa.array(v.astype(np.int32)) for v in (n[rows], r[rows], pos)], ["token", "cid", "n", "r", "pos"])

    names = ("token", "cid", "n", "r", "pos")
    entries = records.select("cid", "n", "tokens").mapInArrow(prefixes, "token bigint, cid bigint, n int, r int, pos int")

    def meet(batches):
        for table, long in whole_runs(batches, "token", LONG):
            if long:
                yield from table.select(["cid"]).append_column("ids", pa.nulls(table.num_rows, pa.binary())).append_column("token", table.column("token")).append_column("n", table.column("n")).append_column("r", table.column("r")).append_column("pos", table.column("pos")).combine_chunks().to_batches()
                continue
            x = {c: column(table, c) for c in names}
            b = bounds(x["token"])
            first = np.repeat(b[:-1], np.diff(b))
            mine = np.arange(len(first))
            at_i, at_j = [], []
            d, i = 1, mine[mine - 1 >= first]
            while len(i):
                j = i - d
                ok = _possible(t, x["n"][i], x["r"][i], x["pos"][i], x["n"][j], x["r"][j], x["pos"][j])
                at_i.append(i[ok])
                at_j.append(j[ok])
                d += 1
                i = i[i - d >= first[i]]
            if at_i:
                yield _sent(x, np.concatenate(at_i), np.concatenate(at_j))

    lists = stage(entries.repartition("token").sortWithinPartitions("token", "n", "cid").mapInArrow(meet, _LISTS), "lists")
    over = lists.filter("ids is null").select(*names)
    lists = lists.filter("ids is not null").select("cid", "ids")
    sizes = over.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    if over.isEmpty():
        return lists
    # long lists: entries fall into blocks, every pair of blocks of a list is a group of its own
    over = over.join(sizes, "token").withColumn("blocks", F.ceil(F.col("c") / LONG).cast("int"))
    over = over.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = over.select(*names, "block", other).select(*names, "block", F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")).alias("task"), (F.col("block") == F.col("other")).alias("same"))

    def blocks(batches):
        for table, _ in whole_runs(batches, "task"):
            every = {c: column(table, c) for c in (*names, "task", "block", "same")}
            b = bounds(every["task"])
            for s, e in zip(b[:-1], b[1:]):
                x = {c: v[s:e] for c, v in every.items()}
                for i in range(1, e - s):
                    j = np.arange(i)
                    ok = (x["token"][j] == x["token"][i]) & (x["same"][j] | (x["block"][j] != x["block"][i]))
                    ok &= _possible(t, x["n"][i], x["r"][i], x["pos"][i], x["n"][j], x["r"][j], x["pos"][j])
                    j = j[ok]
                    if len(j):
                        yield _sent(x, np.full(len(j), i), j)

    more = tasks.repartition("task").sortWithinPartitions("task", "n", "cid").mapInArrow(blocks, _LISTS)
    return lists.unionByName(more.select("cid", "ids"))


def merge_skip(lists: list[list[int]], need: int) -> list[int]:
    """Values found in at least ``need`` of the sorted lists; the heap skips what cannot reach that."""
    if need <= 1:
        return sorted(set().union(*lists))
    heap = [(v[0], i, 0) for i, v in enumerate(lists) if v]
    heapq.heapify(heap)
    out = []
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            out.append(top)
            for _, i, p in popped:
                if p + 1 < len(lists[i]):
                    heapq.heappush(heap, (lists[i][p + 1], i, p + 1))
            continue
        while heap and len(popped) < need - 1:
            popped.append(heapq.heappop(heap))
        if not heap:
            break
        goal = heap[0][0]
        for _, i, p in popped:
            p = bisect_left(lists[i], goal, p)
            if p < len(lists[i]):
                heapq.heappush(heap, (lists[i][p], i, p))
    return out


def _probe(records: DataFrame, lists: DataFrame, t: float, k: int) -> DataFrame:
    """``cid`` (candidate), ``probe, n, tokens``: merged short lists of each record."""
    none = F.lit(None).cast("binary")
    rows = records.select("cid", "n", "tokens", none.alias("ids")).unionByName(lists.select("cid", F.lit(0).alias("n"), none.alias("tokens"), "ids"))

    def run(batches):
        for table, _ in whole_runs(batches, "cid"):
            cid, n, tokens, ids = column(table, "cid"), column(table, "n"), table.column("tokens").to_pylist(), table.column("ids").to_pylist()
            b = bounds(cid)
            to, who, size, data = [], [], [], []
            for i, j in zip(b[:-1].tolist(), b[1:].tolist()):
                if j - i < 2:
                    continue
                least = min(k, math.ceil(t * math.ceil(t * int(n[i]) - 1e-9) - 1e-9))
                found = merge_skip([np.frombuffer(v, np.int64).tolist() for v in ids[i + 1 : j]], least)
                to += found
                who += [int(cid[i])] * len(found)
                size += [int(n[i])] * len(found)
                data += [tokens[i]] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(who, pa.int64()), pa.array(size, pa.int32()), pa.array(data, pa.binary())], ["cid", "probe", "n", "tokens"])

    return rows.repartition("cid").sortWithinPartitions("cid", F.col("n").desc()).mapInArrow(run, "cid bigint, probe bigint, n int, tokens binary")


def _search(records: DataFrame, probes: DataFrame, t: float) -> DataFrame:
    """``cid_a, cid_b, overlap, size_a, size_b`` of the pairs that reach the required overlap."""
    rows = records.select("cid", F.lit(None).cast("bigint").alias("probe"), "n", "tokens").unionByName(probes)

    def run(batches):
        own, own_id, own_n = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            cid, n, heads = column(b, "cid"), column(b, "n").astype(np.int64), np.asarray(b.column("probe").is_null())
            probe = b.column("probe").fill_null(-1).to_numpy(zero_copy_only=False)
            data, off = pieces(b.column("tokens"))
            got = []
            cut = bounds(cid)
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if heads[s]:
                    own, own_id, own_n = np.sort(data[off[s] : off[s + 1]]), cid[s], n[s]
                    s += 1
                if s == e or own_id != cid[e - 1]:
                    continue
                part = data[off[s] : off[e]]
                hit = own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part
                both = np.add.reduceat(hit, off[s:e] - off[s], dtype=np.int64)
                ok = both >= required(t, n[s:e], own_n)
                if ok.any():
                    got.append((probe[s:e][ok], np.full(ok.sum(), own_id), both[ok], n[s:e][ok], np.full(ok.sum(), own_n)))
            if got:
                a, c, o, na, nc = (np.concatenate(v) for v in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(o.astype(np.int32)), pa.array(na.astype(np.int32)), pa.array(nc.astype(np.int32))], ["cid_a", "cid_b", "overlap", "size_a", "size_b"])

    return rows.repartition("cid").sortWithinPartitions("cid", F.col("probe").asc_nulls_first()).mapInArrow(run, "cid_a bigint, cid_b bigint, overlap int, size_a int, size_b int")


def similar_classes(sets: DataFrame, threshold: float = 0.5, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Pairs of different sets (``cid_a, cid_b, overlap, size_a, size_b``) and members (``id, cid``) of all sets.

    ``sets``: ``id, tokens`` as of :func:`parse_hex_sets`; ``k``: occurrences wanted in the short lists. A table of its own
    is written for classes, records and lists.
    """
    spark = sets.sparkSession
    classes, members = collapse(sets)
    members = stage(members, "members")
    records = stage(_records(classes, _heavy(classes), threshold), "records")
    unstage(classes)
    lists = _lists(records, threshold, k)
    return _search(records, _probe(records, lists, threshold, k), threshold), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of ids (``id_a < id_b``, distinct) behind pairs of classes and within classes."""
    a, b = members.select(F.col("id").alias("x"), F.col("cid").alias("cid_a")), members.select(F.col("id").alias("y"), F.col("cid").alias("cid_b"))
    apart = pairs.select("cid_a", "cid_b").join(a, "cid_a").join(b, "cid_b").select("x", "y")
    same = a.join(b, F.col("cid_a") == F.col("cid_b")).filter("x < y").select("x", "y")
    both = apart.filter("x <> y").unionByName(same)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def link_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``id, cid, n_links``: for each id its class and how many other members of its own and of similar classes there are."""
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("c"))
    both = pairs.select("cid_a", "cid_b").unionByName(pairs.select(F.col("cid_b").alias("cid_a"), F.col("cid_a").alias("cid_b")))
    near = both.join(sizes.withColumnRenamed("cid", "cid_b"), "cid_b").groupBy(F.col("cid_a").alias("cid")).agg(F.sum("c").alias("near"))
    per = sizes.join(near, "cid", "left").select("cid", (F.col("c") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return members.join(per, "cid").select("id", "cid", "n_links")
