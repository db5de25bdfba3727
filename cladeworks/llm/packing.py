"""Items of varying length into containers of fixed capacity, with little unused space.

Method: shortest-pack-first over the histogram of lengths. Items longer than the capacity are cut into full pieces and a
rest; nothing else is split. The histogram has at most ``capacity`` rows, so it is small whatever the data. On it lengths
are placed longest first, each into the pattern with the shortest filling, as often as it fits (``shortest``; ``best``
takes the pattern that leaves least room); patterns and their counts are updated together, never item by item. The plan says, for each length, which ranks of items go to which containers; items
get their rank and are joined to the plan by (length, rank).

Scale. One pass for token counts, a map-side combined histogram, and one shuffle for ranks. A length that a third of all
items share is ranked in salted parts, of which there are at most ``PARTS`` beyond one a length, and so are the full pieces
of long items. Histogram, part sizes and plan are bounded by the capacity, not by the number of items, and go through the
driver. Numbers of containers depend on ids and lengths alone, so a plan evaluated twice gives the same.

Defined results: items of no tokens, null and empty texts get no container (``container_no`` null); ties in length go by
salt and id; repeated texts are items of their own; null ids count as items with a null id; no items give no containers.
"""

from __future__ import annotations


from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeworks.llm.tokens import RANKS, with_token_counts
from cladeworks.scratch import stage

#: Items of one length ranked in one task, about; with more than PART * PARTS items, a 1 / PARTS share of all.
PART, PARTS = 50_000, 4096




def plan(histogram: dict[int, int], capacity: int, rule: str = "shortest") -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows ``(length, first_rank, last_rank, first_container, per)`` and the number of containers.

    The item of ``length`` with rank r in [first_rank, last_rank] goes to container first_container + (r - first_rank) // per.
    A pattern is a range of containers with the same room left.
    """
    patterns: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first container, count)
    rooms: list[int] = []  # the rooms in use, ascending
    rows: list[tuple[int, int, int, int, int]] = []
    total = 0

    def put(room: int, base: int, count: int) -> None:
        if room > 0 and count:
            if room not in patterns:
                patterns[room] = []
                insort(rooms, room)
            patterns[room].append((base, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1] if rule == "shortest" else rooms[bisect_left(rooms, length)]
                base, count = patterns[room].pop()
                if not patterns[room]:
                    del patterns[room]
                    rooms.remove(room)
            else:
                room, base, count = capacity, total, -(-left // (capacity // length))
                total += count
            per = min(room // length, left)
            used = min(count, left // per)
            rows.append((length, rank, rank + used * per - 1, base, per))
            put(room - per * length, base, used)
            put(room, base + used, count - used)
            rank += used * per
            left -= used * per
    return rows, total


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """``id, piece, first_token, n_tokens, full``: one row per item, or several of an item longer than the capacity."""
    n = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    x = items.select("id", "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    first = F.col("piece") * F.lit(capacity)
    return x.select("id", "piece", first.alias("first_token"), F.least(F.col("n_tokens") - first, F.lit(capacity)).alias("n_tokens"))


def pack(items: DataFrame, capacity: int, rule: str = "shortest") -> DataFrame:
    """``id, piece, first_token, n_tokens, container_no`` for items ``id, n_tokens`` (written beforehand, read twice)."""
    spark = items.sparkSession
    cut = pieces(items, capacity)
    short = cut.filter(F.col("n_tokens") > 0)
    counts = {r.n_tokens: r.c for r in short.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect()}
    part = max(PART, sum(counts.values()) // PARTS)
    parts = [(n, -(-c // part)) for n, c in counts.items() if c > part]
    salted = short.withColumn("part", F.lit(0))
    sizes = []
    if parts:  # at most PARTS lengths
        table = spark.createDataFrame(parts, "n_tokens int, parts int")
        salted = short.join(F.broadcast(table), "n_tokens", "left").withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        sizes = salted.join(F.broadcast(table), "n_tokens", "left_semi").groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("c")).collect()
    starts: dict[tuple[int, int], int] = {}
    at: dict[int, int] = {}
    for r in sorted(sizes, key=lambda r: (r.n_tokens, r.part)):
        starts[r.n_tokens, r.part] = at.get(r.n_tokens, 0)
        at[r.n_tokens] = at.get(r.n_tokens, 0) + r.c
    rows, _ = plan(counts, capacity, rule)

    order = Window.partitionBy("n_tokens", "part").orderBy("id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(order).cast("bigint") - 1)
    starts = {k: v for k, v in starts.items() if v}
    if starts:
        off = spark.createDataFrame([(n, p, s) for (n, p), s in starts.items()], "n_tokens int, part int, start bigint")
        ranked = ranked.join(F.broadcast(off), ["n_tokens", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("start", F.lit(0)))
    none = cut.filter(F.col("n_tokens") == 0).select("id", "piece", "first_token", "n_tokens", F.lit(None).cast("bigint").alias("container_no"))
    return _place(ranked, rows).unionByName(none)


def _place(ranked: DataFrame, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Joins ranks to the plan: binary search in the plan's sorted (length, rank) table, sent with the task."""
    import numpy as np

    rows = sorted(rows)
    table = np.array(rows, np.int64).reshape(len(rows), 5)

    def run(batches):
        keys = [(int(a), int(b)) for a, b in table[:, :2]]
        first: dict[int, tuple[int, int]] = {}
        for i, (n, _) in enumerate(keys):
            s, e = first.get(n, (i, i))
            first[n] = (s, i + 1)
        for b in batches:
            n, r = b.column("n_tokens").to_numpy(), b.column("rank").to_numpy()
            out = np.zeros(len(n), np.int64)
            for length in np.unique(n):
                s, e = first[int(length)]
                mine = n == length
                at = s + np.searchsorted(table[s:e, 1], r[mine], "right") - 1
                out[mine] = table[at, 3] + (r[mine] - table[at, 1]) // table[at, 4]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "piece", "first_token", "n_tokens")), pa.array(out)], ["id", "piece", "first_token", "n_tokens", "container_no"])

    src = ranked.select("id", "piece", "first_token", "n_tokens", "rank")
    return src.mapInArrow(run, "id bigint, piece int, first_token int, n_tokens int, container_no bigint")


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """``id, n_tokens``, written once: a few bytes a document."""
    return stage(with_token_counts(docs, id_col, text_col, path=path), "lengths")


def pack_documents(lengths: DataFrame, containers: list[tuple[str, int]], rule: str = "shortest") -> DataFrame:
    """All of ``lengths`` into each kind of container: ``container, capacity, id, piece, first_token, n_tokens, container_no``."""
    out = None
    for name, capacity in containers:
        one = pack(lengths, capacity, rule).select(F.lit(name).alias("container"), F.lit(capacity).alias("capacity"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def utilisation(packed: DataFrame) -> DataFrame:
    """Per kind of container: number of containers, items, pieces of cut items, tokens and the share of room used."""
    each = packed.filter("container_no is not null").groupBy("container", "capacity", "container_no").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum(F.when((F.col("piece") > 0) | (F.col("n_tokens") == F.col("capacity")), 1).otherwise(0)).alias("cut"))
    return each.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"),
        (F.sum("t") / (F.count(F.lit(1)) * F.col("capacity"))).alias("used_share"),
    )


def container_list(spark: SparkSession, df: DataFrame, name: str = "container", capacity: str = "capacity_tokens") -> list[tuple[str, int]]:
    """The kinds of containers: a fixed small table of settings."""
    rows = df.filter(F.col(capacity) > 0).select(name, capacity).distinct().collect()
    return sorted((r[0], int(r[1])) for r in rows)
