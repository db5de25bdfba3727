"""MinHash sketches of sequences, distances between sketches, and statistics of Bloom filters."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.functions.hashes import windows


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """``genome, h``: distinct md5 digests of all runs of ``k`` characters. ``seqs``: ``genome, seq`` (several rows allowed)."""
    at = F.explode(F.sequence(F.lit(1), F.char_length("seq") - k + 1)).alias("i")
    x = seqs.filter(F.char_length("seq") >= k).select("genome", "seq", at)
    return x.select("genome", F.md5(F.substring("seq", F.col("i"), F.lit(k)).cast("binary")).alias("h")).distinct()


def sketch(seqs: DataFrame, k: int = 15, s: int = 1000) -> DataFrame:
    """``genome, h``: the ``s`` smallest distinct digests of each genome.

    Every task keeps only the ``s`` smallest of each genome it meets (``s`` digests of 32 characters a genome), so at most
    tasks x genomes x s rows are shuffled.
    """

    def smallest(batches):
        kept: dict[str, np.ndarray] = {}  # digests as rows of two big-endian halves, sorted
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(1).to_pylist()
            code = b.column(0).dictionary_encode()
            names, of_row = code.dictionary.to_pylist(), code.indices.to_numpy()
            # equal runs are told by a 64-bit hash first, so each is digested once a batch
            joined, start, h = windows(texts, k)
            _, first, run = np.unique(h, return_index=True, return_inverse=True)
            raw = b"".join([hashlib.md5(joined[i : i + k].encode("utf-8", "surrogatepass")).digest() for i in start[first].tolist()])
            digest = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)
            rank = np.empty(len(digest), np.int64)
            rank[np.lexsort([digest[:, 1], digest[:, 0]])] = np.arange(len(digest))
            place = rank[run]
            in_order = digest[np.argsort(rank)]
            ends = np.cumsum([len(x) + 1 for x in texts])
            genome = of_row[np.searchsorted(ends, start, "right")]
            for g in range(len(names)):
                held = np.zeros(len(digest), bool)
                held[place[genome == g]] = True
                both = np.concatenate([kept.get(names[g], in_order[:0]), in_order[np.flatnonzero(held)[:s]]])
                kept[names[g]] = np.unique(both, axis=0)[:s]
        for genome, rows in kept.items():
            out = [f"{a:016x}{c:016x}" for a, c in rows.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([genome] * len(out), pa.string()), pa.array(out, pa.string())], ["genome", "h"])

    src = seqs.filter(F.col("genome").isNotNull() & (F.char_length("seq") >= k)).select(F.col("genome").cast("string").alias("genome"), "seq")
    x = src.mapInArrow(smallest, "genome string, h string").distinct()
    whole = Window.partitionBy("genome").orderBy("h")
    return x.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= s).select("genome", "h")


def jaccard(sketches: DataFrame, s: int) -> DataFrame:
    """``g1, g2, shared, used``: shared digests among the ``s`` smallest of both sketches together, for every pair.

    Genomes meet by the lists of equal digests. A common digest's place in the union is the sum of its places in both sketches
    less the number of common ones up to it, so no sketch travels with a pair; pairs without a common digest have only sizes.
    """
    ranked = sketches.select("genome", "h", F.row_number().over(Window.partitionBy("genome").orderBy("h")).alias("r"))
    left, right = ranked.select(F.col("genome").alias("g1"), "h", F.col("r").alias("r1")), ranked.select(F.col("genome").alias("g2"), "h", F.col("r").alias("r2"))
    met = left.join(right, "h").filter("g1 < g2")
    met = met.withColumn("i", F.row_number().over(Window.partitionBy("g1", "g2").orderBy("h")))
    n = met.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("common"), F.sum(F.when(F.col("r1") + F.col("r2") - F.col("i") <= s, 1).otherwise(0)).alias("shared"))
    sizes = sketches.groupBy("genome").agg(F.count(F.lit(1)).alias("n"))
    one, two = sizes.select(F.col("genome").alias("g1"), F.col("n").alias("n1")), sizes.select(F.col("genome").alias("g2"), F.col("n").alias("n2"))
    x = one.join(two, F.col("g1") < F.col("g2")).join(n, ["g1", "g2"], "left")
    return x.select("g1", "g2", F.coalesce("shared", F.lit(0)).cast("int").alias("shared"), F.least(F.lit(s), F.col("n1") + F.col("n2") - F.coalesce("common", F.lit(0))).cast("int").alias("used"))


def mash_distance(j: Column, k: int) -> Column:
    """-ln(2j / (1 + j)) / k; 1 for j = 0."""
    return F.when(j > 0, F.greatest(F.lit(0.0), -F.log(2 * j / (1 + j)) / k)).otherwise(1.0)


def mash_distances(seqs: DataFrame, k: int = 15, s: int = 1000) -> DataFrame:
    j = jaccard(sketch(seqs, k, s), s)
    return j.select("g1", "g2", "shared", mash_distance(F.col("shared") / F.col("used"), k).alias("d"))


def hex_ones(h: Column) -> Column:
    """Number of one bits in a hexadecimal text."""
    text = F.lower(h)
    total = F.lit(0)
    for k, digits in ((1, "1248"), (2, "3569ac"), (3, "7bde"), (4, "f")):
        total = total + k * (F.length(text) - F.length(F.translate(text, digits, "")))
    return total


def bloom_statistics(filters: DataFrame, id_col: str, hex_col: str, hashes: int = 7) -> DataFrame:
    """``id, bits, ones, estimate``: estimated number of values in each filter, -m/k ln(1 - ones/m); null if all bits are one."""
    x = filters.filter(F.col(hex_col).isNotNull() & (F.length(hex_col) > 0)).select(F.col(id_col).alias("id"), (F.length(hex_col) * 4).alias("bits"), hex_ones(F.col(hex_col)).alias("ones"))
    fill = F.col("ones") / F.col("bits")
    return x.select("id", "bits", "ones", F.when(fill < 1, -F.col("bits") / hashes * F.log(1 - fill)).alias("estimate"))


def bloom_filter(values: DataFrame, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """``word, mask``: the non-zero 64-bit words of a Bloom filter over ``h STRING``, built by ``bit_or`` with map-side combining."""
    x = values.select(F.explode(_positions(F.col("h"), bits, hashes)).alias("p"))
    return x.groupBy(F.floor(F.col("p") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("p", F.lit(64)).cast("int"))).alias("mask"))


def _positions(h: Column, bits: int, hashes: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), h), F.lit(bits)) for i in range(hashes)))


def bloom_contains(values: DataFrame, words: DataFrame, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """``h, hit``: whether all bits of each value are set. False positives occur, false negatives do not."""
    x = values.select("h").distinct().select("h", F.explode(_positions(F.col("h"), bits, hashes)).alias("p"))
    x = x.withColumn("word", F.floor(F.col("p") / 64).cast("int")).join(words, "word", "left")
    one = F.coalesce(F.call_function("shiftright", F.col("mask"), F.pmod("p", F.lit(64)).cast("int")).bitwiseAND(F.lit(1)), F.lit(0))
    return x.groupBy("h").agg((F.min(one) == 1).alias("hit"))


def hex_tokens(text: Column) -> Column:
    """The distinct values of 16 hexadecimal digits in a text, whatever stands between them."""
    h = F.regexp_replace(F.lower(text), "[^0-9a-f]", "")
    n = F.floor(F.length(h) / 16).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(h, i * 16 + 1, F.lit(16)))
    return F.when(n > 0, F.array_sort(F.array_distinct(cut))).otherwise(F.array().cast("array<string>"))


def least_jaccard(max_distance: float, k: int) -> float:
    """Jaccard similarity at a Mash distance."""
    import math

    x = math.exp(-k * max_distance)
    return x / (2 - x)


def search(reference: DataFrame, queries: DataFrame, k: int, max_distance: float, top: int = 25, best_only: bool = False) -> DataFrame:
    """``query, rank, id, jaccard, d``: for each query the ``top`` nearest sketches within ``max_distance``, ties by id.

    Both sides are ``id, tokens ARRAY<STRING>``. A match shares at least one of the query's rarest values: as many as are left
    when the required overlap is taken off. Only those meet the reference's inverted lists, so frequent values are hardly
    ever joined; what meets is then compared whole. ``best_only``: only the matches at the smallest distance.
    """
    j = least_jaccard(max_distance, k)
    lists = reference.select("id", F.explode("tokens").alias("t"))
    df = lists.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    q = queries.filter(F.size("tokens") > 0).select(F.col("id").alias("query"), F.col("tokens").alias("qt"))
    asked = q.select("query", F.size("qt").alias("n"), F.explode("qt").alias("t")).join(df, "t")
    rare = Window.partitionBy("query").orderBy("df", "t")
    # values that the reference lacks come first in the order; they take up places without being probed
    lacking = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("query"))
    asked = asked.withColumn("at", F.row_number().over(rare) + lacking).filter(F.col("at") <= F.col("n") - F.ceil(F.lit(j) * F.col("n") - 1e-9) + 1)
    met = asked.select("query", "t").join(lists, "t").select("query", "id").filter("query <> id").distinct()
    x = met.join(q, "query").join(reference.select("id", "tokens"), "id")
    common = F.size(F.array_intersect("qt", "tokens"))
    x = x.select("query", "id", (common / (F.size("qt") + F.size("tokens") - common)).alias("jaccard")).withColumn("d", mash_distance(F.col("jaccard"), k))
    x = x.filter(F.col("d") <= max_distance + 1e-12)
    order = Window.partitionBy("query").orderBy(F.round("d", 12), "id")
    x = x.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    if best_only:
        x = x.withColumn("least", F.min("d").over(Window.partitionBy("query"))).filter(F.col("d") == F.col("least"))
    return x.select("query", "rank", "id", "jaccard", "d")


def lowest_common(matches: DataFrame, paths: DataFrame) -> DataFrame:
    """``query, n, ancestor``: the lowest node on the paths of all matches. ``paths``: ``node, path``; at most ``top`` paths meet."""
    x = matches.join(paths.select(F.col("node").alias("id"), "path"), "id")
    g = x.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.collect_list("path").alias("p"))
    same = F.filter(F.element_at("p", 1), lambda v: F.forall("p", lambda path: F.array_contains(path, v)))
    return g.select("query", "n", F.when(F.size(same) > 0, F.try_element_at(same, F.lit(-1))).alias("ancestor"))


def sketch_lines(sketches: DataFrame) -> DataFrame:
    """``value``: one line a genome, its name, a tab and its sorted digests (the first 16 digits of each), to be written as text."""
    g = sketches.groupBy("genome").agg(F.array_join(F.array_sort(F.collect_set(F.substring("h", 1, 16))), ",").alias("s"))
    return g.select(F.concat_ws("\t", "genome", "s").alias("value"))


def read_sketches(spark, path: str) -> DataFrame:
    """``genome, tokens ARRAY<STRING>`` of files of :func:`sketch_lines`."""
    x = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    return x.select(F.col("p")[0].alias("genome"), hex_tokens(F.col("p")[1]).alias("tokens"))
