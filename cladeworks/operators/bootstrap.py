"""Bootstrap of sites: replicates as rows, so any grouped operator runs all replicates in one job.

A replicate is the multiplicity of each site. ``draws`` takes as many draws as there are sites from a portable hash (md5),
which needs the sites numbered; ``poisson`` gives each site an independent Poisson(1) multiplicity from its own hash and
needs neither numbers nor a shuffle: use that for very many sites.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.operators import distances as M
from cladeworks.operators.numbering import numbered


def _hash(c: Column) -> Column:
    """28 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 7), 16, 10).cast("bigint")


def draws(sites: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """``rep, site, times``. ``sites``: ``site``, distinct; draw j of replicate r takes site number md5(seed:r:j) mod n, in order."""
    order = numbered(sites.select("site"), "site")
    n = order.agg(F.count(F.lit(1))).scalar()
    # the draws themselves come from the numbered sites: draw j for site number j
    x = order.select("no", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).withColumn("n", n)
    at = F.pmod(_hash(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("no").cast("string"))), F.col("n"))
    # parted by number alone, which serves the join too; Spark doesn't count replicates when it guesses sizes, so it must not choose to broadcast draws
    got = x.select("rep", at.alias("no")).repartition("no").groupBy("rep", "no").agg(F.count(F.lit(1)).alias("times"))
    return got.hint("merge").join(order, "no").select("rep", "site", "times")


def poisson(sites: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """``rep, site, times`` with times > 0."""
    u = _hash(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("site").cast("string"))) / F.lit(float(2**28))
    cuts, p, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += p
        cuts.append(total)
        p /= k + 1
    times = sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    x = sites.select("site", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).withColumn("u", u)
    return x.select("rep", "site", times.alias("times")).filter("times > 0")


def split_support(site_masks: DataFrame, sample: DataFrame, replicates: int, min_percent: float = 0.0) -> DataFrame:
    """``mask, n, confidence, weight``: in how many replicates a split occurs and its mean weight there. ``site_masks``: ``site, mask``."""
    w = site_masks.join(sample.hint("merge"), "site").groupBy("rep", "mask").agg(F.sum("times").alias("w"))
    g = w.groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("weight"))
    return g.select("mask", "n", (100.0 * F.col("n") / replicates).alias("confidence"), "weight").filter(F.col("confidence") >= min_percent)


def replicate_distances(pairs_by_site: DataFrame, sample: DataFrame) -> DataFrame:
    """``rep, t1, t2, d``: P-distances of every replicate. ``pairs_by_site``: ``site, t1, t2, differ`` of the sites compared."""
    x = pairs_by_site.join(sample, "site")
    return x.groupBy("rep", "t1", "t2").agg((F.sum(F.when(F.col("differ"), F.col("times")).otherwise(0)) / F.sum("times")).alias("d"))


def tree_support(replicates: DataFrame, reference: DataFrame, n: int) -> DataFrame:
    """``mask, support``: share of the ``n`` replicates (``rep, mask``) that hold each split of the reference tree."""
    hits = replicates.select("rep", "mask").distinct().groupBy("mask").agg(F.count(F.lit(1)).alias("c"))
    return reference.select("mask").join(hits, "mask", "left").select("mask", (F.coalesce("c", F.lit(0)) / n).alias("support"))


def bootstrap_pipeline(chars: DataFrame, sample: DataFrame, distance: Callable[[DataFrame], DataFrame], splits: Callable[..., DataFrame] = M.tree_splits_of, ntax: int = 63, **options) -> DataFrame:
    """``rep, mask, weight``: what ``distance`` and then ``splits`` make of every replicate, all replicates in one plan.

    ``distance`` is a function of pair counts (:mod:`cladeworks.operators.char_distances`), ``splits`` one of distances with
    ``group`` columns, as neighbor joining, neighbor-net or split decomposition. Undefined distances of a replicate become its
    largest defined one, or 1.
    """
    a = chars.select(F.col("taxon").alias("t1"), "site", F.col("ch").alias("ca"))
    b = chars.select(F.col("taxon").alias("t2"), "site", F.col("ch").alias("cb"))
    cells = a.join(b, "site").filter("t1 < t2").groupBy("site", "t1", "t2", "ca", "cb").agg(F.lit(1).alias("one"))
    rep = lambda t: (F.shiftleft(F.col("rep").cast("bigint"), 32) + F.col(t)).alias(t)
    pairs = cells.join(sample, "site").groupBy(rep("t1"), rep("t2"), "ca", "cb").agg(F.sum("times").cast("double").alias("w"))
    low = lambda t: F.col(t).bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias(t)
    d = distance(pairs).select(F.shiftright("t1", 32).cast("int").alias("rep"), low("t1"), low("t2"), "d")
    top = d.groupBy("rep").agg(F.coalesce(F.max("d"), F.lit(1.0)).alias("top"))
    d = d.join(top, "rep").select("rep", "t1", "t2", F.coalesce("d", "top").alias("d"))
    return splits(d, group=("rep",), ntax=ntax, **options)


def bootstrap_tree_splits(replicates: DataFrame, n: int, min_percent: float = 0.0) -> DataFrame:
    """``mask, n, confidence, weight``: every split of replicates ``rep, mask, weight`` with the share of the ``n`` replicates that hold it and its mean weight there."""
    one = replicates.groupBy("rep", "mask").agg(F.sum("weight").alias("weight"))
    g = one.groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight"))
    return g.select("mask", "n", (100.0 * F.col("n") / n).alias("confidence"), "weight").filter(F.col("confidence") >= min_percent)
