"""Splits as sets of taxa: ``mask`` is the side without taxon 1, ``weight DOUBLE``.

A mask is a BIGINT for up to 63 taxa and an ARRAY<BIGINT> beyond (:mod:`cladeworks.functions.bits`). Operators on pairs and
triples of splits are theta joins on bit tests; split systems are already grouped by mask, so they hold one row per
different split and stay small against the characters or trees they come from. The sequential operators take ``group``
columns, to run many systems in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.functions import kernels
from cladeworks.functions.bits import Narrow, bits, meet, overlap, subset, taxa_of
from cladeworks.scratch import small


def full_mask(ntax: int) -> int:
    return (1 << ntax) - 1


def bit(taxon: Column, ntax: int = 63) -> Column:
    return bits(ntax).bit(taxon)


def size(mask: Column, ntax: int = 63) -> Column:
    return bits(ntax).size(mask)


def canonical(mask: Column, ntax: int) -> Column:
    """The side without taxon 1."""
    b = bits(ntax)
    return F.when(b.has(mask, F.lit(1)), b.differ(b.full(), mask)).otherwise(mask)


def compatible(a: Column, b: Column, ntax: int) -> Column:
    """Whether one of the four intersections of sides is empty. Both masks lack taxon 1, so the complements always meet."""
    return ~overlap(bits(ntax), a, b)


def weakly_compatible(a: Column, b: Column, c: Column, ntax: int) -> Column:
    x = bits(ntax)
    na, nb, nc = (x.differ(x.full(), m) for m in (a, b, c))
    meets = lambda p, q, r: ~x.empty(x.both(x.both(p, q), r))
    one = meets(a, b, c) & meets(a, nb, nc) & meets(na, b, nc) & meets(na, nb, c)
    two = meets(na, nb, nc) & meets(na, b, c) & meets(a, nb, c) & meets(a, b, nc)
    return ~(one | two)


def site_masks(presence: DataFrame, ntax: int) -> DataFrame:
    """``site, m``: the taxa at state 1 of each site of ``taxon, site``."""
    return presence.groupBy("site").agg(bits(ntax).union(F.col("taxon")).alias("m"))


def binary_to_splits(chars: DataFrame, min_weight: float = 0.0, ntax: int = 63) -> DataFrame:
    """Sides at state 1 of two-state characters given as ``taxon, site`` of the taxa at state 1: weight is the number of sites."""
    return _by_mask(site_masks(chars, ntax), F.col("m"), min_weight, ntax)


def _by_mask(sites: DataFrame, mask: Column, min_weight: float, ntax: int) -> DataFrame:
    x = sites.select(mask.alias("mask"), F.lit(1.0).alias("w")).filter(~bits(ntax).empty(F.col("mask")))
    return x.groupBy("mask").agg(F.sum("w").alias("weight")).filter(F.col("weight") >= min_weight)


def presence_splits(presence: DataFrame, ntax: int, min_weight: float = 0.0) -> DataFrame:
    m = site_masks(presence, ntax)
    return _by_mask(m.filter(F.col("m") != bits(ntax).full()), canonical(F.col("m"), ntax), min_weight, ntax)


def dna_to_splits(chars: DataFrame, ntax: int, method: str = "majority", min_weight: float = 0.0, gap: str = "-", missing: str = "?") -> DataFrame:
    """Each site made binary: its most frequent state (the first letter among equals) against the rest, or purines against pyrimidines."""
    b = bits(ntax)
    low = chars.select("taxon", "site", F.lower("ch").alias("ch")).filter(~F.col("ch").isin(gap, missing))
    if method == "majority":
        n = low.groupBy("site", "ch").agg(F.count(F.lit(1)).alias("c"), b.union(F.col("taxon")).alias("m"))
        best = n.groupBy("site").agg(F.min(F.struct((-F.col("c")).alias("c"), "ch", "m")).alias("b"))
        masks = best.select("site", F.col("b.m").alias("m"))
    else:
        r, y = (F.col("ch").isin(*x) for x in ("agrdv", "ctuybh"))
        masks = low.groupBy("site").agg(b.union(F.col("taxon"), r).alias("r"), b.union(F.col("taxon"), y).alias("y"))
        masks = masks.select("site", F.when(b.size(F.col("r")) <= b.size(F.col("y")), F.col("r")).otherwise(F.col("y")).alias("m"))
    masks = masks.filter(~b.empty(F.col("m")) & (F.col("m") != b.full()))
    return _by_mask(masks, canonical(F.col("m"), ntax), min_weight, ntax)


def missing_trivial(splits: DataFrame, ntax: int, weight: float = 0.0) -> DataFrame:
    """The singletons that are not in ``splits``, with the given weight."""
    t = splits.sparkSession.range(1, ntax + 1).select(canonical(bit(F.col("id"), ntax), ntax).alias("mask"))
    return t.join(splits.select("mask"), "mask", "left_anti").select("mask", F.lit(weight).alias("weight"))


def weight_slider(splits: DataFrame, ntax: int, threshold: float = 0.0) -> DataFrame:
    kept = splits.filter(F.col("weight") >= threshold).select("mask", "weight")
    return kept.unionByName(missing_trivial(kept, ntax, 0.0))


def confidence_filter(splits: DataFrame, threshold: float) -> DataFrame:
    """Splits of ``mask, weight, confidence`` whose confidence reaches the threshold."""
    return splits.filter(F.col("confidence") >= threshold)


def splits_taxa_filter(splits: DataFrame, kept: list[int], merge: bool = False, ntax: int = 63) -> DataFrame:
    """Splits induced on the kept taxa (renumbered by their order). Splits with all taxa on one side go; ``merge`` sums equal ones."""
    old, new = bits(ntax), bits(len(kept))
    value = new.gather(sorted(kept), lambda t: old.has(F.col("mask"), t))
    out = splits.select(value.alias("mask"), "weight").select(canonical(F.col("mask"), len(kept)).alias("mask"), "weight").filter(~new.empty(F.col("mask")))
    return out.groupBy("mask").agg(F.sum("weight").alias("weight")) if merge else out


def incompatible_pairs(splits: DataFrame, ntax: int) -> DataFrame:
    a, b = splits.select(F.col("mask").alias("a")), splits.select(F.col("mask").alias("b"))
    return a.join(b, (F.col("a") < F.col("b")) & ~compatible(F.col("a"), F.col("b"), ntax))


def blob_filter(splits: DataFrame, ntax: int) -> DataFrame:
    """Splits compatible with all others."""
    other = splits.select(F.col("mask").alias("o"))
    return splits.join(other, ~compatible(F.col("mask"), F.col("o"), ntax), "left_anti")


def split_matrix(weighted: DataFrame) -> DataFrame:
    """``mask, set_id, weight`` of every split in every set of ``set_id, mask, weight``: 0 where it is absent.

    The result has splits x sets rows; sets are few (replicates, trees), and each split is exploded by their checked list.
    """
    ids = weighted.select("set_id").distinct()
    own = weighted.groupBy("set_id", "mask").agg(F.sum("weight").alias("weight"))
    cells = weighted.select("mask").distinct().join(small(ids))
    return cells.join(own, ["set_id", "mask"], "left").select("mask", "set_id", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def separated(splits: DataFrame, ntax: int) -> DataFrame:
    """``mask, weight, t1, t2`` for every pair of taxa that a split separates."""
    b = bits(ntax)
    taxa = F.sequence(F.lit(1), F.lit(ntax))
    on = lambda i: b.has(F.col("mask"), i)
    x = splits.select("mask", "weight", F.filter(taxa, on).alias("a"), F.filter(taxa, lambda i: ~on(i)).alias("b"))
    x = x.select("mask", "weight", F.explode("a").alias("i"), "b").select("mask", "weight", "i", F.explode("b").alias("j"))
    return x.select("mask", "weight", F.least("i", "j").alias("t1"), F.greatest("i", "j").alias("t2"))


def splits_to_distances(splits: DataFrame, ntax: int, use_weights: bool = True) -> DataFrame:
    v = F.col("weight") if use_weights else F.lit(1.0)
    return separated(splits, ntax).groupBy("t1", "t2").agg(F.sum(v).alias("d"))


def fits(splits: DataFrame, distances: DataFrame, ntax: int) -> DataFrame:
    """``least_squares, decomposition``: percentages of the distances that the splits explain."""
    s = splits_to_distances(splits, ntax).withColumnRenamed("d", "s")
    x = distances.join(s, ["t1", "t2"], "left").select("d", F.coalesce("s", F.lit(0.0)).alias("s"))
    two = 100 * (1 - F.sum((F.col("s") - F.col("d")) ** 2) / F.sum(F.col("d") ** 2))
    one = F.greatest(F.lit(0.0), 100 * (1 - F.sum(F.abs(F.col("s") - F.col("d"))) / F.sum("d")))
    return x.agg(two.alias("least_squares"), one.alias("decomposition"))


def phylogenetic_diversity(splits: DataFrame, taxa: list[int], ntax: int) -> DataFrame:
    """Sum of the weights of the splits with taxa of the set on both sides."""
    b = bits(ntax)
    s = b.of(taxa)
    both = meet(b, F.col("mask"), s) & ~subset(b, s, F.col("mask"))
    return splits.agg(F.sum(F.when(both, F.col("weight")).otherwise(0.0)).alias("diversity"))


def shapley_values(splits: DataFrame, ntax: int) -> DataFrame:
    """``taxon, value``: sum over splits of (far side) * weight / (taxa * near side)."""
    b = bits(ntax)
    x = splits.select("mask", "weight", b.size(F.col("mask")).alias("k"), F.explode(F.sequence(F.lit(1), F.lit(ntax))).alias("taxon"))
    near = F.when(b.has(F.col("mask"), F.col("taxon")), F.col("k")).otherwise(ntax - F.col("k"))
    return x.groupBy("taxon").agg(F.sum((ntax - near) * F.col("weight") / (ntax * near)).alias("value"))


def cyclic(splits: DataFrame, cycle: list[int]) -> DataFrame:
    """``mask, weight, is_cyclic``: whether the side without the cycle's first taxon is an interval of the cycle."""
    n = len(cycle)
    b, order = bits(n), F.array(*map(F.lit, cycle))
    head = b.has(F.col("mask"), F.lit(cycle[0]))
    side = F.when(head, b.differ(b.full(), F.col("mask"))).otherwise(F.col("mask"))
    at = F.filter(F.sequence(F.lit(1), F.lit(n)), lambda i: b.has(F.col("side"), F.element_at(order, i)))
    x = splits.select("mask", "weight", side.alias("side")).withColumn("at", at)
    return x.select("mask", "weight", (F.array_max("at") - F.array_min("at") + 1 == F.size("at")).alias("is_cyclic"))


def classify(splits: DataFrame, ntax: int, cycle: list[int] | None = None) -> DataFrame:
    """One row ``compatibility``: compatible, cyclic, weakly_compatible or incompatible, tested in this order."""
    a, b, c = (splits.select(F.col("mask").alias(x)) for x in "abc")
    bad = a.join(b, (F.col("a") < F.col("b")) & ~compatible(F.col("a"), F.col("b"), ntax)).agg(F.count(F.lit(1))).scalar()
    triples = a.join(b, F.col("a") < F.col("b")).join(c, (F.col("b") < F.col("c")) & ~weakly_compatible(F.col("a"), F.col("b"), F.col("c"), ntax))
    odd = triples.agg(F.count(F.lit(1))).scalar()
    off = cyclic(splits, cycle).filter("not is_cyclic").agg(F.count(F.lit(1))).scalar() if cycle else F.lit(1)
    one = splits.sparkSession.range(1).select(bad.alias("bad"), off.alias("off"), odd.alias("odd"))
    return one.select(F.when(F.col("bad") == 0, "compatible").when(F.col("off") == 0, "cyclic").when(F.col("odd") == 0, "weakly_compatible").otherwise("incompatible").alias("compatibility"))


def grouped(df: DataFrame, group: tuple[str, ...], schema: str, run) -> DataFrame:
    """``run`` on each group's rows; without ``group`` the whole table is one."""
    keys = list(group) or ["g"]
    src = df if group else df.withColumn("g", F.lit(1))
    types = dict(df.dtypes)

    def one(p: pd.DataFrame) -> pd.DataFrame:
        out = run(p.reset_index(drop=True))
        for k in reversed(group):
            out.insert(0, k, p[k].iloc[0])
        return out

    return src.groupBy(*keys).applyInPandas(one, "".join(f"{k} {types[k]}, " for k in group) + schema)


def split_rows(b: Narrow, splits) -> pd.DataFrame:
    """Kernel results ``(int, weight)`` as rows."""
    return pd.DataFrame({"mask": pd.Series([b.to_value(m) for m, _ in splits], dtype="int64" if type(b) is Narrow else object), "weight": pd.Series([float(w) for _, w in splits], dtype="float64")})


def _greedy(splits: DataFrame, ntax: int, kernel, group: tuple[str, ...] = ()) -> DataFrame:
    b = bits(ntax)

    def run(p):
        masks = [b.to_int(m) for m in p["mask"]]
        weight = dict(zip(masks, p["weight"].tolist()))
        return split_rows(b, [(m, weight[m]) for m in kernel(masks, p["weight"].tolist(), ntax)])

    return grouped(splits.select(*group, "mask", "weight"), group, f"mask {b.ddl}, weight double", run)


def greedy_compatible(splits: DataFrame, ntax: int, group: tuple[str, ...] = ()) -> DataFrame:
    """Heaviest first (then larger, then by mask), each kept if compatible with all kept. Sequential on the grouped splits."""
    return _greedy(splits, ntax, kernels.greedy_compatible, group)


def greedy_weakly_compatible(splits: DataFrame, ntax: int, group: tuple[str, ...] = ()) -> DataFrame:
    return _greedy(splits, ntax, kernels.greedy_weakly_compatible, group)


def greedy_circular(splits: DataFrame, ntax: int, group: tuple[str, ...] = ()) -> DataFrame:
    """Heaviest first, each kept if all kept still are intervals of some common cycle."""
    return _greedy(splits, ntax, kernels.greedy_circular, group)


def clique_compatible(splits: DataFrame, ntax: int, group: tuple[str, ...] = ()) -> DataFrame:
    """The compatible splits of the largest total weight, exactly (branch and bound)."""
    return _greedy(splits, ntax, kernels.clique_compatible, group)


def clique_circular(splits: DataFrame, ntax: int, cycle: list[int], group: tuple[str, ...] = ()) -> DataFrame:
    """The compatible splits of the largest total weight among those that are intervals of the cycle, in cubic time."""
    return _greedy(splits, ntax, lambda m, w, n: kernels.clique_circular(m, w, n, cycle), group)


def closest_tree(splits: DataFrame, ntax: int, group: tuple[str, ...] = ()) -> DataFrame:
    """The compatible splits that leave the least squared weight out: :func:`clique_compatible` on squares, with their own weights."""
    return _greedy(splits, ntax, lambda m, w, n: kernels.clique_compatible(m, [x * x for x in w], n), group)


def dimension_filter(splits: DataFrame, ntax: int, max_dimension: int = 4, group: tuple[str, ...] = ()) -> DataFrame:
    """Without the lightest splits that take part in more than ``max_dimension`` mutually incompatible ones."""
    return _greedy(splits, ntax, lambda m, w, n: kernels.dimension_filter(m, w, n, max_dimension), group)


def filtered(splits: DataFrame, ntax: int, method: str = "none", threshold: float = 0.0, max_dimension: int = 0) -> DataFrame:
    """Splits of at least the weight, then ``method``: none, greedy_compatible, greedy_weakly_compatible, greedy_circular, closest_tree or blob; then by dimension if that is above 0."""
    ways = {"none": lambda s, n: s, "greedy_compatible": greedy_compatible, "greedy_weakly_compatible": greedy_weakly_compatible, "greedy_circular": greedy_circular, "closest_tree": closest_tree, "blob": blob_filter}
    out = ways[method](splits.filter(F.col("weight") >= threshold).select("mask", "weight"), ntax)
    return dimension_filter(out, ntax, max_dimension) if max_dimension > 0 else out


def splits_cycle(splits: DataFrame, ntax: int, group: tuple[str, ...] = ()) -> DataFrame:
    """``position, taxon``: a cycle for the splits, by the neighbor-net ordering of the numbers of splits that separate two taxa."""
    b = bits(ntax)

    def run(p):
        c = kernels.splits_cycle([b.to_int(m) for m in p["mask"]], ntax)
        return pd.DataFrame({"position": pd.Series(range(1, ntax + 1), dtype="int32"), "taxon": pd.Series(c, dtype="int32")})

    return grouped(splits.select(*group, "mask"), group, "position int, taxon int", run)


def incompatibility_score(splits: DataFrame, ntax: int) -> DataFrame:
    """``score, percent``: weight of the non-trivial splits outside the greedy tree, absolute and of all their weight."""
    inner = splits.filter(size(F.col("mask"), ntax).between(2, ntax - 2))
    tree = greedy_compatible(splits, ntax).select("mask")
    out = inner.join(tree, "mask", "left_anti").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("score"))
    total = inner.agg(F.sum("weight")).scalar()
    return out.select("score", (100 * F.col("score") / total).alias("percent"))


def with_taxa(splits: DataFrame, ntax: int) -> DataFrame:
    """``taxa STRING`` (numbers, ascending, by commas) in place of the mask: the same text for both forms of mask."""
    text = F.array_join(F.transform(taxa_of(bits(ntax), F.col("mask"), ntax), lambda t: t.cast("string")), ",")
    return splits.select(text.alias("taxa"), *(c for c in splits.columns if c != "mask"))
