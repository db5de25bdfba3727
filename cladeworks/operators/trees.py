"""Rooted trees as clusters: ``tree_id INT, mask`` (taxa below an edge), ``weight DOUBLE`` of the edge.

A mask is a BIGINT for up to 63 taxa and an ARRAY<BIGINT> beyond (:mod:`cladeworks.functions.bits`).

The clusters of a tree determine it, so consensus, comparison and diversity of whole collections are groupings by mask
and joins on masks; trees never travel as strings between operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.functions.bits import bits, bits_in, meet, overlap, subset, taxa_of
from cladeworks.operators.splits import canonical, separated
from cladeworks.scratch import small


def tree_splits(clusters: DataFrame, ntax: int) -> DataFrame:
    """``tree_id, mask, weight``: splits of each tree; the two edges at a root of degree two are summed."""
    x = clusters.filter(F.col("mask") != bits(ntax).full()).select("tree_id", canonical(F.col("mask"), ntax).alias("mask"), "weight")
    return x.groupBy("tree_id", "mask").agg(F.sum("weight").alias("weight"))


def n_trees(clusters: DataFrame) -> Column:
    return clusters.agg(F.count_distinct("tree_id")).scalar()


STATISTICS = ("mean", "median", "count", "sum", "uniform", "tree_size_mean", "normalized_sum")


def consensus_splits(clusters: DataFrame, ntax: int, threshold: float = 50.0, statistic: str = "mean") -> DataFrame:
    """``mask, n, confidence, weight`` of the splits in more than ``threshold`` percent of the trees.

    Strict consensus: 99.999999; majority: 50; network: any lower value. The median is the upper one of an even number.
    """
    s = tree_splits(clusters, ntax)
    if statistic in ("tree_size_mean", "normalized_sum"):
        total = F.sum("weight").over(Window.partitionBy("tree_id"))
        s = s.withColumn("share", F.when(total > 0, F.col("weight") / total).otherwise(0.0))
    if statistic == "median":  # places within the split's weights, which a sort may spill
        s = s.select("*", F.row_number().over(Window.partitionBy("mask").orderBy("weight")).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("mask")).alias("m"))
    values = {
        "mean": F.avg("weight"), "sum": F.sum("weight"), "count": F.count(F.lit(1)).cast("double"), "uniform": F.lit(1.0),
        "median": F.max(F.when(F.col("k") == F.floor(F.col("m") / 2) + 1, F.col("weight"))) if statistic == "median" else F.lit(0.0),
        "tree_size_mean": F.avg("share") if "share" in s.columns else F.lit(0.0), "normalized_sum": F.sum("share") if "share" in s.columns else F.lit(0.0),
    }
    g = s.groupBy("mask").agg(F.count(F.lit(1)).alias("n"), values[statistic].cast("double").alias("weight"))
    g = g.withColumn("confidence", 100.0 * F.col("n") / n_trees(clusters))
    return g.filter(F.col("confidence") > threshold).select("mask", "n", "confidence", "weight")


def consensus_clusters(clusters: DataFrame, threshold: float = 50.0) -> DataFrame:
    """``mask, n, weight``: clusters in more than ``threshold`` percent of the trees with their mean weights."""
    g = clusters.groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight"))
    return g.withColumn("t", n_trees(clusters)).filter(100.0 * F.col("n") > threshold * F.col("t")).select("mask", "n", "weight")


def hasse_covers(clusters: DataFrame) -> DataFrame:
    """``parent, child``: pairs of masks with nothing between them."""
    m, x = clusters.select("mask").distinct(), bits_in(clusters)
    sub = lambda a, b: subset(x, F.col(a), F.col(b)) & (F.col(a) != F.col(b))
    pairs = m.select(F.col("mask").alias("child")).join(m.select(F.col("mask").alias("parent")), sub("child", "parent"))
    return pairs.join(m.select(F.col("mask").alias("mid")), sub("child", "mid") & sub("mid", "parent"), "left_anti")


def robinson_foulds(clusters: DataFrame, ntax: int, normalize: bool = False) -> DataFrame:
    """``t1, t2, d`` for every pair of trees: splits in one of them only; ``normalize`` divides by those in either less the number of taxa.

    Shared splits are counted on the non-trivial ones alone: a trivial split is held by nearly all trees, so as a join key it
    would meet all pairs. Which trivial splits a tree has is a set of taxa; two trees share as many as their sets do.
    """
    b = bits(ntax)
    s = tree_splits(clusters, ntax).select("tree_id", "mask", b.size(F.col("mask")).alias("k"))
    single = F.when(F.col("k") == 1, F.array_min(taxa_of(b, F.col("mask"), ntax))).when(F.col("k") == ntax - 1, F.lit(1))
    sizes = s.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(single)).alias("leaves"))
    inner = s.filter((F.col("k") > 1) & (F.col("k") < ntax - 1))
    p, q = inner.select(F.col("tree_id").alias("t1"), "mask"), inner.select(F.col("tree_id").alias("t2"), "mask")
    common = p.join(q, "mask").filter("t1 < t2").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("c"))
    x = sizes.select(F.col("tree_id").alias("t1"), F.col("n").alias("n1"), F.col("leaves").alias("l1"))
    y = sizes.select(F.col("tree_id").alias("t2"), F.col("n").alias("n2"), F.col("leaves").alias("l2"))
    pairs = x.join(y, F.col("t1") < F.col("t2")).join(common, ["t1", "t2"], "left")
    pairs = pairs.withColumn("c", F.coalesce("c", F.lit(0)) + F.when(F.col("l1") == F.col("l2"), F.size("l1")).otherwise(F.size(F.array_intersect("l1", "l2"))))
    d = F.col("n1") + F.col("n2") - 2 * F.col("c")
    whole = F.col("n1") + F.col("n2") - F.col("c") - ntax
    return pairs.select("t1", "t2", (F.when(whole > 0, d / whole).otherwise(0.0) if normalize else d.cast("double")).alias("d"))


def average_distances(clusters: DataFrame, ntax: int, topological: bool = False, compat: bool = False) -> DataFrame:
    """``t1, t2, d``: mean over the trees of the path length between two taxa; ``compat`` halves the weighted form."""
    s = tree_splits(clusters, ntax)
    if topological:
        s = s.withColumn("weight", F.lit(1.0))
    total = s.groupBy("mask").agg(F.sum("weight").alias("weight"))
    d = separated(total, ntax).groupBy("t1", "t2").agg(F.sum("weight").alias("d"))
    by = n_trees(clusters) * (2.0 if compat and not topological else 1.0)
    return d.withColumn("by", by).select("t1", "t2", (F.col("d") / F.col("by")).alias("d"))


def fair_proportions(clusters: DataFrame, ntax: int) -> DataFrame:
    """``tree_id, taxon, value``: each edge's weight shared evenly among the taxa below it."""
    x = clusters.select("tree_id", "mask", (F.col("weight") / bits(ntax).size(F.col("mask"))).alias("v"), F.explode(taxa_of(bits(ntax), F.col("mask"), ntax)).alias("taxon"))
    return x.groupBy("tree_id", "taxon").agg(F.sum("v").alias("value"))


def equal_splits(clusters: DataFrame, ntax: int) -> DataFrame:
    """``tree_id, taxon, value``: each edge's weight divided by the out-degrees on the way down to the taxon."""
    x = bits(ntax)
    size = x.size
    sub = lambda a, b: subset(x, F.col(a), F.col(b)) & (F.col(a) != F.col(b))
    c = clusters.select("tree_id", "mask", "weight")
    up = c.select("tree_id", F.col("mask").alias("above"), F.col("weight").alias("w"))
    pairs = c.select("tree_id", "mask").join(up, "tree_id").filter(sub("mask", "above"))
    parent = pairs.groupBy("tree_id", "mask").agg(F.min_by("above", size(F.col("above"))).alias("parent"))
    degree = parent.groupBy("tree_id", "parent").agg(F.count(F.lit(1)).alias("deg"))
    logs = parent.join(degree, ["tree_id", "parent"]).select("tree_id", "mask", F.log(F.col("deg")).alias("l"))
    on = c.select("tree_id", "mask", "weight", F.explode(taxa_of(x, F.col("mask"), ntax)).alias("taxon"))
    on = on.join(logs, ["tree_id", "mask"], "left").withColumn("l", F.coalesce("l", F.lit(0.0)))
    below = Window.partitionBy("tree_id", "taxon").orderBy(size(F.col("mask")), "mask").rowsBetween(Window.unboundedPreceding, -1)
    on = on.withColumn("down", F.coalesce(F.sum("l").over(below), F.lit(0.0)))
    return on.groupBy("tree_id", "taxon").agg(F.sum(F.col("weight") * F.exp(-F.col("down"))).alias("value"))


def tree_diversity(clusters: DataFrame, taxa: list[int], rooted: bool = True) -> DataFrame:
    """``tree_id, diversity``: weights of the edges above a taxon of the set (unrooted: and not above all of them)."""
    b = bits_in(clusters)
    s = b.of(taxa)
    ok = meet(b, F.col("mask"), s)
    if not rooted:
        ok = ok & ~subset(b, s, F.col("mask"))
    return clusters.groupBy("tree_id").agg(F.sum(F.when(ok, F.col("weight")).otherwise(0.0)).alias("diversity"))


def unique_topologies(clusters: DataFrame, ntax: int, unrooted: bool = False) -> DataFrame:
    """``tree_id, n``: the first tree of each topology and how many trees have it."""
    b = bits(ntax)
    m = canonical(F.col("mask"), ntax) if unrooted else F.col("mask")
    x = clusters.select("tree_id", m.alias("m")).filter(~b.empty(F.col("m")) & (F.col("m") != b.full()))
    sig = x.groupBy("tree_id").agg(F.array_sort(F.collect_set("m")).alias("sig"))
    return sig.groupBy("sig").agg(F.min("tree_id").alias("tree_id"), F.count(F.lit(1)).alias("n")).select("tree_id", "n")


def tree_statistics(clusters: DataFrame, ntax: int = 63) -> DataFrame:
    """``tree_id, n_taxa, n_edges, length``."""
    b = bits(ntax)
    return clusters.groupBy("tree_id").agg(b.size(b.union_of(F.col("mask"))).cast("int").alias("n_taxa"), F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("length"))


def trees_filter(clusters: DataFrame, min_taxa: int = 1, min_length: float = 0.0, all_taxa: bool = False, ntax: int = 63) -> DataFrame:
    """Trees of at least that many taxa (``all_taxa``: of all ``ntax``) and that total length."""
    least = ntax if all_taxa else min_taxa
    ok = tree_statistics(clusters, ntax).filter((F.col("n_taxa") >= least) & (F.col("length") >= min_length))
    return clusters.join(ok.select("tree_id"), "tree_id", "left_semi")


def trees_by_name(clusters: DataFrame, names: DataFrame, disabled: DataFrame) -> DataFrame:
    """Trees whose name (``tree_id, name``) is not in ``disabled`` (``name``)."""
    gone = names.join(disabled.select("name"), "name", "left_semi").select("tree_id")
    return clusters.join(gone, "tree_id", "left_anti")


def edges_filter(clusters: DataFrame, min_length: float = 0.0, uniform: bool = False, rescale: bool = False, min_confidence: float = 0.0) -> DataFrame:
    """Contracts short or weakly supported internal edges (drops their clusters), sets weights to 1, or scales positive weights to sum 100 in each tree.

    ``min_confidence`` looks at a column ``confidence``; edges without a value are kept.
    """
    keep = F.col("weight") >= min_length
    if min_confidence > 0:
        keep = keep & (F.coalesce("confidence", F.lit(min_confidence)) >= min_confidence)
    out = clusters.filter(keep | (bits_in(clusters).size(F.col("mask")) == 1))
    if uniform:
        out = out.withColumn("weight", F.lit(1.0))
    if rescale:
        total = F.sum(F.when(F.col("weight") > 0, F.col("weight"))).over(Window.partitionBy("tree_id"))
        out = out.withColumn("weight", F.when(total > 0, F.col("weight") * 100 / total).otherwise(F.col("weight")))
    return out.select("tree_id", "mask", "weight")


def tree_selector(clusters: DataFrame, which: int = 1) -> DataFrame:
    """The tree of that number, or the last one beyond it."""
    top = clusters.agg(F.max("tree_id")).scalar()
    return clusters.withColumn("top", top).filter(F.col("tree_id") == F.least(F.lit(max(1, which)), F.col("top"))).select("tree_id", "mask", "weight")


def conflicts(clusters: DataFrame) -> DataFrame:
    """``mask, n_conflicting``: for each cluster, the trees that hold a cluster it overlaps without inclusion."""
    m, t = clusters.select("mask").distinct(), clusters.select("tree_id", F.col("mask").alias("o"))
    bad = m.join(t, overlap(bits_in(clusters), F.col("mask"), F.col("o")))
    n = bad.groupBy("mask").agg(F.count_distinct("tree_id").alias("n"))
    return m.join(n, "mask", "left").select("mask", F.coalesce("n", F.lit(0)).alias("n_conflicting"))


def concordance_filter(clusters: DataFrame, min_concordance: float = 0.0) -> DataFrame:
    """Without internal clusters that conflict with at least int(trees * (1 - percent / 100)) trees (one at the least)."""
    least = F.greatest(F.floor(n_trees(clusters) * (1 - min_concordance / 100)), F.lit(1))
    bad = conflicts(clusters).withColumn("least", least).filter(F.col("n_conflicting") >= F.col("least")).select("mask")
    inner = clusters.join(bad.filter(bits_in(clusters).size(F.col("mask")) > 1), "mask", "left_anti")
    return inner.select("tree_id", "mask", "weight")


def confidence_network(clusters: DataFrame, ntax: int, level: float = 0.95) -> DataFrame:
    """``mask, weight, low, high``: splits with simultaneous confidence intervals that reach above 0; weight is the median.

    A split has weight 0 in trees without it. The cut-off rank is the smallest that covers ``level`` of the trees wholly.
    """
    s = tree_splits(clusters, ntax)
    trees, masks = s.select("tree_id").distinct(), s.select("mask").distinct()
    cells = masks.join(small(trees)).join(s, ["mask", "tree_id"], "left").select("mask", "tree_id", F.coalesce("weight", F.lit(0.0)).alias("x"))
    med = cells.groupBy("mask").agg(F.percentile("x", F.lit(0.5)).alias("median"))
    r = cells.join(med, "mask").select("mask", "tree_id", "median", F.abs(F.col("x") - F.col("median")).alias("r"))
    by = Window.partitionBy("mask").orderBy("r")
    r = r.select("*", F.count(F.lit(1)).over(by.rangeBetween(Window.unboundedPreceding, 0)).alias("h"), F.row_number().over(by).alias("k"))
    # trees by their largest rank: one row per rank, so the running count holds no tree ids
    ranks = r.groupBy("tree_id").agg(F.max("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    run = ranks.select("h", F.sum("c").over(Window.orderBy("h")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("all"))
    cut = run.filter(F.col("upto") >= F.ceil(F.lit(level) * F.col("all"))).agg(F.min("h")).scalar()
    out = r.withColumn("cut", cut).filter(F.col("k") == F.col("cut"))
    return out.select("mask", F.col("median").alias("weight"), (F.col("median") - F.col("r")).alias("low"), (F.col("median") + F.col("r")).alias("high")).filter("high > 0")


def transfer_support(clusters: DataFrame, ntax: int, reference: int = 1) -> DataFrame:
    """``mask, support`` of the reference tree's non-trivial splits: 1 - mean over trees of the transfer distance / (side - 1)."""
    b = bits(ntax)
    s = tree_splits(clusters, ntax).select("tree_id", "mask")
    own = s.filter((F.col("tree_id") == reference) & b.size(F.col("mask")).between(2, ntax - 2))
    splits = own.agg(F.collect_list("mask")).scalar()  # fewer than twice the taxa
    k = b.size(b.differ(F.col("e"), F.col("mask")))
    x = s.withColumn("es", splits).select("tree_id", "mask", F.explode("es").alias("e"))
    d = x.groupBy("e", "tree_id").agg(F.min(F.least(k, ntax - k)).alias("d"))
    side = F.least(b.size(F.col("e")), ntax - b.size(F.col("e"))) - 1
    return d.groupBy("e").agg(F.avg(F.greatest(F.lit(0.0), 1 - F.col("d") / side)).alias("support")).select(F.col("e").alias("mask"), "support")


def rooted_triples(clusters: DataFrame, ntax: int) -> DataFrame:
    """``a, b, c, n``: number of trees in which a and b (a < b) are closer to one another than to c."""
    b = bits(ntax)
    taxa = F.sequence(F.lit(1), F.lit(ntax))
    on = lambda i: b.has(F.col("mask"), i)
    x = clusters.filter(b.size(F.col("mask")) > 1).select("tree_id", F.filter(taxa, on).alias("i"), F.filter(taxa, lambda t: ~on(t)).alias("o"))
    x = x.select("tree_id", "i", "o", F.explode("i").alias("a")).select("tree_id", "a", "o", F.explode("i").alias("b")).filter("a < b")
    x = x.select("tree_id", "a", "b", F.explode("o").alias("c")).distinct()
    return x.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))


def one_spr_pairs(clusters: DataFrame, ntax: int) -> DataFrame:
    """``t1, t2``: different trees whose unshared clusters become equal by moving one common pruned taxon set.

    A single move changes the clusters along one path, so after removing the moved taxa all clusters agree. Candidate
    sets are the clusters of the first tree.
    """
    c = clusters.select("tree_id", "mask")
    sig = c.groupBy("tree_id").agg(F.array_sort(F.collect_set("mask")).alias("s"))
    a, b = sig.select(F.col("tree_id").alias("t1"), F.col("s").alias("x")), sig.select(F.col("tree_id").alias("t2"), F.col("s").alias("y"))
    pairs = a.join(b, (F.col("t1") < F.col("t2")) & (F.col("x") != F.col("y")))
    m = bits(ntax)
    less = lambda v, p: F.array_sort(F.array_distinct(F.filter(F.transform(v, lambda c: m.minus(c, p)), lambda c: ~m.empty(c))))
    ok = F.exists("x", lambda p: F.exists("y", lambda q: q == p) & (less(F.col("x"), p) == less(F.col("y"), p)))
    return pairs.filter(ok).select("t1", "t2")


def taxa_filter(clusters: DataFrame, kept: list[int]) -> DataFrame:
    """Trees restricted to the kept taxa (numbers unchanged): edges that become one add up, those above the new root go."""
    b = bits_in(clusters)
    s = b.of(kept)
    x = clusters.select("tree_id", F.col("mask").alias("old"), b.both(F.col("mask"), s).alias("mask"), "weight")
    x = x.filter(~b.empty(F.col("mask")) & ~subset(b, s, F.col("old")))
    return x.groupBy("tree_id", "mask").agg(F.sum("weight").alias("weight"))


def mutual_refinement(clusters: DataFrame) -> DataFrame:
    """Each tree with the clusters of other trees that overlap no cluster of it and no other such candidate; new edges have weight 0.

    A candidate is refused by the conflicts of its cluster alone, which are found once per pair of different clusters.
    """
    b = bits_in(clusters)
    c = clusters.select("tree_id", "mask")
    masks = c.select("mask").distinct()
    clash = masks.join(masks.select(F.col("mask").alias("o")), overlap(b, F.col("mask"), F.col("o")))
    refused = clash.join(c.withColumnRenamed("mask", "o"), "o").select("tree_id", "mask").distinct()
    fits = masks.join(small(c.select("tree_id").distinct())).join(c, ["tree_id", "mask"], "left_anti").join(refused, ["tree_id", "mask"], "left_anti")
    others = clash.join(fits.withColumnRenamed("mask", "o"), "o").select("tree_id", "mask").distinct()
    alone = fits.join(others, ["tree_id", "mask"], "left_anti")
    return clusters.select("tree_id", "mask", "weight").unionByName(alone.select("tree_id", "mask", F.lit(0.0).alias("weight")))


def triple_symmetry(clusters: DataFrame, ntax: int, alpha: float = 0.05, least: int = 10) -> DataFrame:
    """``a, b, c, n1, n2, n3, resolved, asymmetric``: for every three taxa the counts of the topologies ab|c, ac|b, bc|a, and two tests.

    *Resolved*: the most frequent topology exceeds a third of the trees; *asymmetric*: the two others differ. Both by the
    normal approximation with continuity correction, at level ``alpha`` (one-sided, two-sided), from ``least`` trees on.
    """
    from statistics import NormalDist

    t = rooted_triples(clusters, ntax).select(F.array_sort(F.array("a", "b", "c")).alias("s"), "c", "n")
    pick = lambda k: F.coalesce(F.max(F.when(F.col("c") == F.col("s")[k], F.col("n"))), F.lit(0))
    g = t.groupBy("s").agg(pick(2).alias("n1"), pick(1).alias("n2"), pick(0).alias("n3"))
    total, o = F.col("n1") + F.col("n2") + F.col("n3"), F.array_sort(F.array("n1", "n2", "n3"))
    one, two = NormalDist().inv_cdf(1 - alpha), NormalDist().inv_cdf(1 - alpha / 2)
    top = (o[2] - 0.5 - total / 3) / F.sqrt(total * 2 / 9)
    rest = o[0] + o[1]
    side = F.when(rest > 0, (F.abs(o[1] - rest / 2) - 0.5) / F.sqrt(rest / 4)).otherwise(0.0)
    enough = total >= least
    return g.select(F.col("s")[0].alias("a"), F.col("s")[1].alias("b"), F.col("s")[2].alias("c"), "n1", "n2", "n3", (enough & (top > one)).alias("resolved"), (enough & (side > two)).alias("asymmetric"))


def sample_trees(clusters: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` of the trees (all, if there are fewer), those with the smallest hashes of number and seed."""
    ids = clusters.select("tree_id").distinct().orderBy(F.xxhash64("tree_id", F.lit(seed)), "tree_id").limit(n)
    return clusters.join(ids, "tree_id", "left_semi")


def consensus_outline(clusters: DataFrame, ntax: int, threshold: float = 0.0, statistic: str = "mean") -> DataFrame:
    """``mask, weight``: the consensus splits that share a cycle, taken by the number of trees that hold them, with the weights of the statistic."""
    from cladeworks.operators.splits import greedy_circular

    s = consensus_splits(clusters, ntax, threshold, statistic)
    kept = greedy_circular(s.select("mask", F.col("n").cast("double").alias("weight")), ntax).select("mask")
    return s.join(kept, "mask").select("mask", "weight")


def triple_contraction(clusters: DataFrame, ntax: int, alpha: float = 0.05, least: int = 10) -> DataFrame:
    """Trees without the inner edges that incomplete lineage sorting may explain.

    An edge above a cluster is kept if some three taxa, two of them in the cluster and one beside it, are *resolved* by
    :func:`triple_symmetry` with the two of the cluster as the pair; else it is contracted.
    """
    b = bits_in(clusters)
    t = triple_symmetry(clusters, ntax, alpha, least).filter("resolved")
    top = F.greatest("n1", "n2", "n3")
    pair = F.when(F.col("n1") == top, F.array("a", "b", "c")).when(F.col("n2") == top, F.array("a", "c", "b")).otherwise(F.array("b", "c", "a"))
    good = t.select(pair.alias("p")).select(F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("p")[2].alias("z"))
    inner = clusters.filter(b.size(F.col("mask")) > 1).select("mask").distinct()
    x = inner.join(good, b.has(F.col("mask"), F.col("x")) & b.has(F.col("mask"), F.col("y")) & ~b.has(F.col("mask"), F.col("z")), "left_semi")
    single = clusters.filter(b.size(F.col("mask")) == 1)
    whole = clusters.filter(b.size(F.col("mask")) == ntax)
    kept = clusters.filter(b.size(F.col("mask")).between(2, ntax - 1)).join(x, "mask", "left_semi")
    return single.unionByName(whole).unionByName(kept).select("tree_id", "mask", "weight")


def selected_splits(clusters: DataFrame, ntax: int, which: int = 1) -> DataFrame:
    """``mask, weight``: the splits of the tree of that number, or of the last one."""
    return tree_splits(tree_selector(clusters, which), ntax).select("mask", "weight")


def tree_shapley(clusters: DataFrame, ntax: int, which: int = 1) -> DataFrame:
    """``taxon, value``: unrooted Shapley values of one tree."""
    from cladeworks.operators.splits import shapley_values

    return shapley_values(selected_splits(clusters, ntax, which), ntax)
