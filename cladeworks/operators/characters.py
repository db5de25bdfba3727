"""Characters: site patterns, pairwise state counts, site filters and statistics.

A block in long form is ``taxon INT, site, ch STRING`` and optionally ``w DOUBLE``. Sites with the same column of states
are one pattern with a summed weight, so the pair stage costs (distinct patterns) x (pairs) instead of (sites) x (pairs)
rows, and its shuffle carries one combined row per pair and state pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.operators.numbering import numbered


def site_patterns(chars: DataFrame, gap: str = "-") -> DataFrame:
    """``pattern ARRAY<STRING>`` (the states by taxon in order, ``gap`` where a taxon has none), ``taxa ARRAY<INT>``, ``w``."""
    w = F.first("w") if "w" in chars.columns else F.lit(1.0)
    taxa = chars.select("taxon").distinct().agg(F.array_sort(F.collect_list("taxon")).alias("t")).scalar()
    cells = chars.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("taxon", "ch"))).alias("m"), w.alias("w"))
    full = F.transform(F.col("taxa"), lambda t: F.coalesce(F.col("m")[t], F.lit(gap)))
    return cells.withColumn("taxa", taxa).select("taxa", full.alias("pattern"), "w").groupBy("taxa", "pattern").agg(F.sum("w").alias("w"))


def pair_counts(chars: DataFrame, gap: str = "-") -> DataFrame:
    """``t1, t2, ca, cb, w``: summed weight of sites with these states, for every pair of taxa t1 < t2."""
    p = site_patterns(chars, gap)
    one = p.select("taxa", "pattern", "w", F.explode(F.sequence(F.lit(1), F.size("taxa") - 1)).alias("i")).filter(F.size("taxa") > 1)
    two = one.select("taxa", "pattern", "w", "i", F.explode(F.sequence(F.col("i") + 1, F.size("taxa"))).alias("j"))
    at = lambda c, i: F.element_at(c, F.col(i))
    return two.select(at("taxa", "i").alias("t1"), at("taxa", "j").alias("t2"), at("pattern", "i").alias("ca"), at("pattern", "j").alias("cb"), "w").groupBy("t1", "t2", "ca", "cb").agg(F.sum("w").alias("w"))


def _when(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("w")).otherwise(0.0))


def taxa_filter(df: DataFrame, keep: DataFrame, *columns: str) -> DataFrame:
    """Rows whose taxa (in each of ``columns``) are in ``keep``: for characters, distances and genomes alike."""
    for c in columns:
        df = df.join(keep.select(F.col("taxon").alias(c)), c, "left_semi")
    return df


def renumber(taxa: DataFrame, disabled: DataFrame) -> DataFrame:
    """Taxa without the ``disabled`` names, numbered from 1 in order: ``taxon, old, name``."""
    kept = taxa.join(disabled, "name", "left_anti")
    return numbered(kept.select("taxon", "name"), "taxon").select((F.col("no") + 1).cast("int").alias("taxon"), F.col("taxon").alias("old"), "name")


def site_statistics(chars: DataFrame, ntax: Column | int, gap: str = "-") -> DataFrame:
    """``site, states, singles, gaps, constant, uninformative``; a gap is a state here, as a missing cell is."""
    n = chars.groupBy("site", "ch").agg(F.count(F.lit(1)).alias("c"))
    s = n.groupBy("site").agg(F.count(F.lit(1)).alias("seen"), F.sum("c").alias("cells"), F.min("c").alias("least"), F.max(F.when(F.col("ch") == gap, F.col("c"))).alias("written"))
    gaps = (F.lit(ntax) - F.col("cells") + F.coalesce("written", F.lit(0))).cast("bigint")
    absent = F.lit(ntax) - F.col("cells")
    states = F.col("seen") + F.when((absent > 0) & F.col("written").isNull(), 1).otherwise(0)
    least = F.when((absent > 0) & F.col("written").isNull(), F.least("least", absent)).otherwise(F.col("least"))
    return s.select("site", states.cast("int").alias("states"), least.cast("bigint").alias("least"), gaps.alias("gaps"), (states == 1).alias("constant"), ((states == 2) & (least == 1)).alias("uninformative"))


def characters_filter(chars: DataFrame, ntax, *, gap_sites=False, uninformative=False, constant=False, codon_positions: tuple[int, ...] = (), site_number: str | None = None, gap: str = "-", disabled: DataFrame | None = None) -> DataFrame:
    """Without gap, parsimony-uninformative or constant sites, the given codon positions (1, 2, 3) of a numeric site column, or the sites of ``disabled``.

    Gap sites go whenever asked for (``gap_sites``), on its own or with the others.
    """
    out = chars
    if gap_sites or uninformative or constant:
        s = site_statistics(chars, ntax, gap)
        bad = F.lit(False)
        for asked, c in ((gap_sites, F.col("gaps") > 0), (uninformative, F.col("uninformative")), (constant, F.col("constant"))):
            bad = bad | c if asked else bad
        out = out.join(s.filter(bad).select("site"), "site", "left_anti")
    if codon_positions:
        out = out.filter(~F.pmod(F.col(site_number or "site") - 1, F.lit(3)).isin([p - 1 for p in codon_positions]))
    if disabled is not None:
        out = out.join(disabled.select("site"), "site", "left_anti")
    return out


def tajima_d(chars: DataFrame, ntax: int, gap: str = "-", exclude_gaps: bool = True) -> DataFrame:
    """One row: ``sites, segregating, pi, watterson, d``. Mean pairwise differences are over all sites, segregating sites over those kept."""
    kept = characters_filter(chars, ntax, gap_sites=exclude_gaps, gap=gap)
    s = kept.groupBy("site").agg(F.count_distinct("ch").alias("k")).agg(F.count(F.lit(1)).alias("sites"), F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("segregating"))
    n = float(ntax)
    a1, a2 = sum(1 / i for i in range(1, ntax)), sum(1 / i**2 for i in range(1, ntax))
    c1, c2 = (n + 1) / (3 * (n - 1)) - 1 / a1, 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / a1**2
    e1, e2 = c1 / a1, c2 / (a1**2 + a2)
    differ = pair_counts(chars, gap).agg(_when((F.col("ca") != F.col("cb"))).alias("x")).scalar()
    seg = F.col("segregating").cast("double")
    x = s.select("sites", "segregating", (differ / (n * (n - 1) / 2)).alias("pi"), (seg / a1).alias("watterson"))
    return x.select("*", ((F.col("pi") - F.col("watterson")) / F.sqrt(F.lit(e1) * seg + F.lit(e2) * seg * (seg - 1))).alias("d"))


def quartet_v_scores(chars: DataFrame, gap: str = "-", missing: str = "?") -> DataFrame:
    """``i, j, k, l, v`` for every four taxa: the largest capture-recapture estimate of the variable share of sites (1 at most).

    Patterns of four states are summed before the estimate, so the shuffle has one row per quartet and pattern.
    """
    p = site_patterns(chars, gap)
    x = p.select("taxa", "pattern", "w", F.size("taxa").alias("n")).filter("n >= 4")
    x = x.select("*", F.explode(F.expr("sequence(1, n - 3)")).alias("i")).select("*", F.explode(F.expr("sequence(i + 1, n - 2)")).alias("j"))
    x = x.select("*", F.explode(F.expr("sequence(j + 1, n - 1)")).alias("k")).select("*", F.explode(F.expr("sequence(k + 1, n)")).alias("l"))
    for c in "ijkl":
        x = x.withColumn(f"s{c}", F.element_at("pattern", F.col(c)))
    good = F.lit(True)
    for c in "ijkl":
        good = good & ~F.col(f"s{c}").isin(gap, missing)
    ne = lambda a, b: F.col(f"s{a}") != F.col(f"s{b}")
    agg = [F.sum("w").alias("good"), _when(~(ne("i", "j") | ne("i", "k") | ne("i", "l"))).alias("const")]
    sums = {f"{a}{b}": ne(a, b) for a, b in ("ij", "ik", "il", "jk", "jl", "kl")}
    sums |= {"ij_kl": ne("i", "j") & ne("k", "l"), "ik_jl": ne("i", "k") & ne("j", "l"), "il_jk": ne("i", "l") & ne("j", "k")}
    ids = [F.element_at("taxa", F.col(c)).alias(f"t{n}") for n, c in enumerate("ijkl", 1)]
    q = x.filter(good).groupBy(*ids).agg(*agg, *(_when(c).alias(f"f_{k}") for k, c in sums.items()))
    v = 1 - F.col("const") / F.col("good")
    for a, b in (("ij", "kl"), ("ik", "jl"), ("il", "jk")):
        both = F.col(f"f_{a}_{b}")
        v = F.greatest(v, F.when(both > 0, F.col(f"f_{a}") * F.col(f"f_{b}") / both / F.col("good")).otherwise(0.0))
    return q.select("t1", "t2", "t3", "t4", F.least(v, F.lit(1.0)).alias("v"))


def haplotypes(chars: DataFrame) -> DataFrame:
    """``taxon, haplotype, size``: taxa with the same states at the same sites, named by the smallest of them."""
    row = chars.groupBy("taxon").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws("=", F.col("site").cast("string"), "ch")))), 256).alias("h"))
    g = row.groupBy("h").agg(F.min("taxon").alias("haplotype"), F.count(F.lit(1)).alias("size"))
    return row.join(g, "h").select("taxon", "haplotype", "size")


def haplotype_groups(chars: DataFrame, gap: str = "-") -> DataFrame:
    """``taxon, haplotype, size``: taxa linked by pairs that differ at no site where both are observed, named by the smallest.

    Unlike :func:`haplotypes` this joins sequences that are equal but for gaps and missing characters, through others too.
    """
    from cladeworks.operators.char_distances import hamming
    from cladeworks.operators.components import components

    same = hamming(pair_counts(chars, gap), gap=gap).filter("d = 0").select("t1", "t2")
    linked = components(same, "t1", "t2").select(F.col("node").cast("int").alias("taxon"), F.col("component").cast("int").alias("haplotype"))
    all_ = chars.select("taxon").distinct().join(linked, "taxon", "left").select("taxon", F.coalesce("haplotype", "taxon").alias("haplotype"))
    return all_.join(all_.groupBy("haplotype").agg(F.count(F.lit(1)).alias("size")), "haplotype").select("taxon", "haplotype", "size")


def haplotype_traits(groups: DataFrame, traits: DataFrame) -> DataFrame:
    """``haplotype, trait, value``: sums of numeric traits (``taxon, trait, value``) over the taxa of each haplotype; other values count their taxa as ``trait=value``."""
    number = F.expr("try_cast(value as double)")
    x = traits.join(groups.select("taxon", "haplotype"), "taxon").select("haplotype", F.when(number.isNotNull(), F.col("trait")).otherwise(F.concat_ws("=", "trait", "value")).alias("trait"), F.coalesce(number, F.lit(1.0)).alias("v"))
    return x.groupBy("haplotype", "trait").agg(F.sum("v").alias("value"))


def phi_test(chars: DataFrame, window: int = 100, gap: str = "-", missing: str = "?") -> DataFrame:
    """One row ``informative, k, phi, mean, variance, p``: pairwise homoplasy index test for recombination.

    A site is informative with at least two states seen twice. Two sites' incompatibility is edges - nodes + parts of the
    graph of their states. The mean over close pairs is held against its moments when sites are shuffled (band matrix
    against incompatibilities, by the moments of a two-matrix permutation statistic). p is -1 with too few sites.
    The informative sites' pairs go through one task, which holds sites x sites numbers.
    """
    import math

    import numpy as np
    import pandas as pd

    cells = chars.select("site", "taxon", F.lower("ch").alias("ch")).filter(~F.col("ch").isin(gap, missing))
    n = cells.groupBy("site", "ch").agg(F.count(F.lit(1)).alias("c"))
    ok = n.filter("c >= 2").groupBy("site").agg(F.count(F.lit(1)).alias("k")).filter("k >= 2").select("site")
    sites = chars.agg(F.count_distinct("site")).scalar()
    rows = cells.join(ok, "site").groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct(F.col("taxon").cast("string"), "ch"))).alias("m")).withColumn("sites", sites)

    def score(x, y):
        both = x.keys() & y.keys()
        edges = {(x[t], y[t]) for t in both}
        nodes = {("x", v) for v in x.values()} | {("y", v) for v in y.values()}
        up = {v: v for v in nodes}

        def find(v):
            while up[v] != v:
                v = up[v]
            return v

        for a, b in edges:
            up[find(("x", a))] = find(("y", b))
        return len(edges) - len(nodes) + len({find(v) for v in nodes})

    def run(p):
        p = p.sort_values("site")
        maps = [dict(m) for m in p.m]
        m, total = len(maps), int(p.sites.iloc[0])
        k = max(1, int(window * m / total + 0.5))
        s = np.zeros((m, m))
        for i in range(m):
            for j in range(i + 1, m):
                s[i, j] = s[j, i] = score(maps[i], maps[j])
        out = {"informative": m, "k": k, "phi": np.nan, "mean": np.nan, "variance": np.nan, "p": -1.0}
        if m >= 2 * k and m > 3:
            i = np.arange(m)
            near = ((np.abs(i[:, None] - i[None, :]) <= k) & (i[:, None] != i[None, :])).astype(float)
            a0, a1, a2 = near.sum(), (near**2).sum(), (near.sum(1) ** 2).sum()
            b0, b1, b2 = s.sum(), (s**2).sum(), (s.sum(1) ** 2).sum()
            n2, n3, n4 = m * (m - 1), m * (m - 1) * (m - 2), m * (m - 1) * (m - 2) * (m - 3)
            mean = a0 * b0 / n2
            square = 2 * a1 * b1 / n2 + 4 * (a2 - a1) * (b2 - b1) / n3 + (a0**2 + 2 * a1 - 4 * a2) * (b0**2 + 2 * b1 - 4 * b2) / n4
            var = square - mean**2
            t = (near * s).sum()
            z = (t - mean) / math.sqrt(var) if var > 0 else 0.0
            out |= {"phi": t / a0, "mean": mean / a0, "variance": var / a0**2, "p": 0.5 * math.erfc(-z / math.sqrt(2))}
        return pd.DataFrame([out])

    return rows.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(run, "informative int, k int, phi double, mean double, variance double, p double")
