"""Distances ``t1 INT, t2 INT, d DOUBLE`` with t1 < t2: reports, and trees, splits and networks from whole matrices.

Sequential methods run as NumPy kernels on one matrix per group; give ``group`` columns (replicate, data set) to run many
matrices in parallel. A matrix has to fit one task, as its result does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.functions import kernels
from cladeworks.functions.bits import WORD, bits
from cladeworks.operators.splits import grouped, split_rows


def symmetric(d: DataFrame) -> DataFrame:
    return d.select("t1", "t2", "d").unionByName(d.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "d"))


def quartets(d: DataFrame) -> DataFrame:
    """``a, b, c, e, q0, q1, q2``: the three sums of every four taxa, ascending. Joins grow one taxon at a time."""
    x = lambda p, q: d.select(F.col("t1").alias(p), F.col("t2").alias(q), F.col("d").alias(p + q))
    t = x("a", "b").join(x("a", "c"), "a").filter("b < c").join(x("b", "c"), ["b", "c"])
    f = t.join(x("a", "e"), "a").filter("c < e").join(x("b", "e"), ["b", "e"]).join(x("c", "e"), ["c", "e"])
    s = F.array_sort(F.array(F.col("ab") + F.col("ce"), F.col("ac") + F.col("be"), F.col("ae") + F.col("bc")))
    return f.select("a", "b", "c", "e", s[0].alias("q0"), s[1].alias("q1"), s[2].alias("q2"))


def delta_scores(d: DataFrame) -> DataFrame:
    """``taxon, delta, q``: means over the quartets with the taxon; q is divided by the squared mean distance."""
    gap = F.col("q2") - F.col("q0")
    v = quartets(d).select(F.explode(F.array("a", "b", "c", "e")).alias("taxon"), F.when(gap > 1e-7, (F.col("q2") - F.col("q1")) / gap).otherwise(0.0).alias("delta"), ((F.col("q2") - F.col("q1")) ** 2).alias("q"))
    mean = d.agg(F.avg("d")).scalar()
    return v.groupBy("taxon").agg(F.avg("delta").alias("delta"), F.avg("q").alias("q")).withColumn("mean", mean).select("taxon", "delta", (F.col("q") / F.col("mean") ** 2).alias("q"))


def four_point_violations(d: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """One row ``quartets, violated``: how many quartets are not tree-like."""
    return quartets(d).agg(F.count(F.lit(1)).alias("quartets"), F.sum(F.when(F.col("q2") - F.col("q1") > tolerance, 1).otherwise(0)).alias("violated"))


def centred(d: DataFrame) -> DataFrame:
    """``t1, t2, b``: doubly centred halves of the negative squared distances, both directions and the diagonal."""
    s = symmetric(d).select("t1", "t2", (F.col("d") ** 2).alias("x"))
    n = s.agg(F.count_distinct("t1")).scalar()
    rows = s.groupBy("t1").agg(F.sum("x").alias("r")).withColumn("n", n).select("t1", (F.col("r") / F.col("n")).alias("r"))
    whole = rows.agg(F.avg("r")).scalar()
    taxa = rows.select("t1", F.col("t1").alias("t2"), F.lit(0.0).alias("x"))
    x = s.unionByName(taxa).join(rows, "t1").join(rows.select(F.col("t1").alias("t2"), F.col("r").alias("c")), "t2").withColumn("m", whole)
    return x.select("t1", "t2", (-0.5 * (F.col("x") - F.col("r") - F.col("c") + F.col("m"))).alias("b"))


def min_spanning_network(d: DataFrame, epsilon: float = 0.0, group: tuple[str, ...] = ()) -> DataFrame:
    """``t1, t2, d``: all pairs up to ``epsilon`` beyond the smallest value at which they connect all taxa."""
    return _pairs(d, lambda m: kernels.min_spanning_network(m, epsilon), group)


def min_spanning_tree(d: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """``t1, t2, d``: the edges of a minimum spanning tree."""
    return _pairs(d, kernels.min_spanning_tree, group)


def min_spanning_rooted(d: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """The minimum spanning tree with every taxon hung on by an edge of weight 0, rooted in the middle of its longest path."""

    def run(m, t):
        n = len(t)
        edges = [(n + a, n + b, w) for a, b, w in kernels.min_spanning_tree(m)] + [(n + i, i, 0.0) for i in range(n)]
        return _tree(kernels.midpoint_root(edges, list(range(n))), t)

    return _apply(d, group, TREE, run)


def _pairs(d: DataFrame, kernel, group: tuple[str, ...]) -> DataFrame:
    def run(m, taxa):
        e = kernel(m)
        return pd.DataFrame({"t1": np.array([min(taxa[a], taxa[b]) for a, b, _ in e], np.int32), "t2": np.array([max(taxa[a], taxa[b]) for a, b, _ in e], np.int32), "d": np.array([w for *_, w in e], float)})

    return _apply(d, group, "t1 int, t2 int, d double", run)


def _apply(d: DataFrame, group: tuple[str, ...], schema: str, run) -> DataFrame:
    """Runs ``run(matrix, taxa) -> DataFrame`` for each group."""
    keys = list(group) or ["g"]
    src = d if group else d.withColumn("g", F.lit(1))
    types = dict(src.dtypes)

    def one(p: pd.DataFrame) -> pd.DataFrame:
        out = run(*kernels.to_matrix(p.t1, p.t2, p.d))
        for k in reversed(group):
            out.insert(0, k, p[k].iloc[0])
        return out

    lead = "".join(f"{k} {types[k]}, " for k in group)
    return src.select("t1", "t2", "d", *keys).groupBy(*keys).applyInPandas(one, lead + schema)


def _tree(edges, taxa) -> pd.DataFrame:
    n = len(taxa)
    return pd.DataFrame({"parent": [p for p, *_ in edges], "child": [c for _, c, _ in edges], "weight": [w for *_, w in edges], "taxon": pd.array([taxa[c] if c < n else None for _, c, _ in edges], "Int32")})


TREE = "parent int, child int, weight double, taxon int"


def upgma(d: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    return _apply(d, group, TREE, lambda m, t: _tree(kernels.upgma(m), t))


def neighbor_joining(d: DataFrame, group: tuple[str, ...] = (), bio: bool = False) -> DataFrame:
    return _apply(d, group, TREE, lambda m, t: _tree(kernels.neighbor_joining(m, bio), t))


def _split_rows(splits, taxa, ntax: int = WORD) -> pd.DataFrame:
    move = lambda m: sum(1 << (t - 1) for i, t in enumerate(taxa) if m >> i & 1)
    return split_rows(bits(ntax), [(move(m), w) for m, w in splits])


def splits_ddl(ntax: int) -> str:
    return f"mask {bits(ntax).ddl}, weight double"


SPLITS = splits_ddl(WORD)


def neighbor_net(d: DataFrame, group: tuple[str, ...] = (), least: float = 1e-4, ntax: int = WORD) -> DataFrame:
    """Circular splits with non-negative least-squares weights. ``ntax``: the largest taxon number, which decides the form of masks."""
    return _apply(d, group, splits_ddl(ntax), lambda m, t: _split_rows(kernels.neighbor_net(m, least)[1], t, ntax))


def neighbor_net_cycle(d: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """``position, taxon``: the cycle from its first taxon on."""

    def run(m, t):
        c = kernels.neighbor_net_cycle(m)
        c = c[c.index(0) :] + c[: c.index(0)]
        return pd.DataFrame({"position": np.arange(1, len(c) + 1, dtype=np.int32), "taxon": np.array([t[i] for i in c], np.int32)})

    return _apply(d, group, "position int, taxon int", run)


def split_decomposition(d: DataFrame, group: tuple[str, ...] = (), buneman: bool = False, ntax: int = WORD) -> DataFrame:
    """Splits with positive isolation index."""
    return _apply(d, group, splits_ddl(ntax), lambda m, t: _split_rows(kernels.isolation_splits(m, buneman), t, ntax))


def buneman_tree(d: DataFrame, group: tuple[str, ...] = (), ntax: int = WORD) -> DataFrame:
    """Splits with positive Buneman index."""
    return split_decomposition(d, group, True, ntax)


def tree_splits_of(d: DataFrame, method: str = "neighbor_joining", group: tuple[str, ...] = (), ntax: int = WORD) -> DataFrame:
    """Splits of each group's tree: ``neighbor_joining``, ``bionj`` or ``upgma``."""
    make = {"neighbor_joining": kernels.neighbor_joining, "bionj": lambda m: kernels.neighbor_joining(m, True), "upgma": kernels.upgma}[method]
    return _apply(d, group, splits_ddl(ntax), lambda m, t: _split_rows(kernels.tree_splits(make(m), len(t)), t, ntax))


def pcoa(d: DataFrame, group: tuple[str, ...] = (), first: int = 1, second: int = 2) -> DataFrame:
    """``taxon, x, y, share, stress``: two principal coordinates (times 100), the share of variance they explain and their stress."""

    def run(m, t):
        xy, val = kernels.pcoa(m)
        pick = lambda k: xy[:, k - 1] * 100 if k <= xy.shape[1] else np.zeros(len(t))
        pos = val[val > 0].sum()
        share = sum(val[k - 1] for k in (first, second) if k <= xy.shape[1]) / pos if pos > 0 else 0.0
        two = np.stack([pick(first), pick(second)], 1) / 100
        flat = np.sqrt(((two[:, None] - two[None]) ** 2).sum(-1))
        top = (m**2).sum()
        stress = float(np.sqrt(((m - flat) ** 2).sum() / top)) if top > 0 else 0.0
        return pd.DataFrame({"taxon": np.array(t, np.int32), "x": pick(first), "y": pick(second), "share": share, "stress": stress})

    return _apply(d, group, "taxon int, x double, y double, share double, stress double", run)


def path_distances(edges: DataFrame, taxa: list[int], group: tuple[str, ...] = ()) -> DataFrame:
    """``t1, t2, d``: shortest path lengths between the taxa of a network ``src, dst, weight`` whose node ids include them."""
    from cladeworks.functions.networks import shortest

    def run(p: pd.DataFrame) -> pd.DataFrame:
        e = [(int(a), int(b), float(w)) for a, b, w in zip(p.src, p.dst, p.weight)]
        rows = []
        for s in taxa:
            dist = shortest(e, s)
            rows += [(s, t, dist[t]) for t in taxa if t > s and t in dist]
        return pd.DataFrame(rows, columns=["t1", "t2", "d"]).astype({"t1": "int32", "t2": "int32", "d": "float64"})

    return grouped(edges.select(*group, "src", "dst", "weight"), group, "t1 int, t2 int, d double", run)


def check_distances(edges: DataFrame, distances: DataFrame, taxa: list[int]) -> DataFrame:
    """``t1, t2, d, path, difference`` of given distances against the paths of a network; a pair without a path has a null one."""
    path = path_distances(edges, taxa).withColumnRenamed("d", "path")
    return distances.join(path, ["t1", "t2"], "left").select("t1", "t2", "d", "path", (F.col("path") - F.col("d")).alias("difference"))
