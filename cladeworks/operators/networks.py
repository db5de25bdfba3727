"""Rooted networks and plain networks: one kernel run per network, in parallel over networks.

A rooted network is rows ``net_id, parent, child, weight, taxon`` (taxon of the child if it is a leaf).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.functions import kernels
from cladeworks.functions import networks as N
from cladeworks.functions.bits import WORD, bits
from cladeworks.operators.splits import grouped, split_rows

EDGES = "net_id int, parent int, child int, weight double, taxon int"


def _edges(p: pd.DataFrame):
    e = [(int(a), int(b), float(w)) for a, b, w in zip(p.parent, p.child, p.weight)]
    return e, {int(c): int(t) for c, t in zip(p.child, p.taxon) if t == t and t is not None}


def _rows(net_id, edges, leaves) -> pd.DataFrame:
    edges = sorted(edges)
    return pd.DataFrame({"net_id": net_id, "parent": [e[0] for e in edges], "child": [e[1] for e in edges], "weight": [float(e[2]) for e in edges], "taxon": pd.array([leaves.get(e[1]) for e in edges], "Int32")})


def _map(nets: DataFrame, f) -> DataFrame:
    def run(p):
        e, leaves = _edges(p)
        return _rows(p.net_id.iloc[0], f(e, leaves), leaves)

    return nets.groupBy("net_id").applyInPandas(run, EDGES)


def lsa_trees(nets: DataFrame) -> DataFrame:
    return _map(nets, lambda e, t: N.lsa_tree(e, set(t)))


def blob_trees(nets: DataFrame) -> DataFrame:
    return _map(nets, lambda e, t: N.blob_tree(e, set(t)))


def normalized(nets: DataFrame) -> DataFrame:
    return _map(nets, lambda e, t: N.normalize(e, set(t)))


def rerooted(trees: DataFrame, outgroup: set[int]) -> DataFrame:
    """Trees rooted by the taxa of the out-group."""
    return _map(trees, lambda e, t: N.reroot(e, {v for v, x in t.items() if x in outgroup}))


def midpoint_rooted(trees: DataFrame) -> DataFrame:
    """Trees rooted in the middle of their longest path between leaves."""
    return _map(trees, lambda e, t: N.smooth(kernels.midpoint_root(e, sorted(t)), set(t)))


def reordered(trees: DataFrame, by: str = "taxon") -> DataFrame:
    """``net_id, node, position``: leaves in drawing order, the children of each node sorted ``by``: taxon (least taxon below), size
    (few leaves first), size_down (many first), height (near ones first), height_down, stable (as given), reverse, or label ladder ``alternate``."""

    def run(p):
        e, leaves = _edges(p)
        order = N.leaf_order(e, leaves, by)
        return pd.DataFrame({"net_id": p.net_id.iloc[0], "node": order, "taxon": [leaves[v] for v in order], "position": range(1, len(order) + 1)})

    return trees.groupBy("net_id").applyInPandas(run, "net_id int, node int, taxon int, position int")


def loose_and_lacy(trees: DataFrame, traits: DataFrame) -> DataFrame:
    """``net_id, kind, species, taxon``: species hypotheses of trees whose leaves have one trait value each (``taxon, trait``).

    *Tight* species are the maximal clades of a single trait value. *Loose* ones are the smallest clades that hold all
    members of every trait value they meet; a clade that splits no value. *Lacy* ones join loose ones that share a value.
    """
    own = traits.groupBy("taxon").agg(F.min("trait").alias("trait"))
    src = trees.join(own, "taxon", "left").select("net_id", "parent", "child", "weight", "taxon", "trait")

    def run(p):
        e, leaves = _edges(p)
        value = {int(t): v for t, v in zip(p.taxon, p.trait) if t == t and t is not None and isinstance(v, str)}
        rows = [(k, i, t) for k, sets in N.species(e, leaves, value).items() for i, s in enumerate(sets, 1) for t in s]
        return pd.DataFrame({"net_id": p.net_id.iloc[0], "kind": [r[0] for r in rows], "species": [r[1] for r in rows], "taxon": [r[2] for r in rows]})

    return src.groupBy("net_id").applyInPandas(run, "net_id int, kind string, species int, taxon int")


def displayed(nets: DataFrame, trees: DataFrame) -> DataFrame:
    """``net_id, tree_id, displayed``: whether each network contains each tree (``net_id`` of ``trees``) on the same taxa."""
    t = trees.groupBy("net_id").agg(F.collect_list(F.struct("parent", "child", "weight", "taxon")).alias("tree")).withColumnRenamed("net_id", "tree_id")
    n = nets.groupBy("net_id").agg(F.collect_list(F.struct("parent", "child", "weight", "taxon")).alias("net"))

    def parts(rows):
        return [(int(r["parent"]), int(r["child"]), float(r["weight"])) for r in rows], {int(r["child"]): int(r["taxon"]) for r in rows if pd.notna(r["taxon"])}

    def run(batches):
        for p in batches:
            out = []
            for net, tree in zip(p.net, p.tree):
                (a, x), (b, y) = parts(net), parts(tree)
                out.append(N.displays(a, b, x, y))
            yield pd.DataFrame({"net_id": p.net_id, "tree_id": p.tree_id, "displayed": out})

    return n.join(t).mapInPandas(run, "net_id int, tree_id int, displayed boolean")


def contained_trees(nets: DataFrame, distinct: bool = True) -> DataFrame:
    """``net_id, tree_no`` and the edges of every tree that a network contains."""

    def run(p):
        e, leaves = _edges(p)
        parts = [_rows(p.net_id.iloc[0], t, leaves).assign(tree_no=i) for i, t in enumerate(N.contained_trees(e, leaves, distinct), 1)]
        return pd.concat(parts)[["net_id", "tree_no", "parent", "child", "weight", "taxon"]]

    return nets.groupBy("net_id").applyInPandas(run, "net_id int, tree_no int, parent int, child int, weight double, taxon int")


def classes(nets: DataFrame) -> DataFrame:
    """``net_id, class``."""

    def run(p):
        e, leaves = _edges(p)
        return pd.DataFrame({"net_id": [p.net_id.iloc[0]], "class": [N.network_class(e, set(leaves))]})

    return nets.groupBy("net_id").applyInPandas(run, "net_id int, class string")


def class_filter(nets: DataFrame, wanted: str) -> DataFrame:
    """Networks of the class; a class holds those inside it (tree, normal, tree-child, tree-based, network)."""
    order = ["tree", "normal", "tree_child", "tree_based", "network"]
    ok = classes(nets).filter(F.col("class").isin(order[: order.index(wanted) + 1]))
    return nets.join(ok.select("net_id"), "net_id", "left_semi")


def stretch_filter(edges: DataFrame, taxa: list[int], percent: float = 0.0, group: tuple[str, ...] = ()) -> DataFrame:
    """``src, dst, weight`` of a network without the edges that no shortest path between taxa needs within the stretch."""
    return _plain(edges, group, lambda e: N.stretch_filter(e, taxa, percent))


def simplify(edges: DataFrame, taxa: list[int], group: tuple[str, ...] = ()) -> DataFrame:
    """``src, dst, weight`` of a network without unlabelled ends, and with chains through unlabelled nodes of degree 2 as one edge."""
    return _plain(edges, group, lambda e: N.simplify(e, set(taxa)))


def _plain(edges: DataFrame, group: tuple[str, ...], f) -> DataFrame:
    def run(p):
        kept = f([(int(a), int(b), float(w)) for a, b, w in zip(p.src, p.dst, p.weight)])
        return pd.DataFrame(kept, columns=["src", "dst", "weight"]).astype({"src": "int32", "dst": "int32", "weight": "float64"})

    return grouped(edges.select(*group, "src", "dst", "weight"), group, "src int, dst int, weight double", run)


def super_network(partial: DataFrame, ntax: int, group: tuple[str, ...] = ()) -> DataFrame:
    """``mask, weight``: full splits by Z-closure from partial ones ``tree_id, a, b`` (masks of both sides); weight is the number of trees that show a part."""
    x = bits(ntax)

    def run(p):
        a_, b_ = [x.to_int(v) for v in p.a], [x.to_int(v) for v in p.b]
        full = (1 << ntax) - 1
        out = {}
        for a, b in N.z_closure(list(zip(a_, b_)), ntax):
            m = full ^ a if a & 1 else a
            seen = {t for t, u, v in zip(p.tree_id, a_, b_) if (u & ~a == 0 and v & ~b == 0) or (u & ~b == 0 and v & ~a == 0)}
            out[m] = float(len(seen))
        return split_rows(x, out.items())

    return grouped(partial.select(*group, "tree_id", "a", "b"), group, f"mask {x.ddl}, weight double", run)


def filtered_super_network(partial: DataFrame, ntax: int, min_trees: int = 1, max_distortion: int = 1, group: tuple[str, ...] = ()) -> DataFrame:
    """:func:`super_network`, kept where the split's summed distortion is at most ``max_distortion`` and ``min_trees`` trees show it whole.

    A tree's distortion of a split is the least number of taxa to be moved for the restricted split to be one of the tree's.
    """
    x = bits(ntax)

    def run(p):
        trees: dict[int, list[tuple[int, int]]] = {}
        for t, a, b in zip(p.tree_id, p.a, p.b):
            trees.setdefault(int(t), []).append((x.to_int(a), x.to_int(b)))
        parts = [s for t in trees.values() for s in t]
        full, out = (1 << ntax) - 1, {}
        for a, b in N.z_closure(parts, ntax):
            cost, whole = 0, 0
            for own in trees.values():
                taxa = 0
                for u, v in own:
                    taxa |= u | v
                side, rest = a & taxa, b & taxa
                least = min(side.bit_count(), rest.bit_count(), *(min((side & v).bit_count() + (rest & u).bit_count(), (side & u).bit_count() + (rest & v).bit_count()) for u, v in own))
                cost += least
                whole += least == 0
            if cost <= max_distortion * len(trees) and whole >= min_trees:
                out[full ^ a if a & 1 else a] = float(whole)
        return split_rows(x, out.items())

    return grouped(partial.select(*group, "tree_id", "a", "b"), group, f"mask {x.ddl}, weight double", run)


def cluster_tree(clusters: DataFrame, ntax: int, group: tuple[str, ...] = (), whole: bool = True) -> DataFrame:
    """Edges of the tree of compatible clusters ``mask, weight``: consensus trees are this after the consensus. Without ``whole`` only of the clusters' taxa."""
    b = bits(ntax)

    def run(p):
        e = N.clusters_to_edges([(b.to_int(m), w) for m, w in zip(p["mask"], p.weight)], ntax, whole)
        return _rows(1, e, {i: i + 1 for i in range(ntax)})

    return grouped(clusters.select(*group, "mask", "weight"), group, EDGES, run)


def tree_clusters(trees: DataFrame, ntax: int) -> DataFrame:
    """``tree_id, mask, weight``: the taxa below each edge of trees ``net_id, parent, child, weight, taxon`` (of a network: each node's, by its first edge)."""
    b = bits(ntax)

    def run(p):
        e, leaves = _edges(p)
        below, best = N.below(e, leaves), {}
        for _, c, w in e:
            best.setdefault(below[c], w)
        out = split_rows(b, [(m, w) for m, w in best.items() if m])
        out.insert(0, "tree_id", p.net_id.iloc[0])
        return out

    return trees.groupBy("net_id").applyInPandas(run, f"tree_id int, mask {b.ddl}, weight double")


def cluster_network(clusters: DataFrame, ntax: int, group: tuple[str, ...] = (), whole: bool = True) -> DataFrame:
    """The rooted network of any clusters: their cover graph, with an edge of its own above each node of several parents."""
    b = bits(ntax)

    def run(p):
        e, leaves = N.cluster_network([(b.to_int(m), w) for m, w in zip(p["mask"], p.weight)], ntax, whole)
        return _rows(1, e, leaves)

    return grouped(clusters.select(*group, "mask", "weight"), group, EDGES, run)


def median_joining(rows: DataFrame, epsilon: float = 0.0, group: tuple[str, ...] = ()) -> DataFrame:
    """``src, dst, weight`` of the median-joining network of sequences ``taxon, seq``; equal sequences are one node, medians are negative.

    Medians are added until no candidate is left, without a limit on their number; one task holds the matrix of all distances.
    """
    one = rows.groupBy(*group, "seq").agg(F.min("taxon").alias("taxon"))

    def run(p):
        n = len(p.seq.iloc[0])
        _, e = N.median_joining(dict(zip(p.taxon.tolist(), p.seq.tolist())), [1.0] * n, epsilon)
        return pd.DataFrame(e, columns=["src", "dst", "weight"]).astype({"src": "int32", "dst": "int32", "weight": "float64"})

    return grouped(one, group, "src int, dst int, weight double", run)


def parsimony_splits(rows: DataFrame, gap: str = "-", missing: str = "?", gaps_missing: bool = True, ntax: int = WORD, trivial: bool = False, group: tuple[str, ...] = ()) -> DataFrame:
    """``mask, weight`` of the parsimony splits of sequences ``taxon, seq`` (taxa numbered from 1 without gaps).

    Missing characters and ambiguity codes are not compared, nor are gaps unless ``gaps_missing`` is off. ``trivial`` adds
    the missing trivial splits with weight 0.
    """
    b = bits(ntax)

    def run(p):
        p = p.sort_values("taxon")
        s = N.parsimony_splits(p.seq.tolist(), gap if gaps_missing else "", missing)
        if trivial:
            full, have = (1 << len(p)) - 1, {m for m, _ in s}
            s += [(m, 0) for i in range(len(p)) if (m := 1 << i if i else full ^ 1) not in have]
        return split_rows(b, s)

    return grouped(rows.select(*group, "taxon", "seq"), group, f"mask {b.ddl}, weight double", run)


def layouts(trees: DataFrame, kind: str = "rectangular", by_weight: bool = True) -> DataFrame:
    """``net_id, node, x, y`` of each tree: rectangular, circular, radial or triangular."""
    from cladeworks.functions import layouts as L

    def run(p):
        e, _ = _edges(p)
        plain = {"radial": L.radial, "triangular": L.triangular}
        xy = plain[kind](e) if kind in plain else {"rectangular": L.rectangular, "circular": L.circular}[kind](e, by_weight)
        return pd.DataFrame({"net_id": p.net_id.iloc[0], "node": list(xy), "x": [v[0] for v in xy.values()], "y": [v[1] for v in xy.values()]})

    return trees.groupBy("net_id").applyInPandas(run, "net_id int, node int, x double, y double")


def equal_angle(splits: DataFrame, cycle: list[int]) -> DataFrame:
    """``taxon, x, y`` for circular splits: sums of vectors, one per separating split."""
    import math

    n = len(cycle)
    ids = F.array(*map(F.lit, cycle))
    b = bits(n)
    at = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: b.has(F.col("mask"), ids[i]))
    x = splits.select("mask", "weight", at.alias("at")).withColumn("angle", F.lit(math.pi) * (F.array_min("at") + F.array_max("at") + 1) / n)
    x = x.select("weight", "angle", F.explode("at").alias("i")).select(ids[F.col("i")].alias("taxon"), "weight", "angle")
    return x.groupBy("taxon").agg(F.sum(F.col("weight") * F.cos("angle")).alias("x"), F.sum(F.col("weight") * F.sin("angle")).alias("y"))


def taxa_filter(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A network ``id, label`` and ``src, dst`` without labelled nodes whose label is not in ``kept`` (``label``), and their edges."""
    gone = nodes.filter("label is not null").join(kept.select("label"), "label", "left_anti").select("id")
    e = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), e


def outline(splits: DataFrame, cycle: list[int]) -> DataFrame:
    """``step, x, y, taxon``: the corners of the outline of circular splits, in order; ``taxon`` where one sits, else null.

    Walking around the cycle, a split's side is entered by a step of its weight in its direction and left by the step back.
    """
    n = len(cycle)
    b, ids = bits(n), F.array(*map(F.lit, cycle))
    head = b.has(F.col("mask"), F.lit(cycle[0]))
    side = F.when(head, b.differ(b.full(), F.col("mask"))).otherwise(F.col("mask"))
    at = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: b.has(F.col("side"), ids[i]))
    rows = splits.select(side.alias("side"), "weight").withColumn("at", at).filter(F.array_max("at") - F.array_min("at") + 1 == F.size("at"))
    rows = rows.select(F.array_min("at").alias("lo"), F.array_max("at").alias("hi"), "weight")

    def run(p):
        from cladeworks.functions import layouts as L

        steps = L.outline([(int(a), int(c), float(w)) for a, c, w in zip(p.lo, p.hi, p.weight)], n)
        return pd.DataFrame({"step": range(len(steps)), "x": [s[0] for s in steps], "y": [s[1] for s in steps], "taxon": pd.array([None if s[2] is None else cycle[s[2]] for s in steps], "Int32")})

    return grouped(rows, (), "step int, x double, y double, taxon int", run)


def splits_tree(splits: DataFrame, ntax: int, group: tuple[str, ...] = (), midpoint: bool = True) -> DataFrame:
    """The tree of the greedily compatible splits, rooted in the middle of its longest path (else beside taxon 1)."""
    b = bits(ntax)

    def run(p):
        masks = [b.to_int(m) for m in p["mask"]]
        kept = set(kernels.greedy_compatible(masks, p.weight.tolist(), ntax))
        own = [(m, w) for m, w in zip(masks, p.weight.tolist()) if m in kept]
        e = N.clusters_to_edges(own, ntax)
        return _rows(1, N.smooth(kernels.midpoint_root(e, list(range(ntax))), set(range(ntax))) if midpoint else e, {i: i + 1 for i in range(ntax)})

    return grouped(splits.select(*group, "mask", "weight"), group, EDGES, run)


def consensus_tree(clusters: DataFrame, ntax: int, method: str = "majority") -> DataFrame:
    """Strict, majority or greedy consensus of unrooted trees as one tree, rooted in the middle of its longest path."""
    from cladeworks.operators.trees import consensus_splits

    least = {"strict": 99.999999, "majority": 50.0, "greedy": 0.0}[method]
    s = consensus_splits(clusters, ntax, least)
    if method == "greedy":
        from cladeworks.operators.splits import greedy_compatible

        kept = greedy_compatible(s.select("mask", F.col("n").cast("double").alias("weight")), ntax).select("mask")
        s = s.join(kept, "mask")
    return splits_tree(s.select("mask", "weight"), ntax)


def with_support(tree: DataFrame, support: DataFrame, ntax: int) -> DataFrame:
    """The edges of a tree ``net_id, parent, child, weight, taxon`` with ``confidence``: that of the split an edge makes (``mask, confidence``), null where there is none."""
    b = bits(ntax)

    def run(p):
        e, leaves = _edges(p)
        below, full = N.below(e, leaves), (1 << ntax) - 1
        out = _rows(p.net_id.iloc[0], e, leaves)
        out["mask"] = [b.to_value(full ^ below[c] if below[c] & 1 else below[c]) for c in out.child]
        return out

    keyed = tree.groupBy("net_id").applyInPandas(run, EDGES + f", mask {b.ddl}")
    return keyed.join(support.select("mask", "confidence"), "mask", "left").select("net_id", "parent", "child", "weight", "taxon", "confidence")
