"""Parent-child rows of unknown depth: loops, and for every node of the forest its path, depth, root and descendants.

Method. One *climb* serves both. A node still climbing knows its ancestor at distance 1, 2, 4, ...; it is settled as soon as
that ancestor is, and then has its root and depth. A round that settles nobody leaves the nodes on loops and below them:
that is the *cycle separation*. Jumping on until the distance exceeds their number lands exactly on the nodes of the loops,
and the smallest id met on the way names the loop. *Heavy paths*: the climb also sums subtree sizes (what a node's
descendants at distance 2^k hold counts for it). The heaviest child continues its parent's chain, every other child heads a
new one, so a path meets at most log2(n) chains. Paths are chain prefixes plus a slice of the node's own chain; preorder
numbers follow the chains, so the descendants of a node are the numbers from ``first`` to ``last`` under its root.

Scale. All steps are joins and map-side combined aggregates on node ids. A round first combines its climbers by ancestor. If
there are few different ancestors (by the row count of that table, or as there are few climbers), they are broadcast with
what is known of them, so a parent with a third of all nodes is no hot join key and the climbers are not shuffled; if there
are many, both sides are joined by key and adaptive skew joins split what is hot. Children of a hot parent are numbered in blocks of ids, never
in one window. Nothing is collected. Each round is written to the shared folder, and its rows are counted while they are
written. A chain is held as one array; it is no longer than the longest path, which is an array of the result.

Defined results: a parent that is null, 0 or no node of its own makes a root (``orphan`` tells the last case); null ids
are no nodes; of several rows of a node the one latest in time is in force, at equal times the one with the larger
parent; a node that is its own parent is a loop; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.scratch import SMALL, marked, stage, stage_counted, together

#: 2^ID_BITS ids are numbered together when the light children of one parent get their offsets.
ID_BITS = 12


def in_force(df: DataFrame, node: str = "taxon_id", parent: str = "parent_id", at: str = "loaded_at") -> DataFrame:
    """``node, parent`` of the latest row of each node; parent null where it is 0 or null."""
    rows = df.filter(F.col(node).isNotNull()).select(F.col(node).cast("bigint").alias("node"), F.struct(F.col(at), F.col(parent).cast("bigint").alias("parent")).alias("r"))
    last = rows.groupBy("node").agg(F.max("r").alias("r"))
    return last.select("node", F.when(F.col("r.parent") != 0, F.col("r.parent")).alias("parent"))


def known_parents(links: DataFrame) -> DataFrame:
    """Adds ``orphan``; the parent that is no node becomes null."""
    ids = links.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    out = links.join(ids, "parent", "left")
    return out.select("node", F.when(F.col("known"), F.col("parent")).alias("parent"), (F.col("parent").isNotNull() & F.col("known").isNull()).alias("orphan"))


@dataclass(frozen=True)
class Climb:
    """``settled``: ``node, root, depth, size`` (if asked for); ``left``: ``node, anc, low`` of the ``n_left`` nodes on and below loops.

    ``anc`` is the ancestor at distance ``step`` and ``low`` the smallest id from the node up to, not including, ``anc``.
    """

    settled: DataFrame | None
    left: DataFrame
    n_left: int
    step: int


def climb(links: DataFrame, n: int, settle: bool = True) -> Climb:
    """Climbs from every node, ``links``: ``node, parent`` with ``n`` rows. Without ``settle`` nodes that reach a root just drop out."""
    one, none = F.lit(1).cast("bigint"), F.lit(None).cast("bigint")
    roots = links.filter("parent is null").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"))
    now = links.filter("parent is not null").select("node", F.col("parent").alias("anc"), F.col("node").alias("low"), one.alias("held"))
    tables, step, left = [], 1, -1
    settled = lambda: roots.unionByName(together(tables).filter("root is not null").select("node", "root", "depth")) if tables else roots
    while True:
        below, ancestors = now.groupBy("anc").agg(F.sum("held").alias("size")), n
        if n > SMALL:  # so many climbers may have few ancestors: count these
            below, ancestors = stage_counted(below, "below")
        state = now.select(F.col("node").alias("anc"), none.alias("root"), F.lit(None).cast("int").alias("depth"), F.col("anc").alias("up"), F.col("low").alias("up_low"))
        if settle:
            state = state.unionByName(settled().select(F.col("node").alias("anc"), "root", "depth", none.alias("up"), none.alias("up_low")))
        known = marked(state.join(marked(below.select("anc"), ancestors), "anc"), ancestors)
        x = now.join(known, "anc").select("node", "held", "root", (F.col("depth") + step).alias("depth"), "up", F.least("low", "up_low").alias("low"))
        if settle:
            more = marked(below.select(F.col("anc").alias("node"), F.col("size").alias("more")), ancestors)
            x = x.join(more, "node", "left").withColumn("held", F.col("held") + F.coalesce("more", F.lit(0))).drop("more")
        table, n = stage_counted(x, "climb")
        tables.append(table)
        now = table.filter("root is null").select("node", F.col("up").alias("anc"), "low", "held")
        step *= 2
        if n in (0, left):  # none is left, or nobody was settled by the round before, or dropped out in this one
            break
        left = n
    now = now.select("node", "anc", "low")
    if not settle:
        return Climb(None, now, n, step)
    size = links.select("node", one.alias("size")).unionByName(links.filter("parent is not null").select(F.col("parent").alias("node"), one.alias("size")))
    size = size.unionByName(together(tables).filter("root is null").select(F.col("up").alias("node"), F.col("held").alias("size")))
    return Climb(settled().join(size.groupBy("node").agg(F.sum("size").alias("size")), "node"), now, n, step)


def chain_heads(along: DataFrame) -> DataFrame:
    """``node, chain, position``: the head of each node's chain and the steps from it. ``along``: ``node, parent``, null at heads.

    A node continues at most one chain, so an ancestor has one climber at each distance and no key is hot.
    """
    none = F.lit(None).cast("bigint")
    heads = along.filter("parent is null").select("node", F.col("node").alias("chain"), F.lit(0).alias("position"))
    now, step, tables = along.filter("parent is not null").select("node", F.col("parent").alias("anc")), 1, []
    while True:
        done = heads.unionByName(together(tables).filter("chain is not null").select("node", "chain", "position")) if tables else heads
        state = done.select(F.col("node").alias("anc"), "chain", "position", none.alias("up")).unionByName(now.select(F.col("node").alias("anc"), none.alias("chain"), F.lit(None).cast("int").alias("position"), F.col("anc").alias("up")))
        table, n = stage_counted(now.join(state, "anc").select("node", "chain", (F.col("position") + step).alias("position"), "up"), "chains")
        if not n:
            return done
        tables.append(table)
        now, step = table.filter("chain is null").select("node", F.col("up").alias("anc")), step * 2


def loops(climbed: Climb) -> DataFrame:
    """``cycle_id, node``: every node on a loop with the smallest node of its loop."""
    left, step = climbed.left, climbed.step
    while step < climbed.n_left:
        up = left.select(F.col("node").alias("anc"), F.col("anc").alias("up"), F.col("low").alias("up_low"))
        left, step = stage(left.join(up, "anc").select("node", F.col("up").alias("anc"), F.least("low", "up_low").alias("low")), "loop"), step * 2
    return left.join(left.select(F.col("anc").alias("node")).distinct(), "node", "left_semi").select(F.col("low").alias("cycle_id"), "node")


def find_cycles(links: DataFrame) -> DataFrame:
    """The cycle separation of :func:`build_hierarchy`: ``cycle_id, node`` of every node on a loop. ``links``: ``node, parent``."""
    return loops(climb(*stage_counted(known_parents(links), "links"), settle=False))


def _sibling_offsets(light: DataFrame) -> DataFrame:
    """``node, offset``: sizes of the light siblings with smaller ids; in blocks of ids, so no window holds a hot parent's children."""
    block = F.shiftright("node", ID_BITS).alias("block")
    x = light.select("node", "parent", "size", block)
    within = Window.partitionBy("parent", "block").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = x.groupBy("parent", "block").agg(F.sum("size").alias("s")).select("parent", "block", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("before"))
    inner = x.select("node", "parent", "block", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("inside"))
    return inner.join(blocks, ["parent", "block"]).select("node", (F.col("before") + F.col("inside")).alias("offset"))


def build_hierarchy(links: DataFrame) -> DataFrame:
    """For every node that reaches a root: ``node, parent, orphan, root, depth, path ARRAY, chain, position, size, first, last``.

    ``path`` runs from the root to the node; ``first``..``last`` number the subtree in preorder under its root (heavy child
    first, other children by id). Nodes on or below loops are left out: see :func:`find_cycles`.
    """
    links, n = stage_counted(known_parents(links), "links")
    sized = stage(links.join(climb(links, n).settled, "node"), "sized")

    best = F.max(F.struct("size", (-F.col("node")).alias("neg")))
    heavy = sized.filter("parent is not null").groupBy("parent").agg(best.alias("h")).select(F.col("parent").alias("p"), (-F.col("h.neg")).alias("heavy"), F.col("h.size").alias("heavy_size"))
    heavy_marked = sized.join(heavy, F.col("parent") == F.col("p"), "left").drop("p")
    heavy_marked = stage(heavy_marked.withColumn("light", F.col("parent").isNotNull() & (F.col("node") != F.col("heavy"))), "marked")

    along = heavy_marked.select("node", F.when(~F.col("light"), F.col("parent")).alias("parent"))
    nodes = stage(heavy_marked.join(chain_heads(along), "node"), "nodes")

    members = nodes.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("position", "node"))).alias("m")).select("chain", F.col("m.node").alias("members"))
    offsets = _sibling_offsets(nodes.filter("light").select("node", "parent", "size"))
    hook = nodes.select(F.col("node").alias("parent"), F.col("chain").alias("up"), F.col("position").alias("up_position"))
    heads = nodes.filter("light").select("node", "parent", "heavy_size").join(offsets, "node").join(hook, "parent")
    members = stage(members, "members")
    heads = heads.select(F.col("node").alias("chain"), "up", "up_position", (F.col("up_position") + 1 + F.col("heavy_size") + F.col("offset")).alias("start"))
    heads = heads.join(members.withColumnRenamed("chain", "up"), "up").select("chain", "up", F.slice("members", 1, F.col("up_position") + 1).alias("prefix"), "start")

    # a chain's prefix and start, by the chains at distance 1, 2, 4, ... above it
    found = nodes.filter("parent is null").select(F.col("node").alias("chain"), F.array().cast("array<bigint>").alias("prefix"), F.lit(0).cast("bigint").alias("start"))
    found, now, tables = stage(found, "roots"), stage(heads, "heads"), []
    roots = found
    while True:
        above = found.select(F.col("chain").alias("up"), F.lit(None).cast("bigint").alias("next"), F.col("prefix").alias("upper"), F.col("start").alias("before"))
        above = above.unionByName(now.select(F.col("chain").alias("up"), F.col("up").alias("next"), F.col("prefix").alias("upper"), F.col("start").alias("before")))
        step = now.join(above, "up").select("chain", F.col("next").alias("up"), F.concat("upper", "prefix").alias("prefix"), (F.col("before") + F.col("start")).alias("start"))
        table, n = stage_counted(step, "chains")
        if not n:
            break
        tables.append(table)
        found = roots.unionByName(together(tables).filter("up is null").select("chain", "prefix", "start"))
        now = table.filter("up is not null")

    whole = nodes.join(found.join(members, "chain"), "chain")
    first = F.col("start") + F.col("position")
    return whole.select(
        "node", "parent", "orphan", "root", "depth",
        F.concat("prefix", F.slice("members", 1, F.col("position") + 1)).alias("path"),
        "chain", "position", "size", first.alias("first"), (first + F.col("size") - 1).alias("last"),
    )


def descendants(hierarchy: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance`` for every pair, one row for each step of each path."""
    x = hierarchy.select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("i", "ancestor"))
    return x.filter(F.col("i") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("i")).alias("distance"))
