"""Queries on more than 63 taxa: 125 taxa are brands by regions, so masks are arrays of words.

``cells`` (taxon, site): a brand sold in a region above the month's mean quantity. ``clusters`` (tree_id, mask, weight): one
rooted tree for each year, nested clusters of the taxa by octile of quantity. In the results a set is the text of its taxa.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeworks import bridge as B
from cladeworks.functions.bits import bits
from cladeworks.operators import bootstrap as Z
from cladeworks.operators import distances as M
from cladeworks.operators import networks as W
from cladeworks.operators import splits as S
from cladeworks.operators import trees as T

N = 125
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _lines(spark, sf):
    line = B.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    orders = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = B.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = B.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    part = B.table(spark, sf, "part").select("p_partkey", "p_brand")
    brand = F.dense_rank().over(Window.orderBy("p_brand")).alias("b")
    names = B.table(spark, sf, "part").select("p_brand").distinct().select("p_brand", brand)
    x = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == customer.c_custkey).join(nation, F.col("c_nationkey") == nation.n_nationkey)
    x = x.join(part, F.col("l_partkey") == part.p_partkey).join(names, "p_brand")
    return x.select((5 * (F.col("b") - 1) + F.col("n_regionkey") + 1).cast("int").alias("taxon"), "l_quantity", "l_shipdate")


def cells(spark, sf):
    q = _lines(spark, sf).groupBy("taxon", F.date_format("l_shipdate", "yyyy-MM").alias("site")).agg(F.sum("l_quantity").alias("q"))
    return q.withColumn("m", F.avg("q").over(Window.partitionBy("site"))).filter("q > m").select("taxon", "site")


def clusters(spark, sf):
    q = _lines(spark, sf).groupBy((F.year("l_shipdate") - 1991).alias("tree_id"), "taxon").agg(F.sum("l_quantity").alias("q"))
    k = F.ntile(8).over(Window.partitionBy("tree_id").orderBy("q", "taxon")) - 1
    tiles = q.select("tree_id", "taxon", "q", k.alias("k"))
    levels = F.explode(F.array(*(F.struct(F.lit(j).alias("lev"), F.floor(F.col("k") / 2**j).cast("int").alias("c")) for j in range(3)), F.struct(F.lit(9).alias("lev"), F.col("taxon").alias("c"))))
    x = tiles.select("tree_id", "taxon", "q", levels.alias("l")).groupBy("tree_id", "l.lev", "l.c").agg(bits(N).union(F.col("taxon")).alias("mask"), F.round(F.avg("q"), 3).alias("weight"))
    return x.groupBy("tree_id", "mask").agg(F.max("weight").alias("weight"))


_LINES = """ranks AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) AS b FROM (SELECT DISTINCT p_brand FROM part)),
li AS (SELECT CAST(5 * (b - 1) + n_regionkey + 1 AS INTEGER) AS taxon, l_quantity, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON p_partkey = l_partkey JOIN ranks USING (p_brand))"""
_CELLS = f"""{_LINES}, cq AS (SELECT taxon, strftime(l_shipdate, '%Y-%m') AS site, sum(l_quantity) AS q FROM li GROUP BY ALL), ce AS (SELECT taxon, site FROM cq QUALIFY q > avg(q) OVER (PARTITION BY site))"""
_CANON = f"CASE WHEN list_contains(a, 1) THEN list_filter(CAST(range(1, {N + 1}) AS INTEGER[]), lambda x: NOT list_contains(a, x)) ELSE a END"
_SPLITS = f"""WITH {_CELLS}, sm AS (SELECT site, list_sort(list(taxon)) AS a FROM ce GROUP BY site), sc AS (SELECT {_CANON} AS a FROM sm WHERE len(a) < {N}), sp AS (SELECT a, CAST(count(*) AS DOUBLE) AS weight FROM sc GROUP BY a)"""
_CLUSTERS = f"""WITH {_LINES}, yq AS (SELECT CAST(year(l_shipdate) - 1991 AS INTEGER) AS tree_id, taxon, sum(l_quantity) AS q FROM li GROUP BY ALL), yk AS (SELECT *, ntile(8) OVER (PARTITION BY tree_id ORDER BY q, taxon) - 1 AS k FROM yq),
yl AS (SELECT tree_id, taxon, q, 0 AS lev, k AS c FROM yk UNION ALL SELECT tree_id, taxon, q, 1, k // 2 FROM yk UNION ALL SELECT tree_id, taxon, q, 2, k // 4 FROM yk UNION ALL SELECT tree_id, taxon, q, 9, taxon FROM yk),
yx AS (SELECT tree_id, lev, c, list_sort(list(taxon)) AS a, round(avg(q), 3) AS weight FROM yl GROUP BY ALL), cl AS (SELECT tree_id, a, max(weight) AS weight FROM yx GROUP BY ALL),
ts AS (SELECT tree_id, a, sum(weight) AS weight FROM (SELECT tree_id, {_CANON} AS a, weight FROM cl WHERE len(a) < {N}) GROUP BY ALL)"""


def _splits(spark, sf):
    return S.presence_splits(cells(spark, sf), N)


@query(_SPLITS + " SELECT array_to_string(a, ',') AS taxa, weight FROM sp")
def wide_splits(spark, sf):
    return S.with_taxa(_splits(spark, sf), N)


@query(f"WITH {_CELLS}, n AS (SELECT site, count(*) AS k FROM ce GROUP BY site HAVING k < {N}), t AS (SELECT CAST(unnest(range(1, {N + 1})) AS INTEGER) AS t), g AS (SELECT t.t AS t, n.site AS site, ce.taxon IS NOT NULL AS hit FROM t JOIN n ON true LEFT JOIN ce ON ce.taxon = t.t AND ce.site = n.site) SELECT p.t AS t1, q.t AS t2, CAST(count(*) AS DOUBLE) AS d FROM g p JOIN g q ON p.site = q.site AND p.t < q.t AND p.hit <> q.hit GROUP BY ALL")
def wide_splits_distances(spark, sf):
    return S.splits_to_distances(_splits(spark, sf), N)


@query(_SPLITS + ", id AS (SELECT array_to_string(a, ',') AS t, a FROM sp) SELECT count(*) AS n FROM id p JOIN id q ON p.t < q.t WHERE len(list_intersect(p.a, q.a)) NOT IN (0, len(p.a), len(q.a))")
def wide_incompatible(spark, sf):
    return S.incompatible_pairs(_splits(spark, sf), N).agg(F.count(F.lit(1)).alias("n"))


@query(_SPLITS + ", f AS (SELECT list_filter(a, lambda x: x <= 100) AS a, weight FROM sp) SELECT array_to_string(a, ',') AS taxa, sum(weight) AS weight FROM f WHERE len(a) > 0 GROUP BY ALL")
def wide_taxa_filter(spark, sf):
    return S.with_taxa(S.splits_taxa_filter(_splits(spark, sf), list(range(1, 101)), merge=True, ntax=N), 100)


@query(_SPLITS + f", t AS (SELECT CAST(unnest(range(1, {N + 1})) AS INTEGER) AS t), z AS (SELECT t, weight, CAST(CASE WHEN list_contains(a, t) THEN len(a) ELSE {N} - len(a) END AS DOUBLE) AS near FROM sp, t) SELECT t AS taxon, round(sum(({N} - near) * weight / ({N} * near)), 6) AS value FROM z GROUP BY t")
def wide_shapley(spark, sf):
    return S.shapley_values(_splits(spark, sf), N).select(F.col("taxon").cast("int"), F.round("value", 6).alias("value"))


@query(_CLUSTERS + ", g AS (SELECT a, count(*) AS n, avg(weight) AS weight FROM ts GROUP BY a) SELECT array_to_string(a, ',') AS taxa, n, round(weight, 6) AS weight FROM g WHERE 100.0 * n / (SELECT count(DISTINCT tree_id) FROM cl) > 30")
def wide_consensus(spark, sf):
    return S.with_taxa(T.consensus_splits(clusters(spark, sf), N, 30.0).select("mask", "n", F.round("weight", 6).alias("weight")), N)


@query(_CLUSTERS + ", s AS (SELECT tree_id, count(*) AS n FROM ts GROUP BY ALL) SELECT p.tree_id AS t1, q.tree_id AS t2, CAST(p.n + q.n - 2 * (SELECT count(*) FROM ts x JOIN ts y ON x.a = y.a WHERE x.tree_id = p.tree_id AND y.tree_id = q.tree_id) AS DOUBLE) AS d FROM s p JOIN s q ON p.tree_id < q.tree_id")
def wide_robinson_foulds(spark, sf):
    return T.robinson_foulds(clusters(spark, sf), N)


@query(_CLUSTERS + ", t AS (SELECT CAST(unnest(range(1, 126)) AS INTEGER) AS t), h AS (SELECT t, tree_id, a, weight FROM ts JOIN t ON list_contains(a, t)), w AS (SELECT t, sum(weight) AS w FROM h GROUP BY t), c AS (SELECT p.t AS x, q.t AS y, sum(p.weight) AS c FROM h p JOIN h q ON p.tree_id = q.tree_id AND p.a = q.a AND p.t < q.t GROUP BY ALL) SELECT p.t AS t1, q.t AS t2, round((coalesce(u.w, 0) + coalesce(v.w, 0) - 2 * coalesce(c, 0)) / (SELECT count(DISTINCT tree_id) FROM cl), 4) AS d FROM t p JOIN t q ON p.t < q.t LEFT JOIN w u ON u.t = p.t LEFT JOIN w v ON v.t = q.t LEFT JOIN c ON c.x = p.t AND c.y = q.t")
def wide_average_distances(spark, sf):
    return T.average_distances(clusters(spark, sf), N).select("t1", "t2", F.round("d", 4).alias("d"))


@query(_CLUSTERS + " SELECT tree_id, CAST(len(list_distinct(flatten(list(a)))) AS INTEGER) AS n_taxa, count(*) AS n_edges, round(sum(weight), 3) AS length FROM cl GROUP BY tree_id")
def wide_tree_statistics(spark, sf):
    return T.tree_statistics(clusters(spark, sf), N).select("tree_id", "n_taxa", "n_edges", F.round("length", 3).alias("length"))


@query(f"SELECT CAST({N} AS BIGINT) AS n_taxa, CAST({N} AS BIGINT) AS n_trivial, true AS all_cyclic, true AS none_negative, true AS explains")
def wide_neighbor_net(spark, sf):
    """What holds for the neighbor-net of any distances: a cycle of all taxa, all trivial splits, only intervals of the cycle, weights from 0, a positive fit."""
    d = S.splits_to_distances(_splits(spark, sf), N)
    net = M.neighbor_net(d, ntax=N)
    cycle = [r.taxon for r in M.neighbor_net_cycle(d).orderBy("position").collect()]  # as many as taxa
    size = bits(N).size(F.col("mask"))
    x = S.cyclic(net, cycle).agg(F.sum(F.when(size.isin(1, N - 1), 1).otherwise(0)).alias("n_trivial"), F.min("is_cyclic").alias("all_cyclic"), (F.min("weight") >= 0).alias("none_negative"))
    fit = S.fits(net, d, N).select((F.col("least_squares") > 0).alias("explains")).scalar()
    return x.withColumn("explains", fit).select(F.lit(len(set(cycle))).cast("bigint").alias("n_taxa"), F.col("n_trivial").cast("bigint"), "all_cyclic", "none_negative", "explains")


@query(_CLUSTERS + ", g AS (SELECT a, count(*) AS n, avg(weight) AS weight FROM cl GROUP BY a HAVING 2 * n > (SELECT count(DISTINCT tree_id) FROM cl)) SELECT array_to_string(a, ',') AS taxa FROM g")
def wide_consensus_tree(spark, sf):
    """Majority clusters as a tree of nodes and edges, and read back from it."""
    tree = W.cluster_tree(T.consensus_clusters(clusters(spark, sf)), N)
    return S.with_taxa(W.tree_clusters(tree, N), N).select("taxa")


REPS = 10


@query(f"""{_SPLITS}, no AS (SELECT site, a, row_number() OVER (ORDER BY site) - 1 AS no FROM sm), n AS (SELECT count(*) AS n FROM no),
d AS (SELECT rep, CAST('0x' || substr(md5('42:' || rep || ':' || no), 1, 7) AS BIGINT) % n AS no FROM no, n, (SELECT unnest(generate_series(1, {REPS})) AS rep) r),
w AS (SELECT rep, {_CANON} AS a, count(*) AS w FROM d JOIN no USING (no) WHERE len(a) < {N} GROUP BY ALL) SELECT array_to_string(a, ',') AS taxa, count(*) AS n, round(avg(w), 6) AS weight FROM w GROUP BY a HAVING 100.0 * count(*) / {REPS} >= 50""")
def wide_bootstrap(spark, sf):
    m = S.site_masks(cells(spark, sf), N)
    masks = m.filter(F.col("m") != bits(N).full()).select("site", S.canonical(F.col("m"), N).alias("mask"))
    s = Z.split_support(masks, Z.draws(m.select("site"), REPS), REPS, 50.0)
    return S.with_taxa(s.select("mask", "n", F.round("weight", 6).alias("weight")), N)
