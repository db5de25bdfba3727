"""Blocks made from the relational test tables, each over the whole tables, and the same definitions as SQL.

``presence`` (taxon, site): nations of suppliers and the parts they sold. ``dna`` (taxon, site, ch): nations of customers,
a site for each month and return flag, states by quartile of quantity. ``label_distances`` (t1, t2, d): Euclidean
distances of the mean embedding of each label. ``clusters`` (tree_id, mask, weight): one rooted tree for each brand, nested
clusters of customer nations by octile of quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def presence(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    supplier = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1).cast("int").alias("taxon"))
    return line.join(supplier, line.l_suppkey == supplier.s_suppkey).select("taxon", F.col("l_partkey").alias("site")).distinct()


def _by_customer_nation(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") + 1).cast("int").alias("taxon"))
    return line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == customer.c_custkey)


def dna(spark: SparkSession, sf: str) -> DataFrame:
    site = F.concat(F.date_format("l_shipdate", "yyyy-MM"), F.col("l_returnflag")).alias("site")
    q = _by_customer_nation(spark, sf).groupBy("taxon", site).agg(F.sum("l_quantity").alias("q"))
    tile = F.ntile(4).over(Window.partitionBy("site").orderBy("q", "taxon"))
    return q.select("taxon", "site", F.substring(F.lit("acgt"), tile, F.lit(1)).alias("ch"))


def label_distances(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select((F.col("label") + 1).cast("int").alias("taxon"), F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("taxon", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    a, b = means.select(F.col("taxon").alias("t1"), "i", F.col("m").alias("x")), means.select(F.col("taxon").alias("t2"), "i", F.col("m").alias("y"))
    d = a.join(b, "i").filter("t1 < t2").groupBy("t1", "t2").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("d"))
    return d.select("t1", "t2", F.round("d", 6).alias("d"))


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    q = _by_customer_nation(spark, sf).join(part, F.col("l_partkey") == part.p_partkey).groupBy("p_brand", "taxon").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    k = F.ntile(8).over(Window.partitionBy("p_brand").orderBy("q", "taxon")) - 1
    tree = F.dense_rank().over(Window.orderBy("p_brand"))
    names = table(spark, sf, "part").select("p_brand").distinct().select("p_brand", tree.alias("tree_id"))
    tiles = q.select("p_brand", "taxon", "q", "n", k.alias("k")).join(names, "p_brand").select("tree_id", "taxon", "q", "n", "k")
    levels = F.explode(F.array(*(F.struct(F.lit(j).alias("lev"), F.floor(F.col("k") / 2**j).cast("int").alias("c")) for j in range(3)), F.struct(F.lit(9).alias("lev"), F.col("taxon").alias("c"))))
    x = tiles.select("tree_id", "taxon", "q", "n", levels.alias("l")).groupBy("tree_id", "l.lev", "l.c").agg(F.expr("bit_or(1L << (taxon - 1))").alias("mask"), F.round(F.sum("q") / F.sum("n"), 3).alias("weight"))
    return x.groupBy("tree_id", "mask").agg(F.max("weight").alias("weight"))


PRESENCE_SQL = "b1 AS (SELECT DISTINCT CAST(s_nationkey + 1 AS INTEGER) AS taxon, l_partkey AS site FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"
DNA_SQL = """b2q AS (SELECT CAST(c_nationkey + 1 AS INTEGER) AS taxon, strftime(l_shipdate, '%Y-%m') || l_returnflag AS site, sum(l_quantity) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
b2 AS (SELECT taxon, site, substr('acgt', CAST(ntile(4) OVER (PARTITION BY site ORDER BY q, taxon) AS BIGINT), 1) AS ch FROM b2q)"""
LABELS_SQL = """b3m AS (SELECT CAST(label + 1 AS INTEGER) AS taxon, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
b3 AS (SELECT a.taxon AS t1, b.taxon AS t2, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS d FROM b3m a JOIN b3m b ON a.i = b.i AND a.taxon < b.taxon GROUP BY ALL)"""
CLUSTERS_SQL = """b5q AS (SELECT p_brand, CAST(c_nationkey + 1 AS INTEGER) AS taxon, sum(l_quantity) AS q, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
b5n AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) AS tree_id FROM (SELECT DISTINCT p_brand FROM part)),
b5k AS (SELECT CAST(tree_id AS INTEGER) AS tree_id, taxon, q, n, ntile(8) OVER (PARTITION BY p_brand ORDER BY q, taxon) - 1 AS k FROM b5q JOIN b5n USING (p_brand)),
b5l AS (SELECT tree_id, taxon, q, n, 0 AS lev, k AS c FROM b5k UNION ALL SELECT tree_id, taxon, q, n, 1, k // 2 FROM b5k UNION ALL SELECT tree_id, taxon, q, n, 2, k // 4 FROM b5k UNION ALL SELECT tree_id, taxon, q, n, 9, taxon FROM b5k),
b5x AS (SELECT tree_id, lev, c, bit_or(1::BIGINT << (taxon - 1)) AS mask, round(sum(q) / sum(n), 3) AS weight FROM b5l GROUP BY ALL),
b5 AS (SELECT tree_id, mask, max(weight) AS weight FROM b5x GROUP BY ALL)"""
