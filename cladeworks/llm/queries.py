"""Queries on the training-data problems (2, 4, 6, 7, 8) and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm import edit_dups as E
from cladeworks.llm import mixing as X
from cladeworks.llm import packing as K
from cladeworks.llm import set_join as J
from cladeworks.llm import spam as S
from cladeworks.operators.components import components
from cladeworks.scratch import stage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _p2(spark, sf):
    return J.similar_classes(J.parse_hex_sets(table(spark, sf, "mash_sketches"), "taxon_id", "mash_sketch"), 0.5)


def p2_found(spark, sf):
    return J.expand(*_p2(spark, sf)).select(F.col("id_a").cast("int").alias("taxon_id_a"), F.col("id_b").cast("int").alias("taxon_id_b"))


def p2_links(spark, sf):
    pairs, members = _p2(spark, sf)
    least = members.groupBy("cid").agg(F.min("id").alias("class_id"))
    out = J.link_counts(pairs, members).join(least, "cid")
    return out.select(F.col("id").cast("int").alias("taxon_id"), F.col("class_id").cast("int"), F.col("n_links").cast("bigint"))


def _p4(spark, sf):
    c = table(spark, sf, "characters")
    texts = c.select(F.col("seq_id").cast("bigint").alias("id"), E.clean_sequence(F.col("matrix"), F.col("gap"), F.col("missing")).alias("text"))
    return E.near_duplicates(texts, threshold=0.6, k=8)


def p4_found(spark, sf):
    return J.expand(*_p4(spark, sf)).select(F.col("id_a").alias("seq_id_a"), F.col("id_b").alias("seq_id_b"))


def p4_groups(spark, sf):
    """One row per sequence that takes part: its class of equal texts, its group of linked classes and its number of links."""
    pairs, members = _p4(spark, sf)
    pairs = stage(pairs, "pairs")
    names = members.groupBy("cid").agg(F.min("id").alias("class_id"))
    linked = components(pairs, "cid_a", "cid_b").withColumnRenamed("node", "cid")
    groups = names.join(linked, "cid", "left").select("cid", "class_id", F.coalesce("component", "cid").alias("component"))
    least = groups.groupBy("component").agg(F.min("class_id").alias("group_id"))
    out = J.link_counts(pairs, members).join(groups.join(least, "component").select("cid", "class_id", "group_id"), "cid")
    return out.select(F.col("id").alias("seq_id"), "class_id", "group_id", F.col("n_links").cast("bigint"))


def p6_packed(spark, sf):
    lengths = K.token_lengths(table(spark, sf, "documents"))
    kinds = K.container_list(spark, table(spark, sf, "container_sizes"))
    return K.pack_documents(lengths, kinds).withColumnRenamed("id", "doc_id")


def p6_report(spark, sf):
    return K.utilisation(p6_packed(spark, sf))


def p6_limits(spark, sf):
    """What any packing must keep, per kind of container: all documents there once, their tokens once, nothing over capacity or cut without need."""
    packed = p6_packed(spark, sf)
    docs = packed.groupBy("container", "capacity", "doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"), F.sum("n_tokens").alias("t"), F.max(F.when(F.col("first_token") != F.col("piece") * F.col("capacity"), 1).otherwise(0)).alias("moved"),
        F.max(F.when((F.col("n_tokens") > 0) != F.col("container_no").isNotNull(), 1).otherwise(0)).alias("lost"))
    count = lambda bad: F.sum(F.when(bad, 1).otherwise(0)).cast("bigint")
    per = docs.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("n_docs"), count((F.col("last") + 1 != F.col("pieces")) | (F.col("moved") == 1) | (F.col("lost") == 1)).alias("n_broken"),
        count((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity"))).alias("n_cut_in_vain"), F.sum("t").alias("t"))
    full = packed.filter("container_no is not null").groupBy("container", "container_no").agg(F.sum("n_tokens").alias("t"), F.max("capacity").alias("c"))
    full = full.groupBy("container").agg(count(F.col("t") > F.col("c")).alias("n_overfull"))
    lengths = K.token_lengths(table(spark, sf, "documents")).agg(F.sum("n_tokens").alias("all"))
    out = per.join(full, "container").withColumn("all", lengths.scalar())
    return out.select("container", "capacity", "n_docs", "n_broken", "n_cut_in_vain", "n_overfull", (F.col("t") - F.col("all")).alias("tokens_off"))


def _p7(spark, sf):
    tokens = X.source_tokens(table(spark, sf, "documents"))
    rates = X.rates(tokens, table(spark, sf, "mix_targets"))
    return tokens, rates, X.mix(tokens, rates)


def p7_mixed(spark, sf):
    return _p7(spark, sf)[2].withColumnRenamed("id", "doc_id")


def p7_shares(spark, sf):
    tokens, rates, mixed = _p7(spark, sf)
    return X.reached(mixed, tokens, rates)


def p7_limits(spark, sf):
    """What any mix must keep, per source: copies within the cap and next to the rate, the share within what single documents weigh."""
    tokens, rates, mixed = _p7(spark, sf)
    per = mixed.groupBy("source", "id").agg(F.count(F.lit(1)).alias("copies"), F.max("copy").alias("last"))
    per = per.groupBy("source").agg(F.max("copies").alias("most"), F.max(F.col("last") - F.col("copies")).alias("gap"))
    x = X.reached(mixed, tokens, rates).join(per, "source", "left")
    kept = F.coalesce((F.col("most") <= F.col("max_repeats")) & (F.col("most") <= F.ceil("rate")) & (F.col("gap") == 0), F.lit(True))
    return x.select("source", "n_records", "target_share", "max_repeats", kept.alias("within_cap"), (F.abs(F.col("share") - F.col("target_share")) < 0.1).alias("near_target"))


def p8_found(spark, sf):
    return S.spam_pages(table(spark, sf, "documents")).select(F.col("id").alias("doc_id"))


def p8_scores(spark, sf):
    return S.score_pages(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_links, p4_found, p4_groups, p6_packed, p6_report, p6_limits, p7_mixed, p7_shares, p7_limits, p8_found, p8_scores)}

_P2 = """WITH clean AS (SELECT DISTINCT taxon_id, regexp_replace(lower(mash_sketch), '[^0-9a-f]', '', 'g') AS h FROM mash_sketches WHERE taxon_id IS NOT NULL),
vals AS (SELECT DISTINCT taxon_id, substr(h, i, 16) AS v FROM (SELECT taxon_id, h, unnest(generate_series(1, CAST(length(h) AS BIGINT), 16)) AS i FROM clean WHERE h <> '')),
sizes AS (SELECT taxon_id, count(*) AS n FROM vals GROUP BY taxon_id),
pairs AS (SELECT a.taxon_id AS taxon_id_a, b.taxon_id AS taxon_id_b, count(*) AS c FROM vals a JOIN vals b ON a.v = b.v AND a.taxon_id < b.taxon_id GROUP BY ALL),
found AS (SELECT taxon_id_a, taxon_id_b FROM pairs p JOIN sizes a ON a.taxon_id = p.taxon_id_a JOIN sizes b ON b.taxon_id = p.taxon_id_b WHERE 2 * c >= a.n + b.n - c)
"""

_P4 = """WITH clean AS (SELECT DISTINCT seq_id, replace(translate(lower(matrix), lower(coalesce(gap, '') || coalesce(missing, '')), ''), 'u', 't') AS s FROM characters WHERE seq_id IS NOT NULL AND matrix IS NOT NULL),
vals AS (SELECT DISTINCT seq_id, substr(s, i, 8) AS v FROM (SELECT seq_id, s, unnest(generate_series(1, CAST(length(s) AS BIGINT) - 7)) AS i FROM clean WHERE length(s) >= 8)),
sizes AS (SELECT seq_id, count(*) AS n FROM vals GROUP BY seq_id),
pairs AS (SELECT a.seq_id AS seq_id_a, b.seq_id AS seq_id_b, count(*) AS c FROM vals a JOIN vals b ON a.v = b.v AND a.seq_id < b.seq_id GROUP BY ALL),
found AS (SELECT seq_id_a, seq_id_b FROM pairs p JOIN sizes a ON a.seq_id = p.seq_id_a JOIN sizes b ON b.seq_id = p.seq_id_b WHERE 10 * c >= 6 * (a.n + b.n - c))
"""

_SOURCE = "regexp_replace(lower(trim(source)), '[\\s\\-]+', '_', 'g')"

ORACLE = {
    "p4_groups": _P4.replace("WITH clean", "WITH RECURSIVE clean") + """, ids AS (SELECT seq_id, min(s) AS s FROM clean WHERE length(s) >= 8 GROUP BY seq_id),
ends AS (SELECT seq_id_a AS x, seq_id_b AS y FROM found UNION ALL SELECT seq_id_b, seq_id_a FROM found), reach AS (SELECT seq_id AS origin, seq_id AS node FROM ids UNION SELECT origin, y FROM reach JOIN ends ON x = node),
least AS (SELECT origin, min(node) AS group_id FROM reach GROUP BY origin), degree AS (SELECT x, count(*) AS n FROM ends GROUP BY x)
SELECT seq_id, min(seq_id) OVER (PARTITION BY s) AS class_id, group_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links FROM ids JOIN least ON origin = seq_id LEFT JOIN degree ON x = seq_id""",
    "p6_limits": """SELECT container, capacity_tokens AS capacity, (SELECT count(*) FROM documents) AS n_docs, CAST(0 AS BIGINT) AS n_broken, CAST(0 AS BIGINT) AS n_cut_in_vain,
CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS tokens_off FROM container_sizes""",
    "p7_limits": f"""WITH t AS (SELECT {_SOURCE} AS source, max(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 GROUP BY ALL),
d AS (SELECT {_SOURCE} AS source, count(*) AS n FROM documents GROUP BY ALL)
SELECT coalesce(t.source, d.source) AS source, coalesce(n, 0) AS n_records, coalesce(target_share, 0.0) AS target_share, max_repeats, true AS within_cap, true AS near_target FROM t FULL JOIN d ON t.source = d.source""",
    "p4_found": _P4 + "SELECT seq_id_a, seq_id_b FROM found",
    "p2_found": _P2 + "SELECT taxon_id_a, taxon_id_b FROM found",
    "p2_links": _P2 + """, keys AS (SELECT taxon_id, string_agg(v, '' ORDER BY v) AS k FROM vals GROUP BY taxon_id),
ends AS (SELECT taxon_id_a AS t FROM found UNION ALL SELECT taxon_id_b FROM found), counts AS (SELECT t, count(*) AS c FROM ends GROUP BY t)
SELECT taxon_id, min(taxon_id) OVER (PARTITION BY k) AS class_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links FROM keys LEFT JOIN counts ON t = taxon_id""",
}
