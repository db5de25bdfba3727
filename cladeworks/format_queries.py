"""Round trips: a block is written in a format, read back, and must be what the tables say. And operators on rooted networks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks import bridge as B
from cladeworks.operators import networks as W
from cladeworks.operators import sketches as K
from cladeworks.operators import splits as S
from cladeworks.operators import trees as T
from cladeworks.reference_queries import _BSP, _FULL, _LAB, NTAX
from cladeworks.scratch import remove_at_exit, shared_dir
from cladeworks.sources import read as R
from cladeworks.sources import write as O

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def _file(text: DataFrame) -> str:
    """Writes the lines of ``value`` as one file into the shared folder."""
    path = f"{shared_dir(text.sparkSession)}/file-{uuid.uuid4().hex}"
    remove_at_exit(text.sparkSession, path)
    text.coalesce(1).write.text(path)
    return path


# ------------------------------------------------------------------ characters


def _rows(spark, sf) -> DataFrame:
    """``taxon, name, seq``: the DNA block with gaps where a taxon has no state."""
    d = B.dna(spark, sf)
    sites = d.select("site").distinct()
    cells = d.select("taxon").distinct().join(F.broadcast(sites)).join(d, ["taxon", "site"], "left").select("taxon", "site", F.coalesce("ch", F.lit("-")).alias("ch"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site", "ch"))), lambda x: x["ch"]), "").alias("seq")
    return cells.groupBy("taxon").agg(seq).select("taxon", F.format_string("t%03d", "taxon").alias("name"), "seq")


_ROWS = f"""WITH {B.DNA_SQL}, s AS (SELECT DISTINCT site FROM b2), t AS (SELECT DISTINCT taxon FROM b2), c AS (SELECT t.taxon, s.site, coalesce(ch, '-') AS ch FROM t JOIN s ON true LEFT JOIN b2 ON b2.taxon = t.taxon AND b2.site = s.site)
SELECT printf('t%03d', taxon) AS name, string_agg(ch, '' ORDER BY site) AS seq FROM c GROUP BY taxon"""


def _msf(rows):
    names = rows.select(F.concat(F.lit(" Name: "), "name", F.lit(" Len: "), F.length("seq").cast("string"), F.lit(" Check: 0 Weight: 1.00")).alias("value"), F.lit(1).alias("k"), "taxon")
    body = rows.select(F.concat("name", F.lit("  "), F.regexp_replace("seq", "(.{10})", "$1 ")).alias("value"), F.lit(3).alias("k"), "taxon")
    lines = rows.sparkSession.createDataFrame([(" MSF: 1 Type: N Check: 0 ..", 0, 0), ("//", 2, 0)], "value string, k int, taxon int").unionByName(names).unionByName(body)
    return lines.repartition(1).sortWithinPartitions("k", "taxon").select("value")


def _stockholm(rows):
    lines = rows.sparkSession.createDataFrame([("# STOCKHOLM 1.0", 0, 0), ("//", 2, 0)], "value string, k int, taxon int").unionByName(rows.select(F.concat_ws(" ", "name", "seq").alias("value"), F.lit(1).alias("k"), "taxon"))
    return lines.repartition(1).sortWithinPartitions("k", "taxon").select("value")


for _name, _make in (("fasta", O.fasta), ("phylip", O.phylip_sequences), ("clustal", O.clustal), ("nexus_characters", O.nexus_characters), ("msf", _msf), ("stockholm", _stockholm)):
    query(_ROWS, f"format_{_name}")(lambda spark, sf, make=_make: R.characters(spark, _file(make(_rows(spark, sf)))).select("name", "seq"))


@query(_ROWS)
def format_fasta_records(spark, sf):
    """FastA read as records that splits of a large file are cut into."""
    return R.fasta_records(spark, _file(O.fasta(_rows(spark, sf)))).select("name", "seq")


@query(_ROWS)
def format_fasta_split(spark, sf):
    """A FastA file split into a folder per record, read back from all of them."""
    out = f"{shared_dir(spark)}/split-{uuid.uuid4().hex}"
    remove_at_exit(spark, out)
    R.fasta_split(spark, _file(O.fasta(_rows(spark, sf))), out)
    return R.fasta_records(spark, f"{out}/*/*.txt").select("name", "seq")


@query(_ROWS)
def format_plain_characters(spark, sf):
    lines = spark.read.text(_file(O.plain_characters(_rows(spark, sf))))
    return lines.select(F.split("value", "\t")[0].alias("name"), F.split("value", "\t")[1].alias("seq"))


# ------------------------------------------------------------------ distances

_D = _LAB + " SELECT printf('t%03d', t1) AS name1, printf('t%03d', t2) AS name2, round(d, 5) AS d FROM b3"


def _named(spark, sf):
    n = lambda c: F.format_string("t%03d", c)
    return B.label_distances(spark, sf).select(n("t1").alias("name1"), n("t2").alias("name2"), "d")


def _csv(d):
    both = d.unionByName(d.select(F.col("name2").alias("name1"), F.col("name1").alias("name2"), "d"))
    names = both.select("name1").distinct()
    both = both.unionByName(names.select("name1", F.col("name1").alias("name2"), F.lit(0.0).alias("d")))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name2", "d"))), lambda x: x["d"].cast("string")), ",")
    lines = both.groupBy("name1").agg(row.alias("r")).select("name1", F.concat_ws(",", "name1", "r").alias("value"))
    return lines.repartition(1).sortWithinPartitions("name1").select("value")


for _name, _make in (("phylip_distances", O.phylip_distances), ("nexus_distances", O.nexus_distances), ("csv_distances", _csv)):
    query(_D, f"format_{_name}")(lambda spark, sf, make=_make: R.distances(spark, _file(make(_named(spark, sf)))).select(F.least("name1", "name2").alias("name1"), F.greatest("name1", "name2").alias("name2"), F.round("d", 5).alias("d")))


@query(_D)
def format_plain_distances(spark, sf):
    x = spark.read.text(_file(O.plain_distances(_named(spark, sf)))).select(F.split("value", "\t").alias("p"))
    return x.select(F.col("p")[0].alias("name1"), F.col("p")[1].alias("name2"), F.round(F.col("p")[2].cast("double"), 5).alias("d"))


# ------------------------------------------------------------------ splits

NAMES = [f"t{i:03d}" for i in range(1, NTAX + 1)]
_S = _BSP + ", o AS (SELECT mask, weight FROM bs ORDER BY weight DESC, mask) SELECT mask, weight FROM o"


def _splits(spark, sf):
    return S.presence_splits(B.presence(spark, sf), NTAX)


def _mask(side):
    return F.aggregate(side, F.lit(0).cast("bigint"), lambda s, t: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), t.cast("int") - 1)))


@query(_S)
def format_nexus_splits(spark, sf):
    r = R.splits(spark, _file(O.nexus_splits(_splits(spark, sf), NAMES)))
    return r.select(_mask(F.col("side")).alias("mask"), F.round("weight", 6).alias("weight"))


@query(_S)
def format_plain_splits(spark, sf):
    x = spark.read.text(_file(O.plain_splits(_splits(spark, sf), NTAX))).select(F.split("value", "\t").alias("p"))
    return x.select(_mask(F.split(F.col("p")[1], " ")).alias("mask"), F.col("p")[0].cast("double").alias("weight"))


@query(_BSP + " SELECT mask FROM bs")
def format_splits_fasta(spark, sf):
    """Splits as 0/1 sequences, read back and made splits again."""
    rows = R.characters(spark, _file(O.splits_fasta(_splits(spark, sf), NAMES)))
    one = R.long_characters(rows.select(F.substring("name", 2, 9).cast("int").alias("taxon"), "seq")).filter("ch = '1'")
    return S.presence_splits(one.select("taxon", "site"), NTAX).select("mask")


@query(_BSP + f""", iv AS (SELECT mask, weight, min(t) AS lo, max(t) AS hi FROM (SELECT mask, weight, unnest(generate_series(0, {NTAX - 1}))::INTEGER AS t FROM bs) WHERE (mask >> t) & 1 = 1 GROUP BY ALL),
c AS (SELECT mask, weight FROM iv WHERE hi - lo + 1 = bit_count(mask)), tr AS (SELECT CASE WHEN i = 0 THEN {_FULL} - 1 ELSE 1::BIGINT << i END AS mask FROM (SELECT unnest(generate_series(0, {NTAX - 1}))::INTEGER AS i))
SELECT mask, weight FROM c UNION ALL SELECT CAST(mask AS BIGINT), CAST(0 AS DOUBLE) FROM tr WHERE mask NOT IN (SELECT mask FROM c)""")
def format_split_newick(spark, sf):
    """The splits that are intervals of the cycle 1, 2, ... as annotated Newick and back."""
    cyclic = S.cyclic(_splits(spark, sf), list(range(1, NTAX + 1))).filter("is_cyclic").select("mask", "weight")
    r = R.split_newick(spark, _file(O.split_newick(S.weight_slider(cyclic, NTAX), NAMES, list(range(1, NTAX + 1)))))
    side = F.transform("side", lambda x: F.substring(x, F.lit(2), F.lit(9)).cast("int"))
    return r.select(S.canonical(_mask(side), NTAX).alias("mask"), F.round("weight", 6).alias("weight"))


# ------------------------------------------------------------------ trees

def _tree_edges(spark, sf) -> DataFrame:
    """``tree_no, parent, child, weight, label`` of the trees of the bridge, each made in a task of its own."""
    e = W.cluster_tree(B.clusters(spark, sf).filter(F.col("mask") != S.full_mask(NTAX)), NTAX, ("tree_id",), whole=False)
    return e.select(F.col("tree_id").alias("tree_no"), "parent", "child", "weight", F.when(F.col("taxon").isNotNull(), F.format_string("t%03d", "taxon")).alias("label"))


def _clusters_of(edges: DataFrame, key: str = "tree_no") -> DataFrame:
    nets = edges.filter("parent >= 0").select(F.col(key).cast("int").alias("net_id"), "parent", "child", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.expr("cast(substring(label, 2, 9) as int)").alias("taxon"))
    return W.tree_clusters(nets, NTAX).select("tree_id", "mask", F.round("weight", 3).alias("weight"))


_TREES = f"WITH {B.CLUSTERS_SQL} SELECT tree_id, mask, round(weight, 3) AS weight FROM b5 WHERE mask <> {_FULL}"


@query(_TREES)
def trees_to_clusters(spark, sf):
    """Trees of nodes and edges to clusters."""
    return _clusters_of(_tree_edges(spark, sf))


def _newicks(spark, sf):
    return O.newick(_tree_edges(spark, sf)).select("tree_no", F.format_string("tree%03d", "tree_no").alias("name"), F.col("value").alias("newick"))


@query(_TREES)
def format_newick(spark, sf):
    lines = _newicks(spark, sf).repartition(1).sortWithinPartitions("tree_no").select(F.col("newick").alias("value"))
    return _clusters_of(R.tree_edges(R.trees(spark, _file(lines))))


@query(_TREES)
def format_nexus_trees(spark, sf):
    return _clusters_of(R.tree_edges(R.trees(spark, _file(O.nexus_trees(_newicks(spark, sf))))))


@query(_TREES)
def format_nexml(spark, sf):
    text = _file(O.nexml_trees(_tree_edges(spark, sf)))
    n = lambda c: F.substring(c, 2, 9).cast("int")
    e = R.nexml_trees(spark, text).select(F.substring("tree", 5, 9).cast("int").alias("tree_no"), n("source").alias("parent"), n("target").alias("child"), F.col("length").alias("weight"))
    # leaves are numbered from 0 in the order of the taxa
    return _clusters_of(e.withColumn("label", F.when(F.col("child") < NTAX, F.format_string("t%03d", F.col("child") + 1))))


# ------------------------------------------------------------------ networks, taxa, traits, sets, genomes

_NET = "SELECT n_nationkey AS src, 100 + n_regionkey AS dst, CAST(n_nationkey AS DOUBLE) / 4 AS weight FROM nation"


def _network(spark, sf):
    n, r = B.table(spark, sf, "nation"), B.table(spark, sf, "region")
    nodes = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")).unionByName(r.select((F.col("r_regionkey") + 100).alias("id"), F.lit(None).cast("string").alias("label")))
    return nodes, n.select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst"), (F.col("n_nationkey") / 4).alias("weight"))


for _name, _make in (("gml", O.gml), ("nexus_network", O.nexus_network)):
    query(_NET, f"format_{_name}")(lambda spark, sf, make=_make: R.network(spark, _file(make(*_network(spark, sf))))[1].select("src", "dst", "weight"))
    query("SELECT n_nationkey AS id, n_name AS label FROM nation", f"format_{_name}_nodes")(lambda spark, sf, make=_make: R.network(spark, _file(make(*_network(spark, sf))))[0].filter("id < 100").select("id", "label"))


@query(_NET)
def format_plain_network(spark, sf):
    x = spark.read.text(_file(O.plain_network(_network(spark, sf)[1]))).select(F.split("value", "\t").alias("p"))
    return x.select(F.col("p")[0].cast("int").alias("src"), F.col("p")[1].cast("int").alias("dst"), F.col("p")[2].cast("double").alias("weight"))


def _nation_taxa(spark, sf):
    return B.table(spark, sf, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("taxon"), F.col("n_name").alias("name"))


@query("SELECT CAST(n_nationkey + 1 AS INTEGER) AS taxon, n_name AS name FROM nation")
def format_nexus_taxa(spark, sf):
    return R.taxa(spark, _file(O.nexus_taxa(_nation_taxa(spark, sf)))).select("taxon", "name")


@query("SELECT CAST(n_nationkey + 1 AS INTEGER) AS taxon, n_name AS name FROM nation")
def format_plain_taxa(spark, sf):
    x = spark.read.text(_file(O.plain_taxa(_nation_taxa(spark, sf)))).select(F.split("value", "\t").alias("p"))
    return x.select(F.col("p")[0].cast("int").alias("taxon"), F.col("p")[1].alias("name"))


_TRAITS = "SELECT n_name AS name, c_mktsegment AS trait, CAST(count(*) AS VARCHAR) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"


def _traits(spark, sf):
    c, n = B.table(spark, sf, "customer"), B.table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("name"), F.col("c_mktsegment").alias("trait")).agg(F.count(F.lit(1)).cast("string").alias("value"))


@query(_TRAITS)
def format_nexus_traits(spark, sf):
    return R.traits(spark, _file(O.nexus_traits(_traits(spark, sf)))).filter("value <> '?'").select("name", "trait", "value")


@query(_TRAITS)
def format_plain_traits(spark, sf):
    x = spark.read.text(_file(O.plain_traits(_traits(spark, sf)))).select(F.split("value", "\t").alias("p"))
    return x.select(F.col("p")[0].alias("name"), F.col("p")[1].alias("trait"), F.col("p")[2].alias("value"))


_SETS = "SELECT 'taxset' AS kind, r_name AS name, CAST(n_nationkey + 1 AS VARCHAR) AS member FROM nation JOIN region ON n_regionkey = r_regionkey"


def _sets(spark, sf):
    n, r = B.table(spark, sf, "nation"), B.table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.lit("taxset").alias("kind"), F.col("r_name").alias("name"), (F.col("n_nationkey") + 1).cast("string").alias("member"))


@query(_SETS)
def format_nexus_sets(spark, sf):
    return R.sets(spark, _file(O.nexus_sets(_sets(spark, sf)))).select("kind", "name", "member")


@query(_SETS)
def format_plain_sets(spark, sf):
    x = spark.read.text(_file(O.plain_sets(_sets(spark, sf)))).select(F.split("value", "\t").alias("p"))
    return x.select(F.col("p")[0].alias("kind"), F.col("p")[1].alias("name"), F.explode(F.split(F.col("p")[2], " ")).alias("member"))


_GENOMES = """WITH g AS (SELECT taxon_id, genome_accession, genome_size, parts, row_number() OVER (PARTITION BY genome_accession ORDER BY loaded_at, taxon_id, genome_size) AS r FROM genomes
  WHERE taxon_id IS NOT NULL AND genome_accession IS NOT NULL AND genome_size IS NOT NULL AND len(parts) > 0)
SELECT accession, length, n_parts, first_file, first_offset, bases FROM (SELECT genome_accession AS accession, genome_size AS length, CAST(len(parts) AS INTEGER) AS n_parts, parts[1].part_file AS first_file, parts[1].part_offset AS first_offset,
  CAST(list_sum(list_transform(parts, lambda p: p.part_length)) AS BIGINT) AS bases FROM g WHERE r = 1)"""


@query(_GENOMES)
def format_nexus_genomes(spark, sf):
    """All genomes with a taxon, accession, size and parts, the first row of each accession, as one genomes block and back."""
    g = B.table(spark, sf, "genomes").filter("taxon_id is not null and genome_accession is not null and genome_size is not null and size(parts) > 0")
    g = g.withColumn("r", F.row_number().over(Window.partitionBy("genome_accession").orderBy("loaded_at", "taxon_id", "genome_size"))).filter("r = 1")
    parts = F.transform("parts", lambda p: F.struct(p["part_file"].alias("file"), p["part_offset"].alias("offset"), p["part_length"].alias("length"), F.lit(None).cast("string").alias("seq")))
    rows = g.select(F.col("taxon_id").alias("taxon"), F.concat(F.lit("taxon "), F.col("taxon_id").cast("string")).alias("name"), F.col("genome_accession").alias("accession"), F.col("genome_size").alias("length"), parts.alias("parts"))
    back = R.genomes(spark, _file(O.nexus_genomes(rows)))
    bases = F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + p["length"])
    return back.select("accession", "length", F.size("parts").alias("n_parts"), F.col("parts")[0]["file"].alias("first_file"), F.col("parts")[0]["offset"].alias("first_offset"), bases.alias("bases"))


# ------------------------------------------------------------------ rooted trees and networks


@query(f"WITH {B.CLUSTERS_SQL}, nt AS (SELECT count(DISTINCT tree_id) AS t FROM b5), c AS (SELECT mask FROM b5, nt GROUP BY mask, t HAVING count(*) > 0.04 * t) SELECT DISTINCT mask FROM c WHERE mask <> {_FULL}")
def network_of_clusters(spark, sf):
    """The rooted network of all clusters in more than 4 % of the trees shows these clusters."""
    c = T.consensus_clusters(B.clusters(spark, sf), 4.0).select("mask", "weight")
    return W.tree_clusters(W.cluster_network(c, NTAX), NTAX).select("mask").distinct()


def _nets(spark, sf) -> DataFrame:
    """A rooted network for every two trees that follow each other in number: the cover graph of their clusters."""
    c = B.clusters(spark, sf).filter(F.col("mask") != S.full_mask(NTAX))
    both = c.unionByName(c.withColumn("tree_id", F.col("tree_id") - 1)).filter(F.col("tree_id") > 0)
    one = both.groupBy("tree_id", "mask").agg(F.max("weight").alias("weight"))
    return W.cluster_network(one, NTAX, ("tree_id",), whole=False).select(F.col("tree_id").alias("net_id"), "parent", "child", "weight", "taxon")


@query(f"WITH {B.CLUSTERS_SQL}, n AS (SELECT DISTINCT tree_id, mask FROM b5 WHERE mask <> {_FULL} UNION SELECT tree_id - 1, mask FROM b5 WHERE tree_id > 1 AND mask <> {_FULL}) SELECT CAST(tree_id AS INTEGER) AS tree_id, mask FROM n")
def network_clusters(spark, sf):
    return W.tree_clusters(_nets(spark, sf), NTAX).select("tree_id", "mask")


@query(f"""WITH {B.CLUSTERS_SQL}, n AS (SELECT DISTINCT tree_id, mask FROM b5 WHERE mask <> {_FULL} UNION SELECT tree_id - 1, mask FROM b5 WHERE tree_id > 1 AND mask <> {_FULL}),
bad AS (SELECT DISTINCT p.tree_id AS tree_id FROM n p JOIN n q ON p.tree_id = q.tree_id AND p.mask < q.mask AND p.mask & q.mask NOT IN (0, p.mask, q.mask))
SELECT CAST(tree_id AS INTEGER) AS net_id, tree_id NOT IN (SELECT tree_id FROM bad) AS is_tree FROM (SELECT DISTINCT tree_id FROM n)""")
def network_classes(spark, sf):
    return W.classes(_nets(spark, sf)).select("net_id", (F.col("class") == "tree").alias("is_tree"))


@query(f"WITH {B.CLUSTERS_SQL}, n AS (SELECT DISTINCT tree_id, mask FROM b5 UNION SELECT tree_id - 1, mask FROM b5 WHERE tree_id > 1) SELECT CAST(tree_id AS INTEGER) AS tree_id, mask FROM n WHERE bit_count(mask) = 1")
def network_lsa_leaves(spark, sf):
    """Trees of lowest stable ancestors: their leaves are all taxa of the network."""
    return W.tree_clusters(W.lsa_trees(_nets(spark, sf)), NTAX).filter("bit_count(mask) = 1").select("tree_id", "mask")


query(None, "network_lsa_trees")(lambda spark, sf: W.lsa_trees(_nets(spark, sf)))
query(None, "network_blob_trees")(lambda spark, sf: W.blob_trees(_nets(spark, sf)))
query(None, "network_normalized")(lambda spark, sf: W.normalized(_nets(spark, sf)))


def _trees(spark, sf):
    e = W.cluster_tree(B.clusters(spark, sf).filter(F.col("mask") != S.full_mask(NTAX)), NTAX, ("tree_id",), whole=False)
    return e.select(F.col("tree_id").alias("net_id"), "parent", "child", "weight", "taxon")


@query(f"WITH {B.CLUSTERS_SQL} SELECT tree_id, CASE WHEN mask & 1 <> 0 THEN {_FULL} - mask ELSE mask END AS mask FROM b5 WHERE mask <> {_FULL} GROUP BY ALL")
def trees_rerooted(spark, sf):
    """Rooting by the out-group of taxa 1 to 3 leaves the splits of each tree."""
    return _root_free(W.rerooted(_trees(spark, sf), {1, 2, 3}))


@query(f"WITH {B.CLUSTERS_SQL} SELECT tree_id, CASE WHEN mask & 1 <> 0 THEN {_FULL} - mask ELSE mask END AS mask FROM b5 WHERE mask <> {_FULL} GROUP BY ALL")
def trees_midpoint(spark, sf):
    """Mid-point rooting leaves the splits of each tree."""
    return _root_free(W.midpoint_rooted(_trees(spark, sf)))


def _root_free(trees):
    return T.tree_splits(W.tree_clusters(trees, NTAX), NTAX).select("tree_id", "mask")


@query(f"WITH {B.CLUSTERS_SQL}, t AS (SELECT DISTINCT tree_id FROM b5) SELECT tree_id AS net_id, CAST(sum(CASE WHEN bit_count(mask) = 1 THEN bit_count(mask - 1) + 1 END) AS BIGINT) AS taxa, CAST(sum(CASE WHEN bit_count(mask) = 1 THEN 1 END) * (sum(CASE WHEN bit_count(mask) = 1 THEN 1 END) + 1) // 2 AS BIGINT) AS positions FROM b5 JOIN t USING (tree_id) GROUP BY tree_id")
def trees_reordered(spark, sf):
    """Every order of the children lists all taxa once."""
    return W.reordered(_trees(spark, sf), "size_down").groupBy("net_id").agg(F.sum("taxon").cast("bigint").alias("taxa"), F.sum("position").cast("bigint").alias("positions"))


@query(f"""WITH {B.CLUSTERS_SQL}, v AS (SELECT CAST(n_nationkey + 1 AS INTEGER) AS taxon, n_regionkey AS r FROM nation), m AS (SELECT b5.tree_id AS tree_id, mask, count(DISTINCT r) AS k FROM b5 JOIN v ON (mask >> (taxon - 1)) & 1 = 1 GROUP BY ALL),
top AS (SELECT tree_id, mask FROM m WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM m o WHERE o.tree_id = m.tree_id AND o.k = 1 AND o.mask & m.mask = m.mask AND o.mask <> m.mask)) SELECT tree_id AS net_id, count(*) AS tight FROM top GROUP BY tree_id""")
def trees_tight_species(spark, sf):
    """Largest clades of nations of one region."""
    traits = B.table(spark, sf, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("taxon"), F.col("n_regionkey").cast("string").alias("trait"))
    return W.loose_and_lacy(_trees(spark, sf), traits).filter("kind = 'tight'").groupBy("net_id").agg(F.count_distinct("species").alias("tight"))


@query(f"WITH {B.CLUSTERS_SQL} SELECT DISTINCT tree_id AS net_id, true AS displayed FROM b5")
def network_displays(spark, sf):
    """Each tree is contained in itself."""
    t = _trees(spark, sf)
    return W.displayed(t, t).filter("net_id = tree_id").select("net_id", "displayed")


@query("""WITH e AS (SELECT n_nationkey AS a, 100 + n_regionkey AS b FROM nation UNION ALL SELECT 100 + r_regionkey, 200 FROM region), deg AS (SELECT n_regionkey AS r, count(*) AS k FROM nation GROUP BY ALL)
SELECT count(*) AS n_edges, CAST(sum(weight) AS DOUBLE) AS length FROM (SELECT 1.0 AS weight FROM nation JOIN deg ON r = n_regionkey WHERE k > 1 UNION ALL SELECT 1.0 FROM deg WHERE k > 1 UNION ALL SELECT 2.0 FROM deg WHERE k = 1)""")
def network_simplified(spark, sf):
    """Nations on regions on a centre, and a chain and a loose end without taxa, which go."""
    n = B.table(spark, sf, "nation")
    e = n.select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst")).unionByName(n.select((F.col("n_regionkey") + 100).alias("src"), F.lit(200).alias("dst")).distinct())
    extra = n.sparkSession.createDataFrame([(200, 300), (300, 301)], "src int, dst int")
    x = e.unionByName(extra).withColumn("weight", F.lit(1.0))
    return W.simplify(x, list(range(25))).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("length"))


# ------------------------------------------------------------------ sketches


@query("SELECT DISTINCT CAST(taxon_id AS VARCHAR) AS h, true AS hit FROM mash_sketches WHERE taxon_id IS NOT NULL")
def sketch_bloom_contains(spark, sf):
    """A Bloom filter of all keys of sketches holds each of them."""
    h = B.table(spark, sf, "mash_sketches").filter("taxon_id is not null").select(F.col("taxon_id").cast("string").alias("h"))
    return K.bloom_contains(h, K.bloom_filter(h, 1 << 20), 1 << 20)
