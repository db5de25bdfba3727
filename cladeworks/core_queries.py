"""Queries on the core problems (1, 3, 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.operators import hierarchy as H
from cladeworks.operators import orphans as O
from cladeworks.operators import reject_lines as R


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_parsed(spark, sf):
    return R.parse_lines(table(spark, sf, "raw_lines"))


def p1_found(spark, sf):
    return R.parse_lines(table(spark, sf, "raw_lines"), typed=False).filter("not ok").select("line_id")


def p1_rejects(spark, sf):
    return R.rejects(R.parse_lines(table(spark, sf, "raw_lines"), typed=False))


def p1_genomes(spark, sf):
    return R.valid_rows(p1_parsed(spark, sf), "genomes")


def p1_characters(spark, sf):
    return R.valid_rows(p1_parsed(spark, sf), "characters")


def p3_found(spark, sf):
    links = H.in_force(table(spark, sf, "taxa"))
    return H.find_cycles(links).select(F.col("cycle_id").cast("int"), F.col("node").cast("int").alias("taxon_id"))


def p3_hierarchy(spark, sf):
    h = H.build_hierarchy(H.in_force(table(spark, sf, "taxa")))
    return h.select(
        F.col("node").alias("taxon_id"), F.col("parent").alias("parent_id"), "orphan", F.col("root").alias("root_id"), F.col("depth").cast("int"),
        F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), (F.col("size") - 1).alias("n_descendants"), F.col("first").alias("first_no"), F.col("last").alias("last_no"),
    )


def p3_descendants(spark, sf):
    d = H.descendants(H.build_hierarchy(H.in_force(table(spark, sf, "taxa"))))
    return d.select(F.col("ancestor").alias("ancestor_id"), F.col("descendant").alias("descendant_id"), F.col("distance").cast("int"))


def _checked(spark, sf):
    taxa = table(spark, sf, "taxa")
    refs = O.references("taxa", taxa, "parent_id")
    for t in ("genomes", "mash_sketches", "bloom_filters"):
        refs = refs.unionByName(O.references(t, table(spark, sf, t), "taxon_id"))
    return O.check_references(refs, taxa)


def p5_found(spark, sf):
    return O.orphans(_checked(spark, sf)).select("ref_table", "load_month", F.col("ref_id").cast("int")).distinct()


def p5_orphans(spark, sf):
    return O.orphans(_checked(spark, sf))


def p5_report(spark, sf):
    return O.orphan_report(_checked(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_genomes, p1_characters, p3_found, p3_hierarchy, p3_descendants, p5_found, p5_orphans, p5_report)}

_FIELD = r'''(?:[^",\r\n]*|"(?:[^"]|"")*")'''


def _fields(n: int) -> str:
    raw = ", ".join(rf"regexp_extract(l, '(?s)\A(?:{_FIELD},){{{k}}}({_FIELD})(?:,|\z)', 1) AS r{k}" for k in range(n))
    return raw


def _unquote(n: int) -> str:
    return ", ".join(f"CASE WHEN r{k} LIKE '\"%' THEN replace(substr(r{k}, 2, length(r{k}) - 2), '\"\"', '\"') ELSE r{k} END AS f{k}" for k in range(n))


_URL = r"\A[A-Za-z]+://[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?(?::[0-9]{1,5})?/(?:[!#$&-;=?-\[\]-~]|%[0-9A-Fa-f]{2})*\z"


def _int(c: str) -> str:
    return f"(regexp_matches({c}, '\\A[0-9]{{1,10}}\\z') AND coalesce(try_cast({c} AS BIGINT), 0) BETWEEN 1 AND 2147483647)"


_P1 = rf"""
WITH raw AS (SELECT line_id, feed, regexp_replace(line, '\r\z', '') AS l FROM raw_lines),
whole AS (SELECT *, regexp_matches(l, '(?s)\A{_FIELD}(?:,{_FIELD})*\z') AS quoted FROM raw),
g4 AS (SELECT *, {_unquote(4)} FROM (SELECT *, regexp_matches(l, '(?s)\A{_FIELD}(?:,{_FIELD}){{3}}\z') AS n4, {_fields(4)} FROM whole WHERE feed = 'genomes')),
g AS (SELECT *, coalesce(quoted AND n4 AND {_int('f0')} AND regexp_matches(f1, '\A[A-Z]{{3}}_[0-9]{{9}}\.[0-9]+\z') AND (f2 = '' OR {_int('f2')})
  AND (f3 IN ('', 'null') OR (lower(split_part(f3, '://', 1)) IN ('ftp', 'http', 'https') AND regexp_matches(f3, '{_URL}'))), false) AS ok FROM g4),
c6 AS (SELECT *, {_unquote(6)} FROM (SELECT *, regexp_matches(l, '(?s)\A{_FIELD}(?:,{_FIELD}){{5}}\z') AS n6, {_fields(6)} FROM whole WHERE feed = 'characters')),
ca AS (SELECT *, CASE lower(f2) WHEN 'dna' THEN 'acgtryswkmbdhvn' WHEN 'rna' THEN 'acguryswkmbdhvn' WHEN 'protein' THEN 'arndcqeghilkmfpstwyvbzx*' WHEN 'standard' THEN '0123456789' END AS alphabet FROM c6),
c AS (SELECT *, coalesce(quoted AND n6 AND {_int('f0')} AND regexp_matches(f1, '\S') AND alphabet IS NOT NULL AND {_int('f3')} AND f4 <> '' AND length(f4) = list_unique(string_split(lower(f4), ''))
  AND translate(lower(f4), alphabet, '') = '' AND length(replace(f5, ' ', '')) = try_cast(f3 AS BIGINT) AND translate(lower(replace(f5, ' ', '')), lower(f4) || '-?', '') = '', false) AS ok FROM ca)
"""

_FAULTS = {
    "g4": (("taxon_id", _int("f0"), "not an integer from 1"), ("genome_accession", r"regexp_matches(f1, '\A[A-Z]{3}_[0-9]{9}\.[0-9]+\z')", "not an accession"), ("genome_size", f"(f2 = '' OR {_int('f2')})", "neither empty nor an integer from 1"),
           ("fasta_url", f"(f3 IN ('', 'null') OR (lower(split_part(f3, '://', 1)) IN ('ftp', 'http', 'https') AND regexp_matches(f3, '{_URL}')))", "not a URL")),
    "ca": (("block_id", _int("f0"), "not an integer from 1"), ("taxon_name", r"regexp_matches(f1, '\S')", "blank"), ("data_type", "alphabet IS NOT NULL", "unknown type"), ("nchar", _int("f3"), "not an integer from 1"),
           ("symbols", "(f4 <> '' AND length(f4) = list_unique(string_split(lower(f4), '')) AND translate(lower(f4), coalesce(alphabet, lower(f4)), '') = '')", "empty, repeated or foreign symbol"),
           ("matrix", f"({_int('f3')} AND length(replace(f5, ' ', '')) = try_cast(f3 AS BIGINT) AND translate(lower(replace(f5, ' ', '')), lower(f4) || '-?', '') = '')", "wrong length or foreign character")),
}
_P1_FAULTS = " UNION ALL ".join(
    f"SELECT line_id, feed, '{name}' AS field, '{why}' AS reason FROM {src} WHERE quoted AND n{k} AND NOT coalesce({ok}, false)" for src, k in (("g4", 4), ("ca", 6)) for name, ok, why in _FAULTS[src]
) + """ UNION ALL SELECT line_id, feed, CAST(NULL AS VARCHAR), CASE WHEN l IS NULL THEN 'null line' WHEN feed IS NULL OR feed NOT IN ('genomes', 'characters') THEN 'unknown feed' WHEN NOT quoted THEN 'quoting'
  ELSE 'column count: ' || wanted || ' wanted, ' || (length(bare) - length(replace(bare, ',', '')) + 1) || ' found' END
 FROM (SELECT *, CASE feed WHEN 'genomes' THEN 4 ELSE 6 END AS wanted, regexp_replace(l, '"(?:[^"]|"")*"', '', 'g') AS bare FROM whole)
 WHERE l IS NULL OR feed IS NULL OR feed NOT IN ('genomes', 'characters') OR NOT quoted OR length(bare) - length(replace(bare, ',', '')) + 1 <> wanted"""

_TAXA = """in_force AS (SELECT taxon_id AS node, CASE WHEN parent_id <> 0 THEN parent_id END AS parent FROM taxa WHERE taxon_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY taxon_id ORDER BY loaded_at DESC NULLS LAST, parent_id DESC NULLS LAST) = 1)"""

_TREE = f"""WITH RECURSIVE {_TAXA},
links AS (SELECT a.node, b.node AS parent, a.parent IS NOT NULL AND b.node IS NULL AS orphan FROM in_force a LEFT JOIN in_force b ON a.parent = b.node),
walk AS (SELECT node, node AS root, 0 AS depth, [node] AS path FROM links WHERE parent IS NULL
  UNION ALL SELECT l.node, w.root, w.depth + 1, list_append(w.path, l.node) FROM walk w JOIN links l ON l.parent = w.node)"""

_REFS = """refs AS (SELECT 'taxa' AS ref_table, parent_id AS ref_id, loaded_at FROM taxa UNION ALL SELECT 'genomes', taxon_id, loaded_at FROM genomes
  UNION ALL SELECT 'mash_sketches', taxon_id, loaded_at FROM mash_sketches UNION ALL SELECT 'bloom_filters', taxon_id, loaded_at FROM bloom_filters),
checked AS (SELECT ref_table, strftime(loaded_at, '%Y-%m') AS load_month, ref_id, n_refs,
  CASE WHEN EXISTS (SELECT 1 FROM taxa t WHERE t.taxon_id = r.ref_id AND t.loaded_at <= r.loaded_at AND (t.deleted_at IS NULL OR t.deleted_at > r.loaded_at)) THEN 'valid'
    WHEN EXISTS (SELECT 1 FROM taxa t WHERE t.taxon_id = r.ref_id AND t.loaded_at <= r.loaded_at) THEN 'deleted'
    WHEN EXISTS (SELECT 1 FROM taxa t WHERE t.taxon_id = r.ref_id AND t.loaded_at IS NOT NULL) THEN 'late' ELSE 'missing' END AS status
  FROM (SELECT ref_table, ref_id, loaded_at, count(*) AS n_refs FROM refs WHERE ref_id <> 0 GROUP BY ALL) r)"""

ORACLE = {
    "p1_found": _P1 + "SELECT line_id FROM g WHERE NOT ok UNION ALL SELECT line_id FROM c WHERE NOT ok UNION ALL SELECT line_id FROM whole WHERE feed IS NULL OR feed NOT IN ('genomes', 'characters')",
    "p1_rejects": _P1 + _P1_FAULTS,
    "p1_genomes": _P1 + "SELECT line_id, CAST(f0 AS INTEGER) AS taxon_id, f1 AS genome_accession, CAST(nullif(f2, '') AS INTEGER) AS genome_size, CASE WHEN f3 NOT IN ('', 'null') THEN f3 END AS fasta_url FROM g WHERE ok",
    "p1_characters": _P1 + "SELECT line_id, CAST(f0 AS INTEGER) AS block_id, f1 AS taxon_name, f2 AS data_type, CAST(f3 AS INTEGER) AS nchar, f4 AS symbols, replace(f5, ' ', '') AS matrix FROM c WHERE ok",
    "p3_found": f"""WITH RECURSIVE {_TAXA}, walk AS (SELECT node AS start, parent AS cur FROM in_force WHERE parent IS NOT NULL
  UNION SELECT w.start, l.parent FROM walk w JOIN in_force l ON l.node = w.cur WHERE l.parent IS NOT NULL)
SELECT CAST(min(b.cur) AS INTEGER) AS cycle_id, a.start AS taxon_id FROM walk a JOIN walk b ON b.start = a.start WHERE a.cur = a.start GROUP BY a.start""",
    "p3_hierarchy": _TREE + """, up AS (SELECT node AS descendant, unnest(path) AS node FROM walk), sizes AS (SELECT node, count(*) AS size FROM up GROUP BY node),
heavy AS (SELECT l.parent, arg_max(l.node, (s.size, -l.node)) AS child FROM links l JOIN sizes s USING (node) WHERE l.parent IS NOT NULL GROUP BY l.parent),
numbered AS (SELECT node, row_number() OVER (PARTITION BY root ORDER BY key) - 1 AS first_no FROM
  (SELECT w.node, w.root, list(CASE WHEN h.child IS NOT NULL THEN 0 ELSE u.x END ORDER BY u.i) AS key FROM walk w, LATERAL (SELECT unnest(w.path) AS x, generate_subscripts(w.path, 1) AS i) u
   LEFT JOIN heavy h ON h.child = u.x GROUP BY w.node, w.root))
SELECT CAST(w.node AS BIGINT) AS taxon_id, CAST(l.parent AS BIGINT) AS parent_id, l.orphan, CAST(w.root AS BIGINT) AS root_id, CAST(w.depth AS INTEGER) AS depth, array_to_string(w.path, '/') AS path,
  CAST(s.size - 1 AS BIGINT) AS n_descendants, CAST(n.first_no AS BIGINT) AS first_no, CAST(n.first_no + s.size - 1 AS BIGINT) AS last_no
FROM walk w JOIN links l USING (node) JOIN sizes s USING (node) JOIN numbered n USING (node)""",
    "p3_descendants": _TREE + """ SELECT CAST(a AS BIGINT) AS ancestor_id, CAST(node AS BIGINT) AS descendant_id, CAST(depth - i + 1 AS INTEGER) AS distance
FROM (SELECT node, depth, unnest(path) AS a, generate_subscripts(path, 1) AS i FROM walk) WHERE i <= depth""",
    "p5_found": f"WITH {_REFS} SELECT DISTINCT ref_table, load_month, ref_id FROM checked WHERE status <> 'valid'",
    "p5_orphans": f"WITH {_REFS} SELECT ref_table, load_month, CAST(ref_id AS BIGINT) AS ref_id, status, CAST(sum(n_refs) AS BIGINT) AS n_refs FROM checked WHERE status <> 'valid' GROUP BY ALL",
    "p5_report": f"""WITH {_REFS} SELECT ref_table, load_month, CAST(sum(n_refs) AS BIGINT) AS n_refs, """
    + ", ".join(f"CAST(coalesce(sum(n_refs) FILTER (status = '{s}'), 0) AS BIGINT) AS n_{s}" for s in ("valid", "missing", "deleted", "late"))
    + " FROM checked GROUP BY ALL",
}
