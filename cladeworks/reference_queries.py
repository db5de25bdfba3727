"""Queries on the operators for characters, distances, splits, trees and sketches, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeworks import bridge as B
from cladeworks.operators import bootstrap as Z
from cladeworks.operators import char_distances as D
from cladeworks.operators import characters as C
from cladeworks.operators import distances as M
from cladeworks.operators import hierarchy as H
from cladeworks.operators import networks as W
from cladeworks.operators import sketches as K
from cladeworks.operators import splits as S
from cladeworks.operators import trees as T
from cladeworks.scratch import stage

NTAX = 25
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _binary(spark, sf):
    return D.binary_counts(C.pair_counts(B.presence(spark, sf).withColumn("ch", F.lit("1")), gap="0"))


def _dna_pairs(spark, sf):
    return C.pair_counts(B.dna(spark, sf))


def _out(d, *keys):
    keys = keys or ("t1", "t2")
    kind = {"t1": "int", "t2": "int"}
    return d.select(*(F.col(k).cast(kind.get(k, d.schema[k].dataType.simpleString())) for k in keys), F.round("d", 6).alias("d"))


# ------------------------------------------------------------------ characters -> distances

_BIN = f"""WITH {B.PRESENCE_SQL}, size AS (SELECT taxon, count(*) AS n FROM b1 GROUP BY taxon),
abc AS (SELECT x.taxon AS t1, y.taxon AS t2, CAST(coalesce(i.a, 0) AS DOUBLE) AS a, CAST(x.n - coalesce(i.a, 0) AS DOUBLE) AS b, CAST(y.n - coalesce(i.a, 0) AS DOUBLE) AS c FROM size x JOIN size y ON x.taxon < y.taxon
  LEFT JOIN (SELECT p.taxon AS u, q.taxon AS v, count(*) AS a FROM b1 p JOIN b1 q ON p.site = q.site AND p.taxon < q.taxon GROUP BY ALL) i ON i.u = x.taxon AND i.v = y.taxon)"""
_BIG = "CASE WHEN m <= 1 THEN 1.0 ELSE ceil(1.1 * m / power(10.0, ceil(log10(1.1 * m)) - 1)) * power(10.0, ceil(log10(1.1 * m)) - 1) END"


def _repaired(with_: str, d: str, src: str) -> str:
    return f"{with_}, raw AS (SELECT t1, t2, {d} AS d FROM {src}), top AS (SELECT coalesce(max(d), 0.0) AS m FROM raw) SELECT t1, t2, round(coalesce(d, {_BIG}), 6) AS d FROM raw, top"


for _name, _f, _sql in (
    ("dist_dice", lambda n: D.dice(n), "CASE WHEN 2*a+b+c > 0 THEN 1 - 2*a/(2*a+b+c) END"),
    ("dist_jaccard_compat", lambda n: D.jaccard(n, compat=True), "CASE WHEN 2*a+b+c > 0 THEN 1 - 2*a/(2*a+b+c) END"),
    ("dist_jaccard", lambda n: D.jaccard(n), "CASE WHEN a+b+c > 0 THEN 1 - a/(a+b+c) END"),
    ("dist_gene_sharing", lambda n: D.gene_sharing(n), "CASE WHEN least(a+b, a+c) > 0 THEN 1 - a/least(a+b, a+c) END"),
    ("dist_upholt", lambda n: D.upholt(n), "CASE WHEN a > 0 THEN -ln(2*a/(2*a+b+c)) END"),
    ("dist_nei_li", lambda n: D.nei_li(n), "CASE WHEN a > 0 AND 4*sqrt(2*a/(2*a+b+c)) > 1 THEN -1.5*ln((4*sqrt(2*a/(2*a+b+c)) - 1)/3) END"),
):
    query(_name, _repaired(_BIN, _sql, "abc"))(lambda spark, sf, f=_f: _out(D.repair(f(_binary(spark, sf)))))


@query("dist_gene_content", _BIN + """, m AS (SELECT avg(n) AS m FROM size), z AS (SELECT t1, t2, (a+b)/m AS ai, (a+c)/m AS aj, a/m AS aij FROM abc, m),
y AS (SELECT *, 0.5*(1+aij-ai-aj + sqrt((1+aij-ai-aj)*(1+aij-ai-aj) + 4*aij*aij)) AS g FROM z) SELECT t1, t2, round(CASE WHEN g < 1e-7 THEN 1.0 ELSE -ln(g) END, 6) AS d FROM y""")
def dist_gene_content(spark, sf):
    return _out(D.gene_content(_binary(spark, sf)))


_DNA = f"""WITH {B.DNA_SQL}, f AS (SELECT p.taxon AS t1, q.taxon AS t2, p.ch AS x, q.ch AS y, CAST(count(*) AS DOUBLE) AS w FROM b2 p JOIN b2 q ON p.site = q.site AND p.taxon < q.taxon GROUP BY ALL),
sh AS (SELECT t1, t2, sum(w) AS n, coalesce(sum(w) FILTER (x <> y), 0) AS mis, coalesce(sum(w) FILTER (x <> y AND x IN ('a','g') AND y IN ('a','g')), 0)/sum(w) AS ag,
  coalesce(sum(w) FILTER (x <> y AND x IN ('c','t') AND y IN ('c','t')), 0)/sum(w) AS ct, coalesce(sum(w) FILTER ((x IN ('a','g')) <> (y IN ('a','g'))), 0)/sum(w) AS q,
  (coalesce(sum(w) FILTER (x = 'a'), 0) + coalesce(sum(w) FILTER (y = 'a'), 0))/(2*sum(w)) AS pa, (coalesce(sum(w) FILTER (x = 'c'), 0) + coalesce(sum(w) FILTER (y = 'c'), 0))/(2*sum(w)) AS pc,
  (coalesce(sum(w) FILTER (x = 'g'), 0) + coalesce(sum(w) FILTER (y = 'g'), 0))/(2*sum(w)) AS pg, (coalesce(sum(w) FILTER (x = 't'), 0) + coalesce(sum(w) FILTER (y = 't'), 0))/(2*sum(w)) AS pt FROM f GROUP BY t1, t2)"""
_TN = """CASE WHEN pa*pc*pg*pt > 0 THEN CASE WHEN 1-(pa+pg)*ag/(2*pa*pg)-q/(2*(pa+pg)) > 0 AND 1-(pc+pt)*ct/(2*pc*pt)-q/(2*(pc+pt)) > 0 AND 1-q/(2*(pa+pg)*(pc+pt)) > 0 THEN
 -(2*pa*pg/(pa+pg))*ln(1-(pa+pg)*ag/(2*pa*pg)-q/(2*(pa+pg))) - (2*pc*pt/(pc+pt))*ln(1-(pc+pt)*ct/(2*pc*pt)-q/(2*(pc+pt)))
 - 2*((pa+pg)*(pc+pt) - pa*pg*(pc+pt)/(pa+pg) - pc*pt*(pa+pg)/(pc+pt))*ln(1-q/(2*(pa+pg)*(pc+pt))) END END"""
# equal base frequencies: A = 1/4, B = 1/8, C = 1/4
_F84 = """CASE WHEN 1-(ag+ct)/0.5-0.125*q/0.125 > 0 AND 1-q/0.5 > 0 THEN -0.5*ln(1-(ag+ct)/0.5-q) - 0.25*ln(1-q/0.5) END"""
for _name, _f, _sql in (
    ("dist_hamming", lambda p: D.hamming(p), "CASE WHEN n > 0 THEN mis END"),
    ("dist_p", lambda p: D.p_distance(p), "CASE WHEN n > 0 THEN mis/n END"),
    ("dist_jukes_cantor", lambda p: D.jukes_cantor(p), "CASE WHEN 1-(mis/n)/0.75 > 0 THEN -0.75*ln(1-(mis/n)/0.75) END"),
    ("dist_kimura2", lambda p: D.kimura2(p), "CASE WHEN 1-2*(ag+ct)-q > 0 AND 1-2*q > 0 THEN -0.5*ln(1-2*(ag+ct)-q) - 0.25*ln(1-2*q) END"),
    ("dist_felsenstein81", lambda p: D.felsenstein81(p, (0.3, 0.2, 0.2, 0.3)), "CASE WHEN 1-(mis/n)/0.74 > 0 THEN -0.74*ln(1-(mis/n)/0.74) END"),
    ("dist_felsenstein84", lambda p: D.felsenstein84(p), _F84),
    ("dist_tamura_nei93", lambda p: D.tamura_nei93(p), _TN),
):
    query(_name, _repaired(_DNA, _sql, "sh"))(lambda spark, sf, f=_f: _out(D.repair(f(_dna_pairs(spark, sf)))))


@query("dist_log_det")
def dist_log_det(spark, sf):
    return _out(D.repair(D.log_det(_dna_pairs(spark, sf))))


@query("dist_base_frequency", f"""WITH {B.DNA_SQL}, s AS (SELECT taxon, avg(CASE WHEN ch='a' THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN ch='c' THEN 1.0 ELSE 0 END) AS c, avg(CASE WHEN ch='g' THEN 1.0 ELSE 0 END) AS g, avg(CASE WHEN ch='t' THEN 1.0 ELSE 0 END) AS t FROM b2 GROUP BY taxon)
SELECT x.taxon AS t1, y.taxon AS t2, round(CAST(abs(x.a-y.a)+abs(x.c-y.c)+abs(x.g-y.g)+abs(x.t-y.t) AS DOUBLE), 6) AS d FROM s x JOIN s y ON x.taxon < y.taxon""")
def dist_base_frequency(spark, sf):
    return _out(D.base_frequency(B.dna(spark, sf)))


@query("dist_from_similarity", f"""WITH {B.LABELS_SQL}, s AS (SELECT t1, t2, 1/(1+d) AS s FROM b3) SELECT t1, t2, round(CASE WHEN s > 0 AND s <= 1 THEN -ln(s) ELSE 1.0 END, 6) AS d FROM s""")
def dist_from_similarity(spark, sf):
    s = B.label_distances(spark, sf).select("t1", "t2", (1 / (1 + F.col("d"))).alias("s"))
    return _out(D.similarity_to_distance(s, "log"))


@query("char_pair_counts", _DNA + " SELECT t1, t2, x AS ca, y AS cb, w FROM f")
def char_pair_counts(spark, sf):
    return _dna_pairs(spark, sf).filter("ca <> '-' and cb <> '-'").select("t1", "t2", "ca", "cb", "w")


@query("char_site_statistics", f"""WITH {B.DNA_SQL}, c AS (SELECT site, ch, count(*) AS c FROM b2 GROUP BY ALL), s AS (SELECT site, count(*) AS seen, sum(c) AS cells, min(c) AS least FROM c GROUP BY site)
SELECT site, CAST(seen + CASE WHEN cells < {NTAX} THEN 1 ELSE 0 END AS INTEGER) AS states, CAST({NTAX} - cells AS BIGINT) AS gaps, seen + CASE WHEN cells < {NTAX} THEN 1 ELSE 0 END = 1 AS constant,
 seen + CASE WHEN cells < {NTAX} THEN 1 ELSE 0 END = 2 AND CASE WHEN cells < {NTAX} THEN least(least, {NTAX} - cells) ELSE least END = 1 AS uninformative FROM s""")
def char_site_statistics(spark, sf):
    return C.site_statistics(B.dna(spark, sf), NTAX).select("site", "states", "gaps", "constant", "uninformative")


@query("char_filter", f"""WITH {B.DNA_SQL}, ok AS (SELECT site FROM b2 GROUP BY site HAVING count(*) = {NTAX} AND count(DISTINCT ch) > 1) SELECT taxon, site, ch FROM b2 JOIN ok USING (site)""")
def char_filter(spark, sf):
    return C.characters_filter(B.dna(spark, sf), NTAX, gap_sites=True, constant=True)


@query("char_tajima_d", _DNA + f""", k AS (SELECT count(*) AS sites, sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS s FROM (SELECT site, count(DISTINCT ch) AS c, count(*) AS n FROM b2 GROUP BY site HAVING n = {NTAX})),
g AS (SELECT site, count(*) AS n FROM b2 GROUP BY site), pi AS (SELECT ((SELECT sum(mis) FROM sh) + (SELECT sum(n * ({NTAX} - n)) FROM g)) / ({NTAX} * ({NTAX} - 1) / 2.0) AS pi),
a AS (SELECT sum(1.0/i) AS a1, sum(1.0/(i*i)) AS a2 FROM (SELECT unnest(generate_series(1, {NTAX - 1})) AS i)),
e AS (SELECT *, ({NTAX}+1)/(3.0*({NTAX}-1)) - 1/a1 AS c1, 2.0*({NTAX}*{NTAX}+{NTAX}+3)/(9.0*{NTAX}*({NTAX}-1)) - ({NTAX}+2)/(a1*{NTAX}) + a2/(a1*a1) AS c2 FROM a)
SELECT CAST(sites AS BIGINT) AS sites, CAST(s AS BIGINT) AS segregating, round(pi, 6) AS pi, round(s/a1, 6) AS watterson, round((pi - s/a1)/sqrt(c1/a1*s + c2/(a1*a1+a2)*s*(s-1)), 6) AS d FROM k, pi, e""")
def char_tajima_d(spark, sf):
    t = C.tajima_d(B.dna(spark, sf), NTAX)
    return t.select("sites", F.col("segregating").cast("bigint"), *(F.round(c, 6).alias(c) for c in ("pi", "watterson", "d")))


_V = ", ".join(f"CASE WHEN sum(CASE WHEN {x} AND {y} THEN 1 ELSE 0 END) > 0 THEN CAST(sum(CASE WHEN {x} THEN 1 ELSE 0 END) AS DOUBLE) * sum(CASE WHEN {y} THEN 1 ELSE 0 END) / sum(CASE WHEN {x} AND {y} THEN 1 ELSE 0 END) / count(*) ELSE 0 END"
               for x, y in (("a.ch <> b.ch", "c.ch <> d.ch"), ("a.ch <> c.ch", "b.ch <> d.ch"), ("a.ch <> d.ch", "b.ch <> c.ch")))


@query("char_v_scores", f"""WITH {B.DNA_SQL}, q AS (SELECT a.taxon AS taxon, b.taxon AS j, c.taxon AS k, d.taxon AS l, least(1.0, greatest(1 - CAST(sum(CASE WHEN a.ch = b.ch AND a.ch = c.ch AND a.ch = d.ch THEN 1 ELSE 0 END) AS DOUBLE) / count(*), {_V})) AS v
FROM b2 a JOIN b2 b ON a.site = b.site AND a.taxon < b.taxon JOIN b2 c ON a.site = c.site AND b.taxon < c.taxon JOIN b2 d ON a.site = d.site AND c.taxon < d.taxon GROUP BY ALL) SELECT taxon, count(*) AS quartets, round(avg(v), 6) AS mean_v FROM q GROUP BY taxon""")
def char_v_scores(spark, sf):
    """Capture-recapture scores of all quartets of the regions' suppliers' patterns: mean over each first taxon."""
    v = C.quartet_v_scores(B.dna(spark, sf))
    return v.groupBy(F.col("t1").alias("taxon")).agg(F.count(F.lit(1)).alias("quartets"), F.round(F.avg("v"), 6).alias("mean_v"))


@query("char_haplotypes", f"""WITH {B.PRESENCE_SQL}, r AS (SELECT taxon, string_agg(site, ',' ORDER BY site) AS h FROM b1 GROUP BY taxon) SELECT taxon, CAST(min(taxon) OVER (PARTITION BY h) AS INTEGER) AS haplotype, count(*) OVER (PARTITION BY h) AS size FROM r""")
def char_haplotypes(spark, sf):
    return C.haplotypes(B.presence(spark, sf).withColumn("ch", F.lit("1")))


# ------------------------------------------------------------------ splits

_FULL = (1 << NTAX) - 1
_SP = f"""WITH {B.DNA_SQL}, n AS (SELECT site, ch, count(*) AS c, bit_or(1::BIGINT << (taxon - 1)) AS m FROM b2 GROUP BY ALL),
maj AS (SELECT site, m FROM n QUALIFY row_number() OVER (PARTITION BY site ORDER BY c DESC, ch) = 1), can AS (SELECT CASE WHEN m & 1 <> 0 THEN {_FULL} - m ELSE m END AS mask FROM maj WHERE m <> {_FULL}),
sp AS (SELECT mask, CAST(count(*) AS DOUBLE) AS weight FROM can GROUP BY mask)"""


def _splits(spark, sf):
    return S.dna_to_splits(B.dna(spark, sf), NTAX)


@query("splits_from_dna", _SP + " SELECT mask, weight FROM sp")
def splits_from_dna(spark, sf):
    return _splits(spark, sf)


@query("splits_from_dna_ry", f"""WITH {B.DNA_SQL}, ry AS (SELECT site, coalesce(bit_or(CASE WHEN ch IN ('a','g') THEN 1::BIGINT << (taxon-1) END), 0) AS r, coalesce(bit_or(CASE WHEN ch IN ('c','t') THEN 1::BIGINT << (taxon-1) END), 0) AS y FROM b2 GROUP BY site),
m AS (SELECT CASE WHEN bit_count(r) <= bit_count(y) THEN r ELSE y END AS m FROM ry) SELECT CASE WHEN m & 1 <> 0 THEN {_FULL} - m ELSE m END AS mask, CAST(count(*) AS DOUBLE) AS weight FROM m WHERE m NOT IN (0, {_FULL}) GROUP BY 1""")
def splits_from_dna_ry(spark, sf):
    return S.dna_to_splits(B.dna(spark, sf), NTAX, "ry")


_BSP = f"""WITH {B.PRESENCE_SQL}, m AS (SELECT site, bit_or(1::BIGINT << (taxon-1)) AS m FROM b1 GROUP BY site), bs AS (SELECT CASE WHEN m & 1 <> 0 THEN {_FULL} - m ELSE m END AS mask, CAST(count(*) AS DOUBLE) AS weight FROM m WHERE m <> {_FULL} GROUP BY 1)"""


@query("splits_from_binary", _BSP + " SELECT mask, weight FROM bs")
def splits_from_binary(spark, sf):
    return S.presence_splits(B.presence(spark, sf), NTAX)


@query("splits_missing_trivial", _SP + f", t AS (SELECT CASE WHEN i = 0 THEN {_FULL} - 1 ELSE 1::BIGINT << i END AS mask FROM (SELECT unnest(generate_series(0, {NTAX - 1}))::INTEGER AS i)) SELECT CAST(mask AS BIGINT) AS mask, CAST(1.0 AS DOUBLE) AS weight FROM t WHERE mask NOT IN (SELECT mask FROM sp)")
def splits_missing_trivial(spark, sf):
    return S.missing_trivial(_splits(spark, sf), NTAX, 1.0)


@query("splits_weight_slider", _SP + f", k AS (SELECT * FROM sp WHERE weight >= 2), t AS (SELECT CASE WHEN i = 0 THEN {_FULL} - 1 ELSE 1::BIGINT << i END AS mask FROM (SELECT unnest(generate_series(0, {NTAX - 1}))::INTEGER AS i)) SELECT mask, weight FROM k UNION ALL SELECT CAST(mask AS BIGINT), CAST(0 AS DOUBLE) FROM t WHERE mask NOT IN (SELECT mask FROM k)")
def splits_weight_slider(spark, sf):
    return S.weight_slider(_splits(spark, sf), NTAX, 2.0)


@query("splits_incompatible", _SP + " SELECT p.mask AS a, q.mask AS b FROM sp p JOIN sp q ON p.mask < q.mask WHERE p.mask & q.mask NOT IN (0, p.mask, q.mask)")
def splits_incompatible(spark, sf):
    return S.incompatible_pairs(_splits(spark, sf), NTAX)


@query("splits_blob_filter", _SP + f", t AS (SELECT CASE WHEN i = 0 THEN {_FULL} - 1 ELSE 1::BIGINT << i END AS mask FROM (SELECT unnest(generate_series(0, {NTAX - 1}))::INTEGER AS i)), k AS (SELECT mask, weight FROM sp UNION ALL SELECT CAST(mask AS BIGINT), CAST(0 AS DOUBLE) FROM t WHERE mask NOT IN (SELECT mask FROM sp)) SELECT mask, weight FROM k p WHERE NOT EXISTS (SELECT 1 FROM k q WHERE p.mask & q.mask NOT IN (0, p.mask, q.mask))")
def splits_blob_filter(spark, sf):
    """Of the splits and all trivial ones."""
    return S.blob_filter(S.weight_slider(_splits(spark, sf), NTAX), NTAX)


_SEP = f", tx AS (SELECT unnest(generate_series(1, {NTAX}))::INTEGER AS t), sd AS (SELECT a.t AS t1, b.t AS t2, sum(weight) AS d FROM sp JOIN tx a ON true JOIN tx b ON a.t < b.t WHERE ((mask >> (a.t-1)) & 1) <> ((mask >> (b.t-1)) & 1) GROUP BY ALL)"


@query("splits_distances", _SP + _SEP + " SELECT t1, t2, round(d, 6) AS d FROM sd")
def splits_distances(spark, sf):
    return _out(S.splits_to_distances(_splits(spark, sf), NTAX))


@query("splits_fit", _SP + _SEP + ", g AS (SELECT p.taxon AS t1, q.taxon AS t2, CAST(count(*) FILTER (p.ch <> q.ch) AS DOUBLE) AS d FROM b2 p JOIN b2 q ON p.site = q.site AND p.taxon < q.taxon GROUP BY ALL) SELECT round(100*(1-sum((s.d-g.d)*(s.d-g.d))/sum(g.d*g.d)), 6) AS least_squares, round(greatest(0.0, 100*(1-sum(abs(s.d-g.d))/sum(g.d))), 6) AS decomposition FROM g JOIN sd s USING (t1, t2)")
def splits_fit(spark, sf):
    f = S.fits(_splits(spark, sf), D.hamming(_dna_pairs(spark, sf)), NTAX)
    return f.select(F.round("least_squares", 6).alias("least_squares"), F.round("decomposition", 6).alias("decomposition"))


@query("splits_diversity", _SP + " SELECT round(sum(CASE WHEN mask & 31 NOT IN (0, 31) THEN weight ELSE 0 END), 6) AS diversity FROM sp")
def splits_diversity(spark, sf):
    return S.phylogenetic_diversity(_splits(spark, sf), [1, 2, 3, 4, 5], NTAX).select(F.round("diversity", 6).alias("diversity"))


@query("splits_shapley", _SP + f", tx AS (SELECT unnest(generate_series(1, {NTAX}))::INTEGER AS t), z AS (SELECT t, weight, CAST(CASE WHEN (mask >> (t-1)) & 1 = 1 THEN bit_count(mask) ELSE {NTAX} - bit_count(mask) END AS DOUBLE) AS near FROM sp, tx) SELECT t AS taxon, round(sum(({NTAX} - near) * weight / ({NTAX} * near)), 6) AS value FROM z GROUP BY t")
def splits_shapley(spark, sf):
    return S.shapley_values(_splits(spark, sf), NTAX).select(F.col("taxon").cast("int"), F.round("value", 6).alias("value"))


@query("splits_taxa_filter", _SP + ", r AS (SELECT mask & 4095 AS m, weight FROM sp), c AS (SELECT CASE WHEN m & 1 <> 0 THEN 4095 - m ELSE m END AS mask, weight FROM r) SELECT CAST(mask AS BIGINT) AS mask, sum(weight) AS weight FROM c WHERE mask <> 0 GROUP BY mask")
def splits_taxa_filter(spark, sf):
    return S.splits_taxa_filter(_splits(spark, sf), list(range(1, 13)), merge=True)


@query("splits_cyclic", _SP + f", tx AS (SELECT unnest(generate_series(1, {NTAX}))::INTEGER AS t) SELECT mask, weight, max(t) FILTER ((mask >> (t-1)) & 1 = 1) - min(t) FILTER ((mask >> (t-1)) & 1 = 1) + 1 = bit_count(mask) AS is_cyclic FROM sp, tx GROUP BY mask, weight")
def splits_cyclic(spark, sf):
    return S.cyclic(_splits(spark, sf), list(range(1, NTAX + 1)))


_GREEDY = _SP.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT mask, weight, row_number() OVER (ORDER BY weight DESC, bit_count(mask) DESC, mask) AS i FROM sp),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS k UNION ALL SELECT o.i, CASE WHEN {ok} THEN list_append(g.k, o.mask) ELSE g.k END FROM g JOIN o ON o.i = g.i + 1),
kept AS (SELECT unnest(k) AS mask FROM g WHERE i = (SELECT max(i) FROM o))"""
_TREE_OK = "len(list_filter(g.k, lambda x: x & o.mask NOT IN (0, x, o.mask))) = 0"
_N = lambda x: f"({_FULL} - {x})"
_ODD = lambda a, b, c: " AND ".join(f"{p} & {q} & {r} <> 0" for p, q, r in ((a, b, c), (a, _N(b), _N(c)), (_N(a), b, _N(c)), (_N(a), _N(b), c)))
_EVEN = lambda a, b, c: " AND ".join(f"{p} & {q} & {r} <> 0" for p, q, r in ((_N(a), _N(b), _N(c)), (_N(a), b, c), (a, _N(b), c), (a, b, _N(c))))
_WEAK_OK = f"len(list_filter(g.k, lambda x: len(list_filter(g.k, lambda y: y > x AND (({_ODD('x', 'y', 'o.mask')}) OR ({_EVEN('x', 'y', 'o.mask')})))) > 0)) = 0"


@query("splits_greedy_compatible", _GREEDY.replace("{ok}", _TREE_OK) + " SELECT mask, weight FROM sp WHERE mask IN (SELECT mask FROM kept)")
def splits_greedy_compatible(spark, sf):
    return S.greedy_compatible(_splits(spark, sf), NTAX)


@query("splits_greedy_weakly_compatible", _GREEDY.replace("{ok}", _WEAK_OK) + " SELECT mask, weight FROM sp WHERE mask IN (SELECT mask FROM kept)")
def splits_greedy_weakly_compatible(spark, sf):
    return S.greedy_weakly_compatible(_splits(spark, sf), NTAX)


@query("splits_greedy_circular")
def splits_greedy_circular(spark, sf):
    return S.greedy_circular(_splits(spark, sf), NTAX)


@query("splits_dimension_filter")
def splits_dimension_filter(spark, sf):
    return S.dimension_filter(_splits(spark, sf), NTAX)


@query("splits_incompatibility_score", _GREEDY.replace("{ok}", _TREE_OK) + f", i AS (SELECT * FROM sp WHERE bit_count(mask) BETWEEN 2 AND {NTAX - 2}), s AS (SELECT coalesce(sum(weight), 0.0) AS score FROM i WHERE mask NOT IN (SELECT mask FROM kept)) SELECT score, round(100 * score / (SELECT sum(weight) FROM i), 6) AS percent FROM s")
def splits_incompatibility_score(spark, sf):
    return S.incompatibility_score(_splits(spark, sf), NTAX).select("score", F.round("percent", 6).alias("percent"))


query("splits_clique_compatible")(lambda spark, sf: S.clique_compatible(_splits(spark, sf).filter("bit_count(mask) between 2 and 23"), NTAX))
query("splits_cycle")(lambda spark, sf: S.splits_cycle(_splits(spark, sf), NTAX))


@query("splits_matrix", f"""WITH {B.CLUSTERS_SQL}, ts AS (SELECT tree_id, CASE WHEN mask & 1 <> 0 THEN {_FULL} - mask ELSE mask END AS mask, sum(weight) AS weight FROM b5 WHERE mask <> {_FULL} GROUP BY ALL)
SELECT m.mask AS mask, t.tree_id AS set_id, round(coalesce(ts.weight, 0), 6) AS weight FROM (SELECT DISTINCT mask FROM ts) m JOIN (SELECT DISTINCT tree_id FROM ts) t ON true LEFT JOIN ts ON ts.mask = m.mask AND ts.tree_id = t.tree_id""")
def splits_matrix(spark, sf):
    return S.split_matrix(T.tree_splits(B.clusters(spark, sf), NTAX).withColumnRenamed("tree_id", "set_id")).select("mask", "set_id", F.round("weight", 6).alias("weight"))


# ------------------------------------------------------------------ trees

_TR = f"""WITH {B.CLUSTERS_SQL}, ts AS (SELECT tree_id, CASE WHEN mask & 1 <> 0 THEN {_FULL} - mask ELSE mask END AS mask, sum(weight) AS weight FROM b5 WHERE mask <> {_FULL} GROUP BY ALL), nt AS (SELECT count(DISTINCT tree_id) AS n FROM b5)"""


@query("trees_clusters", f"WITH {B.CLUSTERS_SQL} SELECT tree_id, mask, weight FROM b5")
def trees_clusters(spark, sf):
    return B.clusters(spark, sf)


@query("trees_splits", _TR + " SELECT tree_id, mask, round(weight, 6) AS weight FROM ts")
def trees_splits(spark, sf):
    return T.tree_splits(B.clusters(spark, sf), NTAX).select("tree_id", "mask", F.round("weight", 6).alias("weight"))


for _name, _t, _stat, _sql in (
    ("trees_consensus_majority", 50.0, "mean", "avg(weight)"), ("trees_consensus_strict", 99.999999, "mean", "avg(weight)"), ("trees_consensus_network", 8.0, "count", "CAST(count(*) AS DOUBLE)"),
    ("trees_consensus_median", 8.0, "median", "list_sort(list(weight))[count(*) // 2 + 1]"), ("trees_consensus_sum", 8.0, "sum", "sum(weight)"),
):
    _q = _TR + f", g AS (SELECT mask, count(*) AS n, {_sql} AS weight FROM ts GROUP BY mask) SELECT mask, g.n AS n, round(100.0 * g.n / nt.n, 6) AS confidence, round(weight, 6) AS weight FROM g, nt WHERE 100.0 * g.n / nt.n > {_t}"
    query(_name, _q)(lambda spark, sf, t=_t, s=_stat: T.consensus_splits(B.clusters(spark, sf), NTAX, t, s).select("mask", "n", F.round("confidence", 6).alias("confidence"), F.round("weight", 6).alias("weight")))


@query("trees_consensus_tree_size", _TR + ", z AS (SELECT *, sum(weight) OVER (PARTITION BY tree_id) AS t FROM ts), g AS (SELECT mask, count(*) AS n, avg(CASE WHEN t > 0 THEN weight / t ELSE 0 END) AS weight FROM z GROUP BY mask) SELECT mask, g.n AS n, round(weight, 9) AS weight FROM g, nt WHERE 100.0 * g.n / nt.n > 8")
def trees_consensus_tree_size(spark, sf):
    return T.consensus_splits(B.clusters(spark, sf), NTAX, 8.0, "tree_size_mean").select("mask", "n", F.round("weight", 9).alias("weight"))


@query("trees_rooted_consensus", f"WITH {B.CLUSTERS_SQL}, nt AS (SELECT count(DISTINCT tree_id) AS t FROM b5), g AS (SELECT mask, count(*) AS n, avg(weight) AS weight FROM b5 GROUP BY mask) SELECT mask, n, round(weight, 6) AS weight FROM g, nt WHERE 2 * n > t")
def trees_rooted_consensus(spark, sf):
    return T.consensus_clusters(B.clusters(spark, sf)).select("mask", "n", F.round("weight", 6).alias("weight"))


@query("trees_cluster_network", f"WITH {B.CLUSTERS_SQL}, nt AS (SELECT count(DISTINCT tree_id) AS t FROM b5), c AS (SELECT mask FROM b5, nt GROUP BY mask, t HAVING count(*) > 0.04 * t) SELECT p.mask AS parent, q.mask AS child FROM c p JOIN c q ON p.mask & q.mask = q.mask AND p.mask <> q.mask WHERE NOT EXISTS (SELECT 1 FROM c r WHERE r.mask NOT IN (p.mask, q.mask) AND r.mask & q.mask = q.mask AND r.mask & p.mask = r.mask)")
def trees_cluster_network(spark, sf):
    return T.hasse_covers(T.consensus_clusters(B.clusters(spark, sf), 4.0)).select("parent", "child")


@query("trees_robinson_foulds", _TR + ", s AS (SELECT tree_id, count(*) AS n FROM ts GROUP BY tree_id), c AS (SELECT p.tree_id AS t1, q.tree_id AS t2, count(*) AS c FROM ts p JOIN ts q ON p.mask = q.mask AND p.tree_id < q.tree_id GROUP BY ALL) SELECT a.tree_id AS t1, b.tree_id AS t2, CAST(a.n + b.n - 2 * coalesce(c, 0) AS DOUBLE) AS d FROM s a JOIN s b ON a.tree_id < b.tree_id LEFT JOIN c ON a.tree_id = t1 AND b.tree_id = t2")
def trees_robinson_foulds(spark, sf):
    return _out(T.robinson_foulds(B.clusters(spark, sf), NTAX))


@query("trees_average_distances", _TR + f", tx AS (SELECT unnest(generate_series(1, {NTAX}))::INTEGER AS t) SELECT a.t AS t1, b.t AS t2, round(sum(weight) / max(nt.n), 6) AS d FROM ts, nt, tx a, tx b WHERE a.t < b.t AND ((mask >> (a.t-1)) & 1) <> ((mask >> (b.t-1)) & 1) GROUP BY ALL")
def trees_average_distances(spark, sf):
    return _out(T.average_distances(B.clusters(spark, sf), NTAX))


@query("trees_fair_proportions", f"WITH {B.CLUSTERS_SQL}, tx AS (SELECT unnest(generate_series(1, {NTAX}))::INTEGER AS t) SELECT tree_id, t AS taxon, round(sum(weight / bit_count(mask)), 6) AS value FROM b5, tx WHERE (mask >> (t-1)) & 1 = 1 GROUP BY ALL")
def trees_fair_proportions(spark, sf):
    return T.fair_proportions(B.clusters(spark, sf), NTAX).select("tree_id", F.col("taxon").cast("int"), F.round("value", 6).alias("value"))


@query("trees_equal_splits", f"""WITH {B.CLUSTERS_SQL}, tx AS (SELECT unnest(generate_series(1, {NTAX}))::INTEGER AS t),
par AS (SELECT c.tree_id, c.mask, arg_min(p.mask, bit_count(p.mask)) AS up FROM b5 c JOIN b5 p ON p.tree_id = c.tree_id AND p.mask & c.mask = c.mask AND p.mask <> c.mask GROUP BY ALL),
deg AS (SELECT tree_id, up, count(*) AS k FROM par GROUP BY ALL), fac AS (SELECT b5.tree_id, b5.mask, b5.weight, coalesce(ln(k), 0) AS l FROM b5 LEFT JOIN par ON par.tree_id = b5.tree_id AND par.mask = b5.mask LEFT JOIN deg ON deg.tree_id = par.tree_id AND deg.up = par.up)
SELECT a.tree_id, t AS taxon, round(sum(a.weight * exp(-coalesce((SELECT sum(d.l) FROM fac d WHERE d.tree_id = a.tree_id AND d.mask & a.mask = d.mask AND d.mask <> a.mask AND (d.mask >> (t-1)) & 1 = 1), 0))), 10) AS value FROM fac a, tx WHERE (a.mask >> (t-1)) & 1 = 1 GROUP BY ALL""")
def trees_equal_splits(spark, sf):
    return T.equal_splits(B.clusters(spark, sf), NTAX).select("tree_id", F.col("taxon").cast("int"), F.round("value", 10).alias("value"))


@query("trees_diversity", f"WITH {B.CLUSTERS_SQL} SELECT tree_id, round(sum(CASE WHEN mask & 31 NOT IN (0, 31) THEN weight ELSE 0 END), 6) AS diversity FROM b5 GROUP BY tree_id")
def trees_diversity(spark, sf):
    return T.tree_diversity(B.clusters(spark, sf), [1, 2, 3, 4, 5], rooted=False).select("tree_id", F.round("diversity", 6).alias("diversity"))


@query("trees_unique_topologies", f"WITH {B.CLUSTERS_SQL}, s AS (SELECT tree_id, list_sort(list(DISTINCT mask)) AS s FROM b5 WHERE mask <> {_FULL} GROUP BY tree_id) SELECT min(tree_id) AS tree_id, count(*) AS n FROM s GROUP BY s")
def trees_unique_topologies(spark, sf):
    return T.unique_topologies(B.clusters(spark, sf), NTAX)


@query("trees_statistics", f"WITH {B.CLUSTERS_SQL} SELECT tree_id, CAST(bit_count(bit_or(mask)) AS INTEGER) AS n_taxa, count(*) AS n_edges, round(sum(weight), 6) AS length FROM b5 GROUP BY tree_id")
def trees_statistics(spark, sf):
    return T.tree_statistics(B.clusters(spark, sf)).select("tree_id", "n_taxa", "n_edges", F.round("length", 6).alias("length"))


@query("trees_edges_filter", f"WITH {B.CLUSTERS_SQL}, k AS (SELECT * FROM b5 WHERE weight >= 25 OR bit_count(mask) = 1), t AS (SELECT *, sum(weight) FILTER (weight > 0) OVER (PARTITION BY tree_id) AS s FROM k) SELECT tree_id, mask, round(CASE WHEN s > 0 THEN weight * 100 / s ELSE weight END, 6) AS weight FROM t")
def trees_edges_filter(spark, sf):
    return T.edges_filter(B.clusters(spark, sf), min_length=25.0, rescale=True).select("tree_id", "mask", F.round("weight", 6).alias("weight"))


@query("trees_filter", f"WITH {B.CLUSTERS_SQL}, ok AS (SELECT tree_id FROM b5 GROUP BY tree_id HAVING sum(weight) >= 900) SELECT tree_id, mask, weight FROM b5 JOIN ok USING (tree_id)")
def trees_filter(spark, sf):
    return T.trees_filter(B.clusters(spark, sf), 1, 900.0)


@query("trees_selector", f"WITH {B.CLUSTERS_SQL} SELECT tree_id, mask, weight FROM b5 WHERE tree_id = 3")
def trees_selector(spark, sf):
    return T.tree_selector(B.clusters(spark, sf), 3)


@query("trees_conflicts", f"WITH {B.CLUSTERS_SQL}, m AS (SELECT DISTINCT mask FROM b5) SELECT m.mask AS mask, count(DISTINCT b5.tree_id) AS n_conflicting FROM m LEFT JOIN b5 ON m.mask & b5.mask NOT IN (0, m.mask, b5.mask) GROUP BY m.mask")
def trees_conflicts(spark, sf):
    return T.conflicts(B.clusters(spark, sf))


@query("trees_concordance_filter", f"WITH {B.CLUSTERS_SQL}, m AS (SELECT DISTINCT mask FROM b5), n AS (SELECT m.mask AS mask, count(DISTINCT b5.tree_id) AS k FROM m LEFT JOIN b5 ON m.mask & b5.mask NOT IN (0, m.mask, b5.mask) GROUP BY m.mask), t AS (SELECT count(DISTINCT tree_id) AS t FROM b5) SELECT tree_id, mask, weight FROM b5, t WHERE bit_count(mask) = 1 OR mask NOT IN (SELECT mask FROM n, t WHERE k >= greatest(floor(t * 0.5), 1))")
def trees_concordance_filter(spark, sf):
    return T.concordance_filter(B.clusters(spark, sf), 50.0)


@query("trees_confidence_network", _TR + """, ce AS (SELECT m.mask AS mask, t.tree_id AS tree_id, coalesce(ts.weight, 0) AS x FROM (SELECT DISTINCT mask FROM ts) m JOIN (SELECT DISTINCT tree_id FROM ts) t ON true LEFT JOIN ts ON ts.mask = m.mask AND ts.tree_id = t.tree_id),
me AS (SELECT mask, quantile_cont(x, 0.5) AS med FROM ce GROUP BY mask), r AS (SELECT mask, tree_id, med, abs(x - med) AS r FROM ce JOIN me USING (mask)), h AS (SELECT *, count(*) OVER (PARTITION BY mask ORDER BY r RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h, row_number() OVER (PARTITION BY mask ORDER BY r) AS k FROM r),
cut AS (SELECT list_sort(list(h))[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS cut FROM (SELECT tree_id, max(h) AS h FROM h GROUP BY tree_id))
SELECT mask, round(med, 6) AS weight, round(med - r, 6) AS low, round(med + r, 6) AS high FROM h, cut WHERE k = cut AND med + r > 0""")
def trees_confidence_network(spark, sf):
    return T.confidence_network(B.clusters(spark, sf), NTAX).select("mask", *(F.round(c, 6).alias(c) for c in ("weight", "low", "high")))


@query("trees_transfer_support", _TR + f", e AS (SELECT mask AS e FROM ts WHERE tree_id = 1 AND bit_count(mask) BETWEEN 2 AND {NTAX - 2}), d AS (SELECT e, tree_id, CAST(min(least(bit_count(xor(e, mask)), {NTAX} - bit_count(xor(e, mask)))) AS DOUBLE) AS d FROM e, ts GROUP BY ALL) SELECT e AS mask, round(avg(greatest(0.0, 1 - d / (least(bit_count(e), {NTAX} - bit_count(e)) - 1))), 6) AS support FROM d GROUP BY e")
def trees_transfer_support(spark, sf):
    return T.transfer_support(B.clusters(spark, sf), NTAX).select("mask", F.round("support", 6).alias("support"))


@query("trees_rooted_triples", f"WITH {B.CLUSTERS_SQL}, tx AS (SELECT unnest(generate_series(1, {NTAX}))::INTEGER AS t), i AS (SELECT DISTINCT tree_id, x.t AS a, y.t AS b, z.t AS c FROM b5, tx x, tx y, tx z WHERE x.t < y.t AND (mask >> (x.t-1)) & 1 = 1 AND (mask >> (y.t-1)) & 1 = 1 AND (mask >> (z.t-1)) & 1 = 0) SELECT a, b, c, count(*) AS n FROM i GROUP BY ALL")
def trees_rooted_triples(spark, sf):
    return T.rooted_triples(B.clusters(spark, sf), NTAX)


_MOVED = f"""WITH {B.CLUSTERS_SQL}, c AS (SELECT tree_id, mask FROM b5 UNION SELECT tree_id + 100, CASE WHEN mask IN (1, {_FULL}) THEN mask ELSE mask & {_FULL - 1} END FROM b5), s AS (SELECT tree_id, list_sort(list(mask)) AS x FROM c GROUP BY tree_id),
p AS (SELECT a.tree_id AS t1, b.tree_id AS t2, a.x AS x, b.x AS y, unnest(list_intersect(a.x, b.x)) AS cut FROM s a JOIN s b ON a.tree_id < b.tree_id AND a.x <> b.x),
l AS (SELECT t1, t2, list_sort(list_distinct(list_filter(list_transform(x, lambda m: m & ({_FULL} - cut)), lambda m: m <> 0))) AS x, list_sort(list_distinct(list_filter(list_transform(y, lambda m: m & ({_FULL} - cut)), lambda m: m <> 0))) AS y FROM p)
SELECT DISTINCT t1, t2 FROM l WHERE x = y"""


@query("trees_one_spr_pairs", _MOVED)
def trees_one_spr_pairs(spark, sf):
    """Among the trees and copies of them in which taxon 1 is moved below the root."""
    c = B.clusters(spark, sf)
    full = S.full_mask(NTAX)
    away = F.when(F.col("mask").isin(1, full), F.col("mask")).otherwise(F.col("mask").bitwiseAND(F.lit(full - 1)))
    moved = c.select((F.col("tree_id") + 100).alias("tree_id"), away.alias("mask"), "weight")
    return T.one_spr_pairs(c.unionByName(moved).dropDuplicates(["tree_id", "mask"]), NTAX)


# ------------------------------------------------------------------ distances

_LAB = f"WITH {B.LABELS_SQL}"


@query("dist_labels", _LAB + " SELECT t1, t2, d FROM b3")
def dist_labels(spark, sf):
    return B.label_distances(spark, sf)


_Q = ", qt AS (SELECT ab.t1 AS a, ab.t2 AS b, ac.t2 AS c, ad.t2 AS e, list_sort([ab.d + ce.d, ac.d + be.d, ad.d + bc.d]) AS s FROM b3 ab JOIN b3 ac ON ac.t1 = ab.t1 AND ac.t2 > ab.t2 JOIN b3 ad ON ad.t1 = ab.t1 AND ad.t2 > ac.t2 JOIN b3 bc ON bc.t1 = ab.t2 AND bc.t2 = ac.t2 JOIN b3 be ON be.t1 = ab.t2 AND be.t2 = ad.t2 JOIN b3 ce ON ce.t1 = ac.t2 AND ce.t2 = ad.t2)"


@query("dist_delta_scores", _LAB + _Q + ", v AS (SELECT unnest([a, b, c, e]) AS taxon, CASE WHEN s[3] - s[1] > 1e-7 THEN (s[3]-s[2])/(s[3]-s[1]) ELSE 0 END AS delta, (s[3]-s[2])*(s[3]-s[2]) AS q FROM qt) SELECT taxon, round(avg(delta), 6) AS delta, round(avg(q) / (SELECT avg(d)*avg(d) FROM b3), 6) AS q FROM v GROUP BY taxon")
def dist_delta_scores(spark, sf):
    return M.delta_scores(B.label_distances(spark, sf)).select("taxon", F.round("delta", 6).alias("delta"), F.round("q", 6).alias("q"))


@query("dist_four_point", _LAB + _Q + " SELECT count(*) AS quartets, count(*) FILTER (s[3] - s[2] > 1e-7) AS violated FROM qt")
def dist_four_point(spark, sf):
    return M.four_point_violations(B.label_distances(spark, sf))


@query("dist_centred", _LAB + ", y AS (SELECT t1, t2, d*d AS x FROM b3 UNION ALL SELECT t2, t1, d*d FROM b3 UNION ALL SELECT DISTINCT taxon, taxon, 0.0 FROM b3m), r AS (SELECT t1, avg(x) AS r FROM y GROUP BY t1) SELECT y.t1 AS t1, y.t2 AS t2, round(-0.5*(x - p.r - q.r + (SELECT avg(x) FROM y)), 6) AS b FROM y JOIN r p ON p.t1 = y.t1 JOIN r q ON q.t1 = y.t2")
def dist_centred(spark, sf):
    return M.centred(B.label_distances(spark, sf)).select("t1", "t2", F.round("b", 6).alias("b"))


@query("dist_min_spanning_network", _LAB + """, e AS (SELECT t1, t2, d FROM b3), v AS (SELECT DISTINCT d AS t FROM b3), st AS (SELECT min(taxon) AS s, count(DISTINCT taxon) AS n FROM b3m),
ok AS (SELECT min(t) AS t FROM v WHERE (SELECT count(*) FROM (WITH RECURSIVE w AS (SELECT s AS x FROM st UNION SELECT CASE WHEN e.t1 = w.x THEN e.t2 ELSE e.t1 END FROM w JOIN e ON (e.t1 = w.x OR e.t2 = w.x) AND e.d <= v.t) SELECT x FROM w)) = (SELECT n FROM st)) SELECT t1, t2, d FROM b3, ok WHERE d <= t""".replace("b3, ok", "b3, ok"))
def dist_min_spanning_network(spark, sf):
    return M.min_spanning_network(B.label_distances(spark, sf))


for _name, _f in (
    ("dist_min_spanning_rooted", M.min_spanning_rooted), ("dist_upgma", M.upgma), ("dist_neighbor_joining", M.neighbor_joining), ("dist_bionj", lambda d: M.neighbor_joining(d, bio=True)), ("dist_neighbor_net", M.neighbor_net),
    ("dist_neighbor_net_cycle", M.neighbor_net_cycle), ("dist_pcoa", M.pcoa),
):
    query(_name)(lambda spark, sf, f=_f: f(B.label_distances(spark, sf)))


@query("dist_min_spanning_tree", _LAB + " SELECT e.t1 AS t1, e.t2 AS t2, e.d AS d FROM b3 e WHERE e.t2 NOT IN (WITH RECURSIVE w AS (SELECT e.t1 AS x UNION SELECT CASE WHEN f.t1 = w.x THEN f.t2 ELSE f.t1 END FROM w JOIN b3 f ON (f.t1 = w.x OR f.t2 = w.x) AND f.d < e.d) SELECT x FROM w)")
def dist_min_spanning_tree(spark, sf):
    return M.min_spanning_tree(B.label_distances(spark, sf))


# the isolation indices of all splits of the labels, by their quartets
_ISO = _LAB + """, tx AS (SELECT DISTINCT taxon AS t FROM b3m), dd AS (SELECT t1 AS a, t2 AS b, d FROM b3 UNION ALL SELECT t2, t1, d FROM b3 UNION ALL SELECT t, t, 0.0 FROM tx),
q AS (SELECT p.a AS i, p.b AS j, q.a AS k, q.b AS l, ({pick}(ik.d + jl.d, il.d + jk.d) - p.d - q.d) / 2 AS v FROM dd p JOIN dd q ON p.a <= p.b AND q.a <= q.b JOIN dd ik ON ik.a = p.a AND ik.b = q.a JOIN dd jl ON jl.a = p.b AND jl.b = q.b JOIN dd il ON il.a = p.a AND il.b = q.b JOIN dd jk ON jk.a = p.b AND jk.b = q.a),
m AS (SELECT unnest(range(1, 1::BIGINT << ((SELECT count(*) FROM tx) - 1))) * 2 AS mask) SELECT mask, round(min(v), 6) AS weight FROM m JOIN q ON (mask >> (i - 1)) & 1 = 1 AND (mask >> (j - 1)) & 1 = 1 AND (mask >> (k - 1)) & 1 = 0 AND (mask >> (l - 1)) & 1 = 0 GROUP BY mask HAVING min(v) > 1e-7"""


@query("dist_split_decomposition", _ISO.replace("{pick}", "greatest"))
def dist_split_decomposition(spark, sf):
    return M.split_decomposition(B.label_distances(spark, sf)).select("mask", F.round("weight", 6).alias("weight"))


@query("dist_buneman", _ISO.replace("{pick}", "least"))
def dist_buneman(spark, sf):
    return M.buneman_tree(B.label_distances(spark, sf)).select("mask", F.round("weight", 6).alias("weight"))


def _net_and_cycle(spark, sf):
    d = B.label_distances(spark, sf)
    return M.neighbor_net(d), [r.taxon for r in M.neighbor_net_cycle(d).orderBy("position").collect()]


@query("splits_clique_circular")
def splits_clique_circular(spark, sf):
    """The heaviest tree within the neighbor-net of the labels."""
    net, cycle = _net_and_cycle(spark, sf)
    return S.clique_circular(net, len(cycle), cycle)


@query("splits_clique_agree", "SELECT true AS same")
def splits_clique_agree(spark, sf):
    """The heaviest compatible splits of circular splits are the same by the program over intervals and by branch and bound."""
    net, cycle = _net_and_cycle(spark, sf)
    total = lambda x: x.agg(F.round(F.sum("weight"), 6)).scalar()
    return spark.range(1).select((total(S.clique_circular(net, len(cycle), cycle)) == total(S.clique_compatible(net, len(cycle)))).alias("same"))


@query("dist_check", _LAB + " SELECT count(*) AS pairs, CAST(0 AS BIGINT) AS shorter, CAST(0 AS BIGINT) AS without_path FROM b3")
def dist_check(spark, sf):
    """No path of the minimum spanning network is shorter than the distance of its ends, as these meet the triangle inequality."""
    d = B.label_distances(spark, sf)
    e = M.min_spanning_network(d).select(F.col("t1").alias("src"), F.col("t2").alias("dst"), F.col("d").alias("weight"))
    x = M.check_distances(e, d, list(range(1, 11)))
    none = F.lit(0).cast("bigint")
    return x.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum(F.when(F.col("difference") < -1e-5, 1)), none).alias("shorter"), F.coalesce(F.sum(F.when(F.col("path").isNull(), 1)), none).alias("without_path"))


# ------------------------------------------------------------------ sketches

_SRC = "regexp_replace(lower(trim(source)), '[\\s\\-]+', '_', 'g')"


@query("sketch_mash", f"""WITH g AS (SELECT {_SRC} AS genome, lower(text) AS seq FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
k AS (SELECT DISTINCT genome, md5(substr(seq, i, 15)) AS h FROM (SELECT genome, seq, unnest(generate_series(1, CAST(length(seq) AS BIGINT) - 14)) AS i FROM g WHERE length(seq) >= 15)),
s AS (SELECT genome, h FROM k QUALIFY row_number() OVER (PARTITION BY genome ORDER BY h) <= 500), a AS (SELECT genome, list(h) AS x FROM s GROUP BY genome),
p AS (SELECT u.genome AS g1, v.genome AS g2, list_sort(list_distinct(list_concat(u.x, v.x)))[1:500] AS m, list_intersect(u.x, v.x) AS c FROM a u JOIN a v ON u.genome < v.genome),
j AS (SELECT g1, g2, CAST(len(list_intersect(m, c)) AS INTEGER) AS shared, len(m) AS used FROM p)
SELECT g1, g2, shared, round(CASE WHEN shared > 0 THEN greatest(0.0, -ln(2.0 * shared / used / (1 + 1.0 * shared / used)) / 15) ELSE 1.0 END, 6) AS d FROM j""")
def sketch_mash(spark, sf):
    docs = B.table(spark, sf, "documents").filter("source is not null and text is not null")
    g = docs.select(F.regexp_replace(F.lower(F.trim("source")), r"[\s\-]+", "_").alias("genome"), F.lower("text").alias("seq"))
    return K.mash_distances(g, 15, 500).select("g1", "g2", "shared", F.round("d", 6).alias("d"))


@query("sketch_bloom_statistics", """WITH b AS (SELECT taxon_id AS id, CAST(length(bloom_filter) * 4 AS INTEGER) AS bits, CAST(list_sum(list_transform(string_split(lower(bloom_filter), ''), lambda x: bit_count(CAST(instr('0123456789abcdef', x) - 1 AS INTEGER)))) AS INTEGER) AS ones FROM bloom_filters WHERE length(bloom_filter) > 0)
SELECT id, bits, ones, round(CASE WHEN ones < bits THEN -bits / 7.0 * ln(1 - 1.0 * ones / bits) END, 6) AS estimate FROM b""")
def sketch_bloom_statistics(spark, sf):
    return K.bloom_statistics(B.table(spark, sf, "bloom_filters"), "taxon_id", "bloom_filter").select("id", "bits", F.col("ones").cast("int"), F.round("estimate", 6).alias("estimate"))


# ------------------------------------------------------------------ models, bootstrap, networks

query("dist_hky85")(lambda spark, sf: _out(D.repair(D.hky85(_dna_pairs(spark, sf)))))
query("dist_gtr")(lambda spark, sf: _out(D.repair(D.gtr(_dna_pairs(spark, sf)))))
query("char_phi_test")(lambda spark, sf: C.phi_test(B.dna(spark, sf)))

REPS = 20
_BOOT = f"""WITH {B.PRESENCE_SQL}, m AS (SELECT site, bit_or(1::BIGINT << (taxon-1)) AS m FROM b1 GROUP BY site), no AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS no FROM m), n AS (SELECT count(*) AS n FROM m),
d AS (SELECT rep, CAST('0x' || substr(md5('42:' || rep || ':' || no), 1, 7) AS BIGINT) % n AS no FROM no, n, (SELECT unnest(generate_series(1, {REPS})) AS rep) r),
s AS (SELECT rep, site, count(*) AS times FROM d JOIN no USING (no) GROUP BY ALL)"""


def _site_masks(spark, sf):
    p = B.presence(spark, sf)
    return p.groupBy("site").agg(F.bit_or(S.bit(F.col("taxon"))).alias("m"))


@query("bootstrap_draws", _BOOT + " SELECT CAST(rep AS INTEGER) AS rep, site, times FROM s")
def bootstrap_draws(spark, sf):
    return Z.draws(_site_masks(spark, sf).select("site"), REPS)


@query("bootstrap_splits", _BOOT + f", w AS (SELECT rep, CASE WHEN m & 1 <> 0 THEN {_FULL} - m ELSE m END AS mask, sum(times) AS w FROM s JOIN m USING (site) WHERE m <> {_FULL} GROUP BY ALL), g AS (SELECT mask, count(*) AS n, avg(w) AS weight FROM w GROUP BY mask) SELECT mask, n, round(100.0 * n / {REPS}, 6) AS confidence, round(weight, 6) AS weight FROM g WHERE 100.0 * n / {REPS} >= 10")
def bootstrap_splits(spark, sf):
    m = stage(_site_masks(spark, sf), "masks")
    masks = m.filter(F.col("m") != S.full_mask(NTAX)).select("site", S.canonical(F.col("m"), NTAX).alias("mask"))
    return Z.split_support(masks, Z.draws(m.select("site"), REPS), REPS, 10.0).select("mask", "n", F.round("confidence", 6).alias("confidence"), F.round("weight", 6).alias("weight"))


@query("bootstrap_nj_support")
def bootstrap_nj_support(spark, sf):
    """Support of the neighbor-joining tree of the P-distances, over replicates that each run distances and tree in their own group."""
    from cladeworks.functions import kernels

    p = B.dna(spark, sf)
    a, b = p.select(F.col("taxon").alias("t1"), "site", F.col("ch").alias("x")), p.select(F.col("taxon").alias("t2"), "site", F.col("ch").alias("y"))
    pairs = a.join(b, "site").filter("t1 < t2").select("site", "t1", "t2", (F.col("x") != F.col("y")).alias("differ"))
    d = Z.replicate_distances(pairs, Z.draws(p.select("site").distinct(), REPS))
    run = lambda m, t: M._split_rows(kernels.tree_splits(kernels.neighbor_joining(m), len(t)), t)
    reps = M._apply(d, ("rep",), M.SPLITS, run).select("rep", "mask")
    own = M._apply(D.p_distance(C.pair_counts(p)), (), M.SPLITS, run)
    return Z.tree_support(reps, own, REPS)


@query("bootstrap_pipeline", f"SELECT CAST({REPS} AS BIGINT) AS replicates, CAST({NTAX} AS BIGINT) AS certain_trivial, true AS in_range")
def bootstrap_pipeline(spark, sf):
    """Jukes-Cantor distances and BioNJ trees of every replicate: all have the trivial splits, and supports are percentages."""
    p = B.dna(spark, sf)
    reps = stage(Z.bootstrap_pipeline(p, Z.draws(p.select("site").distinct(), REPS), D.jukes_cantor, M.tree_splits_of, method="bionj"), "replicates")
    s = Z.bootstrap_tree_splits(reps, REPS)
    n = F.bit_count("mask")
    x = s.agg(F.sum(F.when(n.isin(1, NTAX - 1) & (F.col("n") == REPS), 1).otherwise(0)).cast("bigint").alias("certain_trivial"), (F.max("confidence") <= 100).alias("in_range"))
    return x.withColumn("replicates", reps.agg(F.count_distinct("rep")).scalar()).select("replicates", "certain_trivial", "in_range")


# a tree of clusters ``k`` (mask, weight): node t - 1 is the leaf of taxon t, inner nodes follow by size and mask, parents are the next larger sets
_EDGES = f""", sets AS (SELECT mask FROM k UNION SELECT 1::BIGINT << i FROM (SELECT unnest(generate_series(0, {NTAX - 1}))::INTEGER AS i) UNION SELECT CAST({_FULL} AS BIGINT)), no AS (SELECT mask, row_number() OVER (ORDER BY bit_count(mask), mask) - 1 AS i FROM sets),
id AS (SELECT mask, i, CASE WHEN bit_count(mask) = 1 THEN bit_count(mask - 1) ELSE {NTAX} + i END AS v FROM no), up AS (SELECT c.mask AS mask, min(p.i) AS i FROM id c JOIN id p ON p.i > c.i AND p.mask & c.mask = c.mask GROUP BY c.mask)
SELECT 1 AS net_id, CAST(p.v AS INTEGER) AS parent, CAST(c.v AS INTEGER) AS child, round(coalesce(k.weight, 0), 6) AS weight, CAST(CASE WHEN bit_count(c.mask) = 1 THEN c.v + 1 END AS INTEGER) AS taxon FROM up JOIN id c ON c.mask = up.mask JOIN id p ON p.i = up.i LEFT JOIN k ON k.mask = c.mask"""


def _edge_rows(t):
    return t.select("net_id", "parent", "child", F.round("weight", 6).alias("weight"), "taxon")


@query("trees_consensus_tree", f"WITH {B.CLUSTERS_SQL}, nt AS (SELECT count(DISTINCT tree_id) AS t FROM b5), k AS (SELECT mask, avg(weight) AS weight FROM b5, nt GROUP BY mask, t HAVING 2 * count(*) > t)" + _EDGES)
def trees_consensus_tree(spark, sf):
    return _edge_rows(W.cluster_tree(T.consensus_clusters(B.clusters(spark, sf)), NTAX))


@query("trees_greedy_consensus_tree", _TR.replace("WITH ", "WITH RECURSIVE ", 1) + f""", sp AS (SELECT mask, CAST(count(*) AS DOUBLE) AS weight FROM ts GROUP BY mask), o AS (SELECT mask, row_number() OVER (ORDER BY weight DESC, bit_count(mask) DESC, mask) AS i FROM sp),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS k UNION ALL SELECT o.i, CASE WHEN {_TREE_OK} THEN list_append(g.k, o.mask) ELSE g.k END FROM g JOIN o ON o.i = g.i + 1),
k AS (SELECT mask, weight FROM sp WHERE mask IN (SELECT unnest(k) FROM g WHERE i = (SELECT max(i) FROM o)))""" + _EDGES)
def trees_greedy_consensus_tree(spark, sf):
    return _edge_rows(W.cluster_tree(S.greedy_compatible(T.consensus_splits(B.clusters(spark, sf), NTAX, 0.0, "count"), NTAX), NTAX))


@query("trees_average_consensus")
def trees_average_consensus(spark, sf):
    return M.neighbor_net(T.average_distances(B.clusters(spark, sf), NTAX))


@query("trees_super_network")
def trees_super_network(spark, sf):
    """Partial splits: each tree restricted to the taxa whose number is not congruent to the tree's modulo 5."""
    c = B.clusters(spark, sf)
    taxa = sum(1 << k for k in range(NTAX))
    drop = F.element_at(F.array(*(F.lit(taxa & ~sum(1 << k for k in range(NTAX) if k % 5 == r)).cast("bigint") for r in range(5))), F.pmod("tree_id", F.lit(5)) + 1)
    a = F.col("mask").bitwiseAND(drop)
    parts = c.select("tree_id", a.alias("a"), drop.bitwiseAND(F.bitwise_not("mask")).alias("b")).filter("bit_count(a) > 1 and bit_count(b) > 1").distinct()
    return W.super_network(parts, NTAX)


@query("network_stretch_filter")
def network_stretch_filter(spark, sf):
    d = B.label_distances(spark, sf).select(F.col("t1").alias("src"), F.col("t2").alias("dst"), F.col("d").alias("weight"))
    return W.stretch_filter(d, list(range(1, 11)), 10.0)


@query("network_path_distances", _LAB.replace("WITH ", "WITH RECURSIVE ", 1) + """, hop AS (SELECT t1 AS a, t2 AS b, d FROM b3 UNION ALL SELECT t2, t1, d FROM b3), top AS (SELECT max(d) AS t FROM b3 e WHERE e.t2 NOT IN (WITH RECURSIVE w AS (SELECT e.t1 AS x UNION SELECT CASE WHEN f.t1 = w.x THEN f.t2 ELSE f.t1 END FROM w JOIN b3 f ON (f.t1 = w.x OR f.t2 = w.x) AND f.d < e.d) SELECT x FROM w)),
p AS (SELECT a AS s, b AS x, d, [a, b] AS seen FROM hop, top WHERE d <= t UNION ALL SELECT p.s, h.b, p.d + h.d, list_append(p.seen, h.b) FROM p JOIN hop h ON h.a = p.x, top WHERE h.d <= t AND NOT list_contains(p.seen, h.b)) SELECT s AS t1, x AS t2, round(min(d), 6) AS d FROM p WHERE s < x GROUP BY ALL""")
def network_path_distances(spark, sf):
    d = M.min_spanning_network(B.label_distances(spark, sf)).select(F.col("t1").alias("src"), F.col("t2").alias("dst"), F.col("d").alias("weight"))
    return M.path_distances(d, list(range(1, 11))).select("t1", "t2", F.round("d", 6).alias("d"))


_HIGH = """h AS (SELECT CAST(c_nationkey + 1 AS INTEGER) AS taxon, quarter(l_shipdate) || l_returnflag AS site, sum(l_quantity) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
c AS (SELECT taxon, site, CASE WHEN s > avg(s) OVER (PARTITION BY site) THEN '1' ELSE '0' END AS ch FROM h)"""


def _high(spark, sf):
    """Two states: a nation's quantity in a quarter and return flag above the mean or not."""
    site = F.concat(F.quarter("l_shipdate").cast("string"), F.col("l_returnflag")).alias("site")
    q = B._by_customer_nation(spark, sf).groupBy("taxon", site).agg(F.sum("l_quantity").alias("s"))
    return q.withColumn("m", F.avg("s").over(Window.partitionBy("site"))).select("taxon", "site", (F.col("s") > F.col("m")).cast("int").cast("string").alias("ch"))


@query("char_haplotype_groups", f"""WITH RECURSIVE {_HIGH}, p AS (SELECT a.taxon AS x, b.taxon AS y FROM c a JOIN c b USING (site) WHERE a.taxon <> b.taxon GROUP BY ALL HAVING count(*) FILTER (a.ch <> b.ch) = 0),
r AS (SELECT DISTINCT taxon AS origin, taxon AS node FROM c UNION SELECT origin, y FROM r JOIN p ON x = node), g AS (SELECT origin AS taxon, min(node) AS haplotype FROM r GROUP BY origin) SELECT taxon, haplotype, count(*) OVER (PARTITION BY haplotype) AS size FROM g""")
def char_haplotype_groups(spark, sf):
    return C.haplotype_groups(_high(spark, sf))


@query("trees_consensus_tree_majority", _TR + ", g AS (SELECT mask, avg(weight) AS weight FROM ts GROUP BY mask HAVING 2 * count(*) > (SELECT n FROM nt)) SELECT mask, round(weight, 6) AS weight FROM g")
def trees_consensus_tree_majority(spark, sf):
    """The majority consensus of the unrooted trees as a tree, and its splits."""
    t = W.tree_clusters(W.consensus_tree(B.clusters(spark, sf), NTAX), NTAX)
    return T.tree_splits(t, NTAX).select("mask", F.round("weight", 6).alias("weight"))


@query("trees_support", _TR + f", g AS (SELECT mask, 100.0 * count(*) / max(n) AS confidence FROM ts, nt GROUP BY mask) SELECT count(*) AS n_leaves, min(confidence) AS least FROM g WHERE bit_count(mask) IN (1, {NTAX - 1})")
def trees_support(spark, sf):
    """Leaf edges of the majority tree with the confidence of their splits."""
    c = B.clusters(spark, sf)
    t = W.with_support(W.consensus_tree(c, NTAX), T.consensus_splits(c, NTAX, 0.0), NTAX)
    return t.filter("taxon is not null").agg(F.count(F.lit(1)).alias("n_leaves"), F.min("confidence").alias("least"))


@query("trees_selected_splits", _TR + " SELECT mask, round(weight, 6) AS weight FROM ts WHERE tree_id = 3")
def trees_selected_splits(spark, sf):
    return T.selected_splits(B.clusters(spark, sf), NTAX, 3).select("mask", F.round("weight", 6).alias("weight"))


@query("trees_shapley", _TR + f", tx AS (SELECT unnest(generate_series(1, {NTAX}))::INTEGER AS t), z AS (SELECT t, weight, CAST(CASE WHEN (mask >> (t-1)) & 1 = 1 THEN bit_count(mask) ELSE {NTAX} - bit_count(mask) END AS DOUBLE) AS near FROM ts, tx WHERE tree_id = 3) SELECT t AS taxon, round(sum(({NTAX} - near) * weight / ({NTAX} * near)), 6) AS value FROM z GROUP BY t")
def trees_shapley(spark, sf):
    return T.tree_shapley(B.clusters(spark, sf), NTAX, 3).select(F.col("taxon").cast("int"), F.round("value", 6).alias("value"))


@query("char_codon_filter", f"""WITH {B.DNA_SQL}, o AS (SELECT site, row_number() OVER (ORDER BY site) AS no FROM (SELECT DISTINCT site FROM b2)) SELECT taxon, site, ch FROM b2 JOIN o USING (site) WHERE no % 3 <> 0 AND site NOT LIKE '1992%'""")
def char_codon_filter(spark, sf):
    """Without every third site, and without a list of disabled ones."""
    from cladeworks.operators.numbering import numbered

    d = B.dna(spark, sf)
    no = numbered(d.select("site").distinct(), "site").select("site", (F.col("no") + 1).alias("number"))
    off = d.filter("site like '1992%'").select("site").distinct()
    return C.characters_filter(d.join(no, "site"), NTAX, codon_positions=(3,), site_number="number", disabled=off).select("taxon", "site", "ch")


query("trees_sample")(lambda spark, sf: T.sample_trees(B.clusters(spark, sf), 5))
query("trees_consensus_outline")(lambda spark, sf: T.consensus_outline(B.clusters(spark, sf), NTAX))
query("trees_triple_contraction")(lambda spark, sf: T.triple_contraction(B.clusters(spark, sf), NTAX))
query("layout_outline")(lambda spark, sf: W.outline(M.neighbor_net(B.label_distances(spark, sf)), [r.taxon for r in M.neighbor_net_cycle(B.label_distances(spark, sf)).orderBy("position").collect()]))


@query("network_median_joining")
def network_median_joining(spark, sf):
    """Nations' presence in the order quarters of the whole period, as two-state sequences."""
    q = B._by_customer_nation(spark, sf).groupBy("taxon", F.quarter("l_shipdate").alias("q"), "l_returnflag").agg(F.sum("l_quantity").alias("s"))
    high = q.withColumn("hi", (F.col("s") > F.avg("s").over(Window.partitionBy("q", "l_returnflag"))).cast("int"))
    rows = high.groupBy("taxon").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q", "l_returnflag", "hi"))), lambda x: x["hi"].cast("string")), "").alias("seq"))
    return W.median_joining(rows)


@query("char_parsimony_splits")
def char_parsimony_splits(spark, sf):
    rows = B.dna(spark, sf)
    full = C.site_patterns(rows).select(F.posexplode("pattern").alias("i", "ch"), "pattern", "w").select((F.col("i") + 1).alias("taxon"), F.array_join("pattern", "").alias("p"), F.repeat("ch", F.col("w").cast("int")).alias("ch"))
    return W.parsimony_splits(full.groupBy("taxon").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "ch"))), lambda x: x["ch"]), "").alias("seq")))


# ------------------------------------------------------------------ search in the sketch database

MASH_K, MAX_DISTANCE, TOP = 21, 0.03, 25


def _sketch_search(spark, sf):
    rows = B.table(spark, sf, "mash_sketches").filter("taxon_id is not null and mash_sketch is not null")
    ref = rows.select(F.col("taxon_id").alias("id"), K.hex_tokens(F.col("mash_sketch")).alias("tokens")).filter(F.size("tokens") > 0).dropDuplicates(["id"])
    return K.search(ref, ref.filter("id % 20 = 0"), MASH_K, MAX_DISTANCE, TOP)


_SEARCH = f"""WITH clean AS (SELECT DISTINCT taxon_id, regexp_replace(lower(mash_sketch), '[^0-9a-f]', '', 'g') AS h FROM mash_sketches WHERE taxon_id IS NOT NULL),
vals AS (SELECT DISTINCT taxon_id, substr(h, i, 16) AS v FROM (SELECT taxon_id, h, unnest(generate_series(1, CAST(length(h) AS BIGINT), 16)) AS i FROM clean WHERE h <> '')),
sizes AS (SELECT taxon_id, count(*) AS n FROM vals GROUP BY taxon_id),
pairs AS (SELECT a.taxon_id AS query, b.taxon_id AS id, count(*) AS c FROM vals a JOIN vals b ON a.v = b.v AND a.taxon_id <> b.taxon_id WHERE a.taxon_id % 20 = 0 GROUP BY ALL),
found AS (SELECT query, id, CAST(c AS DOUBLE) / (a.n + b.n - c) AS jaccard FROM pairs JOIN sizes a ON a.taxon_id = query JOIN sizes b ON b.taxon_id = id),
near AS (SELECT *, greatest(0.0, -ln(2 * jaccard / (1 + jaccard)) / {MASH_K}) AS d FROM found), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(d, 12), id) AS rank FROM near WHERE d <= {MAX_DISTANCE} + 1e-12)"""


@query("sketch_search", _SEARCH + f" SELECT query, CAST(rank AS INTEGER) AS rank, id, round(jaccard, 6) AS jaccard, round(d, 6) AS d FROM ranked WHERE rank <= {TOP}")
def sketch_search(spark, sf):
    return _sketch_search(spark, sf).select("query", "rank", "id", F.round("jaccard", 6).alias("jaccard"), F.round("d", 6).alias("d"))


@query("sketch_context", f"""WITH RECURSIVE in_force AS (SELECT taxon_id AS node, CASE WHEN parent_id <> 0 THEN parent_id END AS parent FROM taxa WHERE taxon_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY taxon_id ORDER BY loaded_at DESC NULLS LAST, parent_id DESC NULLS LAST) = 1),
links AS (SELECT a.node, b.node AS parent FROM in_force a LEFT JOIN in_force b ON a.parent = b.node), walk AS (SELECT node, [node] AS path FROM links WHERE parent IS NULL UNION ALL SELECT l.node, list_append(w.path, l.node) FROM walk w JOIN links l ON l.parent = w.node),
{_SEARCH.removeprefix("WITH ")}, met AS (SELECT query, path FROM ranked JOIN walk ON node = id WHERE rank <= {TOP}), n AS (SELECT query, count(*) AS n FROM met GROUP BY query),
c AS (SELECT query, i, x, count(*) AS k FROM (SELECT query, unnest(path) AS x, generate_subscripts(path, 1) AS i FROM met) GROUP BY ALL), low AS (SELECT query, arg_max(x, i) AS ancestor FROM c JOIN n USING (query) WHERE k = n GROUP BY query)
SELECT CAST(query AS INTEGER) AS query, n, CAST(ancestor AS BIGINT) AS ancestor FROM n LEFT JOIN low USING (query)""")
def sketch_context(spark, sf):
    """Lowest common ancestor of each query's matches in the taxonomy."""
    return K.lowest_common(_sketch_search(spark, sf), H.build_hierarchy(H.in_force(B.table(spark, sf, "taxa"))))


# ------------------------------------------------------------------ filters, refinement, layouts


@query("dist_taxa_filter", _LAB + " SELECT t1, t2, d FROM b3 WHERE t1 <= 6 AND t2 <= 6")
def dist_taxa_filter(spark, sf):
    d = B.label_distances(spark, sf)
    keep = d.select(F.explode(F.array("t1", "t2")).alias("taxon")).distinct().filter("taxon <= 6")
    return C.taxa_filter(d, keep, "t1", "t2").select("t1", "t2", "d")


@query("trees_taxa_filter", f"WITH {B.CLUSTERS_SQL} SELECT tree_id, mask & 4095 AS mask, round(sum(weight), 6) AS weight FROM b5 WHERE mask & 4095 NOT IN (0, 4095) GROUP BY ALL")
def trees_taxa_filter(spark, sf):
    return T.taxa_filter(B.clusters(spark, sf), list(range(1, 13))).select("tree_id", "mask", F.round("weight", 6).alias("weight"))


@query("trees_mutual_refinement", f"""WITH {B.CLUSTERS_SQL}, m AS (SELECT DISTINCT mask FROM b5), t AS (SELECT DISTINCT tree_id FROM b5),
k AS (SELECT tree_id, mask FROM m, t WHERE NOT EXISTS (SELECT 1 FROM b5 WHERE b5.tree_id = t.tree_id AND (b5.mask = m.mask OR b5.mask & m.mask NOT IN (0, b5.mask, m.mask))))
SELECT tree_id, mask, weight FROM b5 UNION ALL SELECT tree_id, mask, CAST(0 AS DOUBLE) FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.tree_id = k.tree_id AND o.mask & k.mask NOT IN (0, o.mask, k.mask))""")
def trees_mutual_refinement(spark, sf):
    return T.mutual_refinement(B.clusters(spark, sf))


@query("trees_triple_symmetry", f"""WITH {B.CLUSTERS_SQL}, tx AS (SELECT unnest(generate_series(1, {NTAX}))::INTEGER AS t), i AS (SELECT DISTINCT tree_id, x.t AS a, y.t AS b, z.t AS c FROM b5, tx x, tx y, tx z WHERE x.t < y.t AND (mask >> (x.t-1)) & 1 = 1 AND (mask >> (y.t-1)) & 1 = 1 AND (mask >> (z.t-1)) & 1 = 0),
s AS (SELECT list_sort([a, b, c]) AS s, c FROM i), g AS (SELECT s[1] AS a, s[2] AS b, s[3] AS c, count(*) FILTER (c = s[3]) AS n1, count(*) FILTER (c = s[2]) AS n2, count(*) FILTER (c = s[1]) AS n3 FROM s GROUP BY s),
o AS (SELECT *, list_sort([n1, n2, n3]) AS o, n1 + n2 + n3 AS t FROM g) SELECT a, b, c, n1, n2, n3, t >= 10 AND (o[3] - 0.5 - t / 3) / sqrt(t * 2 / 9) > 1.6448536269514722 AS resolved,
t >= 10 AND CASE WHEN o[1] + o[2] > 0 THEN (abs(o[2] - (o[1] + o[2]) / 2) - 0.5) / sqrt((o[1] + o[2]) / 4) ELSE 0 END > 1.959963984540054 AS asymmetric FROM o""")
def trees_triple_symmetry(spark, sf):
    return T.triple_symmetry(B.clusters(spark, sf), NTAX)


@query("layout_consensus_tree")
def layout_consensus_tree(spark, sf):
    return W.layouts(W.cluster_tree(T.consensus_clusters(B.clusters(spark, sf)), NTAX), "radial")


@query("layout_equal_angle", _BSP + f""", c AS (SELECT mask, weight, min(t) AS lo, max(t) AS hi FROM (SELECT mask, weight, unnest(generate_series(0, {NTAX - 1}))::INTEGER AS t FROM bs) WHERE (mask >> t) & 1 = 1 GROUP BY ALL),
p AS (SELECT t + 1 AS taxon, weight, pi() * (lo + hi + 1) / {NTAX} AS a FROM (SELECT *, unnest(generate_series(0, {NTAX - 1}))::INTEGER AS t FROM c) WHERE (mask >> t) & 1 = 1) SELECT taxon, round(sum(weight * cos(a)), 4) AS x, round(sum(weight * sin(a)), 4) AS y FROM p GROUP BY taxon""")
def layout_equal_angle(spark, sf):
    s = S.presence_splits(B.presence(spark, sf), NTAX)
    return W.equal_angle(s, list(range(1, NTAX + 1))).select("taxon", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
