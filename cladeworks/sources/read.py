"""Readers: files to DataFrames. Each file is parsed in one task; FastA and Newick files are cut into records and spread."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.sources import parse as P


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _per_file(spark: SparkSession, path: str, schema: str, parse: Callable[[str], list[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for p in batches:
            rows = [(f, *r) for f, t in zip(p.path, p.text) for r in parse(t)]
            yield pd.DataFrame(rows, columns=["path", *names])

    return whole_files(spark, path).mapInPandas(run, f"path string, {schema}")


_ALIGNED = {"clustal": P.clustal, "stockholm": P.stockholm, "msf": P.msf, "phylip": P.phylip_sequences, "fasta": P.fasta, "nexus": lambda t: P.nexus_characters(t)[0]}


def characters(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """``path, taxon, name, seq`` of aligned sequences; without a format it is told from each file's first line."""

    def parse(text):
        kind = format or P.sniff(text)
        if kind not in _ALIGNED:
            raise P.FormatError(f"no aligned sequences: {kind}")
        rows = _ALIGNED[kind](text)
        if len({len(s) for _, s in rows}) > 1:
            raise P.FormatError("sequences of different lengths")
        return [(i + 1, n, s) for i, (n, s) in enumerate(rows)]

    return _per_file(spark, path, "taxon int, name string, seq string", parse)


def fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq`` of FastA records, aligned or not, read as splits of large files at the record mark."""
    raw = spark.read.text(path, lineSep=">").filter(F.length(F.trim("value")) > 0)
    head = F.substring_index("value", "\n", 1)
    return raw.select(F.trim(F.regexp_replace(head, "\r", "")).alias("name"), F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "").alias("seq"))


def distances(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """``path, name1, name2, d``."""
    kinds = {"phylip_distances": P.phylip_distances, "csv_distances": P.csv_distances, "nexus": P.nexus_distances}
    return _per_file(spark, path, "name1 string, name2 string, d double", lambda t: kinds[format or P.sniff(t)](t))


def trees(spark: SparkSession, path: str) -> DataFrame:
    """``path, tree_no, name, newick`` of Newick (one or more trees a line) and Nexus tree files."""

    def parse(text):
        if P.sniff(text) == "nexus":
            return [(i + 1, n, t) for i, (n, t) in enumerate(P.nexus_trees(text))]
        parts = [x.strip() for x in text.replace("\n", " ").split(";") if x.strip()]
        return [(i + 1, f"tree-{i + 1}", x + ";") for i, x in enumerate(parts)]

    return _per_file(spark, path, "tree_no int, name string, newick string", parse)


def tree_edges(trees: DataFrame) -> DataFrame:
    """``path, tree_no, parent, child, weight, label, reticulate`` of ``path, tree_no, newick``."""

    def run(batches):
        for p in batches:
            rows = [(f, n, *e) for f, n, t in zip(p.path, p.tree_no, p.newick) for e in P.newick(t)]
            yield pd.DataFrame(rows, columns=["path", "tree_no", "parent", "child", "weight", "label", "reticulate"])

    return trees.select("path", "tree_no", "newick").mapInPandas(run, "path string, tree_no int, parent int, child int, weight double, label string, reticulate boolean")


def nexml_trees(spark: SparkSession, path: str) -> DataFrame:
    """``path, tree, source, target, length`` of the edges of NeXML trees and networks."""
    import xml.etree.ElementTree as ET

    def parse(text):
        out = []
        for t in ET.fromstring(text).iter():
            if t.tag.rpartition("}")[2] in ("tree", "network"):
                out += [(t.get("id"), e.get("source"), e.get("target"), float(e.get("length")) if e.get("length") else None) for e in t if e.tag.rpartition("}")[2] == "edge"]
        return out

    return _per_file(spark, path, "tree string, source string, target string, length double", parse)


def splits(spark: SparkSession, path: str) -> DataFrame:
    """``path, split_id, side ARRAY<INT>, weight, confidence`` of Nexus splits."""
    return _per_file(spark, path, "split_id int, side array<int>, weight double, confidence double", lambda t: [(i + 1, *s) for i, s in enumerate(P.nexus_splits(t)[0])])


def taxa(spark: SparkSession, path: str) -> DataFrame:
    """``path, taxon, name, info, display_label`` of Nexus taxa blocks."""
    return _per_file(spark, path, "taxon int, name string, info string, display_label string", lambda t: [(i + 1, *d) for i, d in enumerate(P.nexus_taxa_details(t))])


def sites(spark: SparkSession, path: str) -> DataFrame:
    """``path, site, w, label, states ARRAY<STRING>`` of Nexus characters blocks: weights and labels of sites."""
    return _per_file(spark, path, "site int, w double, label string, states array<string>", P.nexus_sites)


def split_properties(spark: SparkSession, path: str) -> DataFrame:
    """``path, fit, compatibility, threshold, cycle ARRAY<INT>``."""
    return _per_file(spark, path, "fit double, compatibility string, threshold double, cycle array<int>", lambda t: [p] if (p := P.nexus_split_properties(t)) else [])


def tree_properties(spark: SparkSession, path: str) -> DataFrame:
    """``path, partial, rooted, reticulated``."""
    return _per_file(spark, path, "partial boolean, rooted boolean, reticulated boolean", lambda t: [p] if (p := P.nexus_tree_properties(t)) else [])


def trait_details(spark: SparkSession, path: str) -> DataFrame:
    """``path, trait, latitude, longitude, color``."""
    return _per_file(spark, path, "trait string, latitude double, longitude double, color string", P.nexus_trait_details)


def traits(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, "name string, trait string, value string", P.nexus_traits)


def sets(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, "kind string, name string, member string", P.nexus_sets)


def network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``path, id, label`` and edges ``path, src, dst, weight`` of GML files and Nexus network blocks."""

    def both(text):
        if P.sniff(text) == "nexus":
            nodes, edges = P.nexus_network(text)
            return [n[:2] for n in nodes], [e[:3] for e in edges]
        return P.gml(text)

    return _per_file(spark, path, "id int, label string", lambda t: both(t)[0]), _per_file(spark, path, "src int, dst int, weight double", lambda t: both(t)[1])


def genomes(spark: SparkSession, path: str) -> DataFrame:
    """``path, taxon, name, accession, length, parts ARRAY<STRUCT<file, offset, length, seq>>`` of Nexus genomes blocks, one row per genome.

    One task a file cuts its lines into rows of the matrix as they come, so a file need not fit memory; the rows are parsed in parallel.
    """

    def cut(batches):
        chunks = ((f, "\n".join(p.value[i:j]) + "\n") for p in batches for f, i, j in _runs(p.path))
        for f, own in groupby(chunks, lambda x: x[0]):
            rows = ((f, *r) for r in P.nexus_genome_rows(c for _, c in own))
            while some := list(islice(rows, 10_000)):
                yield pd.DataFrame(some, columns=["path", "no", "label", "labels", "accessions", "multipart", "text"])

    def parse(batches):
        for p in batches:
            rows = []
            for f, i, *r in p.itertuples(index=False):
                n, a, k, parts = P.nexus_genome(*r)
                rows.append((f, i + 1, n, a, k, [{"file": x, "offset": o, "length": m, "seq": s} for x, o, m, s in parts]))
            yield pd.DataFrame(rows, columns=["path", "taxon", "name", "accession", "length", "parts"])

    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    ordered = lines.repartition("path").sortWithinPartitions("path", "block", "at").select("path", "value")
    rows = ordered.mapInPandas(cut, "path string, no int, label string, labels boolean, accessions boolean, multipart boolean, text string").repartition("path", "no")
    return rows.mapInPandas(parse, "path string, taxon int, name string, accession string, length int, parts array<struct<file: string, offset: bigint, length: int, seq: string>>")


def _runs(keys: pd.Series) -> list[tuple[str, int, int]]:
    """(key, start, end) of each run of equal keys."""
    starts = [i for i, new in enumerate(keys.ne(keys.shift())) if new]
    return [(keys.iloc[i], i, j) for i, j in zip(starts, [*starts[1:], len(keys)])]


def split_newick(spark: SparkSession, path: str) -> DataFrame:
    """``path, split_id, side ARRAY<STRING> (labels), weight``."""

    def parse(text):
        leaves, splits = P.split_newick(text)
        return [(i + 1, [leaves[k] for k in side], w) for i, (side, w) in enumerate(splits)]

    return _per_file(spark, path, "split_id int, side array<string>, weight double", parse)


def fasta_split(spark: SparkSession, path: str, out: str, min_length: int = 0) -> None:
    """Writes each record of FastA files into a folder of its own below ``out`` (``name=...``), in parallel; short records are left out."""
    rows = fasta_records(spark, path).filter(F.length("seq") >= min_length)
    key = F.regexp_replace(F.substring_index("name", " ", 1), "[^A-Za-z0-9._-]", "_").alias("name")
    rows.select(key, F.concat(F.lit(">"), F.col("name"), F.lit("\n"), "seq").alias("value")).write.mode("overwrite").partitionBy("name").text(out)


def long_characters(chars: DataFrame) -> DataFrame:
    """``taxon, site, ch`` of rows with ``taxon, seq``; sites from 1."""
    return chars.select("taxon", F.posexplode(F.split("seq", "")).alias("i", "ch")).filter("ch <> ''").select("taxon", (F.col("i") + 1).alias("site"), "ch")
