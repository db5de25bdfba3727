"""Writers: DataFrames to text in public formats. Row formats are lazy columns ``value``; block formats are one text per group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.functions import kernels
from cladeworks.functions.bits import bits, taxa_of


def fasta(chars: DataFrame) -> DataFrame:
    """One ``value`` per sequence of ``name, seq``; write with ``.write.text``."""
    return chars.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))


def plain_characters(chars: DataFrame) -> DataFrame:
    return chars.select(F.concat_ws("\t", "name", "seq").alias("value"))


def plain_distances(d: DataFrame) -> DataFrame:
    return d.select(F.concat_ws("\t", F.col("name1"), F.col("name2"), F.col("d").cast("string")).alias("value"))


def _one(df: DataFrame, make) -> DataFrame:
    """One text of a whole block, which has to fit one task as the file has to."""
    return df.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda p: pd.DataFrame({"value": [make(p)]}), "value string")


def phylip_sequences(chars: DataFrame) -> DataFrame:
    def make(p):
        p = p.sort_values("taxon")
        return f"{len(p)} {len(p.seq.iloc[0])}\n" + "\n".join(f"{n} {s}" for n, s in zip(p.name_, p.seq))

    return _one(chars.select("taxon", F.col("name").alias("name_"), "seq"), make)


def clustal(chars: DataFrame, width: int = 60) -> DataFrame:
    def make(p):
        p = p.sort_values("taxon")
        pad = max(map(len, p.name_)) + 4
        n = len(p.seq.iloc[0])
        blocks = ["\n".join(f"{a:<{pad}}{s[i : i + width]}" for a, s in zip(p.name_, p.seq)) for i in range(0, n, width)]
        return "CLUSTAL multiple sequence alignment\n\n" + "\n\n".join(blocks) + "\n"

    return _one(chars.select("taxon", F.col("name").alias("name_"), "seq"), make)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'" if not x.replace("_", "a").replace(".", "a").isalnum() else x


def nexus_characters(chars: DataFrame, data_type: str = "DNA", gap: str = "-", missing: str = "?") -> DataFrame:
    def make(p):
        p = p.sort_values("taxon")
        names = [_quoted(x) for x in p.name_]
        rows = "\n".join(f"{a} {s}" for a, s in zip(names, p.seq))
        return (
            f"#NEXUS\nBEGIN TAXA;\nDIMENSIONS NTAX={len(p)};\nTAXLABELS {' '.join(names)};\nEND;\nBEGIN CHARACTERS;\nDIMENSIONS NCHAR={len(p.seq.iloc[0])};\n"
            f"FORMAT DATATYPE={data_type} MISSING={missing} GAP={gap} LABELS=LEFT;\nMATRIX\n{rows}\n;\nEND;\n"
        )

    return _one(chars.select("taxon", F.col("name").alias("name_"), "seq"), make)


def _matrix(p: pd.DataFrame):
    m, taxa = kernels.to_matrix(p.name1, p.name2, p.d)
    return taxa, m


def phylip_distances(d: DataFrame) -> DataFrame:
    def make(p):
        taxa, m = _matrix(p)
        return f"{len(taxa)}\n" + "\n".join(f"{t} " + " ".join(f"{x:.10g}" for x in row) for t, row in zip(taxa, m))

    return _one(d.select("name1", "name2", "d"), make)


def nexus_distances(d: DataFrame) -> DataFrame:
    def make(p):
        taxa, m = _matrix(p)
        names = [_quoted(t) for t in taxa]
        rows = "\n".join(f"{t} " + " ".join(f"{x:.10g}" for x in row) for t, row in zip(names, m))
        return f"#NEXUS\nBEGIN TAXA;\nDIMENSIONS NTAX={len(taxa)};\nTAXLABELS {' '.join(names)};\nEND;\nBEGIN DISTANCES;\nDIMENSIONS NTAX={len(taxa)};\nFORMAT LABELS=LEFT DIAGONAL TRIANGLE=BOTH;\nMATRIX\n{rows}\n;\nEND;\n"

    return _one(d.select("name1", "name2", "d"), make)


def splits_fasta(splits: DataFrame, names: list[str]) -> DataFrame:
    """Splits as 0/1 sequences, one ``value`` per taxon, sites by ascending mask."""
    on = F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("i")
    bit = bits(len(names)).has(F.col("mask"), F.col("i") + 1).cast("int").cast("string")
    x = splits.select("mask", on).groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mask", bit.alias("b")))), lambda s: s["b"]), "").alias("seq"))
    return x.select(F.concat(F.lit(">"), F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1), F.lit("\n"), "seq").alias("value"))


def nexus_splits(splits: DataFrame, names: list[str], cycle: list[int] | None = None, fit: float | None = None, compatibility: str | None = None) -> DataFrame:
    """A splits block of ``mask, weight``, with properties and cycle where they are given."""
    head = f"PROPERTIES{'' if fit is None else f' FIT={fit:.10g}'}{'' if compatibility is None else f' {compatibility}'};\n" if fit is not None or compatibility else ""
    head += f"CYCLE {' '.join(map(str, cycle))};\n" if cycle else ""

    def make(p):
        rows = []
        for k, (m, w) in enumerate(sorted(zip(map(bits(len(names)).to_int, p["mask"]), p.weight.tolist())), 1):
            side = [i + 1 for i in range(len(names)) if m >> i & 1]
            rows.append(f"[{k}, size={len(side)}]\t{w:.10g}\t{' '.join(map(str, side))},")
        return f"#NEXUS\nBEGIN TAXA;\nDIMENSIONS NTAX={len(names)};\nTAXLABELS {' '.join(map(_quoted, names))};\nEND;\nBEGIN SPLITS;\nDIMENSIONS NTAX={len(names)} NSPLITS={len(rows)};\n{head}MATRIX\n" + "\n".join(rows) + "\n;\nEND;\n"

    return _one(splits.select("mask", "weight"), make)


def newick(edges: DataFrame, key: str = "tree_no") -> DataFrame:
    """``key, value``: the Newick text of each tree of ``key, parent, child, weight, label``."""

    def make(p):
        names = {int(c): x for c, x in zip(p.child, p.label) if isinstance(x, str)}
        e = [(int(a), int(b), float(w) if w == w else 0.0) for a, b, w in zip(p.parent, p.child, p.weight) if a >= 0]
        return pd.DataFrame({key: [p[key].iloc[0]], "value": [kernels.newick(e, names)]})

    return edges.select(key, "parent", "child", "weight", "label").groupBy(key).applyInPandas(make, f"{key} int, value string")


def gml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One text of a network ``id, label`` and ``src, dst, weight``."""
    n = nodes.select(F.concat(F.lit("  node [ id "), F.col("id").cast("string"), F.lit(' label "'), F.coalesce("label", F.lit("")), F.lit('" ]')).alias("x"), F.lit(0).alias("k"), F.col("id").alias("i"), F.lit(0).alias("j"))
    e = edges.select(F.concat(F.lit("  edge [ source "), F.col("src").cast("string"), F.lit(" target "), F.col("dst").cast("string"), F.lit(" weight "), F.col("weight").cast("string"), F.lit(" ]")).alias("x"), F.lit(1).alias("k"), F.col("src").alias("i"), F.col("dst").alias("j"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "i", "j", "x"))), lambda s: s["x"]), "\n")
    return n.unionByName(e).agg(F.concat(F.lit("graph [\n  directed 0\n"), lines, F.lit("\n]\n")).alias("value"))


# ---------------------------------------------------------------- one row a line: lazy columns, ordered by the caller


def plain_splits(splits: DataFrame, ntax: int) -> DataFrame:
    """``value``: weight and the taxa of the side without taxon 1."""
    taxa = F.array_join(F.transform(taxa_of(bits(ntax), F.col("mask"), ntax), lambda t: t.cast("string")), " ")
    return splits.select(F.concat_ws("\t", F.col("weight").cast("string"), taxa).alias("value"))


def plain_taxa(taxa: DataFrame) -> DataFrame:
    return taxa.select(F.concat_ws("\t", F.col("taxon").cast("string"), "name").alias("value"))


def plain_traits(traits: DataFrame) -> DataFrame:
    return traits.select(F.concat_ws("\t", "name", "trait", "value").alias("value"))


def plain_sets(sets: DataFrame) -> DataFrame:
    """One line a set of ``kind, name, member``."""
    g = sets.groupBy("kind", "name").agg(F.array_join(F.array_sort(F.collect_set("member")), " ").alias("m"))
    return g.select(F.concat_ws("\t", "kind", "name", "m").alias("value"))


def plain_network(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string")).alias("value"))


# ---------------------------------------------------------------- Nexus blocks


def _taxa_block(names) -> str:
    return f"BEGIN TAXA;\nDIMENSIONS NTAX={len(names)};\nTAXLABELS {' '.join(map(_quoted, names))};\nEND;\n"


def nexus_taxa(taxa: DataFrame) -> DataFrame:
    """A taxa block of ``taxon, name`` and, where they are columns, ``info`` and ``display_label``."""
    more = [c for c in ("info", "display_label") if c in taxa.columns]

    def make(p):
        p = p.sort_values("taxon")
        text = "#NEXUS\n" + _taxa_block(p.name_.tolist())
        for c, word in (("info", "TAXINFO"), ("display_label", "DISPLAYLABELS")):
            if c in more:
                text = text[: -len("END;\n")] + f"{word} {' '.join(_text(x) for x in p[c])};\nEND;\n"
        return text

    return _one(taxa.select("taxon", F.col("name").alias("name_"), *more), make)


def _text(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "null"


def plain_report(lines: DataFrame) -> DataFrame:
    """``value``: the text of ``line_no, line`` in order, one row a line."""
    return lines.orderBy("line_no").select(F.col("line").alias("value"))


def nexus_report(lines: DataFrame) -> DataFrame:
    """A report block of ``line_no, line``."""
    return _one(lines.select("line_no", "line"), lambda p: "#NEXUS\nBEGIN REPORT;\nTEXT\n" + "\n".join(p.sort_values("line_no").line) + "\n;\nEND;\n")


def nexus_trees(trees: DataFrame, rooted: bool = True) -> DataFrame:
    """A trees block of ``tree_no, name, newick``."""

    def make(p):
        p = p.sort_values("tree_no")
        mark = "[&R]" if rooted else "[&U]"
        rows = "".join(f"TREE {_quoted(n)} = {mark} {x}\n" for n, x in zip(p.name_, p.newick))
        return f"#NEXUS\nBEGIN TREES;\nPROPERTIES ROOTED={'yes' if rooted else 'no'};\n{rows}END;\n"

    return _one(trees.select("tree_no", F.col("name").alias("name_"), "newick"), make)


def nexus_traits(traits: DataFrame) -> DataFrame:
    """A traits block of ``name, trait, value``, one value a taxon and trait; absent ones are ``?``."""

    def make(p):
        t = p.pivot_table(index="name_", columns="trait", values="value", aggfunc="min")
        rows = "\n".join(f"{_quoted(n)} " + ",".join("?" if not isinstance(v, str) else v for v in row) for n, row in zip(t.index, t.to_numpy()))
        return f"#NEXUS\n{_taxa_block(list(t.index))}BEGIN TRAITS;\nDIMENSIONS NTRAITS={len(t.columns)};\nFORMAT LABELS=yes MISSING=? SEPARATOR=Comma;\nTRAITLABELS {' '.join(map(_quoted, t.columns))};\nMATRIX\n{rows}\n;\nEND;\n"

    return _one(traits.select(F.col("name").alias("name_"), "trait", "value"), make)


def nexus_sets(sets: DataFrame) -> DataFrame:
    """A sets block of ``kind, name, member``; whole numbers are written in their order."""

    def make(p):
        key = lambda x: (0, int(x), "") if x.isdigit() else (1, 0, x)
        rows = [f"\t{k.upper()} {_quoted(n)} = {' '.join(_quoted(m) for m in sorted(set(g.member), key=key))};" for (k, n), g in p.groupby(["kind", "name_"])]
        return "#NEXUS\nBEGIN SETS;\n" + "\n".join(rows) + "\nEND;\n"

    return _one(sets.select("kind", F.col("name").alias("name_"), "member"), make)


def nexus_network(nodes: DataFrame, edges: DataFrame, kind: str = "Other") -> DataFrame:
    """A network block of ``id, label`` and ``src, dst, weight``."""
    n = nodes.select(F.lit(0).alias("k"), F.col("id").alias("i"), F.lit(0).alias("j"), F.col("label").alias("x"), F.lit(0.0).alias("w"))
    e = edges.select(F.lit(1).alias("k"), F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(None).cast("string").alias("x"), F.col("weight").alias("w"))

    def make(p):
        v, f = p[p.k == 0].sort_values("i"), p[p.k == 1].sort_values(["i", "j"])
        a = ",\n".join(f"\tid={i}" + (" label='" + x.replace("'", "''") + "'" if isinstance(x, str) and x else "") for i, x in zip(v.i, v.x))
        b = ",\n".join(f"\tid={k} sid={i} tid={j}" + (f" weight='{w!r}'" if w == w else "") for k, (i, j, w) in enumerate(zip(f.i, f.j, f.w.tolist()), 1))
        return f"#NEXUS\nBEGIN NETWORK;\nDIMENSIONS nVertices={len(v)} nEdges={len(f)};\nTYPE {kind};\nVERTICES\n{a}\n;\nEDGES\n{b}\n;\nEND;\n"

    return _one(n.unionByName(e), make)


def nexus_genomes(genomes: DataFrame) -> DataFrame:
    """A genomes block of ``taxon, name, accession, length, parts`` (parts by file and offset, or by sequence), one ``value`` per line in one partition."""

    def make(batches):
        for p in batches:
            rows = []
            for n, a, k, parts in p[["name_", "accession", "length", "parts"]].itertuples(index=False):
                cells = [f"{x['length']} " + (f"'file://{x['file']}' {x['offset']}" if x["file"] else x["seq"]) for x in parts]
                rows.append("\t'" + n.replace("'", "''") + f"' {a} {k} {len(cells)} " + " ".join(cells))
            yield pd.DataFrame({"taxon": p.taxon, "accession": p.accession, "value": rows})

    def block(batches):
        held = None
        for p in batches:
            out = [held + ","] if held is not None else []
            if held is None and len(p):
                out = ["#NEXUS", "BEGIN GENOMES;", f"DIMENSIONS ntax={p.n.iloc[0]};", "FORMAT labels=yes accessions=yes multiPart=yes dataType=DNA;", "MATRIX"]
            if len(p):
                rows = p.value.tolist()
                held = rows.pop()
                yield pd.DataFrame({"value": [*out, *(x + "," for x in rows)]})
        if held is not None:
            yield pd.DataFrame({"value": [held, ";", "END;"]})

    kind = genomes.schema["taxon"].dataType.simpleString()
    lines = genomes.select("taxon", F.col("name").alias("name_"), "accession", "length", "parts").mapInPandas(make, f"taxon {kind}, accession string, value string")
    n = genomes.agg(F.count(F.lit(1))).scalar()
    return lines.repartition(1).sortWithinPartitions("taxon", "accession").select("value", n.alias("n")).mapInPandas(block, "value string")


def nexml_trees(edges: DataFrame) -> DataFrame:
    """One NeXML document of trees ``tree_no, parent, child, weight, label``."""

    def make(p):
        from xml.sax.saxutils import quoteattr

        labels = sorted({x for x in p.label if isinstance(x, str) and x})
        otu = {x: f"otu{i}" for i, x in enumerate(labels, 1)}
        out = ['<?xml version="1.0" encoding="UTF-8"?>', '<nex:nexml version="0.9" xmlns:nex="http://www.nexml.org/2009" xmlns="http://www.nexml.org/2009">', '<otus id="taxa">']
        out += [f"<otu id={quoteattr(i)} label={quoteattr(x)}/>" for x, i in otu.items()] + ["</otus>", '<trees id="trees" otus="taxa">']
        for t, g in p.groupby("tree_no"):
            name = {int(c): x for c, x in zip(g.child, g.label) if isinstance(x, str) and x}
            ends = sorted({int(v) for v in g.parent if v >= 0} | {int(v) for v in g.child})
            top = set(ends) - {int(c) for c, q in zip(g.child, g.parent) if q >= 0}
            out.append(f'<tree id="tree{t}">')
            out += [f'<node id="n{v}"' + (f" otu={quoteattr(otu[name[v]])} label={quoteattr(name[v])}" if v in name else "") + (' root="true"' if v in top else "") + "/>" for v in ends]
            out += [f'<edge id="e{c}" source="n{q}" target="n{c}"' + (f' length="{w!r}"' if w == w else "") + "/>" for q, c, w in sorted(zip(g.parent.tolist(), g.child.tolist(), g.weight.tolist())) if q >= 0]
            out.append("</tree>")
        return "\n".join([*out, "</trees>", "</nex:nexml>"])

    return _one(edges.select("tree_no", "parent", "child", "weight", "label"), make)


def split_newick(splits: DataFrame, names: list[str], cycle: list[int]) -> DataFrame:
    """Circular splits as a Newick tree in the order of the cycle, with marks for those the tree lacks."""
    b = bits(len(names))

    def make(p):
        return kernels.split_newick([(b.to_int(m), float(w)) for m, w in zip(p["mask"], p.weight)], [_quoted(n) for n in names], cycle)

    return _one(splits.select("mask", "weight"), make)
