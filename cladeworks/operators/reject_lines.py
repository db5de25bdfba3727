"""Delimited lines to typed rows, with the lines that do not parse set apart and every fault named.

Method. Lines of an Arrow batch are put behind an ordinal and handed to ``pyarrow.csv`` as one buffer; its invalid-row
callback receives the lines with a wrong number of columns. All fields are read as strings; vectorised casts and
patterns then label each failing cell. The work is one narrow map without a shuffle, so a feed holding a third of all
rows does not matter.

``pyarrow.csv`` is lenient about quotes (it takes ``D"NA`` as text and lets an open quote swallow the next lines), so a
line must first match the quoting rule as a whole; else it is rejected as ``quoting`` and not fed to the reader.

Defined results: a null line, a null feed or an unknown feed is a reject; an empty line is a reject (column count);
lines may repeat and are judged one by one; texts may be of any length; an empty table gives an empty table; columns
other than id, feed and line are not looked at, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = r'(?:[^",\r\n]*|"(?:[^"]|"")*")'
QUOTING = rf"(?s)\A{CELL}(?:,{CELL})*\z"
INT = r"\A[0-9]{1,10}\z"
INT_MAX = 2147483647
#: Bytes of lines handed to the reader at once.
CHUNK = 16 << 20

#: Alphabets of the sequence types, lower case (fixed values).
ALPHABETS = {
    "dna": "acgtryswkmbdhvn",
    "rna": "acguryswkmbdhvn",
    "protein": "arndcqeghilkmfpstwyvbzx*",
    "standard": "0123456789",
}
ACCESSION = r"\A[A-Z]{3}_[0-9]{9}\.[0-9]+\z"
URL = (
    r"\A(?:[fF][tT][pP]|[hH][tT][tT][pP][sS]?)://[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?(?::[0-9]{1,5})?/"
    r"(?:[!#$&-;=?-\[\]-~]|%[0-9A-Fa-f]{2})*\z"
)

Check = Callable[[dict[str, pa.Array]], tuple[pa.Array, pa.Array]]


def _matches(a: pa.Array, pattern: str) -> pa.Array:
    return pc.match_substring_regex(a, pattern)


def integer(name: str, optional: bool = False) -> Check:
    """1 to 10 digits, from 1 to 2147483647; ``optional``: or empty (null)."""

    def check(cells):
        a = cells[name]
        digits = _matches(a, INT)
        n = pc.cast(pc.if_else(digits, a, pa.scalar(None, pa.string())), pa.int64())
        ok = pc.fill_null(pc.and_(pc.greater_equal(n, 1), pc.less_equal(n, INT_MAX)), False)
        n = pc.cast(pc.if_else(ok, n, pa.scalar(None, pa.int64())), pa.int32())
        return (pc.or_(ok, pc.equal(a, "")) if optional else ok), n

    return check


def pattern(name: str, regex: str, empty: tuple[str, ...] = ()) -> Check:
    """Text that matches; the texts in ``empty`` are allowed and become null."""

    def check(cells):
        a = cells[name]
        none = pc.is_in(a, value_set=pa.array(list(empty), pa.string()))
        return pc.or_(_matches(a, regex), none), pc.if_else(none, pa.scalar(None, pa.string()), a)

    return check


def _ascii_lower(a: pa.Array) -> pa.Array:
    return pc.ascii_lower(a)


def _data_type(cells):
    low = _ascii_lower(cells["data_type"])
    return pc.is_in(low, value_set=pa.array(list(ALPHABETS))), cells["data_type"]


def _not_blank(cells):
    return pc.invert(_matches(cells["taxon_name"], r"\A[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*\z")), cells["taxon_name"]


def _symbols(cells):
    kinds, symbols = _ascii_lower(cells["data_type"]).to_pylist(), _ascii_lower(cells["symbols"]).to_pylist()
    known: dict[tuple[str, str], bool] = {}
    out = []
    for key in zip(kinds, symbols):
        if key not in known:
            kind, s = key
            known[key] = bool(s) and len(set(s)) == len(s) and set(s) <= set(ALPHABETS.get(kind, s))
        out.append(known[key])
    return pa.array(out, pa.bool_()), cells["symbols"]


def _matrix(cells):
    """Without blanks exactly nchar characters, each a symbol in any case, ``-`` or ``?``."""
    bare = pc.replace_substring(cells["matrix"], " ", "")
    low = _ascii_lower(bare)
    wanted = integer("nchar")(cells)[1].to_pylist()
    sizes = pc.utf8_length(bare).to_pylist()
    symbols = _ascii_lower(cells["symbols"]).to_pylist()
    allowed: dict[str, frozenset] = {}
    out = []
    for text, n, size, s in zip(low.to_pylist(), wanted, sizes, symbols):
        if s not in allowed:
            allowed[s] = frozenset(s + "-?")
        out.append(n == size and not (set(text) - allowed[s]))
    return pa.array(out, pa.bool_()), bare


@dataclass(frozen=True)
class Column:
    name: str
    type: pa.DataType
    check: Check
    fault: str


@dataclass(frozen=True)
class Feed:
    name: str
    columns: tuple[Column, ...] = field(default_factory=tuple)

    @property
    def ddl(self) -> str:
        return ", ".join(f"{c.name}: {'int' if c.type == pa.int32() else 'string'}" for c in self.columns)


GENOMES = Feed("genomes", (
    Column("taxon_id", pa.int32(), integer("taxon_id"), "not an integer from 1"),
    Column("genome_accession", pa.string(), pattern("genome_accession", ACCESSION), "not an accession"),
    Column("genome_size", pa.int32(), integer("genome_size", optional=True), "neither empty nor an integer from 1"),
    Column("fasta_url", pa.string(), pattern("fasta_url", URL, ("", "null")), "not a URL"),
))
CHARACTERS = Feed("characters", (
    Column("block_id", pa.int32(), integer("block_id"), "not an integer from 1"),
    Column("taxon_name", pa.string(), _not_blank, "blank"),
    Column("data_type", pa.string(), _data_type, "unknown type"),
    Column("nchar", pa.int32(), integer("nchar"), "not an integer from 1"),
    Column("symbols", pa.string(), _symbols, "empty, repeated or foreign symbol"),
    Column("matrix", pa.string(), _matrix, "wrong length or foreign character"),
))
FEEDS = (GENOMES, CHARACTERS)


def _read(lines: list[str], feed: Feed) -> tuple[list[int], dict[str, pa.Array], dict[int, int]]:
    """Ordinals and cells of the lines with the right number of fields; of the others, the number of fields."""
    bad: dict[int, int] = {}

    def structural(row):
        bad[int(row.text.partition(",")[0])] = row.actual_columns - 1
        return "skip"

    buffer = "".join(f"{i},{line}\n" for i, line in enumerate(lines)).encode()
    names = ["ordinal", *(c.name for c in feed.columns)]
    table = pv.read_csv(
        pa.BufferReader(buffer),
        read_options=pv.ReadOptions(column_names=names, use_threads=False, block_size=len(buffer) + 1),
        parse_options=pv.ParseOptions(newlines_in_values=True, invalid_row_handler=structural),
        convert_options=pv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
    ).combine_chunks()
    cells = {n: _flat(table[n]) for n in names}
    return [int(x) for x in cells.pop("ordinal").to_pylist()], cells, bad


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.array([], pa.string()) if not column.num_chunks else pa.concat_arrays(column.chunks)


def _chunks(rows: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    part, size = [], 0
    for row in rows:
        if part and size + len(row[1]) > CHUNK:
            yield part
            part, size = [], 0
        part.append(row)
        size += len(row[1]) + 16
    if part:
        yield part


def _judge(batch: pa.RecordBatch, feeds: tuple[Feed, ...], schema: pa.Schema, typed_rows: bool) -> pa.RecordBatch:
    n = batch.num_rows
    names, lines = batch.column(1).to_pylist(), batch.column(2)
    bare = pc.replace_substring_regex(lines, r"\r\z", "")
    sound, texts = _matches(bare, QUOTING).to_pylist(), bare.to_pylist()
    faults: list[list[dict]] = [[] for _ in range(n)]
    values: dict[str, list] = {f.name: [None] * n for f in feeds}
    groups: dict[str, list[tuple[int, str]]] = {f.name: [] for f in feeds}
    for i, (name, text) in enumerate(zip(names, texts)):
        if text is None:
            faults[i].append({"field": None, "reason": "null line"})
        elif name not in groups:
            faults[i].append({"field": None, "reason": "unknown feed"})
        elif not sound[i]:
            faults[i].append({"field": None, "reason": "quoting"})
        else:
            groups[name].append((i, text))
    for feed in feeds:
        for part in _chunks(groups[feed.name]):
            at = [i for i, _ in part]
            kept, cells, bad = _read([t for _, t in part], feed)
            for k, count in bad.items():
                faults[at[k]].append({"field": None, "reason": f"column count: {len(feed.columns)} wanted, {count} found"})
            if not kept:
                continue
            typed = {}
            for c in feed.columns:
                ok, typed[c.name] = c.check(cells)
                for k, good in zip(kept, ok.to_pylist()):
                    if not good:
                        faults[at[k]].append({"field": c.name, "reason": c.fault})
            if not typed_rows:
                continue
            rows = zip(*(typed[c.name].to_pylist() for c in feed.columns))
            keys = [c.name for c in feed.columns]
            for k, row in zip(kept, rows):
                if not faults[at[k]]:
                    values[feed.name][at[k]] = dict(zip(keys, row))
    columns = [batch.column(0), batch.column(1), pa.array([not f for f in faults], pa.bool_()), pa.array(faults, schema.field("faults").type)]
    if typed_rows:
        columns += [pa.array(values[f.name], schema.field(f"row_{f.name}").type) for f in feeds]
    columns += batch.columns[3:]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def parse_lines(df: DataFrame, id_col: str = "line_id", feed_col: str = "feed", line_col: str = "line", feeds: tuple[Feed, ...] = FEEDS, carried: tuple[str, ...] = (), typed: bool = True) -> DataFrame:
    """``line_id, feed, ok, faults ARRAY<STRUCT<field, reason>>`` and for each feed ``row_<feed>`` STRUCT, null unless valid; then the columns ``carried``, as they are.

    Without ``typed`` the ``row_`` columns, which cost a conversion, are left out.
    """
    src = df.select(F.col(id_col).cast("bigint").alias("line_id"), F.col(feed_col).cast("string").alias("feed"), F.col(line_col).cast("string").alias("line"), *carried)
    fault = pa.list_(pa.struct([("field", pa.string()), ("reason", pa.string())]))
    schema = pa.schema(
        [("line_id", pa.int64()), ("feed", pa.string()), ("ok", pa.bool_()), ("faults", fault)]
        + [(f"row_{f.name}", pa.struct([(c.name, c.type) for c in f.columns])) for f in feeds if typed]
    )
    ddl = "line_id bigint, feed string, ok boolean, faults array<struct<field: string, reason: string>>" + "".join(f", row_{f.name} struct<{f.ddl}>" for f in feeds if typed)
    ddl += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[3:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _judge(b, feeds, pa.schema([*schema, *list(b.schema)[3:]]), typed)

    return src.mapInArrow(run, ddl)


def valid_rows(parsed: DataFrame, feed: str) -> DataFrame:
    """Typed rows of one feed."""
    return parsed.filter(F.col("ok") & (F.col("feed") == feed)).select("line_id", f"row_{feed}.*")


def rejects(parsed: DataFrame) -> DataFrame:
    """One row for each fault of each rejected line."""
    return parsed.filter(~F.col("ok")).select("line_id", "feed", F.explode("faults").alias("f")).select("line_id", "feed", "f.field", "f.reason")
