"""Text of one file (or record) to rows. Pure functions; the readers run them inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain


class FormatError(ValueError):
    pass


def fasta(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, list[str]]] = []
    for line in text.splitlines():
        if line.startswith(">"):
            out.append((line[1:].strip(), []))
        elif line.strip():
            if not out:
                raise FormatError("sequence before the first header")
            out[-1][1].append("".join(line.split()))
    return [(n, "".join(p)) for n, p in out]


def _rows_in_order(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    found: dict[str, list[str]] = {}
    for n, s in pairs:
        found.setdefault(n, []).append(s)
    return [(n, "".join(p)) for n, p in found.items()]


def clustal(text: str) -> list[tuple[str, str]]:
    lines = text.splitlines()
    if not lines or not lines[0].upper().startswith("CLUSTAL"):
        raise FormatError("no CLUSTAL header")
    pairs = []
    for line in lines[1:]:
        if line.strip() and not line[0].isspace():
            p = line.split()
            if len(p) >= 2:
                pairs.append((p[0], p[1]))
    return _rows_in_order(pairs)


def stockholm(text: str) -> list[tuple[str, str]]:
    lines = text.splitlines()
    if not lines or not lines[0].startswith("# STOCKHOLM"):
        raise FormatError("no STOCKHOLM header")
    pairs = []
    for line in lines[1:]:
        if line.startswith("//"):
            break
        p = line.split()
        if len(p) == 2 and not line.startswith("#"):
            pairs.append((p[0], p[1]))
    return _rows_in_order(pairs)


def msf(text: str) -> list[tuple[str, str]]:
    head, sep, body = text.partition("//")
    if not sep:
        raise FormatError("no // after the header")
    names = re.findall(r"Name:\s*(\S+)", head)
    pairs = []
    for line in body.splitlines():
        p = line.split()
        if p and p[0] in names:
            pairs.append((p[0], "".join(p[1:]).replace(".", "-").replace("~", "-")))
    return _rows_in_order(pairs)


def phylip_sequences(text: str, strict: bool = False) -> list[tuple[str, str]]:
    """Sequential or interleaved; ``strict``: names are the first ten characters."""
    lines = [x for x in text.splitlines() if x.strip()]
    head = lines[0].split() if lines else []
    if len(head) < 2 or not all(x.isdigit() for x in head[:2]):
        raise FormatError("no counts in the first line")
    n, m = int(head[0]), int(head[1])
    body = lines[1:]

    def named(line):
        if strict:
            return line[:10].strip(), "".join(line[10:].split())
        p = line.split(None, 1)
        return p[0], "".join(p[1].split()) if len(p) > 1 else ""

    names, seqs, at = [], [], 0
    while len(names) < n and at < len(body):  # sequential: each name's lines until it is full
        name, s = named(body[at])
        at += 1
        while len(s) < m and at < len(body):
            s += "".join(body[at].split())
            at += 1
        names.append(name)
        seqs.append(s)
    if len(names) == n and all(len(s) == m for s in seqs):
        return list(zip(names, seqs))
    names, seqs = map(list, zip(*(named(x) for x in body[:n])))
    for i, line in enumerate(body[n:]):
        seqs[i % n] += "".join(line.split())
    if len(names) != n or any(len(s) != m for s in seqs):
        raise FormatError("rows do not have the stated length")
    return list(zip(names, seqs))


def phylip_distances(text: str) -> list[tuple[str, str, float]]:
    """Square or lower triangular; rows may go over several lines. Result: name, name, distance for i < j."""
    p = text.split()
    n, at = int(p[0]), 1
    names: list[str] = []
    rows: list[list[float]] = []
    square = len(p) - 1 == n * (n + 1)
    for i in range(n):
        names.append(p[at])
        k = n if square else i
        rows.append([float(x) for x in p[at + 1 : at + 1 + k]])
        at += 1 + k
    return [(names[j], names[i], rows[i][j]) for i in range(n) for j in range(i)]


def csv_distances(text: str) -> list[tuple[str, str, float]]:
    """A count line and labelled rows, labelled rows, or bare numbers (names t1, t2, ...); lines of # or // are comments."""
    rows = [[c.strip() for c in re.split(r"[,\t;]", x)] for x in text.splitlines() if x.strip() and not x.lstrip().startswith(("#", "//"))]
    if rows and len([c for c in rows[0] if c]) == 1 and rows[0][0].isdigit():
        rows = rows[1:]

    def number(x):
        try:
            float(x)
            return True
        except ValueError:
            return False

    if rows and all(number(c) for c in rows[0]):
        names, values = [f"t{i + 1}" for i in range(len(rows))], rows
    else:
        if rows and not rows[0][0] and not all(number(c) for c in rows[0][1:]):
            rows = rows[1:]
        names, values = [r[0] for r in rows], [r[1:] for r in rows]
    return [(names[j], names[i], float(values[i][j])) for i in range(len(names)) for j in range(i)]


TOKEN = re.compile(r"\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]]+")


def newick(text: str) -> list[tuple[int, int, float | None, str | None, bool]]:
    """Edges ``parent, child, weight, label of the child, reticulate``; node 0 is the root. ``#`` marks hybrid nodes."""
    edges: list[list] = []
    hybrids: dict[str, int] = {}
    stack: list[int] = []
    cur = _Node(edges)
    root = cur.new(None)
    node, expect = root, "node"
    for t in TOKEN.findall(text):
        if t.startswith("["):
            continue
        if t == "(":
            stack.append(node)
            node, expect = cur.new(node), "node"
        elif t == ",":
            if not stack:
                raise FormatError("comma outside of parentheses")
            node, expect = cur.new(stack[-1]), "node"
        elif t == ")":
            if not stack:
                raise FormatError("unbalanced parentheses")
            node, expect = stack.pop(), "label"
        elif t == ":":
            expect = "weight"
        elif t == ";":
            break
        elif expect == "weight":
            cur.weight(node, float(t))
            expect = "end"
        else:
            label = t[1:-1].replace("''", "'") if t.startswith("'") else t
            if "#" in label and not t.startswith("'"):
                name, _, tag = label.partition("#")
                if tag in hybrids:
                    cur.merge(node, hybrids[tag])
                    node = hybrids[tag]
                else:
                    hybrids[tag] = node
                cur.reticulate(node)
                label = name
            if label:
                cur.label(node, label)
            expect = "end"
    if stack:
        raise FormatError("unbalanced parentheses")
    return cur.rows()


class _Node:
    def __init__(self, edges):
        self.n, self.up, self.labels, self.same, self.ret = 0, {}, {}, {}, set()

    def new(self, parent):
        i = self.n
        self.n += 1
        if parent is not None:
            self.up[i] = [parent, None]
        self.last = i
        return i

    def merge(self, i, into):
        self.same[i] = into
        self.last = i

    def weight(self, i, w):
        for k in reversed(range(self.n)):
            if self.same.get(k, k) == i and k in self.up and self.up[k][1] is None:
                self.up[k][1] = w
                return

    def label(self, i, x):
        self.labels[self.same.get(i, i)] = x

    def reticulate(self, i):
        self.ret.add(i)

    def rows(self):
        real = lambda i: self.same.get(i, i)
        out = [(real(p), real(c), w, self.labels.get(real(c)), real(c) in self.ret) for c, (p, w) in sorted(self.up.items())]
        return [(-1, 0, None, self.labels.get(0), False), *out] if 0 in self.labels and not out else out


NEXUS = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|[;=,()/]|[^\s;=,()/'\"]+")


def nexus_blocks(text: str) -> dict[str, list[list[str]]]:
    """Commands (lists of tokens) of each block, by the block's lower-case name. Comments in brackets are dropped."""
    text = re.sub(r"\[[^\]]*\]", " ", text)
    blocks: dict[str, list[list[str]]] = {}
    name = None
    for part in _commands(text):
        words = NEXUS.findall(part)
        if not words:
            continue
        first = words[0].lower()
        if first == "#nexus":
            words = words[1:]
            first = words[0].lower() if words else ""
        if first == "begin":
            name = words[1].lower()
            blocks.setdefault(name, [])
        elif first in ("end", "endblock"):
            name = None
        elif name:
            blocks[name].append([*words, "\n" + part.strip()])
    return blocks


def _commands(text: str) -> list[str]:
    out, start, quote = [], 0, None
    for i, c in enumerate(text):
        if quote:
            quote = None if c == quote else quote
        elif c == "'" and (i == 0 or not text[i - 1].isalnum()):
            quote = c
        elif c == ";":
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def _plain(x: str) -> str:
    return x[1:-1].replace("''", "'") if x[:1] in "'\"" else x


def nexus_options(words: list[str]) -> dict[str, str]:
    out = {}
    for i, w in enumerate(words):
        if w == "=" and 0 < i < len(words) - 1:
            out[words[i - 1].lower()] = _plain(words[i + 1])
        elif w.lower() in ("interleave", "transpose", "nodiagonal", "diagonal", "respectcase"):
            out.setdefault(w.lower(), "yes")
    return out


def nexus_taxa(text: str) -> list[str]:
    for c in nexus_blocks(text).get("taxa", []):
        if c[0].lower() == "taxlabels":
            return [_plain(w) for w in c[1:-1]]
    return []


def nexus_taxa_details(text: str) -> list[tuple[str, str | None, str | None]]:
    """(label, info, display label) of each taxon; ``null`` stands for none."""
    lists: dict[str, list[str]] = {}
    for c in nexus_blocks(text).get("taxa", []):
        lists[c[0].lower()] = [_plain(w) for w in c[1:-1]]
    labels = lists.get("taxlabels", [])
    at = lambda k, i: x if i < len(lists.get(k, [])) and (x := lists[k][i]) != "null" else None
    return [(n, at("taxinfo", i), at("displaylabels", i)) for i, n in enumerate(labels)]


def nexus_sites(text: str) -> list[tuple[int, float, str | None, list[str]]]:
    """(site, weight, label, labels of states) of each site of a characters block."""
    blocks = nexus_blocks(text)
    n, weights, names, states = 0, [], {}, {}
    for c in blocks.get("characters") or blocks.get("data") or []:
        key, words = c[0].lower(), c[1:-1]
        if key == "dimensions":
            n = int(nexus_options(words).get("nchar", 0))
        elif key == "charweights":
            weights = [float(w) for w in words]
        elif key == "charlabels":
            names = {i: _plain(w) for i, w in enumerate(words, 1)}
        elif key == "charstatelabels":
            part: list[str] = []
            for w in [*words, ","]:
                if w != ",":
                    part.append(w)
                    continue
                if part:
                    cut = part.index("/") if "/" in part else len(part)
                    site = int(part[0])
                    if cut > 1:
                        names[site] = _plain(part[1])
                    states[site] = [_plain(x) for x in part[cut + 1 :]]
                part = []
    return [(i, weights[i - 1] if i <= len(weights) else 1.0, names.get(i), states.get(i, [])) for i in range(1, n + 1)]


def nexus_split_properties(text: str) -> tuple[float | None, str | None, float | None, list[int]] | None:
    """(fit, compatibility, threshold, cycle) of a splits block."""
    block = nexus_blocks(text).get("splits")
    if block is None:
        return None
    fit = kind = threshold = None
    for c in block:
        key, raw = c[0].lower(), " ".join(c[-1].split()).lower()
        if key == "threshold":
            threshold = float(c[2])
        elif key == "properties":
            if m := re.search(r"fit\s*=\s*([0-9.eE+-]+)", raw):
                fit = float(m[1])
            kind = next((k for k in ("incompatible", "weakly compatible", "compatible", "cyclic", "circular") if k in raw), None)
    return fit, kind, threshold, nexus_splits(text)[1]


def nexus_tree_properties(text: str) -> tuple[bool, bool, bool] | None:
    """(partial, rooted, reticulated) of a trees block."""
    block = nexus_blocks(text).get("trees")
    if block is None:
        return None
    o: dict[str, str] = {}
    for c in block:
        if c[0].lower() == "properties":
            o |= nexus_options(c[1:-1])
    return tuple(o.get(k, "no").lower() in ("yes", "true") for k in ("partialtrees", "rooted", "reticulated"))


def nexus_trait_details(text: str) -> list[tuple[str, float | None, float | None, str | None]]:
    """(trait, latitude, longitude, colour)."""
    lists: dict[str, list[str]] = {}
    for c in nexus_blocks(text).get("traits", []):
        # signs stand as words of their own only where quotes cut them off
        lists[c[0].lower()] = [_plain(w) for w in c[1:-1]]
    at = lambda k, i: lists[k][i] if i < len(lists.get(k, [])) and lists[k][i] else None
    number = lambda x: None if x is None else float(x)
    return [(t, number(at("traitlatitude", i)), number(at("traitlongitude", i)), at("traitcolor", i)) for i, t in enumerate(lists.get("traitlabels", []))]


def nexus_characters(text: str) -> tuple[list[tuple[str, str]], dict[str, str]]:
    blocks = nexus_blocks(text)
    taxa = nexus_taxa(text)
    block = blocks.get("characters") or blocks.get("data") or []
    options: dict[str, str] = {}
    rows: list[tuple[str, str]] = []
    for c in block:
        key = c[0].lower()
        if key in ("dimensions", "format"):
            options |= nexus_options(c[1:-1])
        elif key == "matrix":
            body = c[-1][1:].strip()[len("matrix") :]
            labels = options.get("labels", "left").lower() not in ("no", "false")
            pairs, i = [], 0
            for line in body.splitlines():
                p = NEXUS.findall(line) if "'" in line else line.split()
                if not p:
                    continue
                if labels:
                    pairs.append((_plain(p[0]), "".join(p[1:])))
                else:
                    pairs.append((taxa[i % len(taxa)] if taxa else f"t{i + 1}", "".join(p)))
                    i += 1
            rows = _rows_in_order(pairs)
    match = options.get("matchchar")
    if match and rows:
        top = rows[0][1]
        rows = [rows[0], *((n, "".join(t if c == match else c for c, t in zip(s, top))) for n, s in rows[1:])]
    return rows, options


def nexus_distances(text: str) -> list[tuple[str, str, float]]:
    taxa, options = nexus_taxa(text), {}
    for c in nexus_blocks(text).get("distances", []):
        key = c[0].lower()
        if key in ("dimensions", "format"):
            options |= nexus_options(c[1:-1])
        elif key == "matrix":
            lines = [x.split() for x in c[-1][1:].strip()[len("matrix") :].splitlines() if x.split()]
            shape = options.get("triangle", "both").lower()
            labels = options.get("labels", "no").lower() not in ("no", "false")
            diagonal = "nodiagonal" not in options and options.get("diagonal", "yes").lower() not in ("no", "false")
            names, out = [], []
            n = int(options.get("ntax", len(taxa) or len(lines)))
            flat = [x for p in lines for x in p]
            at = 0
            for i in range(n):
                names.append(_plain(flat[at]) if labels else taxa[i] if taxa else f"t{i + 1}")
                at += labels
                d = 1 if diagonal else 0
                k = n - (1 - d) if shape == "both" else i + d if shape == "lower" else n - i - 1 + d
                vals = [float(x) for x in flat[at : at + k]]
                at += k
                cols = [j for j in range(n) if (diagonal or j != i)] if shape == "both" else list(range(i + d)) if shape == "lower" else list(range(i + 1 - d, n))
                out += [(i, j, v) for j, v in zip(cols, vals) if i != j]
            low = {(min(i, j), max(i, j)): v for i, j, v in reversed(out)}
            return [(names[i], names[j], v) for (i, j), v in sorted(low.items())]
    return []


def nexus_trees(text: str) -> list[tuple[str, str]]:
    """Name and Newick text of each tree, translated."""
    out, names = [], {}
    for c in nexus_blocks(text).get("trees", []):
        raw = c[-1][1:].strip()
        key = c[0].lower()
        if key == "translate":
            for pair in raw[len("translate") :].split(","):
                p = pair.split(None, 1)
                if len(p) == 2:
                    names[p[0]] = p[1].strip()
        elif key in ("tree", "utree"):
            name, _, body = raw[len(key) :].partition("=")
            text_ = body.strip() + ";"
            if names:
                text_ = re.sub(r"(?<=[(,])\s*([^\s(),:;]+)", lambda m: names.get(m[1], m[1]), text_)
            out.append((name.strip().lstrip("*").strip(), text_))
    return out


def nexus_splits(text: str) -> tuple[list[tuple[list[int], float, float | None]], list[int]]:
    """Splits as (side, weight, confidence) and the cycle."""
    out, cycle = [], []
    for c in nexus_blocks(text).get("splits", []):
        key, raw = c[0].lower(), c[-1][1:].strip()
        if key == "cycle":
            cycle = [int(x) for x in raw.split()[1:]]
        elif key == "matrix":
            for line in raw[len("matrix") :].split(","):
                p = [x.split() for x in line.strip().split("\t")] if "\t" in line else None
                words = [w for x in p for w in x] if p else line.split()
                if not words:
                    continue
                head = p[:-1] if p else []
                numbers = [x for part in head for x in part]
                side = [int(x) for x in (p[-1] if p else words[1:])]
                values = [float(x) for x in numbers if not x.endswith("]")]
                if p:
                    weight = values[0] if values else 1.0
                    out.append((side, weight, values[1] if len(values) > 1 else None))
                else:
                    out.append((side, float(words[0]), None))
    return out, cycle


def nexus_traits(text: str) -> list[tuple[str, str, str]]:
    taxa = nexus_taxa(text)
    rows, labels, options = [], [], {}
    for c in nexus_blocks(text).get("traits", []):
        key = c[0].lower()
        if key == "format":
            options = nexus_options(c[1:-1])
        elif key == "traitlabels":
            labels = [_plain(w) for w in c[1:-1]]
        elif key == "matrix":
            sep = {"comma": ",", "tab": "\t"}.get(options.get("separator", "").lower())
            for i, line in enumerate(x for x in c[-1][1:].strip()[len("matrix") :].splitlines() if x.strip()):
                p = line.split(None, 1) if options.get("labels", "yes").lower() != "no" else [taxa[i], line]
                cells = p[1].split(sep) if sep else p[1].split()
                rows += [(_plain(p[0]), labels[k] if k < len(labels) else f"trait{k + 1}", v.strip()) for k, v in enumerate(cells)]
    return rows


def nexus_sets(text: str) -> list[tuple[str, str, str]]:
    """``kind, name, member``; ranges of character sets are expanded."""
    out = []
    for c in nexus_blocks(text).get("sets", []):
        kind, words = c[0].lower(), c[1:-1]
        if kind not in ("taxset", "charset") or "=" not in words:
            continue
        at = words.index("=")
        for w in words[at + 1 :]:
            m = re.fullmatch(r"(\d+)-(\d+)(?:\\(\d+))?", w)
            members = range(int(m[1]), int(m[2]) + 1, int(m[3] or 1)) if m else [_plain(w)]
            out += [(kind, _plain(words[0]), str(x)) for x in members if x != ","]
    return out


def gml(text: str) -> tuple[list[tuple[int, str | None]], list[tuple[int, int, float | None]]]:
    """Nodes (id, label) and edges (source, target, weight) of a GML graph."""
    words = re.findall(r'"[^"]*"|\[|\]|[^\s\[\]"]+', text)
    nodes, edges, at, kind, cur, depth = [], [], 0, None, {}, 0
    while at < len(words):
        w = words[at]
        if w == "[":
            depth += 1
        elif w == "]":
            depth -= 1
            if kind == "node" and depth == 1:
                nodes.append((int(cur["id"]), cur.get("label")))
                kind = None
            elif kind == "edge" and depth == 1:
                edges.append((int(cur["source"]), int(cur["target"]), float(cur["weight"]) if "weight" in cur else None))
                kind = None
        elif depth == 1 and w.lower() in ("node", "edge"):
            kind, cur = w.lower(), {}
        elif kind and depth == 2 and at + 1 < len(words) and words[at + 1] not in "[]":
            cur[w.lower()] = words[at + 1].strip('"')
            at += 1
        at += 1
    return nodes, edges


def nexus_network(text: str) -> tuple[list[tuple[int, str | None, dict]], list[tuple[int, int, float | None, dict]]]:
    """Nodes (id, label, properties) and edges (source, target, weight, properties) of a network block."""
    nodes, edges = [], []
    for c in nexus_blocks(text).get("network", []):
        key = c[0].lower()
        if key not in ("vertices", "edges"):
            continue
        entry: dict[str, str] = {}

        def close(entry=entry, key=key):
            if not entry:
                return
            low = {k.lower(): v for k, v in entry.items()}
            rest = {k: v for k, v in entry.items() if k.lower() not in ("id", "label", "sid", "tid", "weight")}
            if key == "vertices":
                nodes.append((int(low["id"]), low.get("label"), rest))
            else:
                edges.append((int(low["sid"]), int(low["tid"]), float(low["weight"]) if "weight" in low else None, rest))
            entry.clear()

        words, i = c[1:-1], 0
        while i < len(words):
            if words[i] == ",":
                close()
            elif i + 2 < len(words) and words[i + 1] == "=":
                entry[words[i]] = _plain(words[i + 2])
                i += 2
            i += 1
        close()
    return nodes, edges


_COMMENT, _MARK, _MATRIX = re.compile(r"\[[^\]]*\]"), re.compile("[';,]"), re.compile(r"\s*matrix(?!\w)", re.I)


def _without_comments(chunks: Iterable[str]) -> Iterator[str]:
    """Chunks of a text with comments in brackets dropped; one that is open at a chunk's end is held until it is closed."""
    held: list[str] = []
    for c in chunks:
        if held:
            if "]" not in c:
                held.append(c)
                continue
            c, held = "".join([*held, c]), []
        c = _COMMENT.sub(" ", c)
        if (at := c.find("[")) >= 0:
            held, c = [c[at:]], c[:at]
        if c:
            yield c
    if held:
        yield "".join(held)


def nexus_genome_rows(chunks: Iterable[str]) -> Iterator[tuple[int, str | None, bool, bool, bool, str]]:
    """(place from 0, label in the taxa block, labels, accessions, multipart, text) of each row of a genomes matrix.

    ``chunks`` are a file's text in order, cut anywhere. One row is held at a time, and the labels of a taxa block; rows without
    labels of their own wait for a taxa block behind them.
    """
    name, taxa, flags, n = None, None, (False, False, False), 0
    part: list[str] = []
    matrix, quote, before = None, False, " "
    waiting: list[tuple] = []

    def row(text):
        nonlocal n
        if text.strip():
            n += 1
            if taxa is None and not flags[0]:
                waiting.append((n - 1, flags, text))
            else:
                yield n - 1, taxa[n - 1] if taxa and n <= len(taxa) else None, *flags, text

    def command(text):
        nonlocal name, taxa, flags
        words = NEXUS.findall(text)
        if words and words[0].lower() == "#nexus":
            words = words[1:]
        key = words[0].lower() if words else ""
        if key == "begin":
            name = words[1].lower()
        elif key in ("end", "endblock"):
            name = None
        elif name == "taxa" and key == "taxlabels" and taxa is None:
            taxa = [_plain(w) for w in words[1:]]
        elif name == "genomes" and key == "format":
            options = nexus_options(words[1:])
            flags = tuple(options.get(k, "no").lower() in ("yes", "true") for k in ("labels", "accessions", "multipart"))

    for chunk in chain(_without_comments(chunks), [None]):
        if chunk is None:  # the end of the text ends a command, within quotes too
            quote, chunk = False, ";"
        start = 0
        for m in _MARK.finditer(chunk):
            i, c = m.start(), m[0]
            if c == "'":
                quote = not quote and not (chunk[i - 1] if i else before).isalnum()
            elif not quote and (c == ";" or name == "genomes" and matrix is not False):
                text = "".join([*part, chunk[start:i]])
                if matrix is None:
                    head = _MATRIX.match(text) if name == "genomes" else None
                    matrix = head is not None
                    if not matrix and c == ",":
                        continue
                    text = text[head.end() :] if matrix else text
                yield from row(text) if matrix else command(text) or ()
                part, start = [], i + 1
                matrix = None if c == ";" else matrix
        part.append(chunk[start:])
        before = chunk[-1]
    for i, f, text in waiting:
        yield i, taxa[i] if taxa and i < len(taxa) else None, *f, text


def nexus_genome(label: str | None, labels: bool, accessions: bool, multipart: bool, text: str) -> tuple[str | None, str | None, int, list[tuple[str | None, int | None, int, str | None]]]:
    """(label, accession, length, parts) of a row of a genomes matrix, a part being (file, offset, length, sequence)."""
    w, at = re.findall(r"'(?:[^']|'')*'|\S+", text), 0
    if labels:
        label, at = _plain(w[0]), 1
    accession = None
    if accessions:
        accession, at = _plain(w[at]), at + 1
    length, at = int(w[at]), at + 1
    n = 1
    if multipart:
        n, at = int(w[at]), at + 1
    parts = []
    for _ in range(n):
        size = length
        if multipart:
            size, at = int(w[at]), at + 1
        x, at = _plain(w[at]), at + 1
        if x.lower().startswith("file:"):
            parts.append((re.sub(r"^file:(//)?", "", x, flags=re.I), int(w[at]), size, None))
            at += 1
        else:
            parts.append((None, None, size, x))
    return label, accession, length, parts


def nexus_genomes(text: str) -> list[tuple[str | None, str | None, int, list[tuple[str | None, int | None, int, str | None]]]]:
    """(label, accession, length, parts), a part being (file, offset, length, sequence)."""
    return [nexus_genome(*r[1:]) for r in nexus_genome_rows([text])]


_SPLIT_TOKEN = re.compile(r"<\d+\||\|\d+(?::[0-9eE.+-]+)*>|'(?:[^']|'')*'|[(),;]|:[0-9eE.+-]+|[^(),;:<>|']+")


def split_newick(text: str) -> tuple[list[str], list[tuple[list[int], float]]]:
    """Leaf labels in order, and splits (places of leaves from 0, weight) of a Newick tree with marks ``<k|`` ... ``|k:weight>``.

    The leaves from the one behind ``<k|`` to the one before ``|k>`` are a side of split k; the tree's edges are the other splits.
    """
    leaves: list[str] = []
    splits: list[tuple[list[int], float]] = []
    open_at: dict[str, int] = {}
    stack: list[int] = []
    last: tuple[int, int] | None = None
    for t in _SPLIT_TOKEN.findall(text.strip()):
        if t == "(":
            stack.append(len(leaves))
            last = None
        elif t == ")":
            if not stack:
                raise FormatError("unbalanced parentheses")
            last = (stack.pop(), len(leaves))
        elif t in ",;":
            if last and last not in _seen(splits):
                splits.append((list(range(*last)), 0.0))
            last = None
        elif t.startswith("<"):
            open_at[t[1:-1]] = len(leaves)
        elif t.startswith("|"):
            k, *values = t[1:-1].split(":")
            if k not in open_at:
                raise FormatError(f"split {k} ends without a start")
            splits.append((list(range(open_at.pop(k), len(leaves))), float(values[0]) if values else 1.0))
        elif t.startswith(":"):
            if last:
                splits.append((list(range(*last)), float(t[1:])))
                last = None
        elif t.strip() and (last is None or last[1] - last[0] == 0):
            leaves.append(_plain(t.strip()))
            last = (len(leaves) - 1, len(leaves))
    if stack or open_at:
        raise FormatError("unbalanced parentheses or splits")
    total: dict[tuple[int, ...], float] = {}
    n = len(leaves)
    for side, w in splits:
        side = side if 0 not in side else [i for i in range(n) if i not in set(side)]
        if side:
            total[tuple(side)] = total.get(tuple(side), 0.0) + w
    return leaves, [(list(k), w) for k, w in total.items()]


def _seen(splits) -> set[tuple[int, int]]:
    return {(s[0], s[-1] + 1) for s, _ in splits if s}


def sniff(text: str) -> str:
    """Name of the format, by the first line."""
    first = next((x.strip() for x in text.splitlines() if x.strip()), "")
    low = first.lower()
    if low.startswith("#nexus"):
        return "nexus"
    if first.startswith(">"):
        return "fasta"
    if low.startswith("clustal"):
        return "clustal"
    if low.startswith("# stockholm"):
        return "stockholm"
    if low.startswith(("graph [", "graph[")) or low == "graph":
        return "gml"
    if low.startswith("<?xml") or low.startswith("<nex"):
        return "nexml"
    if "msf:" in low or low.startswith(("!!", "pileup")):
        return "msf"
    if first.startswith("("):
        return "split_newick" if re.search(r"<\d+\|", first) else "newick"
    p = first.split()
    if len(p) == 2 and all(x.isdigit() for x in p):
        return "phylip"
    if len(p) == 1 and p[0].isdigit():
        return "phylip_distances"
    return "csv_distances" if "," in first or "\t" in first else "unknown"
