"""Token counts of texts by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks file of a byte-level BPE; must exist at this path on every executor.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern that belongs to these ranks (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space as the pattern has it, in runs so long that its look-ahead would run out of stack.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def count_tokens(enc, text: str, blanks: re.Pattern = _BLANKS) -> int:
    """Tokens of the whole text, of any length; the encoder merges long pre-tokens in n log n steps.

    By the pattern a run of white space is one pre-token without its last character, which begins the next one, or with it at
    the end of the text. Long runs are cut out by this rule, so the count is the encoder's.
    """
    n, at = 0, 0
    for m in blanks.finditer(text):
        n += len(enc.encode_ordinary(text[at : m.start()]))
        at = m.end() if m.end() == len(text) else m.end() - 1
        n += len(enc._encode_single_piece(text[m.start() : at]))
    return n + len(enc.encode_ordinary(text[at:]))


def with_token_counts(df: DataFrame, id_col: str, text_col: str, *keep: str, path: str = RANKS) -> DataFrame:
    """``id, n_tokens`` and the columns in ``keep``; a null text has 0 tokens. One narrow pass, texts do not leave it."""
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *keep)
    kinds = ", ".join(["id bigint", "n_tokens int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or encoder(path)
            n = []
            for t in b.column(1):
                t = t.as_py()
                n.append(count_tokens(enc, t.encode("utf-8", "replace").decode()) if t else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), *b.columns[2:]], ["id", "n_tokens", *b.schema.names[2:]])

    return src.mapInArrow(run, kinds)
