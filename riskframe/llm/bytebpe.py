"""Byte-level BPE encoding and decoding with a local rank file.

The tiktoken library splits a text by the pattern and merges the bytes of each
match by rank.  Its matcher gives up on very long white space, and a long text
would be one call, so texts beyond ``LONG`` characters are cut first at places
no match of the pattern spans: before ASCII white space, and between ASCII
letters, digits and punctuation in the orders that ``CUT`` lists.  A stretch of
``BLANKS`` or more white space is taken by the pattern's own rule: all of it at
the end of the text, else all but its last character, which the next match may
take.  Decoding joins the raw bytes of the ids.

Cases: a null or empty text has no ids and decodes to no bytes, and so do null
ids; texts of any length are encoded whole; equal texts get equal ids; an empty
table gives an empty result; further columns pass through, and one named like a
result is replaced by it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskframe.llm.common import col, map_arrow, slices, with_columns_from

#: Characters from which a text is cut, and the least a cut-off part has.
LONG = 65_536
#: White space characters in a row that the matcher does not get to see.
BLANKS = 4_096
#: Coded rows decoded together.
ROWS = 512

#: Between these characters every match ends: whatever stands before white space,
#: and neighbours of unlike kind, but for punctuation before a letter ('s).
CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9!-&(-/:-@\[-`{-~])"
                 r"|(?<=[0-9])(?=[A-Za-z!-&(-/:-@\[-`{-~])")
#: White space as the pattern knows it (Unicode White_Space).
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
               0x202F, 0x205F, 0x3000]
LONG_BLANK = re.compile(f"[{''.join(map(chr, WHITE_SPACE))}]{{{BLANKS},}}")


def default_ranks() -> str:
    """File of the public multilingual byte-level ranks of this machine."""
    from public_tokenizers import path
    return path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    """The pattern that goes with the public rank files."""
    from public_tokenizers import PATTERN
    return PATTERN


def load_encoding(ranks: str, pattern: str):
    """The library's encoder for a rank file (base64 token, rank per line)."""
    import tiktoken
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def cut(text: str, long: int = LONG) -> Iterator[str]:
    """``text`` in parts of ``long`` characters or little more, cut between matches."""
    at = 0
    while len(text) - at > long:
        found = CUT.search(text, at + long)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def encode_text(encoding, text: str, long: int = LONG) -> list[int]:
    """Ids of a text of any length."""
    if len(text) <= long:
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for blank in LONG_BLANK.finditer(text):
        end = blank.end() if blank.end() == len(text) else blank.end() - 1
        for part in cut(text[at:blank.start()], long):
            ids += encoding.encode_ordinary(part)
        ids += encoding._encode_single_piece(text[blank.start():end])
        at = end
    for part in cut(text[at:], long):
        ids += encoding.encode_ordinary(part)
    return ids


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None,
           ranks: str | None = None, pattern: str | None = None,
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus the token ids of ``text`` (array of int); with ``decoded``
    also what the ids decode to (binary), in the same pass.  ``keep`` names the
    columns that pass through, by default all."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        encoding = load_encoding(ranks, pattern)

        def work(texts: pa.Array) -> list[pa.Array]:
            coded = [encode_text(encoding, t) if t else [] for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
            flat = np.fromiter((i for c in coded for i in c), np.int32, int(ends[-1]))
            out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            if decoded is not None:
                out.append(pa.array([encoding.decode_bytes(c) for c in coded], pa.binary()))
            return out

        return work

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded is not None:
        fields.append(T.StructField(decoded, T.BinaryType()))
    return with_columns_from(docs, text, fields, start, keep)


def decode(coded: DataFrame, ids: str = "ids", decoded: str = "decoded",
           ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``coded`` without ``ids``, plus the bytes its ids stand for."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    names = [c for c in coded.columns if c != ids and c.lower() != decoded.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks, pattern)
        for batch in batches:
            for part in slices(batch, ROWS):
                raw = [encoding.decode_bytes(x or []) for x in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(names)], pa.array(raw, pa.binary())],
                    [f"c{i}" for i in range(len(names) + 1)])

    types = [coded.schema[c].dataType for c in names] + [T.BinaryType()]
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    given = coded.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)],
                         col(ids).alias("ids"))
    return map_arrow(given, run, schema).toDF(*names, decoded)
