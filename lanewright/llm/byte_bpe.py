"""Byte-level BPE encoding and decoding with a local rank file.

Every match of the split pattern is merged by the ranks on its own, without special tokens.  A long text
is cut first, at places where the pattern always starts a new match, so that one call of the
tokenizer never holds more than about one piece.  A cut is safe between an ASCII letter, digit or common mark and
a following ASCII space or line end: no alternative of the pattern runs from a character that is not white space into one
that is, and its look-ahead only concerns runs of white space, which stay whole on the right of the cut.

Null is the empty text, and the empty text has no ids.  A text without a safe place is encoded whole.  Rows are
independent: repeated rows, ties and empty tables need no care.  Only the named key columns are kept, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewright.llm.common import keyed, short_batches, text_of, with_arrow_column

#: Characters of one piece of a long text, at least.
PIECE = 1 << 16
SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The tokenizer of a rank file, loaded once in each Python worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in order, cut at the first safe place after every ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = PIECE) -> np.ndarray:
    parts = [np.asarray(enc.encode_ordinary(piece), dtype=np.int32) for piece in pieces(text, size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _int_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))


def encode(docs: DataFrame, rank_file: str, keys: list[str], text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """``keys`` and ``ids``, the token ids of each whole text (array of int)."""
    short_batches(docs.sparkSession)
    rows, names = keyed(docs, keys, _text=text_of(text))

    def convert():
        enc = encoding(rank_file, pattern)
        return lambda texts: _int_lists([encode_text(enc, x) for x in texts])

    made = with_arrow_column(rows, "_text", "ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), convert)
    return made.withColumnsRenamed(names)


def decode(tokens: DataFrame, rank_file: str, keys: list[str], ids: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """``keys``, ``ids`` and ``raw``: the bytes that the ids stand for, whether or not they are valid UTF-8.

    Null ids decode to no bytes.  An id outside the rank file is an error.
    """
    short_batches(tokens.sparkSession)
    empty = F.array().cast("array<int>")
    rows, names = keyed(tokens, keys, _ids=F.coalesce(F.col(ids), empty))
    names["_kept"] = "ids"

    def convert():
        enc = encoding(rank_file, pattern)
        return lambda lists: [enc.decode_bytes(x) for x in lists]

    made = with_arrow_column(rows.withColumn("_kept", F.col("_ids")), "_ids", "raw", T.BinaryType(), pa.binary(), convert)
    return made.withColumnsRenamed(names)
