"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A long text is cut where the splitting pattern always ends a match, so that the
library sees bounded strings and the ids are those of the whole text. Decoding
joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidepanel.llm import shared

# A text of more characters is cut at the first safe place after this many.
PIECE_CHARS = 1 << 16

# A match of the pattern that holds a letter goes on with letters only, so it ends here.
SAFE_CUT = regex.compile(r"(?<=\p{L})(?!\p{L})")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that tokenise independently.

    A text without any safe place is one piece.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    if start < len(text):
        yield text[start:]


def encode_text(encoding: tiktoken.Encoding, text: str, size: int = PIECE_CHARS) -> list[int]:
    ids: list[int] = []
    for piece in safe_pieces(text, size):
        ids += encoding.encode_ordinary(piece)
    return ids


def encode(df: DataFrame, ranks_path: str, pattern: str, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``kept``, ``ids`` (array of int) and ``decoded`` (binary) of column ``text``.

    ``decoded`` is made from the ids alone. Special tokens are ordinary text;
    null counts as empty and gives no ids and no bytes. The rank file is read on
    the driver and sent to the tasks, so only the driver needs it.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = shared.fields(df, kept, ("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType()))

    def start():
        encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})

        def step(batch):
            values, ends, decoded = array("i"), [0], []
            for text in shared.texts_of(batch):
                ids = encode_text(encoding, text)
                values.extend(ids)
                ends.append(len(values))
                decoded.append(encoding.decode_bytes(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            columns = [*[batch.column(c) for c in kept], lists, pa.array(decoded, pa.binary())]
            return pa.record_batch(columns, schema.names)

        return step

    return shared.map_batches(df.select(*kept, "text"), start, schema)
