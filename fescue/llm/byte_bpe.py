"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of more characters are encoded in pieces of about this many.
LONG = 200_000
#: Texts, in bytes, that go back to Spark in one batch.
BATCH = 8 << 20
#: A rank file is sent to every executor, so it may not be larger than this.
MOST_RANK_BYTES = 64 << 20

_built: dict = {}


def _encoding(ranks: bytes, pattern: str):
    """Built once in each worker."""
    import tiktoken

    key = (hash(ranks), pattern)
    if key not in _built:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _built[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _built[key]


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """The text in pieces that encode as they do within it: a piece ends after a letter or digit that a space or line
    feed follows. No match of a byte-level pattern holds white space behind anything else, so one ends there in any case."""
    start = 0
    while len(text) - start > long:
        at = start + long
        while at < len(text) and not (text[at] in " \n" and text[at - 1].isalnum()):
            at += 1
        yield text[start:at]
        start = at
    yield text[start:]


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text) for i in enc.encode_ordinary(piece)]


def byte_bpe(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with ids (array of int) and decoded (binary: the bytes the ids stand for), replaced where docs has such.

    Every text is encoded whole, null as the empty one, without special tokens: their strings are ordinary text. Rows
    are independent; other columns pass unchanged."""
    ranks = open(rank_path, "rb").read()
    if len(ranks) > MOST_RANK_BYTES:
        raise ValueError(f"{rank_path} has {len(ranks)} bytes; {MOST_RANK_BYTES} is the most")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    names = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded_col, T.BinaryType(), False)])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(sent.value, pattern)
        for batch in batches:
            start, held, ids, decoded = 0, 0, [], []
            for k, text in enumerate(batch.column(at)):
                ids.append(found := encode_text(enc, text.as_py() or ""))
                decoded.append(enc.decode_bytes(found))
                held += len(decoded[-1])
                if held > BATCH or k == batch.num_rows - 1:
                    cols = [batch.column(i).slice(start, len(ids)) for i in range(batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], names=[*names, ids_col, decoded_col])
                    start, held, ids, decoded = k + 1, 0, [], []

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
