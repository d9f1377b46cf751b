"""Byte-level BPE encoding and decoding (operator 3).

Bytes become Latin-1 characters, so pyahocorasick matches the whole vocabulary; encoding backtracks from the longest
matches with memoised compatibility of adjacent tokens (see bpe.Bpe). Pieces are memoised too, within a bound.

Texts are read a stretch at a time, cut where no piece goes on, so a long text needs no list of all its pieces.

Null and empty texts have no tokens. Repeated rows and null keys each give a row; equal matches don't occur, as a vocabulary
holds a string once. Empty tables give no rows. Columns other than the two named are not read, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.bpe import Bpe, Pieces, ranks_class, stretches
from weftgraph.llm.common import portions, table

#: Pieces a worker memoises at most; results don't depend on it.
MEMO = 300_000


class Codec(dict):
    """piece of text to its ids as little-endian unsigned 32-bit integers; filled as pieces come."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.bpe, self.pieces = Bpe.from_ranks(path), Pieces(pattern, ranks_class)
        self.tokens = [b""] * (max(self.bpe.texts) + 1)
        for i, s in self.bpe.texts.items():
            self.tokens[i] = s.encode("latin-1")

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        out = np.array(self.bpe.encode(piece.encode().decode("latin-1")), "<u4").tobytes()
        if len(piece) < 200:
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(self[piece] for part in stretches(text) for piece in self.pieces(part))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """One codec for each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ids, an array of the token ids of the whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in portions(batches, 1):
            ids = [np.frombuffer(c.encode(t or ""), "<u4").astype(np.int32) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and data, the bytes that the ids stand for (null ids: none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            data = [b"".join(map(c.tokens.__getitem__, x or [])) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], [key, "data"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, data binary")


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256: encode and decode in one pass, without sending ids through Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in portions(batches, 1):
            n, ids_sha, data_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t or "")
                n.append(len(ids) // 4)
                ids_sha.append(sha256(ids).hexdigest())
                data_sha.append(sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
