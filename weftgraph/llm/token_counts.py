"""Token counts by prefix dynamic programming (operator 9).

Of every prefix of a word the last token and the token count are kept (bpe.Bpe.prefix_counts); of a text, the running
count at every word. Counts, truncation to a budget and budget questions are then look-ups, without encoding again.

Texts are read a stretch at a time, cut where no word goes on.

Null and empty texts have 0 tokens. Repeated rows and null keys each give a row. Empty tables give no rows. Columns other than
the two named are not read, so they may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from weftgraph.llm.bpe import Bpe, Pieces, in_latin1, json_class, stretches
from weftgraph.llm.common import portions, table

MEMO = 300_000
LIMIT = 2048
#: Fixed values of the vocabulary word_bpe_49k.json: its split pattern and special strings.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")


def marked(word: str) -> str:
    """UTF-8 bytes as symbols, the last as a word end."""
    s = word.encode().decode("latin-1")
    return s[:-1] + chr(ord(s[-1]) + 256)


class Counter(dict):
    """word to its token count; filled as words come."""

    def __init__(self, path: str):
        super().__init__()
        self.bpe, self.pieces = Bpe.from_json(path), Pieces(PATTERN, json_class)
        self.normal = Tokenizer.from_file(path).normalizer

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self.bpe.prefix_counts(marked(word))[1][-1]
        if len(word) < 200:
            self[word] = out
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings, normalised by the library, which on Latin-1 only makes letters small."""
        return self.pieces(text.lower() if in_latin1(text) else self.normal.normalize_str(text))

    def count(self, text: str) -> int:
        if "<|" in text:
            return sum(1 if n % 2 else self._count(x) for n, x in enumerate(SPECIAL.split(text)))
        return self._count(text)

    def _count(self, text: str) -> int:
        return sum(self[word] for part in stretches(text) for word in self.words(part))

    def prefixes(self, text: str) -> tuple[list[str], list[int]]:
        """The words (special strings included) and the token count up to and with each of them."""
        words, counts = [], []
        for n, x in enumerate(SPECIAL.split(text)):
            own = [x] if n % 2 else self.words(x)
            words += own
            counts += [1] if n % 2 else map(self.__getitem__, own)
        return words, list(accumulate(counts))

    def word_prefix(self, word: str, size: int) -> int:
        """The token count of a word's first size bytes as a word: the stored count of what stands before its last token, and one."""
        if not size:
            return 0
        s = word.encode().decode("latin-1")[:size]
        last, count = self.bpe.prefix_counts(s)
        for k in range(size):  # the longest last token comes first; only one is compatible
            t = self.bpe.ids.get(s[k:-1] + chr(ord(s[-1]) + 256))
            if t is not None and (not k or last[k] >= 0 and self.bpe.compatible(last[k], t)):
                return count[k] + 1
        raise ValueError("the vocabulary lacks a byte")

    def fits(self, text: str, budget: int) -> int:
        """How many leading words stay within a budget of tokens."""
        return bisect_right(self.prefixes(text)[1], budget)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and over_limit of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in portions(batches, 1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def truncated(docs: DataFrame, path: str, budget: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, kept_words and kept_tokens: the most leading words within the budget, read off the prefix counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in portions(batches, 1):
            rows = []
            for t in b.column(1).to_pylist():
                words, counts = c.prefixes(t or "")
                k = bisect_right(counts, budget)
                rows.append((len(words), k, counts[k - 1] if k else 0))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], [key, "n_words", "kept_words", "kept_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, kept_words long, kept_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
