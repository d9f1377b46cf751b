"""Best-fit packing after Martello-Toth dominance reduction (operator 8).

Lengths are whole numbers up to the capacity, so the instance is its counts by length, whatever the number of documents.
The reduction fixes sets that provably dominate every other set holding their largest piece (exact partners; the best
single partner where no two fit; the best two where no three fit), shrinks the counts and repeats; best fit by falling
length packs what remains. Sequences are runs of equal patterns; pieces take their places by their rank within a length.

Null and empty texts are the end token alone. Repeated rows are packed each; pieces of one length are alike, so ties among them
go by a hash of key, place and ids, and rows that agree in all of it take each other's places. Null keys are ordinary. Empty
tables give no rows. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.bpe import byte_symbols
from weftgraph.llm.common import portions, ranked, stored, table

CAPACITY = 2048
#: Fixed by the contract: the id that ends a document.
END = 0

#: A pattern: (length, copies) runs, and how many sequences have it.
Pattern = tuple[tuple[tuple[int, int], ...], int]

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """A byte-level tokenizers file as ranks, which are its ids: merges make ids in order. A special string inside a text is its id."""
    if path not in _ENCODINGS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("the vocabulary's ids don't follow its merges")
        as_byte = byte_symbols()
        ranks = {bytes(as_byte[c] for c in s): i for s, i in vocab.items()}
        _ENCODINGS[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODINGS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all are full but the first."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, piece, start, length and ids_crc32 of every piece of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for b in portions(batches, 1):
            rows, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.append(e.encode_to_numpy(t or "", allowed_special="all"), END).astype("<u4")
                own = cut(len(ids), capacity)
                rows += [i] * len(own)
                out += [(n, s, k, zlib.crc32(ids[s : s + k].data)) for n, (s, k) in enumerate(own)]
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], [key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


class Counts:
    """Pieces left by length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for k, v in counts.items():
            self.n[k] = v

    def take(self, *lengths: int) -> int:
        """As many whole sets of these lengths as there are."""
        return min(int(self.n[k]) // lengths.count(k) for k in lengths)

    def without(self, *lengths: int) -> np.ndarray:
        out = self.n.copy()
        for k in lengths:
            out[k] -= 1
        return out


def largest(n: np.ndarray, most: int) -> int:
    """The greatest length present that is at most most; 0 if there is none."""
    found = np.flatnonzero(n[1 : most + 1] > 0) if most > 0 else ()
    return int(found[-1]) + 1 if len(found) else 0


def smallest_sum(n: np.ndarray, k: int) -> int:
    """The sum of the k smallest pieces; beyond any capacity if there are fewer."""
    total = 0
    for length in np.flatnonzero(n > 0):
        got = min(k, int(n[length]))
        total, k = total + got * int(length), k - got
        if not k:
            return total
    return 1 << 60


def dominant(c: Counts, top: int, capacity: int) -> tuple[int, ...]:
    """A set with top, the largest piece in it, that dominates all other sets with top; empty if none is known.

    Every feasible set can be exchanged for it piece by piece: no partner in it is smaller than the one it replaces.
    """
    room, rest = capacity - top, c.without(top)
    first = largest(rest, room)
    if not first:
        return (top,)
    if first == room or smallest_sum(rest, 2) > room:
        return top, first
    if smallest_sum(rest, 3) > room:  # at most two partners
        rest[first] -= 1
        second = largest(rest, room - first)
        rest[first] += 1
        half = largest(rest, room // 2)  # no smaller partner of two can be larger than this
        if second and second >= half:
            return top, first, second
    return ()


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns fixed by dominance, and the counts that remain."""
    c, fixed, changed = Counts(counts, capacity), [], True
    while changed:
        changed = False
        for top in range(capacity, 0, -1):
            while c.n[top] > 0 and (own := dominant(c, top, capacity)):
                times = c.take(*own)
                for k in own:
                    c.n[k] -= times
                fixed.append((tuple((k, own.count(k)) for k in dict.fromkeys(own)), times))
                changed = True
    return fixed, {k: int(v) for k, v in enumerate(c.n) if v}


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit by falling length, a whole length at a time: a piece goes to the fullest sequence that has room for it."""
    open_: list[list[tuple[tuple[tuple[int, int], ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in range(length, capacity):
            fit, groups = room // length, open_[room]
            while left and groups:
                runs, have = groups.pop()
                full = min(have, left // fit)
                if full:
                    open_[room - fit * length].append(((*runs, (length, fit)), full))
                    left, have = left - full * fit, have - full
                if have and 0 < left < fit:
                    open_[room - left * length].append(((*runs, (length, left)), 1))
                    left, have = 0, have - 1
                if have:
                    groups.append((runs, have))
            if not left:
                break
        fit = capacity // length
        if left // fit:
            open_[capacity - fit * length].append((((length, fit),), left // fit))
        if left % fit:
            open_[capacity - left % fit * length].append((((length, left % fit),), 1))
    return [x for groups in open_ for x in groups]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduced(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(plan: list[Pattern]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """By length: the ranks at which runs of places begin, and each run's first sequence, copies in a sequence and offset."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for runs, times in plan:
        offset = 0
        for length, copies in runs:
            begins, own = out.setdefault(length, ([], []))
            begins.append(used.get(length, 0))
            own.append((sequence, copies, offset))
            used[length] = used.get(length, 0) + times * copies
            offset += length * copies
        sequence += times
    return out


def packed(parts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """pieces() with sequence_id and offset. To the driver go the counts by length, at most capacity rows; the plan's size
    is bounded by the capacity alone and is broadcast."""
    parts = stored(parts, "pieces")
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(places(packing_plan(counts, capacity)))
    spread = parts.withColumn("_spread", F.xxhash64(key, "piece", "ids_crc32"))
    numbered = ranked(spread, "length", "_spread", sum(counts.values()), "_rank").drop("_spread")
    names = numbered.columns
    at_length, at_rank = names.index("length"), names.index("_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = plan.value
        for b in batches:
            sequences, offsets = [], []
            for length, rank in zip(b.column(at_length).to_pylist(), b.column(at_rank).to_pylist(), strict=True):
                begins, own = where[length]
                n = bisect_right(begins, rank) - 1
                sequence, copies, offset = own[n]
                step, copy = divmod(rank - begins[n], copies)
                sequences.append(sequence + step)
                offsets.append(offset + copy * length)
            keep = [i for i in range(len(names)) if i != at_rank]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], [*(names[i] for i in keep), "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("_rank").schema)
    return numbered.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
