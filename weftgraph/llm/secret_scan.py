"""Secret scans (operator 2).

Three fixed kinds are found by pattern. The method adds a fourth: in candidate strings, runs of one character class are
read by a sliding window whose Shannon entropy is kept by incremental counts; windows over the class's threshold join to
a span, unless a fixed span already covers it. Windows that overlap a match of the allow list are not read; the rest of the
candidate is.

Work grows with a text's length alone: what a span lies in is looked up among sorted spans.

Null and empty texts have no spans. Repeated rows and null keys each give a row. Offsets are code points, ends exclusive.
Empty tables give no rows. Only the named columns are read, so others may have any name; redacted() keeps them all.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import portions, table

#: Fixed patterns of the contract, with the least length of what counts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of [0-9a-f]+ that are long enough
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: The assign pattern needs one of these after the word.
MARKS = re.compile("[:=]")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class CharClass:
    """window: characters read together; bits: least entropy per character; needs: a window must match all of these."""

    name: str
    run: str
    window: int
    bits: float
    needs: tuple[str, ...]


CLASSES = (
    CharClass("hex", r"[0-9A-Fa-f]{24,}", 24, 3.0, (r"[0-9]", r"[A-Fa-f]")),
    CharClass("base64", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.7, (r"[0-9]", r"[a-z]", r"[A-Z]")),
    CharClass("base36", r"[a-z0-9]{20,}", 20, 3.6, (r"(?:[0-9][^0-9]*){3}", r"[a-z]")),
    CharClass("base32", r"[A-Z0-9]{20,}", 20, 3.6, (r"(?:[0-9][^0-9]*){2}", r"[A-Z]")),
)
#: A run of letters and digits with one of these is made up as a whole.
MADE_UP = re.compile(r"(?i)example|sample|dummy|placeholder|changeme")
WORD = re.compile(r"[A-Za-z0-9]+")
#: Searched in the text from a candidate's start to its end; what stands before it can be looked at.
ALLOW = (
    r"(?i)xxxx",
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    r"(?i)abcdefghij|0123456789",
    r"(?<=:)//[A-Za-z0-9_-]*|(?:/[a-z_-]{2,}){3,}",
    r"(?<![A-Za-z0-9+/_=-])[A-Za-z]+(?![A-Za-z0-9+/_=-])",
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed kinds, by start and then kind as listed."""
    out = []
    if MARKS.search(text):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def hot_windows(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined spans of windows with at least so many bits a character; each step changes two counts.

    With counts c that sum to w, the entropy is log2 w - sum(c log2 c) / w; the sum is kept up to date.
    """
    if len(s) < window:
        return []
    cost = [0.0, *(c * log2(c) for c in range(1, window + 1))]
    counts: dict[str, int] = {}
    total, most = 0.0, (log2(window) - bits) * window + 1e-9
    out: list[tuple[int, int]] = []
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        total += cost[k + 1] - cost[k]
        counts[c] = k + 1
        if i >= window:
            gone = s[i - window]
            k = counts[gone]
            total += cost[k - 1] - cost[k]
            counts[gone] = k - 1
        if i >= window - 1 and total <= most:
            begin = i - window + 1
            if out and begin <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((begin, i + 1))
    return out


class Cover:
    """Whether a stretch lies in one of some spans: those that begin no later, by the furthest of their ends."""

    def __init__(self, spans: list[tuple[int, int]]):
        own = sorted(spans)
        self.starts, self.ends = [s for s, _ in own], list(accumulate((e for _, e in own), max))

    def add(self, start: int, end: int) -> None:
        """A span that begins no earlier than those before it."""
        self.starts.append(start)
        self.ends.append(max(end, self.ends[-1] if self.ends else 0))

    def holds(self, start: int, end: int) -> bool:
        n = bisect_right(self.starts, start)
        return n > 0 and self.ends[n - 1] >= end


def outside(spans: list[tuple[int, int]], start: int, end: int) -> Iterator[tuple[int, int]]:
    """The stretches from start to end that no span touches; spans are sorted."""
    for s, e in [*spans, (end, end)]:
        if s > start:
            yield start, s
        start = max(start, e)


class Scanner:
    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
        self.classes = [(c, re.compile(c.run), [re.compile(n) for n in c.needs]) for c in classes]
        self.allow = [re.compile(a) for a in allow]

    def entropy_spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        fixed = Cover([(s, e) for s, e, _ in base])
        for m in CANDIDATE.finditer(text):
            found_by: list[Cover] = []
            allowed = [x.span() for a in self.allow for x in a.finditer(text, *m.span())]
            if MADE_UP.search(text, *m.span()):
                allowed += [x.span() for x in WORD.finditer(text, *m.span()) if MADE_UP.search(x.group())]
            allowed.sort()
            for c, run, needs in self.classes:
                own = Cover([])
                for r in (r for part in outside(allowed, *m.span()) for r in run.finditer(text, *part)):
                    for s, e in hot_windows(r.group(), c.window, c.bits):
                        found = r.group()[s:e]
                        s, e = r.start() + s, r.start() + e
                        if all(n.search(found) for n in needs) and not any(x.holds(s, e) for x in (fixed, *found_by)):
                            out.append((s, e, "entropy"))
                            own.add(s, e)
                found_by.append(own)
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        base = base_spans(text)
        return sorted([*base, *self.entropy_spans(text, base)], key=lambda x: (x[0], (*KINDS, "entropy").index(x[2]), x[1]))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """text with each stretch of overlapping spans replaced by mark."""
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """key and spans, an array of (start, end, kind) over the whole text."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow)
        for b in portions(batches, 1):
            rows = [[{"start": s, "end": e, "kind": k} for s, e, k in scanner.spans(t)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], [key, "spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, spans array<struct<start:long,end:long,kind:string>>")


def redacted(docs: DataFrame, text: str = "text", size: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mark (null stays null); size, if it is a column, follows the new text. All other columns stay as they are."""
    at = docs.columns.index(text)
    at_size = docs.columns.index(size) if size in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in portions(batches, at):
            texts, changed = b.column(at).to_pylist(), False
            sizes = b.column(at_size).to_pylist() if at_size is not None else None
            for i, t in enumerate(texts):
                if t and (spans := scanner.spans(t)):
                    texts[i], changed = redact(t, spans, mark), True
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            if changed:
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
                if sizes is not None:
                    b = b.set_column(at_size, b.schema.field(at_size), pa.array(sizes, b.schema.field(at_size).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests, from the operator's spans."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    joined_sql = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined_sql(base), 256).alias("base_sha256"), joined_sql(F.col("spans")).alias("spans"))
