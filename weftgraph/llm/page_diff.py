"""HTML extraction by differencing with the page of the nearest URL (operator 6).

Pages of a host are ordered by URL path; a page's partner is the neighbour in that order whose path shares more with its own.
The two pages' lines are aligned by longest common subsequence, and lines that both have are deleted, as templates repeat from
page to page. Mark-up settles only what a partner can't: prose of a marked article stays though another page has it too
(articles quote the same passages), and lines marked up as navigation, notices, adverts, forms or comments go even where they
differ. All else is for differencing to decide: lines outside the article, and lines in it that are links or stand in no
element of prose.

Null and empty HTML gives an empty text. Null and odd URLs sort together as one host. A page's copies (the same lines) are
not its neighbours: the nearest pages of the host that differ are, so every copy keeps its text. A host whose pages are all
the same has no partners; of equally near neighbours the one before counts. Every row gives a row, repeated and null keys
too. Empty tables give no rows. Only the three named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from weftgraph.llm.common import PORTION_ROWS, portions, stored, table

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements whose lines are prose when they stand in a marked article.
PROSE = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is in these is not text at all, or never the article's.
GONE = frozenset("script style noscript template head iframe object svg canvas math audio video".split())
PARTS = frozenset("nav footer aside form button select textarea dialog menu option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark template parts.
HINTS = re.compile(
    r"(?:^|[-_ ])(?:ads?|adbox|adverts?|advertis(?:ing|ement)|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|cookie-?(?:bar|banner|notice)|consent|gdpr|notices?|notification|alert|disclaimer|popup|modal|overlay|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|rail|widget|footer|foot|masthead|topbar|toolbar|share|sharing|social|related|recommended|trending|popular|pagination|pager|skip)(?:$|[-_ ])",
    re.I,
)
#: These mark a page's head only outside its article.
HEAD = re.compile(r"(?:^| )(?:(?:site|page|main|global)[-_]?)?header(?:$| )", re.I)
MAIN_TAGS = frozenset(("article", "main"))
ITEMS, LISTS = frozenset(("li", "td", "th", "tr", "dt", "dd", "option")), frozenset(("ul", "ol", "table", "dl", "select", "tr"))
#: A comment is often an article of its own; it isn't the page's.
COMMENT = re.compile(r"(?:^|[-_ ])(?:comments?|comment-?(?:list|form|section|thread)|repl(?:y|ies)|responses?|respond|discussion|disqus|feedback)(?:$|[-_ ])", re.I)

#: Bits kept at once for a way back through an alignment.
TRACE = 1 << 24
#: HTML in a range of pages on average, most ranges, and sampled URLs a range that place their borders. Results don't hang on them.
RANGE_BYTES, MOST_RANGES, URLS = 16 << 20, 50_000, 10


class Open(NamedTuple):
    """An open element. state: plain, main, hint, template or gone, with what its ancestors say; silent: its text counts for nothing."""

    tag: str
    state: str
    inside: bool
    silent: bool


class Lines(HTMLParser):
    """lines: (text, zone), a line for each block that has text. Zones: main (prose of the article), inner (its other lines),
    plain (outside), template."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = [Open("", "plain", False, False)]
        self.count: Counter[str] = Counter()
        self.text: list[str] = []
        self.unlinked = False
        self.lines: list[tuple[str, str]] = []

    def flush(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            linked, self.text, self.unlinked = not self.unlinked, [], False
            state = self.open[-1].state
            if words and state != "gone":
                if state == "main" and (linked or self.holder() not in PROSE):
                    state = "inner"
                self.lines.append((words, "template" if state == "hint" else state))

    def holder(self) -> str:
        """The nearest open block."""
        return next((x.tag for x in reversed(self.open) if x.tag in BLOCKS or not x.tag), "")

    def pop(self, at: int) -> None:
        for x in self.open[at:]:
            self.count[x.tag] -= 1
        del self.open[at:]

    def shut(self, tag: str) -> None:
        """Close an element and what is left open in it."""
        if self.count[tag]:
            self.pop(next(i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag != "title":
                self.shut("head")
            self.shut_up_to("p", BLOCKS)
        elif tag == "body":
            self.shut("head")
        elif tag == "br":
            self.text.append(" ")
        if tag in ITEMS:
            self.shut_up_to(tag, LISTS - {tag})
        if tag in VOID:
            return
        named = {k: v or "" for k, v in attrs}
        marks = f"{named.get('class', '')} {named.get('id', '')}".strip()
        up, role = self.open[-1], named.get("role", "").lower()
        state = up.state
        if state not in ("gone", "template"):
            if tag in GONE:
                state = "gone"
            elif tag in PARTS or role in ROLES or "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")):
                state = "template"
            elif tag in MAIN_TAGS or role in ("main", "article") or named.get("itemprop") == "articleBody":
                state = "template" if COMMENT.search(marks) else "main"
            elif tag not in ("html", "body"):
                if COMMENT.search(marks):
                    state = "template"
                elif HINTS.search(marks) or not up.inside and (tag == "header" or HEAD.search(marks)):
                    state = "hint"
        # a marked element inside a block is no line of its own: its text goes, and the block's line goes on
        silent = state == "gone" or tag not in BLOCKS and (up.silent or state in ("template", "hint") and state != up.state) or up.silent and state == "template"
        self.open.append(Open(tag, state, up.inside or state == "main", silent))
        self.count[tag] += 1

    def shut_up_to(self, tag: str, ends: frozenset[str]) -> None:
        """Close the nearest such element, unless one of ends is nearer: a block ends a paragraph, an item its open sibling."""
        for i in range(len(self.open) - 1, 0, -1) if self.count[tag] else ():
            if self.open[i].tag == tag:
                self.pop(i)
                return
            if self.open[i].tag in ends:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.shut(tag)

    def handle_data(self, data: str) -> None:
        if not self.open[-1].silent:
            self.text.append(data)
            self.unlinked = self.unlinked or not self.count["a"] and not data.isspace()


def page_lines(page: str | None) -> list[tuple[str, str]]:
    parser = Lines()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.lines


def row_masks(a: list[int]) -> dict[int, int]:
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of b with every prefix of a, by one bit-parallel row (a bit is 0 where it grows)."""
    where, full = row_masks(a), (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(a) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Indexes of a's lines in a longest common subsequence with b. Memory grows with the lines, not their product: b is halved
    where a parts best until the rows kept for a way back take at most TRACE bits."""
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    out: set[int] = set()
    todo = [(at, [x for x in b if x in both])]
    while todo:
        own, other = todo.pop()
        if own and other:
            x = [a[i] for i in own]
            if len(own) * len(other) <= TRACE or len(other) == 1:
                out.update(own[i] for i in traced(x, other))
            else:
                half = len(other) // 2
                k = int((prefix_lengths(x, other[:half]) + prefix_lengths(x[::-1], other[half:][::-1])[::-1]).argmax())
                todo += [(own[:k], other[:half]), (own[k:], other[half:])]
    return out


def traced(a: list[int], b: list[int]) -> set[int]:
    """common_lines() with all rows kept."""
    where, full = row_masks(a), (1 << len(a)) - 1
    row, rows = full, []
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out, i, j = set(), len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if j and not rows[j - 1] >> (i - 1) & 1:
                continue
            out.add(i - 1)
            i -= 1
    return out


def main_text(lines: list[tuple[str, str]], partner: list[int] | None) -> str:
    """What stays of a page's lines. partner: hashes of the partner's lines that aren't prose of its article.

    The article's prose stays, and of all other unmarked lines those that the partner lacks. With nothing to compare, a marked
    article that is at least as long as the unmarked lines is taken for the whole.
    """
    shared: set[int] = set()
    if partner:
        shared = common_lines([line_hash(t) for t, _ in lines], partner)
    sizes = Counter()
    for t, z in lines:
        sizes["plain" if z == "plain" else "main" if z != "template" else z] += len(t)
    trusted = not partner and sizes["main"] >= sizes["plain"]
    return "\n".join(t for i, (t, z) in enumerate(lines) if z == "main" or i not in shared and (z == "inner" or z == "plain" and not trusted))


#: A page's path and the hashes of its lines that aren't prose of its article.
Neighbour = tuple[str, list[int]]


class Page(NamedTuple):
    host: str
    path: str
    lines: list[tuple[str, str]]
    print: bytes


def line_hash(text: str) -> int:
    return xxh3_64_intdigest(text) - (1 << 63)


def shared_path(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def nearer(path: str, before: Neighbour | None, after: Neighbour | None) -> Neighbour | None:
    """The neighbour to difference with; the one before if both are as near."""
    return after if before is None or after is not None and shared_path(path, after[0]) > shared_path(path, before[0]) else before


def packed_lines(lines: list[tuple[str, str]]) -> bytes:
    return zstandard.compress("\n".join(z[0] + t for t, z in lines).encode())


ZONES = {"m": "main", "i": "inner", "p": "plain", "t": "template"}


def unpacked_lines(data: bytes) -> list[tuple[str, str]]:
    """Lines hold no line break, as white space in a block is one space."""
    text = zstandard.decompress(data).decode()
    return [(x[1:], ZONES[x[0]]) for x in text.split("\n")] if text else []


def outside(lines: list[tuple[str, str]]) -> list[int]:
    return [line_hash(t) for t, z in lines if z != "main"]


def page_print(lines: list[tuple[str, str]]) -> bytes:
    """Equal for copies, however they are marked up."""
    return xxh3_128_digest("\n".join(t for t, _ in lines))


def beyond(edges: list[tuple]) -> list[tuple[int, str] | None]:
    """For the first run of each task where the nearest page of its host in the tasks before is: (task, place); None if there is none.
    Runs of copies may fill whole tasks.

    edges, in the order of tasks: the task, (host, print) of its first and last run, the places of these, the place of the last page
    before the last run if its host is the same (else None), and the number of runs.
    """
    out: list[tuple[int, str] | None] = []
    last = at = other = None
    for task, first, end, place, inner, runs in edges:
        found = None
        if last is not None and last[0] == first[0]:
            found = other if last == first else at
        out.append(found)
        last, at, other = end, (task, place), found if runs == 1 else inner and (task, inner)
    return out


def borders(keyed: DataFrame, key: str, least: int) -> list[tuple]:
    """Where ranges of (host, path, key) begin, but for the first: by a sample of the URLs, at most MOST_RANGES * URLS or so. Only
    the sizes of the HTML are read. least: fewest ranges, if there are as many rows."""
    rows, size = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_html")), F.lit(0))).first()
    ranges = max(1, min(MOST_RANGES, -(-size // RANGE_BYTES), rows))
    ranges = max(ranges, min(rows, least))
    if ranges < 2:
        return []
    share = min(1.0, ranges * URLS / rows)
    luck = F.pmod(F.xxhash64("_host", "_path", key), F.lit(1 << 30)) / float(1 << 30)
    some = sorted((r[0], r[1], r[2] is not None, r[2]) for r in keyed.where(luck < share).select("_host", "_path", key).collect())
    return sorted({some[len(some) * n // ranges] for n in range(1, ranges)}) if some else []


def extracted(pages: DataFrame, source: str = "html", url: str = "url", key: str = "page_id", least: int | None = None) -> DataFrame:
    """key, url, text and n_chars of every page.

    Pages are reduced to their lines, once, and dealt to ranges of host, path and key, so that a hot host spreads over tasks. A
    task sees its pages in order, as runs of copies, and so both neighbours of all runs but its first and last; the pages of
    these wait and are settled afterwards, when digests of the tasks' ends tell which pages lie beyond. So the result doesn't hang
    on where ranges end.
    """
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_replace(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), F.lit(""))
    keyed = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(source).alias("_html"), host.alias("_host"), path.alias("_path"))
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    own = f"_key {kinds['_key']}, _url {kinds['_url']}"
    begins = borders(keyed, "_key", least or pages.sparkSession.sparkContext.defaultParallelism)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 2):
            blobs = pa.array([packed_lines(page_lines(x)) for x in b.column(2).to_pylist()], pa.binary())
            keys = zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(0).to_pylist(), strict=True)
            ranges = pa.array([bisect_right(begins, (h, q, k is not None, k)) for h, q, k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), blobs, ranges], ["_key", "_url", "_host", "_path", "_lines", "_range"])

    reduced = keyed.mapInArrow(reduce, f"{own}, _host string, _path string, _lines binary, _range int")
    ordered = reduced.repartitionById(len(begins) + 1, F.col("_range")).sortWithinPartitions("_range", "_host", "_path", "_key")
    side = pa.struct([("place", pa.string()), ("path", pa.string()), ("hashes", pa.list_(pa.int64()))])
    end = pa.struct([("first_host", pa.string()), ("first_print", pa.binary()), ("last_host", pa.string()), ("last_print", pa.binary()), ("inner", pa.bool_()), ("runs", pa.int64()), ("sides", pa.list_(side))])
    names = ["_key", "_url", "text", "_part", "_run", "_path", "_lines", "_edge"]
    fields = f"{own}, text string, _part int, _run string, _path string, _lines binary, _edge struct<first_host:string,first_print:binary,last_host:string,last_print:binary,inner:boolean,runs:long,sides:array<struct<place:string,path:string,hashes:array<long>>>>"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        types = None
        rows: list[tuple] = []
        run: list[tuple] = []  # key, url, path and packed lines of a run of copies
        before = first = last = second = None
        runs = 0

        def near(other: Page | None, host: str) -> Neighbour | None:
            return (other.path, outside(other.lines)) if other is not None and other.host == host else None

        def settled(after: Page | None, waits: str | None) -> Iterator[tuple]:
            """The rows of a run; of the first and last run of a task, what is needed to settle them later."""
            if waits:
                for k, u, q, data in run:
                    yield (k, u, None, part, waits, q, data, None)
                return
            x, y = near(before, last.host), near(after, last.host)
            texts: dict[tuple, str] = {}
            for k, u, q, data in run:
                n = nearer(q, x, y)
                if (data, n is x) not in texts:
                    texts[data, n is x] = main_text(unpacked_lines(data), n and n[1])
                yield (k, u, texts[data, n is x], part, None, None, None, None)

        def batch(some: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*some, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (*types, pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary(), end), strict=True)], names)

        for b in portions(batches, 4):
            types = (b.column(0).type, b.column(1).type)
            for k, u, h, q, data in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True):
                if run and last.host == h and run[-1][3] == data:
                    page, data = last._replace(path=q), run[-1][3]
                else:
                    lines = unpacked_lines(data)
                    page = Page(h, q, lines, page_print(lines))
                if last is None:
                    first, runs = page, 1
                elif (last.host, last.print) != (h, page.print):
                    if runs == 1:
                        second = near(page, first.host)
                    rows += settled(page, "first" if runs == 1 else None)
                    before, run, runs = last, [], runs + 1
                run.append((k, u, q, data))
                last = page
            for at in range(0, len(rows), PORTION_ROWS):
                yield batch(rows[at : at + PORTION_ROWS])
            rows = []
        if last is not None:
            rows += settled(None, "last" if runs > 1 else "only")
            inner = near(before, last.host)
            places = {"first": (first.path, outside(first.lines)), "second": second, "inner": inner, "last": (last.path, outside(last.lines))}
            sides = [{"place": p, "path": n[0], "hashes": n[1]} for p, n in places.items() if n]
            ended = {"first_host": first.host, "first_print": first.print, "last_host": last.host, "last_print": last.print, "inner": inner is not None, "runs": runs, "sides": sides}
            for at in range(0, len(rows), PORTION_ROWS):
                yield batch(rows[at : at + PORTION_ROWS])
            yield batch([(None, None, None, part, None, None, None, ended)])

    found = stored(ordered.mapInArrow(stream, fields), "pages")
    refs = "_part int, _left int, _left_place string, _right int, _right_place string"

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda x: x[0])
        left = beyond([(t, (fh, fp), (lh, lp), "last", "inner" if inner else None, runs) for t, fh, fp, lh, lp, inner, second, runs in tasks])
        right = beyond([(t, (lh, lp), (fh, fp), "first", "second" if second else None, runs) for t, fh, fp, lh, lp, inner, second, runs in reversed(tasks)])[::-1]
        columns = [[t[0] for t in tasks], *([x and x[i] for x in refs] for refs in (left, right) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)], ["_part", "_left", "_left_place", "_right", "_right_place"])

    # digests of a row a task, as borders of ranges are; lines move only from a place to the tasks that it is a neighbour of
    edges = found.where("_edge is not null")
    second = F.exists("_edge.sides", lambda s: s["place"] == "second").alias("second")
    resolved = edges.select("_part", "_edge.first_host", "_edge.first_print", "_edge.last_host", "_edge.last_print", "_edge.inner", second, "_edge.runs").coalesce(1).mapInArrow(resolve, refs)
    sides = edges.select(F.col("_part").alias("_at"), F.explode("_edge.sides").alias("_s")).select("_at", F.col("_s.place").alias("_place"), F.struct("_s.path", "_s.hashes").alias("_page"))
    held = F.when(F.col("_run") == "last", "inner").otherwise(F.col("_left_place")), F.when(F.col("_run") == "first", "second").otherwise(F.col("_right_place"))
    ways = edges.select("_part", F.explode(F.when(F.col("_edge.runs") == 1, F.array(F.lit("only"))).otherwise(F.array(F.lit("first"), F.lit("last")))).alias("_run")).join(resolved, "_part")
    ways = ways.select("_part", "_run", F.when(F.col("_run") == "last", F.col("_part")).otherwise(F.col("_left")).alias("_x"), held[0].alias("_xp"), F.when(F.col("_run") == "first", F.col("_part")).otherwise(F.col("_right")).alias("_y"), held[1].alias("_yp"))
    x, y = (sides.select(F.col("_at").alias(a), F.col("_place").alias(f"{a}p"), F.col("_page").alias(n)) for a, n in (("_x", "_before"), ("_y", "_after")))
    ways = ways.join(x, ["_x", "_xp"], "left").join(y, ["_y", "_yp"], "left").select("_part", "_run", "_before", "_after")
    waiting = found.where("_run is not null").select("_key", "_url", "_part", "_run", "_path", "_lines").join(ways, ["_part", "_run"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[tuple, str] = {}
        run = None
        for b in portions(batches, 5):
            out = []
            for r in b.select(["_part", "_run", "_path", "_lines", "_before", "_after"]).to_pylist():
                if run != (run := (r["_part"], r["_run"])):
                    texts = {}
                before, after = (n and (n["path"], n["hashes"]) for n in (r["_before"], r["_after"]))
                n = nearer(r["_path"], before, after)
                if (r["_lines"], n is before) not in texts:
                    texts[r["_lines"], n is before] = main_text(unpacked_lines(r["_lines"]), n and n[1])
                out.append(texts[r["_lines"], n is before])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["_key", "_url", "text"])

    late = waiting.select("_key", "_url", "_part", "_run", "_path", "_lines", "_before", "_after").mapInArrow(settle, f"{own}, text string")
    both = found.where("_run is null and _edge is null").select("_key", "_url", "text").unionByName(late)
    return both.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def op6_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
