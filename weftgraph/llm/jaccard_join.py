"""N-gram Jaccard join as a metric-space join (operator 7).

Documents are sets of word shingles under Jaccard distance. Equal sets are one class, so copies are never compared. The join
over classes is exact and has three steps.

1. Regions. Among documents almost every distance is 1, so document pivots chosen blindly would replicate everything.
   Instead a class's anchors are its rarest shingles, so many that two classes within the threshold share one at least (any
   total order of shingles gives this; counts only make regions small). For each anchor the most central of its classes is the
   pivot; all classes of the anchor enter the pivot's region, boundary classes several regions.
2. Regions of over `region` classes are split by pivots of their own into Voronoi regions, level by level, on the cluster: a
   class goes to its nearest pivot and, by the triangle inequality, to every pivot that is at most twice the threshold further.
   Classes that link to a pivot are linked by it already: in its region they stay only where they are near enough to a class
   that isn't, and a region of such classes alone is done. What pivots can't split is cut into pairs of hash blocks.
3. A region that fits is joined in one task. A bitmap of each set bounds distances from below, as sets differ in as many
   shingles as their bitmaps in bits, or more: regions fall apart into what can still link, and only those classes' sets are
   read. The rest is split by pivots again, in memory, down to `small` classes, which are compared pair by pair; a Voronoi region
   that holds nearly all of its parent is joined by windows: by order of distance to the pivot, those that differ in it by more
   than the threshold can't link.

Only links that join two parts of a region are kept; components come from large-star and small-star steps.

Shingle counts use a fixed-width table of counters: an estimate, which only decides how large regions get. Classes are told apart by a 64-bit
fingerprint (128 bits are stored): among n classes two are taken for one with a chance below n^2 / 2^65.

Null and empty texts, and texts without a word, have an empty set and no links: their component is themselves. Rows with a
null key count in their class only. Repeated rows each give a row; of rows that share a key and differ in text each has its own
text's component. Ties of distance keep a class in all regions concerned. Empty tables give no rows. Only the two named columns
are read, so others may have any name; one_of_each() keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from weftgraph.llm.common import portions, released, skew_join, stored, table
from weftgraph.operators.graph_iter import connected_components

MEMO = 500_000
#: Counters: 2 ** WIDTH, moved in blocks of 2 ** BLOCK; a task's counts are moved as bytes and the sums kept as 16 bits, both saturated.
WIDTH, BLOCK = 24, 16


@dataclass(frozen=True)
class Join:
    """Sets of `words`-word shingles link when 100 * intersection >= percent * union. region: most classes joined in one task.
    small: most classes compared pair by pair without pivots. pivots: most pivots of a region a level. levels: most levels of
    Voronoi regions on the cluster before hash blocks. broadcast: most candidate keys that are broadcast to the scan; beyond it
    the scan is shuffled."""

    words: int = 4
    percent: int = 85
    region: int = 1000
    small: int = 64
    pivots: int = 64
    broadcast: int = 1_000_000
    levels: int = 4

    @property
    def far(self) -> float:
        return 1 - self.percent / 100

    def linked(self, both: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (sizes + others - both)

    def anchors(self, n: int) -> int:
        """A class of n shingles shares at least ceil(n * percent / 100) with any class it links to."""
        return n - -(-n * self.percent // 100) + 1


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = xxh3_64_intdigest(word)
        return out


#: One for each Python worker.
WORDS = Words()


def mixed(h: np.ndarray, odd: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(odd)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text. bytes.lower and bytes.split work on ASCII alone, as the contract has it."""
    own = text.encode().lower().split() if text else []
    n = len(own)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, own), np.uint64, n)
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = (out + h[i : n - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(mixed(out, 0x94D049BB133111EB))


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    return tuple(int(mixed(h, odd).sum(dtype=np.uint64).astype(np.int64)) for odd in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def classes(docs: DataFrame, join: Join, text: str, key: str) -> DataFrame:
    """A row (key, n, f1, f2) for each document; and rows (block, counts) of each task's shingle counts over distinct sets."""
    k = join.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts, kind = set(), np.zeros(1 << WIDTH, np.uint16), None
        for b in portions(batches, 1):
            kind, rows = b.column(0).type, []
            for t in b.column(1).to_pylist():
                h = shingles(t, k)
                f = fingerprint(h)
                rows.append((len(h), *f))
                if len(h) and f[0] not in seen:
                    seen.add(f[0])
                    at = (h >> np.uint64(64 - WIDTH)).astype(np.int64)
                    counts[at] = np.minimum(counts[at], 0xFFFE) + np.uint16(1)
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], [key, "n", "f1", "f2", "block", "counts"])
        for block in range(1 << (WIDTH - BLOCK)) if kind is not None else ():
            part = counts[block << BLOCK : (block + 1) << BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([block], pa.int32()), pa.array([np.minimum(part, 255).astype(np.uint8).tobytes()], pa.binary())], [key, "n", "f1", "f2", "block", "counts"])

    fields = f"`{key}` {docs.schema[key].dataType.simpleString()}, n long, f1 long, f2 long, block int, counts binary"
    return docs.select(key, text).mapInArrow(run, fields)


def total_counts(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters, added in two rounds on the executors; its size is fixed."""

    def adding(kind: type, most: int, to: type):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    more = np.frombuffer(data, kind).astype(np.uint32)
                    sums[block] = sums[block] + more if block in sums else more
            for block, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(x, most).astype(to).tobytes()], pa.binary())], ["block", "counts"])

        return add

    own = parts.where("block is not null").select("block", "counts")
    fields = "block int, counts binary"
    some = own.repartition("block", F.pmod(F.xxhash64("counts"), F.lit(16))).mapInArrow(adding(np.uint8, 0xFFFFFFFF, np.uint32), fields)
    out = np.zeros(1 << WIDTH, np.uint16)
    for r in some.repartition("block").mapInArrow(adding(np.uint32, 0xFFFF, np.uint16), fields).toLocalIterator():
        out[r["block"] << BLOCK : (r["block"] + 1) << BLOCK] = np.frombuffer(r["counts"], np.uint16)
    return out


def bitmap(h: np.ndarray) -> bytes:
    """Bits at the shingles' low bits: two bits and more a shingle, a power of two."""
    size = 1 << max(8, (2 * len(h) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(h & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def grouped(df: DataFrame, key: str, run, fields: str) -> DataFrame:
    """run(key, rows as a table) of each group, for groups of a bounded size: groups stream by in order, without a frame for each."""

    def all_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield from run(current, pa.Table.from_batches(held).combine_chunks())

        for b in batches:
            keys = b.column(key).to_pylist()
            begin = 0
            while begin < len(keys):
                if keys[begin] != current:
                    yield from done()
                    held, current = [], keys[begin]
                end = begin
                while end < len(keys) and keys[end] == current:
                    end += 1
                held.append(b.slice(begin, end - begin))
                begin = end
        yield from done()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(all_groups, fields)


def anchored(docs: DataFrame, counts: np.ndarray, join: Join, text: str) -> DataFrame:
    """(f1, n, central, bits, anchors) of the distinct sets that a task meets: their size, how common their shingles are, their
    bitmap and their rarest shingles."""
    shipped = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, many = set(), shipped.value
        for b in portions(batches, 0):
            rows, anchors = [], []
            for t in b.column(0).to_pylist():
                h = shingles(t, join.words)
                if not len(h) or (f := fingerprint(h)[0]) in seen:
                    continue
                seen.add(f)
                c = many[(h >> np.uint64(64 - WIDTH)).astype(np.int64)]
                rows.append((f, len(h), float(np.log(c).mean()), bitmap(h)))
                # 48 bits do: an anchor that two shingles share by chance only makes a region larger, and shuffles are a fifth smaller
                anchors.append((h[np.lexsort((h, c))[: join.anchors(len(h))]] >> np.uint64(16)).astype(np.int64))
            ends = np.cumsum([0, *map(len, anchors)])
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.binary()), strict=True)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *anchors])))], ["f1", "n", "central", "bits", "anchors"])

    return docs.select(text).mapInArrow(run, "f1 long, n long, central double, bits binary, anchors array<long>")


def near(df: DataFrame, join: Join) -> DataFrame:
    """df to be broadcast, if it is counted to be small enough."""
    return F.broadcast(df) if df.count() <= join.broadcast else df


def sets_of(docs: DataFrame, keys: DataFrame, join: Join, text: str, key: str) -> DataFrame:
    """(f1, h) of the documents with these keys; a null among them stands for all documents without one."""
    own = stored(keys.select(F.col(key).alias("_key")), "keys")
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    chosen = rows.join(near(own, join), F.col("_id") == F.col("_key"), "left_semi")
    if not own.where("_key is null").isEmpty():
        chosen = chosen.unionByName(rows.where("_id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 0):
            own = [shingles(t, join.words) for t in b.column(0).to_pylist()]
            ends = np.cumsum([0, *map(len, own)])
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(h)[0] for h in own], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *own]).astype(np.int64)))], ["f1", "h"])

    return chosen.select("_text").mapInArrow(run, "f1 long, h array<long>")


def shared(a: list[np.ndarray], b: list[np.ndarray], width: int) -> np.ndarray:
    """Sizes of the intersections of a's with b's sets of column numbers, by a dense product over a's columns."""
    columns = np.full(width, -1, np.int64)
    used = np.unique(np.concatenate(a)) if a else np.empty(0, np.int64)
    columns[used] = np.arange(len(used))
    out = np.zeros((len(a), len(b)), np.float32)
    step = max(1, 4_000_000 // max(1, len(a) + len(b)))
    for begin in range(0, len(used), step):
        dense = []
        for side in (a, b):
            m = np.zeros((len(side), min(step, len(used) - begin)), np.float32)
            for i, x in enumerate(side):
                at = columns[x] - begin
                m[i, at[(at >= 0) & (at < m.shape[1])]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


class Region:
    """Classes of one task, joined by Voronoi regions. links: those that connect the classes as all their links would."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], join: Join):
        """sets: sorted shingle hashes."""
        self.ids, self.join, self.links = ids, join, []
        flat, column = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(column, minlength=len(flat)) > 1
        place = np.where(often, np.cumsum(often) - 1, -1)
        self.sizes = np.array([len(s) for s in sets])
        self.own = [(c := place[column[e - k : e]])[c >= 0] for e, k in zip(np.cumsum(self.sizes), self.sizes, strict=True)]
        self.width = int(often.sum())
        self.root = list(range(len(ids)))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def link(self, xs: np.ndarray, ys: np.ndarray) -> None:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            a, b = self.find(x), self.find(y)
            if a != b:
                self.root[max(a, b)] = min(a, b)
                self.links.append((self.ids[x], self.ids[y]))

    def compare(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Links every x with every y where they do; distances."""
        both = shared([self.own[x] for x in xs], [self.own[y] for y in ys], self.width)
        a, b = self.sizes[xs][:, None], self.sizes[ys][None, :]
        i, j = np.nonzero(self.join.linked(both, a, b))
        self.link(xs[i], ys[j])
        return 1 - both / (a + b - both)

    def pivots(self, own: np.ndarray, first: int) -> np.ndarray:
        """Distances of pivots to own: of the first, then always of the class that is furthest from those before."""
        rows = [self.compare(np.array([first]), own)[0]]
        for _ in range(min(8, len(own) // self.join.small) or 1):
            least = np.min(rows, 0)
            at = int(least.argmax())
            if least[at] <= self.join.far:
                break
            rows.append(self.compare(own[at : at + 1], own)[0])
        return np.array(rows)

    def voronoi(self, own: np.ndarray, first: int) -> None:
        """All links among own, by regions of pivots and their regions in turn."""
        todo = [(own, first)]
        while todo:
            own, first = todo.pop()
            if len(own) <= self.join.small:
                self.compare(own, own)
                continue
            distance = self.pivots(own, first)
            nearest = distance.min(0)
            inside = [unsettled(d, d <= nearest + 2 * self.join.far + 1e-9, self.join) for d in distance]
            if max(map(np.sum, inside)) * 10 > len(own) * 9 or sum(map(np.sum, inside)) > 2 * len(own):
                self.windows(own, distance[0])
                continue
            todo += [(own[x], int(own[x][d[x].argmin()])) for x, d in zip(inside, distance, strict=True) if x.any()]

    def windows(self, own: np.ndarray, distance: np.ndarray, block: int = 256) -> None:
        """All links among own, by windows of the distance to one pivot."""
        order = np.argsort(distance, kind="stable")
        own, distance = own[order], distance[order]
        for i in range(0, len(own), block):
            reach = distance[min(i + block, len(own)) - 1] + self.join.far + 1e-9
            for j in range(i, len(own), block):
                if distance[j] > reach:  # the triangle inequality: none of the rest can link
                    break
                self.compare(own[i : i + block], own[j : j + block])


def unsettled(distance: np.ndarray, inside: np.ndarray, join: Join) -> np.ndarray:
    """Which classes inside a pivot's region have links left to find: those that don't link to the pivot, and those near enough to one of them."""
    loose = inside & (distance > join.far - 1e-9)
    return inside & (distance >= distance[loose].min() - join.far - 1e-9) if loose.any() else loose


def region_links(ids: list[int], sets: list[np.ndarray], pivot: int, join: Join) -> list[tuple[int, int]]:
    """Links that connect the region as all its links would. pivot: the place of its first pivot."""
    found = Region(ids, sets, join)
    found.voronoi(np.arange(len(ids)), pivot)
    return found.links


def can_link(ids: list[int], sizes: list[int], bits: list[bytes], join: Join) -> dict[int, int]:
    """id to a common id of those that bitmaps don't keep apart; ids that can link to none are left out."""
    order = sorted(range(len(ids)), key=lambda i: sizes[i])
    maps = [int.from_bytes(bits[i], "little") for i in order]
    root = list(range(len(order)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    met = set()
    for x, i in enumerate(order):
        n, size, own = sizes[i], len(bits[i]), maps[x]
        for y in range(x + 1, len(order)):
            j = order[y]
            if 100 * n < join.percent * sizes[j]:
                break
            other, wide = maps[y], len(bits[j])
            while wide > size:
                wide //= 2
                other = other & ((1 << 8 * wide) - 1) | other >> 8 * wide
            if (own ^ other).bit_count() * (100 + join.percent) <= (100 - join.percent) * (n + sizes[j]):
                met |= {x, y}
                root[find(x)] = find(y)
    return {ids[order[x]]: ids[order[find(x)]] for x in met}


def linkable(members: DataFrame, entries: DataFrame, join: Join) -> DataFrame:
    """(region, pivot, f1) of the classes that can still link, in regions of those that can link to each other."""

    def run(region: str, t: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = {f: (n, b) for f, n, b in zip(*(t.column(c).to_pylist() for c in ("f1", "n", "bits")), strict=True)}
        if len(rows) > 1:
            found = can_link(list(rows), [n for n, _ in rows.values()], [b for _, b in rows.values()], join)
            yield pa.RecordBatch.from_arrays([pa.array([f"{region}:{r}" for r in found.values()], pa.string()), pa.array(found.values(), pa.int64()), pa.array(found, pa.int64())], ["region", "pivot", "f1"])

    return grouped(members.select("region", "f1").join(entries.select("f1", "n", "bits"), "f1"), "region", run, "region string, pivot long, f1 long")


def joined_regions(members: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """(a, b) links of regions given as (region, pivot, f1) rows of at most join.region classes each."""

    def run(region: str, t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = t.column("f1").to_pylist()
        each = dict(zip(ids, (np.asarray(t.column("h")[i].values) for i in range(len(ids))), strict=True))
        if len(each) > 1:
            ids, pivot = list(each), t.column("pivot")[0].as_py()
            links = region_links(ids, list(each.values()), ids.index(pivot) if pivot in each else 0, join)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], ["a", "b"])

    return grouped(members.join(sets, "f1").select("region", "pivot", "f1", "h"), "region", run, "a long, b long")


def dealt(members: DataFrame, join: Join) -> tuple[DataFrame, DataFrame | None]:
    """members in regions that fit, and the rest (None if there is none)."""
    large = members.groupBy("region").count().where(F.col("count") > join.region).select("region")
    large = near(stored(large, "large"), join)
    if large.isEmpty():
        return members, None
    return members.join(large, "region", "left_anti"), members.join(large, "region", "left_semi")


def split(members: DataFrame, sets: DataFrame, join: Join, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Large regions (stored) as Voronoi regions of their own pivots, with every class that a border may part from a link and without
    those that its pivot links already; members of the regions that pivots can't tell apart, as they were; and the links to
    pivots, (a, b). A region is of the second kind if one of its parts holds over nine tenths of it, or all together twice of it.

    Pivots are the region's own and some by chance. A region's classes are dealt to parts of about 1,000, and its pivots go to each.
    """
    sized = members.groupBy("region").agg(F.count("*").alias("_n"), F.first("pivot").alias("_first"))
    sized = stored(sized.select("region", "_first", "_n", F.least(F.lit(float(join.pivots)), 2 * F.col("_n") / join.region + 1).alias("_k"), F.ceil(F.col("_n") / 1000).cast("int").alias("_parts")), "sized")
    luck = F.pmod(F.xxhash64("f1", "region", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
    both = skew_join(members.select("region", "f1"), sized, "region", how="inner")
    both = stored(both.withColumn("_part", F.pmod(F.xxhash64("f1", F.lit(7)), F.col("_parts")).cast("int")), "parted")
    pivots = both.where((luck < F.col("_k") / F.col("_n")) | (F.col("f1") == F.col("_first"))).select("region", "_parts", F.col("f1").alias("_p"))
    pivots = pivots.join(sets.select(F.col("f1").alias("_p"), F.col("h").alias("_hp")), "_p")
    pivots = pivots.select("region", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_p", "_hp")
    common = F.size(F.array_intersect("h", "_hp"))
    distances = both.select("region", "_part", "f1").join(sets, "f1").join(pivots, ["region", "_part"])
    union = F.size("h") + F.size("_hp") - common
    distances = stored(distances.select("region", "_part", "f1", "_p", (1 - common / union).alias("_d"), (100 * common >= join.percent * union).alias("_links")), "distances")
    nearest = distances.groupBy("region", "_part", "f1").agg(F.min("_d").alias("_least"))
    inside = stored(distances.join(nearest, ["region", "_part", "f1"]).where(F.col("_d") <= F.col("_least") + 2 * join.far + 1e-9), "inside")
    loose = inside.where(~F.col("_links")).groupBy("region", "_p").agg(F.min("_d").alias("_loose"))
    name = F.concat_ws("/", "region", F.col("_p").cast("string")).alias("_at")
    left = skew_join(inside.select("region", name, "_p", "f1", "_d"), loose.select(name, "_loose"), "_at", how="inner").where(F.col("_d") >= F.col("_loose") - join.far - 1e-9)
    left = stored(left.select(F.col("region").alias("_of"), F.col("_at").alias("region"), F.col("_p").alias("pivot"), "f1"), "voronoi")
    held = left.groupBy("_of", "region").count().groupBy("_of").agg(F.max("count").alias("_most"), F.sum("count").alias("_all")).join(sized.select(F.col("region").alias("_of"), "_n"), "_of")
    stuck = near(stored(held.where("_most * 10 > _n * 9 or _all > 2 * _n").select("_of"), "stuck"), join)
    parts = left.join(stuck, "_of", "left_anti").select("region", "pivot", "f1")
    return parts, members.join(stuck.withColumnRenamed("_of", "region"), "region", "left_semi"), distances.where("_links and f1 <> _p").select(F.col("f1").alias("a"), F.col("_p").alias("b"))


def blocks(members: DataFrame, join: Join) -> DataFrame:
    """Regions that pivots can't split, as pairs of hash blocks: every two classes meet in one of them."""
    half = max(1, join.region // 3)
    sized = members.groupBy("region").agg(F.ceil(F.count("*") / half).cast("int").alias("_b"))
    own = skew_join(members, sized, "region", how="inner").withColumn("_i", F.pmod(F.xxhash64("f1", F.lit(99)), F.col("_b")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_j")
    pairs = own.select("region", "pivot", "f1", "_i", other)
    return pairs.select(F.concat_ws("/", "region", F.least("_i", "_j").cast("string"), F.greatest("_i", "_j").cast("string")).alias("region"), "pivot", "f1")


def voronoi_regions(members: DataFrame, sets_for, join: Join) -> tuple[DataFrame, list[DataFrame]]:
    """members in regions that fit, and the links that their splits have found. sets_for: (f1, h), stored, of members."""
    fit, rest = dealt(members, join)
    done, links = [fit], []
    if rest is not None:
        rest = stored(rest, "large-regions")
        sets = sets_for(rest)
        for level in range(join.levels):
            parts, stuck, more = split(rest, sets, join, level)
            links.append(more)
            done.append(blocks(stored(stuck, "stuck-regions"), join))
            fit, rest = dealt(stored(parts, "split"), join)
            done.append(fit)
            if rest is None:
                break
            rest = stored(rest, "large-regions")
        else:
            done.append(blocks(rest, join))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, links


def class_links(docs: DataFrame, parts: DataFrame, firsts: DataFrame, join: Join, text: str, key: str) -> DataFrame:
    """(a, b) links between classes; their components are those of all links. firsts: (f1, _min), a class's smallest key."""
    anchors = stored(anchored(docs, total_counts(parts), join, text), "anchors")
    each = anchors.select("f1", F.explode("anchors").alias("anchor"))
    short = F.shiftrightunsigned("f1", 16)
    met = each.groupBy("anchor").agg(F.min(short).alias("_a"), F.max(short).alias("_b")).where("_a < _b").select("anchor")
    shared_anchors = stored(each.join(met, "anchor", "left_semi"), "met")
    own = shared_anchors.distinct()
    entries = stored(anchors.join(own.select("f1").distinct(), "f1", "left_semi").dropDuplicates(["f1"]).drop("anchors"), "met-classes")
    released(anchors)
    pivots = own.join(entries.select("f1", "central"), "f1").groupBy("anchor").agg(F.max_by("f1", F.struct("central", "f1")).alias("pivot"))
    members = stored(own.join(pivots, "anchor").select(F.col("pivot").cast("string").alias("region"), "pivot", "f1").distinct(), "regions")
    released(shared_anchors)

    def sets_for(some: DataFrame) -> DataFrame:
        keys = firsts.join(some.select("f1").distinct(), "f1", "left_semi").select(F.col("_min").alias(key))
        return stored(sets_of(docs, keys, join, text, key).dropDuplicates(["f1"]), "sets")

    regions, links = voronoi_regions(members, sets_for, join)
    left = stored(linkable(regions, entries, join), "linkable")
    released(entries)
    out = joined_regions(left, sets_for(left), join)
    for more in links:
        out = out.unionByName(more)
    return stored(out.distinct(), "links")


def jaccard_components(docs: DataFrame, join: Join = Join(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles and component_id, the smallest key reachable by links, of every document."""
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    parts = stored(classes(rows, join, "_text", "_id"), "classes")
    rows_of = parts.where("block is null").select("_id", "n", "f1")
    firsts = stored(rows_of.where("n > 0").groupBy("f1").agg(F.min("_id").alias("_min")), "firsts")
    labels = stored(connected_components(class_links(rows, parts, firsts, join, "_text", "_id")), "labels")
    named = firsts.join(labels, F.col("f1") == F.col("id"), "left").select("f1", "_min", F.coalesce("label", "f1").alias("label"))
    named = stored(named, "named")
    linked = named.join(labels.select(F.col("label")).distinct(), "label", "left_semi")
    least = linked.groupBy("label").agg(F.min("_min").alias("_all"))
    found = stored(named.join(least, "label", "left").select("f1", F.coalesce("_all", "_min").alias("component_id")), "components")
    full = skew_join(rows_of.where("n > 0"), found, "f1").select("_id", F.col("n").alias("n_shingles"), "component_id")
    out = full.unionByName(rows_of.where("n = 0").select("_id", F.col("n").alias("n_shingles"), F.col("_id").alias("component_id")))
    return out.withColumnRenamed("_id", key)


def one_of_each(docs: DataFrame, join: Join, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, with the columns they have, without those whose component has a smaller key; of rows that repeat a key and a text one stays.

    Keys that are null or repeat don't tell rows apart. If there are any, rows are joined and dropped by key and text, so that a
    text is judged by its own links only. Rows with a null key stay and come after all others.
    What goes is usually little: its keys are broadcast if they are few enough, else shuffled.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(key).alias("_id"), F.col(text).alias("_text"))
    unclear = rows.groupBy("_id").count().where((F.col("count") > 1) | F.col("_id").isNull())
    repeats = not unclear.isEmpty()
    if repeats:
        rows = rows.withColumn("_id", F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("key"), F.xxhash64("_text").alias("text")))
    found = stored(jaccard_components(rows, join, "_text", "_id"), "found")
    gone = found.where("_id <> component_id and not _id.none" if repeats else "_id <> component_id").select(F.col("_id").alias("_key")).distinct()
    rest = rows.join(near(stored(gone, "gone"), join), F.col("_id") == F.col("_key"), "left_anti")
    if repeats:
        nameless = F.col("_id.none")
        rest = rest.where(~nameless).dropDuplicates(["_id"]).unionByName(rest.where(nameless))
    return rest.select("_row.*")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
