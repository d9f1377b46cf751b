"""Interleaved document sequences with media columns (operator 4).

HTML becomes an ordered sequence of text and media-reference structs: position, text, reference (the digest of the stored
form) and caption (the figure's, or the alternative text). A join on digests brings what is stored under a reference to its
place, so that positions and captions stay aligned; a reference without stored media keeps its place with nulls.

The stored form of a text is a run of binary greyscale images (PGM allows several in a row), 24 samples wide: of each a short
header, then a segment of the payload byte for byte. As a document, the text is a paragraph and a figure for each segment;
the figure names the image by its digest, and its caption says which bytes it holds.

Null and empty HTML has no items. Null and empty texts have one image of fill alone. Repeated rows and null keys each give
their items again; a digest stored many times counts once. Equal texts have equal values. Empty tables give no rows. Only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import portions, skew_join, stored, table

#: Fixed by the contract: payloads are multiples of this, filled with bytes 255; 24 x 24 samples.
UNIT, SIDE, FILL, TAIL = 576, 24, b"\xff", 32
#: Bytes of a payload in one image.
SEGMENT = 113 * UNIT
#: Bytes of texts that are images in a worker at once, or one text.
HELD = 1 << 20
MEDIA = frozenset(("img", "video", "audio", "source", "embed"))
BREAKS = frozenset("p div section article h1 h2 h3 h4 h5 h6 li ul ol table tr td th blockquote pre figure figcaption header footer main aside nav br hr".split())
SILENT = frozenset(("script", "style", "template", "head"))
ITEM = "pos int, kind string, text string, ref string, caption string"
REF = "sha256:"
FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
FEATURE_KINDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class Sequence(HTMLParser):
    """items: {pos, kind, text, ref, caption} in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None
        self.silent = 0

    def flush(self) -> None:
        words = " ".join("".join(self.text).split())
        self.text = []
        if words:
            self.items.append({"pos": len(self.items), "kind": "text", "text": words, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        if tag in BREAKS and self.caption is None:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA and (ref := (named := dict(attrs)).get("src") or named.get("data-src")):
            self.flush()
            self.items.append({"pos": len(self.items), "kind": "media", "text": None, "ref": ref.removeprefix(REF), "caption": named.get("alt")})

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            words, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure if self.figure is not None else len(self.items) :]:
                if item["kind"] == "media" and words:
                    item["caption"] = words
        elif tag in BREAKS and self.caption is None:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(page: str | None) -> list[dict]:
    parser = Sequence()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.items


def to_image(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (SIDE, len(payload) // SIDE) + payload


def from_image(image: bytes) -> bytes:
    m = re.match(rb"P5\n(\d+) (\d+)\n255\n", image)
    payload = image[m.end() :]
    if len(payload) != int(m[1]) * int(m[2]):
        raise ValueError("the image's samples don't match its header")
    return payload


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text, and these filled up to a positive multiple of UNIT."""
    data = (text or "").encode()
    return len(data), data + FILL * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def images(text: str | None) -> list[bytes]:
    """A text's stored form."""
    _, data = payload(text)
    return [to_image(data[i : i + SEGMENT]) for i in range(0, len(data), SEGMENT)]


def rendered(text: str | None) -> str:
    """A text as a document: each segment's characters (those that begin in it), then its image and which bytes that holds."""
    size, data = payload(text)
    begins = list(range(0, len(data), SEGMENT))
    cuts = []
    for at in begins:
        while at < size and data[at] & 0xC0 == 0x80:
            at += 1
        cuts.append(min(at, size))
    out = []
    for i, begin in enumerate(begins):
        words = data[cuts[i] : cuts[i + 1] if i + 1 < len(cuts) else size].decode()
        digest = sha256(to_image(data[begin : begin + SEGMENT])).hexdigest()
        out.append(f'<p>{escape(words)}</p><figure><img src="{REF}{digest}"><figcaption>bytes {min(begin, size)}-{min(begin + SEGMENT, size)}</figcaption></figure>')
    return f"<article>{''.join(out)}</article>"


class Payload:
    """What the images of a sequence hold, read back one at a time."""

    def __init__(self) -> None:
        self.size = self.stored = 0
        self.hashes = sha256(), sha256()
        self.tail = b""
        self.sums: list[np.ndarray] = []
        self.total = self.squares = 0

    def add(self, image: bytes) -> None:
        data = from_image(image)
        self.size += len(data)
        self.stored += len(image)
        self.hashes[0].update(data)
        self.hashes[1].update(image)
        self.tail = (self.tail + data[-TAIL:])[-TAIL:]
        a = np.frombuffer(data, np.uint8).reshape(-1, SIDE)
        self.sums.append(a.reshape(len(a), 8, SIDE // 8).sum(2, dtype=np.uint16))
        self.total += int(a.sum(dtype=np.int64))
        self.squares += int(np.square(a, dtype=np.uint32).sum(dtype=np.int64))

    def feature(self) -> str:
        """Height, mean and deviation of the samples, and a hash of 8 x 8 block means against their mean."""
        rows = np.concatenate(self.sums)
        ends = np.arange(9) * len(rows) // 8
        blocks = np.add.reduceat(rows, ends[:8], axis=0, dtype=np.int64) / np.diff(ends)[:, None]
        bits = int("".join("1" if x else "0" for x in (blocks > blocks.mean()).ravel()), 2)
        mean = self.total / self.size
        return f"h={len(rows)};mean={mean:.4f};std={max(0.0, self.squares / self.size - mean * mean) ** 0.5:.4f};blocks={bits:016x}"

    def row(self) -> tuple[int, str, int, int, str, str]:
        """The FEATURES."""
        return self.size, self.hashes[0].hexdigest(), zlib.crc32(self.tail), self.stored, self.hashes[1].hexdigest(), self.feature()


def described_images(stored_form: list[bytes]) -> tuple[int, str, int, int, str, str]:
    held = Payload()
    for image in stored_form:
        held.add(image)
    return held.row()


def documents_of(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and html of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(rendered, b.column(1).to_pylist()), pa.string())], [key, "html"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, html string")


def sequences(pages: DataFrame, source: str = "html", key: str = "page_id") -> DataFrame:
    """key and items, the ordered sequence of each page."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "ref", "caption"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence(x) for x in b.column(1).to_pylist()], kind)], [key, "items"])

    return pages.select(key, source).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>")


def numbered(found: DataFrame) -> DataFrame:
    """sequences() stored, with _doc, a number of each sequence: keys may be null or repeat."""
    return stored(found.withColumn("_doc", F.monotonically_increasing_id()), "sequences")


def resolved(found: DataFrame, media: DataFrame, key: str = "page_id") -> DataFrame:
    """A row for each item of numbered sequences: key, _doc, the item's fields, and media's other columns for its reference.

    media: a column digest, and what is to be brought to a reference's place: payloads, or what was made of them.
    Only references are shuffled to the join; a digest that a third of all items name is joined by a bounded broadcast.
    """
    items = found.select(key, "_doc", F.explode("items").alias("_i")).select(key, "_doc", "_i.*")
    others = [c for c in media.columns if c != "digest"]
    first = [F.first(c, ignorenulls=False).alias(c) for c in others]
    placed = skew_join(items.where("ref is not null"), media.groupBy(F.col("digest").alias("ref")).agg(*first), "ref")
    kinds = {f.name: f.dataType for f in media.schema}
    return placed.unionByName(items.where("ref is null").select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in others)))


def interleaved(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """resolved() rows gathered again: key, _doc and items in order."""
    fields = [c for c in rows.columns if c not in (key, "_doc")]
    items = F.sort_array(F.collect_list(F.struct("pos", *(c for c in fields if c != "pos")))).alias("items")
    return rows.groupBy("_doc").agg(F.first(key).alias(key), items).select(key, "_doc", "items")


def media_store(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest, media and several (whether the text has more than one) of all texts' images, written to the shared folder. An image that
    a task meets again is stored once, by a bounded memory of digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for b in portions(batches, 0, size=HELD):
            rows = []
            for t in b.column(0).to_pylist():
                own = images(t)
                for image in own:
                    digest = sha256(image)
                    seen = digest.digest() + bytes([len(own) > 1])
                    if seen not in met:
                        if len(met) == 200_000:
                            met.clear()
                        met.add(seen)
                        rows.append((digest.hexdigest(), image, len(own) > 1))
            for i in range(0, len(rows), 1000):
                columns = zip(*rows[i : i + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.bool_()), strict=True)], ["digest", "media", "several"])

    return stored(docs.select(text).mapInArrow(run, "digest string, media binary, several boolean"), "media")


def as_batch(first: list, rows: list[tuple], name: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(first, pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [name, *FEATURES])


def described(media: DataFrame) -> DataFrame:
    """digest and the FEATURES of each stored image, read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1):
            yield as_batch(b.column(0).to_pylist(), [described_images([x]) for x in b.column(1).to_pylist()], "digest")

    return media.select("digest", "media").mapInArrow(run, f"digest string, {FEATURE_KINDS}")


def described_sequences(refs: DataFrame, media: DataFrame) -> DataFrame:
    """refs (sequence, refs) with different sequences: sequence and the FEATURES of the images that refs name, read back in order."""
    parts = refs.select("sequence", F.posexplode("refs").alias("_n", "digest")).join(media.select("digest", "media").dropDuplicates(["digest"]), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for b in portions(batches, 1):
            names, rows = [], []
            for name, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != current:
                    if held:
                        names.append(current)
                        rows.append(held.row())
                    current, held = name, Payload()
                held.add(image)
            if rows:
                yield as_batch(names, rows, "sequence")
        if held:
            yield as_batch([current], [held.row()], "sequence")

    return parts.repartition("sequence").sortWithinPartitions("sequence", "_n").select("sequence", "media").mapInArrow(run, f"sequence string, {FEATURE_KINDS}")


def layout(items: Column) -> Column:
    """Every item in order: its position, then a text's length or a media item's caption."""
    return F.array_join(F.transform(items, lambda i: F.concat_ws(":", i["pos"].cast("string"), F.coalesce(i["caption"], F.length(i["text"]).cast("string")))), ",")


def media_features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, the FEATURES of the whole stored form, n_media and layout of every text."""
    store = media_store(docs, text)
    found = sequences(documents_of(docs, text, key), key=key)
    # text items stay as their layout: the texts themselves aren't shuffled
    slim = F.filter("items", lambda i: i["kind"] == "media")
    found = numbered(found.select(key, slim.alias("items"), layout(F.col("items")).alias("layout")))
    whole = interleaved(resolved(found, stored(described(store), "described"), key), key)
    whole = stored(whole.join(found.select("_doc", "layout"), "_doc"), "interleaved")
    last = F.element_at("items", -1)
    n_bytes = F.regexp_extract(last["caption"], r"-(\d+)$", 1).cast("long").alias("n_bytes")
    more = [F.size("items").alias("n_media"), "layout"]
    one = whole.where(F.size("items") == 1).select(key, n_bytes, *(last[c].alias(c) for c in FEATURES), *more)
    several = whole.where(F.size("items") > 1).withColumn("refs", F.col("items.ref")).withColumn("sequence", F.sha2(F.array_join("refs", ","), 256))
    features = described_sequences(several.select("sequence", "refs").dropDuplicates(["sequence"]), store.where("several"))
    long = skew_join(several, stored(features, "features"), "sequence", how="inner").select(key, n_bytes, *FEATURES, *more)
    return one.unionByName(long)


def op4_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
