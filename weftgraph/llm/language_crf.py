"""Language identification by a linear-chain conditional random field over words (operator 5).

A sentence is a sequence of words, each labelled with a language. A word's features are affixes, character n-grams and
lexicon entries; transitions between languages are learned from sentences and from code-switched joins of sentences.
Forward-backward gives every word its label distribution; a text's language is that with the most expected words.

Fitting reads a bounded sample (Sample) of labelled rows in one task; the driver holds only the model's bytes. Prediction
reads every whole text: runs of over LONGEST letters are read as consecutive words, sentences of over CHAIN words as
consecutive sequences.

Null texts and texts without a letter are `und` with score 0, as are all if nothing is labelled. Ties between languages go to
the first by name. Repeated rows each give a row. Empty tables give no rows. Only the named columns are read, so others may
have any name.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_hexdigest

from weftgraph.llm.common import portions, table

UNKNOWN = "und"
LONGEST, CHAIN = 40, 512
WORDS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}|[.!?\n]")
BREAK = re.compile(r"[\W\d_]")
STOPS = frozenset(".!?\n")
#: What a worker holds at once: words read together, code points cut into words together, and word rows times languages kept.
SLICE, CHUNK, KEPT = 100_000, 200_000, 2_000_000


@dataclass(frozen=True)
class Sample:
    """The bound on what fitting reads: labelled rows of each language, and sentences of a row, spread evenly over its whole text."""

    rows: int = 200
    sentences: int = 40
    seed: int = 7


@dataclass(frozen=True)
class Fit:
    """lexicon: entries a language. rounds: passes over the sample. cells: words times languages of a step."""

    lexicon: int = 2000
    rounds: int = 6
    steps: int = 8
    rate: float = 0.5
    l2: float = 1e-4
    cells: int = 1_000_000


def sentences(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in WORDS.findall(text.lower()):
        if w in STOPS or len(out[-1]) == CHAIN:
            if out[-1]:
                out.append([])
        if w not in STOPS:
            out[-1].append(w)
    return [s for s in out if s]


def chunks(text: str) -> Iterator[str]:
    """The text cut where no word goes on, about every CHUNK code points."""
    begin = 0
    while len(text) - begin > CHUNK:
        m = BREAK.search(text, begin + CHUNK)
        if not m:
            break
        yield text[begin : m.end()]
        begin = m.end()
    yield text[begin:]


def forward_backward(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward messages of all sequences at once. e: emission potentials of all words in a row; a
    sequence is a start and a size. Longest sequences come first, so the live ones are always a prefix."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest + 1), side="left")
    fore, back = np.empty_like(e), np.ones_like(e)
    if not longest:
        return fore, back
    a = first * e[starts]
    a /= a.sum(1, keepdims=True)
    fore[starts] = a
    for t in range(1, longest):
        at = starts[: live[t]] + t
        a = (a[: live[t]] @ move) * e[at]
        a /= a.sum(1, keepdims=True)
        fore[at] = a
    b = np.ones((0, e.shape[1]), e.dtype)
    for t in range(longest - 2, -1, -1):
        k = live[t + 1]
        if len(b) < k:
            b = np.vstack([b, np.ones((k - len(b), e.shape[1]), e.dtype)])
        b = (e[starts[:k] + t + 1] * b[:k]) @ move.T
        b /= b.sum(1, keepdims=True)
        back[starts[:k] + t] = b
    return fore, back


def grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def features(word: str) -> list[str]:
    """Affixes, n-grams and the word itself (for the lexicon)."""
    w = f"<{word}>"
    n = len(w)
    return [f"={word}", w[:4] + "*", w[:5] + "*", "*" + w[-4:], "*" + w[-5:], *w, *[w[i : i + 2] for i in range(n - 1)], *grams(word)]


def entries(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of chosen rows, and the row (counted among the chosen) of each; row r ends at ends[r + 1]."""
    sizes = ends[rows + 1] - ends[rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(ends[rows], sizes), owner


def least_coverage(rows: list[list[list[str]]]) -> float:
    """Half the share of known trigrams of the worst of every fifth row, by the trigrams of the other rows: what reads like no learned text lies below."""
    known = {g for n, r in enumerate(rows) if n % 5 for s in r for w in s for g in grams(w)}
    held = [np.mean([np.mean([g in known for g in grams(w)]) for s in r for w in s]) for r in rows[::5] if r]
    return 0.5 * float(min(held)) if len(held) > 1 else 0.0


class Crf:
    """index: feature to its row of weights; row 0 is the bias. Features that fitting has not met have no weight."""

    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, first: np.ndarray, move: np.ndarray, least: float = 0.0):
        self.labels, self.index, self.weights, self.first, self.move, self.least = labels, index, weights, first, move, least
        self.most = max(20_000, KEPT // max(1, len(labels)))
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, len(labels)))
        self.cover = np.empty(0)

    def packed(self) -> bytes:
        return pickle.dumps((self.labels, self.index, self.weights, self.first, self.move, self.least))

    @classmethod
    def fitted(cls, rows: list[tuple[str, str]], fit: Fit = Fit(), seed: int = 7) -> Crf:
        """rows: (text, label). Adagrad on the mean log-likelihood of label sequences, a bounded part of them at a time."""
        labels = sorted({lang for _, lang in rows})
        at, size = {lang: y for y, lang in enumerate(labels)}, len(labels)
        rng = np.random.default_rng(seed)
        read = [(sentences(text), at[lang]) for text, lang in rows]
        own = [(s, y) for r, y in read for s in r]
        seen: dict[str, Counter] = {}
        for s, y in own:
            for w in set(s):
                seen.setdefault(w, Counter())[y] += 1
        best: list[list[tuple[int, str]]] = [[] for _ in labels]
        for w, c in seen.items():
            y, n = c.most_common(1)[0]
            if n >= 2 and n >= 0.8 * c.total():
                best[y].append((n, w))
        lexicon = {f"={w}" for each in best for _, w in sorted(each, reverse=True)[: fit.lexicon]}
        sequences = [[(w, y) for w in s] for s, y in own]
        for i in rng.permutation(len(own))[: len(own) // 4] if own else ():  # code-switched text
            (s, y), (r, z) = own[i], own[rng.integers(len(own))]
            sequences.append([(w, y) for w in s] + [(w, z) for w in r])
        vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for s in sequences for w, _ in s))}
        index: dict[str, int] = {"": 0}
        each = [[0, *(index.setdefault(f, len(index)) for f in dict.fromkeys(features(w)) if f[0] != "=" or f in lexicon or f == "=")] for w in vocabulary]
        ends = np.cumsum([0, *map(len, each)])
        flat = np.array([x for f in each for x in f], np.int64)
        del each, seen, best, own
        weights, first, move = np.zeros((len(index), size)), np.zeros(size), np.zeros((size, size))
        sums = [np.full_like(x, 1e-6) for x in (weights, first, move)]
        words = sum(map(len, sequences))
        most = max(1, min(fit.cells // max(1, size), -(-words // fit.steps)))
        for _ in range(fit.rounds if words else 0):
            part: list[list[tuple[str, int]]] = []
            count = 0
            order = rng.permutation(len(sequences))
            for n, i in enumerate(order):
                part.append(sequences[i])
                count += len(sequences[i])
                if count >= most or n == len(order) - 1:
                    own_ids = np.fromiter((vocabulary[w] for s in part for w, _ in s), np.int64, count)
                    gold = np.fromiter((y for s in part for _, y in s), np.int64, count)
                    sizes = np.fromiter(map(len, part), np.int64, len(part))
                    met, ids = np.unique(own_ids, return_inverse=True)
                    places, owner = entries(ends, met)
                    grads = cls.gradients(weights, first, move, flat[places], owner, len(met), ids, gold, sizes)
                    for x, g, s in zip((weights, first, move), grads, sums, strict=True):
                        g = g / count * 100 + fit.l2 * x
                        s += g * g
                        x -= fit.rate * g / np.sqrt(s)
                    part, count = [], 0
        return cls(labels, index, weights.astype(np.float32), np.exp(first), np.exp(move), least_coverage([r for r, _ in read]))

    @staticmethod
    def gradients(weights: np.ndarray, first: np.ndarray, move: np.ndarray, flat: np.ndarray, owner: np.ndarray, words: int, ids: np.ndarray, gold: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the negative log-likelihood of sequences of words (ids, their labels gold) whose features are flat, of word owner."""
        size, starts = len(first), np.cumsum(sizes) - sizes
        scores = np.stack([np.bincount(owner, weights[flat, y], words) for y in range(size)], 1)
        e = np.exp(scores - scores.max(1, keepdims=True))[ids]
        m = np.exp(move)
        fore, back = forward_backward(e, starts, sizes, np.exp(first), m)
        inner = np.ones(len(ids), bool)
        inner[starts] = False
        cur = np.flatnonzero(inner)
        before, here = fore[cur - 1], e[cur] * back[cur]
        g_move = m * ((before / ((before @ m) * here).sum(1, keepdims=True)).T @ here)
        np.subtract.at(g_move, (gold[cur - 1], gold[cur]), 1)
        post = fore * back
        post /= post.sum(1, keepdims=True)
        post[np.arange(len(ids)), gold] -= 1
        by_word = np.stack([np.bincount(ids, post[:, y], words) for y in range(size)], 1)
        g_weights = np.stack([np.bincount(flat, by_word[owner, y], len(weights)) for y in range(size)], 1)
        return g_weights, post[starts].sum(0), g_move

    def emit(self, words: list[str]) -> None:
        """Rows of emission potentials, and shares of known trigrams, for words first met; known must hold their row numbers already."""
        if not words:
            return
        get = self.index.get
        each = [[0, *(i for f in dict.fromkeys(features(w)) if (i := get(f)) is not None)] for w in words]
        sizes = np.array([len(x) for x in each])
        scores = np.add.reduceat(self.weights[np.array([i for x in each for i in x])], np.cumsum(sizes) - sizes)
        need = len(self.known)
        if need > len(self.rows):
            self.rows = np.vstack([self.rows, np.empty((need, len(self.labels)))])
            self.cover = np.concatenate([self.cover, np.empty(need)])
        at = [self.known[w] for w in words]
        self.rows[at] = np.exp(scores - scores.max(1, keepdims=True))
        self.cover[at] = [sum(g in self.index for g in own) / len(own) for own in map(grams, words)]

    def votes(self, ids: list[int], owners: list[tuple[int, int]], rows: int) -> np.ndarray:
        """By row the expected words of each language, then the sum of the words' shares of known trigrams. ids: words, -1
        between sequences. owners: (row, end) of the ids of each row."""
        at = np.array(ids, np.int64)
        word = at >= 0
        out = np.zeros((rows, len(self.labels) + 1))
        if not word.any():
            return out
        begins = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        sizes = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) - begins + 1
        parts = -(-sizes // CHAIN)
        step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * CHAIN
        starts, rest = np.repeat(begins, parts) + step, np.repeat(sizes, parts) - step
        e = np.ones((len(at), len(self.labels)))
        e[word] = self.rows[at[word]]
        fore, back = forward_backward(e, starts, np.minimum(rest, CHAIN), self.first, self.move)
        post = fore[word] * back[word]
        post /= post.sum(1, keepdims=True)
        ends = np.array([end for _, end in owners])
        owner = np.repeat([row for row, _ in owners], np.diff(ends, prepend=0))[word]
        for y in range(len(self.labels)):
            out[:, y] = np.bincount(owner, post[:, y], rows)
        out[:, -1] = np.bincount(owner, self.cover[at[word]], rows)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, its share of the expected words, share of known trigrams in a word) of each text."""
        total = np.zeros((len(texts), len(self.labels) + 1))
        ids: list[int] = []
        owners: list[tuple[int, int]] = []
        new: list[str] = []

        def read() -> None:
            nonlocal total
            self.emit(new)
            total += self.votes(ids, owners, len(texts))
            for held in (ids, owners, new):
                held.clear()
            if len(self.known) > self.most:
                self.known.clear()
                self.rows, self.cover = self.rows[: self.most], self.cover[: self.most]

        known, stops = self.known, STOPS
        for i, t in enumerate(texts if self.labels else ()):
            for part in chunks(t) if t else ():
                for w in WORDS.findall(part.lower()):
                    if w in stops:
                        ids.append(-1)
                    else:
                        n = known.get(w)
                        if n is None:
                            n = known[w] = len(known)
                            new.append(w)
                        ids.append(n)
                ids.append(-1)
                owners.append((i, len(ids)))
                if len(ids) >= SLICE or len(known) > self.most:
                    read()
        if ids:
            read()
        out = []
        for t, v in zip(texts, total, strict=True):
            words = v[:-1].sum()
            if words < 0.5 or not any(map(str.isalpha, t)):
                out.append((UNKNOWN, 0.0, 0.0))
            else:
                best = int(v[:-1].argmax())
                out.append((self.labels[best], min(1.0, float(v[best] / words)), min(1.0, float(v[-1] / words))))
        return out

    def label_words(self, text: str) -> list[tuple[str, str]]:
        """(word, most probable language) in order: for code-switched text."""
        out = []
        for s in sentences(text):
            new = [w for w in dict.fromkeys(s) if w not in self.known]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.emit(new)
            e = self.rows[[self.known[w] for w in s]]
            fore, back = forward_backward(e, np.array([0]), np.array([len(s)]), self.first, self.move)
            out += [(w, self.labels[k]) for w, k in zip(s, (fore * back).argmax(1), strict=True)]
        return out


#: The last model that a Python worker has read, by the hash of its bytes: words met by one task are known to the next.
_READ: dict[str, Crf] = {}


def unpacked(model: bytes) -> Crf:
    name = xxh3_64_hexdigest(model)
    if name not in _READ:
        _READ.clear()
        _READ[name] = Crf(*pickle.loads(model))
    return _READ[name]


def sampled(docs: DataFrame, learn: Column, sample: Sample = Sample(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(_t, _l): at most sample.rows rows of each language, chosen by a hash of key and text; _t holds their chosen sentences, a line
    each. One count a language is sent to the driver."""
    labelled = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("_t"), F.col(lang).cast("string").alias("_l"), F.col(key).alias("_i"))
    counts = labelled.groupBy("_l").count().collect()
    shares = [F.lit(x) for r in sorted(counts) for x in (r[0], min(1.0, 1.5 * sample.rows / r[1] + 20 / r[1]))]
    luck = F.pmod(F.xxhash64("_i", "_t", F.lit(sample.seed)), F.lit(1 << 30)) / float(1 << 30)
    some = labelled.withColumn("_k", luck).where(F.col("_k") < F.element_at(F.create_map(*shares), F.col("_l")) if shares else F.lit(False))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 0):
            read = map(sentences, b.column(0).to_pylist())
            lines = ["\n".join(" ".join(s) for s in r[:: max(1, -(-len(r) // sample.sentences))]) for r in read]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), b.column(1), b.column(2)], ["_t", "_l", "_k"])

    rank = F.row_number().over(W.partitionBy("_l").orderBy("_k", "_t"))
    lines = some.select("_t", "_l", "_k").mapInArrow(spread, "_t string, _l string, _k double")
    return lines.withColumn("_n", rank).where(F.col("_n") <= sample.rows).select("_t", "_l")


def fitted_model(rows: DataFrame, fit: Fit = Fit()) -> bytes:
    """The packed model of sampled() rows, fitted in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([Crf.fitted(held, fit).packed()], pa.binary())], ["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return bytes(found[0][0]) if found else Crf.fitted([], fit).packed()


def identify(docs: DataFrame, model: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score of every whole text. The model's size is bounded by Sample and Fit and is broadcast."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = unpacked(shipped.value)
        for b in portions(batches, 1):
            found = crf.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, *_ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64())], [key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def identified_rows(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that are in a learned language: texts without a letter go, and those that share
    fewer trigrams with the sample than half of what its own worst held-out row does. All rows stay if nothing could be learned."""
    at = docs.columns.index(text)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = unpacked(shipped.value)
        for b in portions(batches, at):
            found = crf.predict(b.column(at).to_pylist()) if crf.labels else [(None, 1.0, 1.0)] * b.num_rows
            yield b.filter(pa.array([x != UNKNOWN and c >= crf.least for x, _, c in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted_model(sampled(docs, ~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
