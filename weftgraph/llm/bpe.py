"""Exact BPE in linear time: longest matches, backtracking and memoised compatibility of adjacent tokens.

Symbols are characters below 512 (a byte as Latin-1, plus 256 when it ends a word in vocabularies with word ends), so
that pyahocorasick can match whole vocabularies.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import ahocorasick
import tiktoken
from tokenizers import Regex, normalizers

NEVER = 1 << 60
#: Code points of a text whose pieces are listed together.
STRETCH = 1 << 20
#: A place where no piece goes on from before: an ASCII space after something else. (What re holds for no space, the libraries do too.)
BORDER = re.compile(r"(?<=\S)[ \n]")


def stretches(text: str) -> Iterator[str]:
    """The text cut at borders, about every STRETCH code points."""
    begin = 0
    while len(text) - begin > STRETCH:
        m = BORDER.search(text, begin + STRETCH)
        if not m:
            break
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


@cache
def every_code_point() -> str:
    return "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)


@cache
def ranks_class(pattern: str) -> list[int]:
    """The code points that the tiktoken library holds for a class such as \\p{L}; its Unicode tables are newer than Python's."""
    library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return list(map(ord, bytes(library.encode_ordinary(every_code_point())).decode()))


@cache
def json_class(pattern: str) -> list[int]:
    """The code points that the tokenizers library holds for a class."""
    return list(map(ord, normalizers.Replace(Regex(f"[^{pattern}]+"), "").normalize_str(every_code_point())))


def inside_class(points: list[int], top: int) -> str:
    """The inside of a character class for ascending code points up to a top."""
    ranges: list[list[int]] = []
    for c in points:
        if c > top:
            break
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in ranges)


def piece_pattern(pattern: str, members: Callable[[str], list[int]], top: int = sys.maxunicode) -> re.Pattern:
    r"""A tokenizer's split pattern for re, which is faster than regex here but knows no \p{..}; for texts up to a code point."""
    letters, numbers, space = (inside_class(members(c), top) for c in (r"\p{L}", r"\p{N}", r"\s"))
    pattern = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(pattern.replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", f"[{space}]"))


def in_latin1(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Pieces:
    """Splits texts; a pattern with small classes serves texts within Latin-1 three times as fast, with the same pieces.

    members: the library's code points of a class.
    """

    def __init__(self, pattern: str, members: Callable[[str], list[int]]):
        self.pattern, self.members = pattern, members
        self.small = piece_pattern(pattern, members, 255)

    @cached_property
    def full(self) -> re.Pattern:
        return piece_pattern(self.pattern, self.members)

    def __call__(self, text: str) -> list[str]:
        return (self.small if in_latin1(text) else self.full).findall(text)


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from 256 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}


class Bpe:
    """texts: token id to symbol string. born: when a token's last merge happens (-1: a symbol). halves: the two parts of that merge."""

    def __init__(self, texts: dict[int, str], born: dict[int, int], halves: dict[int, tuple[int, int]], merged=None):
        self.texts, self.born, self.halves = texts, born, halves
        self.ids = {s: i for i, s in texts.items()}
        self.merged = merged or (lambda x, y: self.ids.get(self.texts[x] + self.texts[y]))
        self.sizes = {i: len(s) for i, s in texts.items()}
        self.matcher = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.matcher.add_word(s, i)
        self.matcher.make_automaton()
        self.shorter = {i: next((self.ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.ids), None) for i, s in texts.items()}
        self.fits: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_ranks(cls, path: str) -> Bpe:
        """A tiktoken rank file; parts of a token are what its bytes merge to by lower ranks."""
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        halves = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = [token[i : i + 1] for i in range(len(token))]
                while len(parts) > 2:
                    best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], NEVER) if len(parts[i] + parts[i + 1]) < len(token) else NEVER)
                    parts[best : best + 2] = [parts[best] + parts[best + 1]]
                halves[rank] = (ranks[parts[0]], ranks[parts[1]])
        return cls({r: t.decode("latin-1") for t, r in ranks.items()}, {r: r if len(t) > 1 else -1 for t, r in ranks.items()}, halves)

    @classmethod
    def from_json(cls, path: str) -> Bpe:
        """A tokenizers file with byte-level symbols; a word-end suffix becomes 256 more on the last symbol."""
        model = json.load(open(path))["model"]
        end = model.get("end_of_word_suffix") or ""
        as_byte = byte_symbols()

        def symbols(s: str) -> str:
            ends = bool(end) and s.endswith(end)
            out = [chr(as_byte[c]) for c in (s[: -len(end)] if ends else s)]
            return "".join(out[:-1]) + chr(ord(out[-1]) + 256) if ends else "".join(out)

        special = {x["content"] for x in json.load(open(path))["added_tokens"]}
        vocab = {s: i for s, i in model["vocab"].items() if s not in special}
        born, halves, pairs = {i: -1 for i in vocab.values()}, {}, {}
        for n, (a, b) in enumerate(model["merges"]):
            t = vocab[a + b]
            pairs.setdefault((vocab[a], vocab[b]), t)
            if born[t] < 0:
                born[t], halves[t] = n, (vocab[a], vocab[b])
        return cls({i: symbols(s) for s, i in vocab.items()}, born, halves, lambda x, y: pairs.get((x, y)))

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b stay apart: undo their merges backwards in time and look for one across the border that came first."""
        key = (a, b)
        if (known := self.fits.get(key)) is not None:
            return known
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        born, halves = self.born, self.halves
        until_a = until_b = NEVER
        out = True
        while True:
            t = self.merged(a, b)
            if t is not None and (at := born[t]) < until_a and at <= until_b:  # of equal merges the left one comes first
                out = False
                break
            if born[a] < 0 and born[b] < 0:
                break
            if born[a] > born[b]:
                until_a, a = born[a], halves[a][1]
            else:
                until_b, b = born[b], halves[b][0]
        self.fits[key] = out
        return out

    def encode(self, s: str) -> list[int]:
        """The tokens of one piece of symbols."""
        if (whole := self.ids.get(s)) is not None:
            return [whole]
        n, sizes = len(s), self.sizes
        longest = [0] * n
        for end, t in self.matcher.iter(s):
            longest[end - sizes[t] + 1] = t  # ends ascend: the longest comes last
        dead, out, at = bytearray(n + 1), [], 0
        t = longest[0]
        while True:
            end = at + sizes[t]
            if not dead[end] and (not out or self.compatible(out[-1], t)):
                out.append(t)
                at = end
                if at == n:
                    return out
                t = longest[at]
            elif (less := self.shorter[t]) is not None:
                t = less
            else:
                dead[at] = 1
                t = out.pop()
                at -= sizes[t]

    def prefix_counts(self, s: str) -> tuple[list[int], list[int]]:
        """(last token, token count) of every prefix of s, by dynamic programming: a prefix's last token is the one match
        ending there that is compatible with the last token of what stands before it. Index 0 is the empty prefix."""
        n, sizes = len(s), self.sizes
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end, t in self.matcher.iter(s):
            end += 1
            begin = end - sizes[t]
            if last[end] < 0 and (not begin or last[begin] >= 0 and self.compatible(last[begin], t)):
                last[end], count[end] = t, count[begin] + 1
        return last, count
