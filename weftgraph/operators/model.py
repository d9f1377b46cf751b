"""External model calls and embeddings behind protocols, with deterministic stand-ins that need no network.

A reply is paid for once: results are written by key, and a restart skips the keys that are there (skip_done).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from hashlib import blake2b
from itertools import islice
from typing import Protocol
from urllib import error, request

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.config import Model


class ModelClient(Protocol):
    def complete(self, prompt: str) -> str: ...


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Refused(Exception):
    """The service won't answer this prompt; asking again doesn't help."""


class HttpClient:
    """A chat-completion service; made on the workers, so that its secrets come from their environment."""

    def __init__(self, url: str, model: str, key: str, config: Model = Model()):
        self.url, self.model, self.key, self.config = url, model, key, config

    def complete(self, prompt: str) -> str:
        cause = "no reply"
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.config.max_tokens}).encode()
        for n in range(self.config.request_tries):
            try:
                ask = request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
                with request.urlopen(ask, timeout=self.config.timeout) as reply:
                    return json.load(reply)["choices"][0]["message"]["content"]
            except error.HTTPError as e:
                if e.code in (400, 450, 451):
                    raise Refused(f"status {e.code}") from e
                cause = f"status {e.code}"
            except (OSError, ValueError, KeyError, IndexError, TypeError) as e:  # the connection, or a reply that isn't one
                cause = f"{type(e).__name__}: {e}"
            if n + 1 < self.config.request_tries:
                time.sleep(self.config.request_pause)
        raise Refused(f"no reply after {self.config.request_tries} tries: {cause}")


#: Of each mode: the variables of the workers' environment that hold the address, the key and the model.
MODES = {"internal": ("WEFT_INTERNAL_URL", "WEFT_INTERNAL_KEY", "WEFT_INTERNAL_MODEL"), "standard": ("WEFT_CHAT_URL", "WEFT_CHAT_KEY", "WEFT_CHAT_MODEL")}


def chosen_mode(mode: str, settings: Mapping[str, str]) -> str:
    """internal, standard, or auto: the first of both whose address is set. Fails if a mode's address isn't."""
    if mode != "auto" and mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    ready = [m for m in MODES if settings.get(MODES[m][0])]
    if mode == "auto" and ready:
        return ready[0]
    if mode not in ready:
        raise ValueError(f"no address for mode {mode}")
    return mode


def http_client(mode: str = "auto", config: Model = Model()) -> Callable[[], ModelClient]:
    """A maker of clients; the mode and its settings are read where the client is made, on the workers."""

    def make() -> ModelClient:
        url, key, model = (os.environ.get(n, "") for n in MODES[chosen_mode(mode, os.environ)])
        return HttpClient(url, model, key, config)

    return make


class ModelEncoder:
    """Adapts a model with encode(texts, ...) that gives vectors, or a mapping that holds them under `field`, such as the libraries
    of sentence encoders have. made by `load` on the worker, once a task."""

    def __init__(self, load: Callable[[], object], field: str = "dense_vecs", **options):
        self.model, self.field, self.options = load(), field, options

    def encode(self, texts: list[str]) -> np.ndarray:
        found = self.model.encode(texts, **self.options)
        return np.asarray(found[self.field] if isinstance(found, Mapping) else found, np.float32)


class StubClient:
    """Answers extraction prompts with an object of the longest words, dependency prompts with an array over the listed names."""

    def complete(self, prompt: str) -> str:
        body = prompt.rsplit("\n\n", 1)[-1]
        if body.startswith("["):
            names = json.loads(body)
            rows = [{"from": a, "to": b, "score": 1 + blake2b(f"{a}\x00{b}".encode(), digest_size=2).digest()[0] % 5, "reason": "order"} for a, b in zip(names, names[1:], strict=False)]
            return f"Here it is: {json.dumps(rows)}"
        words = sorted(dict.fromkeys(w for w in body.split() if w.isalpha()), key=lambda w: (-len(w), w))[:8]
        return "```json\n" + json.dumps({str(i + 1): f"{w} - the concept of {w}" for i, w in enumerate(words)}) + "\n```"


class HashEncoder:
    """Signed counts of hashed character trigrams."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            w = f"  {t.lower()}  "
            for k in range(len(w) - 2):
                h = int.from_bytes(blake2b(w[k : k + 3].encode(), digest_size=4).digest(), "little")
                out[i, h % self.size] += 1 if h >> 31 else -1
        return out


def completed(prompts: DataFrame, client: Callable[[], ModelClient], accept: Callable[[str], bool], config: Model = Model(pause=0.0), key: str = "key") -> DataFrame:
    """(key, raw, attempts, status) of (key, prompt): each round asks only for what has no accepted reply yet; the last raw
    reply stays. status: ok, unparsed, refused. A task holds `batch` prompts and `threads` requests at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = client()

        def ask(prompt: str) -> tuple[str | None, bool]:
            try:
                return own.complete(prompt), False
            except Refused as e:
                return str(e), True

        with ThreadPoolExecutor(config.threads) as pool:
            for b in batches:
                rows = iter(b.itertuples(index=False))
                while part := list(islice(rows, config.batch)):
                    raw: list[str | None] = [None] * len(part)
                    status, attempts, left = ["unparsed"] * len(part), [0] * len(part), list(range(len(part)))
                    for n in range(config.rounds):
                        for i, (text, refused) in zip(left, pool.map(ask, [part[i][1] for i in left]), strict=True):
                            raw[i], attempts[i] = text, n + 1
                            status[i] = "refused" if refused else "ok" if text is not None and accept(text) else "unparsed"
                        left = [i for i in left if status[i] == "unparsed"]
                        if not left:
                            break
                        time.sleep(config.pause)
                    yield pd.DataFrame({key: [p[0] for p in part], "raw": raw, "attempts": attempts, "status": status})

    kind = dict(prompts.dtypes)[key]
    return prompts.select(key, "prompt").mapInPandas(run, f"`{key}` {kind}, raw string, attempts int, status string")


def has_object(reply: str) -> bool:
    """Whether a reply holds a JSON object, fenced or bare."""
    fence = reply.find("```json")
    if fence >= 0 and (end := reply.find("```", fence + 7)) >= 0:
        text = reply[fence + 7 : end]
    else:
        text = reply[reply.find("{") : reply.rfind("}") + 1]
    return isinstance(loaded(text), dict)


def has_array(reply: str) -> bool:
    return isinstance(loaded(reply[reply.find("[") : reply.rfind("]") + 1]), list)


def loaded(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def skip_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key isn't in the results of earlier runs; stands before the model call, as no filter moves past one."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def embedded(names: DataFrame, encoder: Callable[[], Encoder], batch: int = 256, text: str = "name") -> DataFrame:
    """names with vec; the encoder is made once a task and gets `batch` texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder()
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                yield part.assign(vec=list(own.encode(part[text].tolist())))

    fields = ", ".join(f"`{n}` {k}" for n, k in names.dtypes)
    return names.mapInPandas(run, f"{fields}, vec array<float>")


def lexical_weights(names: DataFrame, text: str = "name") -> DataFrame:
    """names with lex, a map from each word to its share of the text's words: a sparse embedding."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    share = lambda w: F.size(F.filter(words, lambda x: x == w)) / F.size(words)
    return names.withColumn("lex", F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, share(w).cast("float")))))
