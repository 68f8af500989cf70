"""Models behind small interfaces: encoders, rerankers and language models, each a factory that workers call once.

A factory is a callable without arguments; what it returns stays with the worker process. Language models answer
prompts; a call that keeps failing gives null, and whoever asked falls back on what it had."""

from __future__ import annotations

import contextlib
import hashlib
import random
import re
import time
import uuid
import weakref
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Status codes and words of errors worth another try (fixed values).
TRANSIENT_STATUS = (408, 409, 425, 429, 500, 502, 503, 504)
TRANSIENT_WORDS = (
    "timeout", "timed out", "temporarily", "overloaded", "unavailable",
    "rate limit", "ratelimit", "connection", "reset by peer", "try again",
)

_made: dict[str, object] = {}
_NAMES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


class Shared:
    """A factory under a name of its own, given on the driver: worker processes, which serve many
    plans, make what it makes once, and never take it for that of another factory."""

    def __init__(self, factory: Callable[[], object]):
        self.factory, self.name = factory, uuid.uuid4().hex
        with contextlib.suppress(TypeError):  # not every callable can be referred to weakly
            self.name = _NAMES.setdefault(factory, self.name)

    def get(self):
        if self.name not in _made:
            _made[self.name] = self.factory()
        return _made[self.name]


@dataclass(frozen=True)
class Retry:
    """How a call to a service is repeated: errors that pass (by type, status or wording) are met with waits that double
    up to a longest one, each a little longer by chance, so that workers do not come back together."""

    attempts: int = 3
    first: float = 0.5
    longest: float = 8.0
    sleep: Callable[[float], None] = time.sleep

    @staticmethod
    def passes(error: BaseException) -> bool:
        if isinstance(error, (TimeoutError, ConnectionError)):
            return True
        statuses = {s for s in (getattr(error, name, None) for name in ("status_code", "status")) if type(s) is int}
        if statuses & set(TRANSIENT_STATUS):
            return True
        return re.search("|".join(TRANSIENT_WORDS), f"{type(error).__name__} {error}", re.IGNORECASE) is not None

    def waits(self) -> Iterator[float]:
        wait = self.first
        for _ in range(self.attempts - 1):
            yield min(wait, self.longest) * random.uniform(1, 1.25)
            wait *= 2

    def run(self, call: Callable):
        for wait in self.waits():
            try:
                return call()
            except Exception as error:
                if not self.passes(error):
                    raise
            self.sleep(wait)
        return call()


class HashEncoder:
    """Tokens counted by a hash into a vector of unit length: an encoder for tests and a stand-in offline."""

    dim = 64

    def encode(self, texts: list[str], query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for raw in re.split(r"[^A-Za-z0-9]+", t or ""):
                if raw:
                    parts = [raw.lower(), *(p.lower() for p in re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", raw).split() if p.lower() != raw.lower())]
                    for p in parts:
                        out[i, int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "big") % self.dim] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class OverlapReranker:
    """The share of the query's words that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        q = set(re.findall(r"\w+", query.lower()))
        return [len(q & set(re.findall(r"\w+", (t or "").lower()))) / max(1, len(q)) for t in texts]


def embed(df: DataFrame, factory: Callable[[], object] = HashEncoder, text: str = "embed_text", out: str = "vector", query: bool = False, prefix: str = "", batch: int = 64) -> DataFrame:
    """df with the vectors of a text column."""
    shared = Shared(factory)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = shared.get()
        for f in frames:
            texts = [prefix + (t or "") for t in f[text]]
            parts = [encoder.encode(texts[i : i + batch], query) for i in range(0, len(texts), batch)]
            yield f.assign(**{out: [v.tolist() for p in parts for v in p]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out)
    return df.drop(out).mapInPandas(run, f"{fields}, `{out}` array<float>")


def rerank(pairs: DataFrame, factory: Callable[[], object] = OverlapReranker, query: str = "query", text: str = "text", out: str = "rerank_score") -> DataFrame:
    """pairs with a model's score of each query and text; 0 where the model fails."""
    shared = Shared(factory)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.get()
        for f in frames:
            scores = pd.Series(0.0, index=f.index)
            for q, own in f.groupby(query, sort=False):
                try:
                    scores[own.index] = Retry().run(lambda q=q, own=own: model.score(q, own[text].tolist()))
                except Exception:
                    continue
            yield f.assign(**{out: scores})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name != out)
    return pairs.drop(out).mapInPandas(run, f"{fields}, `{out}` double")


def generate(prompts: DataFrame, factory: Callable[[], object], prompt: str = "prompt", out: str = "reply", max_tokens: int = 4096, attempts: int = 3) -> DataFrame:
    """prompts with a language model's replies; null where it fails. The model has generate(prompt, max_tokens) -> str."""
    shared = Shared(factory)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.get()

        def ask(p):
            try:
                return Retry(attempts).run(lambda: model.generate(p, max_tokens))
            except Exception:
                return None

        for f in frames:
            yield f.assign(**{out: [ask(p) for p in f[prompt]]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields if f.name != out)
    return prompts.drop(out).mapInPandas(run, f"{fields}, `{out}` string")
