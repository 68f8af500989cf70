"""Words, and 64-bit hashes of words and of runs of words, in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

from quarry.llm.arrow import Memo

#: Words whose hash a worker remembers.
MEMO_WORDS = 300_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
word_hash = Memo(xxhash.xxh3_64_intdigest, MEMO_WORDS)
word_hash_128 = Memo(xxhash.xxh3_128_digest, MEMO_WORDS)


def split(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, as UTF-8; bytes.split() parts at exactly these characters."""
    return text.encode().split() if text else []


def split_lower(text: str | None) -> list[bytes]:
    """The same after lower-casing A-Z alone, which bytes.lower() does."""
    return text.encode().lower().split() if text else []


def hashes_128(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word, as columns."""
    return np.frombuffer(b"".join(map(word_hash_128.__getitem__, words)), dtype=np.uint64).reshape(-1, 2)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n at least."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1024), b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        got = _powers[base] = tuple(both)
    return got


def runs(h: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A hash of every run of width words, by its start; lanes give independent hashes."""
    n = len(h)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    power, inverse = _power(_BASES[lane], n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * power[:n], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * inverse[: n - width + 1])
