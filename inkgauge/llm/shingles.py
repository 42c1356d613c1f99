"""Word and shingle hashes of whole texts, a chunk of texts at a time in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 1 << 18
_PRIME = 0x100000001B3
_INVERSE = pow(_PRIME, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = 0x9E3779B97F4A7C15
_KEEP = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_LOWER = bytes.maketrans(b"\t\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"     abcdefghijklmnopqrstuvwxyz")
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + np.uint64((seed + 1) * _STEP & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2 ** 64; kept up to a few chunks' length."""
    if n <= len(_powers[0]):
        return _powers[0][:n], _powers[1][:n]
    size = max(n, CHUNK_BYTES + 4096)
    made = []
    for base in (_PRIME, _INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    if size <= 4 * CHUNK_BYTES:
        _powers[:] = made
    return made[0][:n], made[1][:n]


@dataclass
class Chunk:
    """Some texts: hash of each word, the words of text i being cut[i]:cut[i + 1], and where words lie in raw."""

    first: int
    cut: np.ndarray
    hashes: np.ndarray
    raw: bytes
    begin: np.ndarray
    end: np.ndarray


def chunks(texts: list[str | None], lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts in chunks of about most bytes (a longer text is a chunk of its own); null is the empty text."""
    table = _LOWER if lower else _KEEP
    first, parts, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace").translate(table)
        if size and size + len(raw) > most:
            yield hashed(first, parts)
            first, parts, size = i, [], 0
        parts.append(raw)
        size += len(raw) + 1
    if parts:
        yield hashed(first, parts)


def hashed(first: int, parts: list[bytes]) -> Chunk:
    raw = b" ".join([b"", *parts, b""])
    b = np.frombuffer(raw, np.uint8)
    word = b != 32
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    power, inverse = powers(len(b))
    total = np.cumsum((b + np.uint64(1)) * power, dtype=np.uint64)
    value = (total[end - 1] - total[begin - 1]) * inverse[begin]
    starts = np.cumsum([1, *(len(p) + 1 for p in parts)])
    return Chunk(first, np.searchsorted(begin, starts), mixed(value + mixed((end - begin).astype(np.uint64), 1)), raw, begin, end)


def windows(hashes: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    """The hash of each k words in a row (order counts); windows may reach over texts, callers cut them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total = total * np.uint64(_PRIME) + hashes[j : j + n]
    return mixed(total, seed)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, lower-cased ASCII; fewer words make one shingle, none the empty set."""
    for c in chunks(texts, lower=True):
        all_windows = windows(c.hashes, k)
        for a, b in zip(c.cut[:-1].tolist(), c.cut[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(all_windows[a : b - k + 1])
            else:
                yield windows(c.hashes[a:b], b - a, 100 + b - a) if b > a else c.hashes[:0]


def long_windows(hashes: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """As windows(), by prefix sums: the cost doesn't depend on k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(hashes) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)))
    return mixed((total[k:] - total[:-k]) * inverse[:n], seed)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k values in a row, by doubling."""
    if len(x) < k:
        return x[:0]
    span = 1
    while 2 * span <= k:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return x if span == k else np.minimum(x[: len(x) - (k - span)], x[k - span :])
