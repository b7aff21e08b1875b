"""Vectorized word hashes over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(raw: bytes, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of ``[^\\x20\\x09-\\x0D]+``; fold lower-cases A-Z first.

    A word of up to eight bytes is its own number before it is mixed, so such words never
    collide with one another; one of up to 16 is two numbers, a longer one its xxHash.
    """
    b = np.frombuffer(raw, np.uint8)
    if fold:
        b = _FOLD[b]
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([b, np.zeros(16, np.uint8)]), 8)
    size = end - start
    keep = _U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * np.clip(size, 1, 8).astype(np.uint64))
    value = mix((eights[start].view("<u8")[:, 0] & keep) + _U(_BASE))
    two = np.flatnonzero((size > 8) & (size <= 16))
    if len(two):
        keep = _U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * (size[two] - 8).astype(np.uint64))
        value[two] = mix(value[two] * _U(_BASE) ^ mix((eights[start[two] + 8].view("<u8")[:, 0] & keep) + size[two].astype(np.uint64)))
    long = np.flatnonzero(size > 16)
    if len(long):
        import xxhash

        view = memoryview(b)
        value[long] = [xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(start[long].tolist(), end[long].tolist())]
    return value, start, end


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * _U(_BASE) + words[k : len(words) - n + 1 + k]
    return mix(out)
