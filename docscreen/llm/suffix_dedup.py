"""Suffix-array dedup: a hash-compared suffix sort.

Suffixes that begin at a shared anchor (see ``repeats``) are sorted by merging. Two suffixes
are compared by the length of their common extension, found by binary search on prefix
polynomial hashes, and by the byte after it: a comparison takes the logarithm of the length.
All merges of a level, over all groups of a block, run as one vectorized step. The common
extensions of neighbours in the final order are verified byte by byte; if a hash has lied,
the block is sorted again by the bytes themselves.

The sorted suffixes to the right of the anchors and the sorted reversed prefixes to the left
give, from their common extensions, which strings agree for any number of bytes.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is removed.

Defined results: null and empty texts have no bytes; rows that repeat an id are documents of
their own, so repeated rows remove one another; texts shorter than ``length`` lose nothing;
other columns are ignored. What is left may be no valid UTF-8, so it is kept as binary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow
from .hashing import mix, powers
from .repeats import MOST, Plan, fingerprint, id_of, merged, spans

LENGTH, GRAM = 200, 32
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def symbols(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n bytes, from prefix hashes."""
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum((s.astype(np.uint64) + _U(1)) * powers(_INVERSE, len(s)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(_BASE, len(s))[: len(s) - n + 1])


def _common(prefix: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common extension of each pair of rows, by binary search on prefix hashes [length, row]."""
    low, high = np.zeros(len(a), np.int64), np.minimum(size[a], size[b])
    while (open_ := low < high).any():
        middle = (low + high + 1) >> 1
        equal = (prefix[middle, a] == prefix[middle, b]) & open_
        low = np.where(equal, middle, low)
        high = np.where(open_ & ~equal, middle - 1, high)
    return low


def _before(text: np.ndarray, prefix: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Whether each row of a sorts before that of b; ties says what equal ones count as. The end of a string is less than any byte."""
    n = _common(prefix, size, a, b)
    x = np.where(n < size[a], text[np.minimum(n, len(text) - 1), a].astype(np.int16), -1)
    y = np.where(n < size[b], text[np.minimum(n, len(text) - 1), b].astype(np.int16), -1)
    return (x < y) | ((x == y) & ties)


def merge_sort(text: np.ndarray, prefix: np.ndarray, size: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows in order within each group of consecutive rows; all runs of one width are merged at once."""
    n = len(group)
    order, count = np.arange(n), np.diff(start, append=n)
    place = np.arange(n) - start[group]
    width = 1
    while len(todo := np.flatnonzero(count[group] > width)):
        first, total, at = start[group[todo]], count[group[todo]], place[todo]
        run = at // width
        other = run ^ 1
        base = np.minimum(other * width, total)
        low, high = np.zeros(len(todo), np.int64), np.minimum(base + width, total) - base
        own, later = order[first + at], run & 1 == 1
        while len(k := np.flatnonzero(low < high)):
            middle = (low[k] + high[k]) >> 1
            less = _before(text, prefix, size, order[first[k] + base[k] + middle], own[k], later[k])
            low[k] = np.where(less, middle + 1, low[k])
            high[k] = np.where(less, high[k], middle)
        order[first + (run >> 1) * 2 * width + at - run * width + low] = own
        width *= 2
    return order


def classes(rows: list[np.ndarray], group: np.ndarray, depth: int) -> np.ndarray:
    """Classes [d, row]: rows of one group have equal numbers at d if their first d bytes agree; rows shorter than d are alone."""
    n = len(rows)
    size = np.array([min(len(x), depth) for x in rows])
    text = np.zeros((depth, n), np.uint8)
    flat = np.zeros((n, depth), np.uint8)
    for i, x in enumerate(rows):
        flat[i, : size[i]] = x[:depth]
    text[:] = flat.T
    prefix = np.zeros((depth + 1, n), np.uint64)
    for d in range(depth):
        prefix[d + 1] = prefix[d] * _U(_BASE) + text[d] + _U(1)
    start = np.flatnonzero(np.diff(group, prepend=-1))
    order = merge_sort(text, prefix, size, start, group)
    common = _neighbours(text, size, group, order, prefix)
    if common is None:  # a hash collision: sort by the bytes
        order = np.array(sorted(range(n), key=lambda i: (group[i], flat[i, : size[i]].tobytes())))
        common = _neighbours(text, size, group, order, None)
    out, at = np.empty((depth + 1, n), np.int32), np.arange(n, dtype=np.int32)
    for d in range(depth + 1):
        out[d, order] = np.maximum.accumulate(np.where(common < d, at, 0))
    return out


def _neighbours(text: np.ndarray, size: np.ndarray, group: np.ndarray, order: np.ndarray, prefix: np.ndarray | None) -> np.ndarray | None:
    """Common extension of each row with the one before it in order, -1 at the start of a group; None if the hashes' lengths or order aren't the bytes'."""
    a, b = order[:-1], order[1:]
    least = np.minimum(size[a], size[b])
    true = np.empty(len(a), np.int64)
    step = max(1, 8_000_000 // max(1, len(text)))
    for i in range(0, len(a), step):
        differ = text[:, a[i : i + step]] != text[:, b[i : i + step]]
        true[i : i + step] = np.where(differ.any(0), differ.argmax(0), len(text))
    true = np.minimum(true, least)
    same = group[a] == group[b]
    if prefix is not None:
        end = np.minimum(true, len(text) - 1)
        x, y = np.where(true < size[a], text[end, a].astype(np.int16), -1), np.where(true < size[b], text[end, b].astype(np.int16), -1)
        if ((_common(prefix, size, a, b) != true) | (x > y))[same].any():
            return None
    return np.concatenate([[-1], np.where(same, true, -1)])


def both(hulls: list[bytes], at: np.ndarray, group: np.ndarray, right: int, left: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the bytes from place ``at`` of each hull on, and of those before it read backwards."""
    rows = [symbols(x) for x in hulls]
    return classes([x[k:] for x, k in zip(rows, at)], group, right), classes([x[:k][::-1] for x, k in zip(rows, at)], group, left)


def plan(length: int = LENGTH, gram: int = GRAM, most: int = MOST, fingerprint: Callable = fingerprint) -> Plan:
    return Plan(length, gram, str.encode, symbols, None, grams, both, "any", most, fingerprint)


def remove_repeats(docs: DataFrame, cut: Plan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for d, v, packed, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                raw, gone = unpack(packed.as_py()), merged(found.as_py())
                ends = [0, *(e for _, e in gone)]
                kept = b"".join(raw[a:e] for a, e in zip(ends, [*(s for s, _ in gone), len(raw)])) if gone else raw
                rows.append((id_of(d, v), len(raw), len(raw) - len(kept), len(gone), kept))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_arrow(spans(docs, cut or plan(), id_col, text_col), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
