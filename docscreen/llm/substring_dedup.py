"""Substring dedup by seed and extend.

Seeds are winnowed runs of SEED words; documents are joined on them. From each seed shared
by different surroundings, matches are extended word by word to the right and to the left,
all occurrences at once: those that agreed so far are told apart by their next word. Repeats
of at least ``length`` words that contain the seed are kept (see ``repeats``), and each word
that one covers is removed where the same words start in a document with a smaller id.

Seeds are found by hashes of words; matches are extended over the words themselves.

Defined results: null and empty texts have no words; a null id counts as greater than all
others; rows that repeat an id are one document, whose texts don't remove one another;
texts shorter than ``length`` words lose nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow
from .hashing import gram_hashes, word_hashes
from .repeats import MOST, Plan, fingerprint, id_of, merged, spans

LENGTH, SEED = 50, 8


def normal(text: str) -> bytes:
    """The words of a text, joined by one space. ``bytes.split`` cuts at exactly the six characters of the word rule."""
    return b" ".join(text.encode().split())


def symbols(raw: bytes) -> np.ndarray:
    return word_hashes(raw)[0]


def places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of such a text."""
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    return np.concatenate([[0], gaps + 1]).tolist(), np.append(gaps, len(raw)).tolist()


def extend(rows: list[np.ndarray], group: np.ndarray, depth: int) -> np.ndarray:
    """Classes [d, row]: rows of one group have equal numbers at d if their first d words agree; rows shorter than d are alone."""
    n = len(rows)
    size = np.array([len(x) for x in rows])
    words = np.zeros((depth, n), np.int64)
    for i, x in enumerate(rows):
        words[: len(x), i] = x[:depth]
    out = np.empty((depth + 1, n), np.int32)
    out[0] = label = group.astype(np.int64)
    for d in range(1, depth + 1):
        order = np.lexsort((words[d - 1], label))
        new = np.ones(n, bool)
        new[1:] = (label[order[1:]] != label[order[:-1]]) | (words[d - 1][order[1:]] != words[d - 1][order[:-1]]) | (size[order[1:]] < d) | (size[order[:-1]] < d)
        label = np.empty(n, np.int64)
        label[order] = np.cumsum(new) - 1
        out[d] = label
    return out


def both(hulls: list[bytes], at: np.ndarray, group: np.ndarray, right: int, left: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words from place ``at`` of each hull on, and of those before it read backwards."""
    number: dict[bytes, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in x.split(b" ")]) for x in hulls]
    return extend([x[k:] for x, k in zip(rows, at)], group, right), extend([x[:k][::-1] for x, k in zip(rows, at)], group, left)


def plan(length: int = LENGTH, seed: int = SEED, most: int = MOST, fingerprint: Callable = fingerprint) -> Plan:
    return Plan(length, seed, normal, symbols, places, gram_hashes, both, "smaller", most, fingerprint)


def remove_repeats(docs: DataFrame, cut: Plan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept (words joined by one space) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for d, v, packed, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                words, gone = unpack(packed.as_py()).split(), merged(found.as_py())
                kept, at = [], 0
                for begin, end in gone:
                    kept += words[at:begin]
                    at = end
                kept += words[at:]
                rows.append((id_of(d, v), len(words), len(words) - len(kept), len(gone), b" ".join(kept).decode()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["doc_id", "n_words", "n_removed", "n_spans", "kept"])

    return map_arrow(spans(docs, cut or plan(), id_col, text_col), run, "doc_id long, n_words long, n_removed long, n_spans long, kept string")
