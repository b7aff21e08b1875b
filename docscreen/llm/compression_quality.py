"""Quality rules: zstandard compression bands over whole documents and fixed chunks.

Repetitive text compresses to far less of its size than prose does, noise to far more.
The usual ratio depends on the length (a short text has little history to refer to),
so each length class has limits of its own. Chunks of a fixed size find a repetitive or
incompressible stretch inside a document whose whole ratio looks usual; they start at each
multiple of the size, and one more ends where the text ends.

The limits leave room on both sides of what the ratios of ordinary text are. In the test tables
(sf0.1, documents that pass the base rule, level 3) from the least to the greatest: 0.46-0.74
from 256 bytes on, 0.38-0.59 from 1024, 0.36-0.48 from 4096, 0.34-0.43 from 16384; chunks
0.38-0.49. Repeated phrases fall below a tenth, base64 lies at three quarters and more. Texts
under 256 bytes have ratios from 0.25 to 1.14 (zstandard's own header counts there) and nearly
all have too few words for the base rule, so they have no band.

Defined results: a null or empty text has no words, ratio null and fails the base rule;
a text below the least measured length has no band and passes it; repeated rows are
judged each on its own; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES, map_arrow, words

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, worst_low_chunk double, worst_high_chunk double"
)


@dataclass(frozen=True)
class Band:
    """Texts of at least ``least`` UTF-8 bytes must have low <= compressed / raw <= high."""

    least: int
    low: float
    high: float


#: Limits for whole documents, by length; the last class that a text reaches holds.
DOCUMENT_BANDS = (Band(256, 0.30, 0.90), Band(1024, 0.20, 0.75), Band(4096, 0.16, 0.65), Band(16384, 0.12, 0.60))
#: Limits for chunks of CHUNK bytes, for texts of at least one chunk; the last chunk ends with the text.
CHUNK = 4096
CHUNK_BAND = Band(CHUNK, 0.12, 0.68)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    w = words(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" " + SPACES):
            seen.add(line)
    grams = list(zip(w, w[1:], w[2:]))
    repeat = 0
    if len(set(grams)) < len(grams):
        counts = Counter(grams)
        end = 0
        for i, g in enumerate(grams):
            if counts[g] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return len(w), sum(map(len, w)), sum(map(text.count, SYMBOLS)), dup, repeat


def band_for(n: int, bands: tuple[Band, ...]) -> Band | None:
    return next((b for b in reversed(bands) if n >= b.least), None)


def judge(pack, raw: bytes, bands: tuple[Band, ...], chunk: int, chunk_band: Band) -> tuple[bool, float | None, float | None, float | None]:
    """Whether the ratios lie in their bands, the whole ratio, and the least and greatest chunk ratio."""
    if not raw:
        return True, None, None, None
    ratio = len(pack(raw)) / len(raw)
    band = band_for(len(raw), bands)
    ok = band is None or band.low <= ratio <= band.high
    low = high = None
    if len(raw) >= chunk:
        starts = [*range(0, len(raw) - chunk, chunk), len(raw) - chunk]
        ratios = [len(pack(raw[i : i + chunk])) / chunk for i in starts]
        low, high = min(ratios), max(ratios)
        ok = ok and chunk_band.low <= low and high <= chunk_band.high
    return ok, ratio, low, high


def quality(
    docs: DataFrame,
    bands: tuple[Band, ...] = DOCUMENT_BANDS,
    chunk: int = CHUNK,
    chunk_band: Band = CHUNK_BAND,
    level: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of docs with the base counts, the ratios and the verdict; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress
        for b in batches:
            rows = []
            for text in map(pa.StringScalar.as_py, b.column(1)):
                n, chars, symbols, dup, repeat = base_counts(text)
                failed = n < 50 or 100 * repeat > 50 * n
                ok, ratio, low, high = judge(pack, (text or "").encode(), bands, chunk, chunk_band)
                rows.append((n, chars, symbols, dup, repeat, failed, ok and not failed, ratio, low, high))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "worst_low_chunk", "worst_high_chunk"]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, SCHEMA)
