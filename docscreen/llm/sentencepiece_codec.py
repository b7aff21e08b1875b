"""SentencePiece encoding and decoding through a distinct-chunk table.

A whitespace marker (U+2581, to which spaces are mapped) can only begin a piece when no
piece of the vocabulary holds a marker after another character. Then no merge crosses the
place before a run of markers, so a text falls into chunks (a run of markers and the word
after it) that segment independently. Each distinct chunk is segmented once for each task,
and a document's ids are the chunks' ids joined by position. ``check_vocabulary`` refuses
a model for which this doesn't hold.

Defined results: null and empty texts have no ids and decode to the empty string; repeated
rows are encoded each; other columns are ignored; a chunk of over LONG characters is
segmented without a place in the table; the table is emptied when it holds TABLE_CHARS
characters, so that memory doesn't grow with the vocabulary of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MARK = "▁"
LONG = 64
TABLE_CHARS = 24_000_000
SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"

_CHUNK = re.compile(" +[^ ]*")


def check_vocabulary(model_file: str) -> None:
    """Raise unless markers stand only at the start of pieces and the model normalizes nothing but spaces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    crossing = re.compile(f"[^{MARK}]{MARK}")
    for i in range(sp.get_piece_size()):
        if not sp.is_control(i) and crossing.search(sp.id_to_piece(i)):
            raise ValueError(f"piece {i} crosses a whitespace marker")
    probe = " ﬁ ½  é\tx "
    if sp.decode(sp.encode(probe)) != probe:
        raise ValueError("the model changes characters before segmentation")


class ChunkTable:
    """Ids (decimal, joined by commas) and decoded text of chunks, each distinct chunk segmented once."""

    def __init__(self, model: bytes, table_chars: int = TABLE_CHARS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.mark_id = self.sp.piece_to_id(MARK)
        self.left = self.room = table_chars
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def segment(self, chunk: str) -> tuple[str, str]:
        """chunk: one or more spaces, then a word; the processor itself adds the first marker."""
        ids = self.sp.encode(chunk[1:]) if len(chunk) > 1 else [self.mark_id]
        return ",".join(map(str, ids)), " " + self.sp.decode(ids)

    def add(self, chunks: set[str]) -> dict[str, tuple[str, str]]:
        """Make room for the chunks that the table lacks; the long ones are returned instead of kept."""
        long = {}
        for c in chunks:
            pair = self.segment(c)
            if len(c) > LONG:
                long[c] = pair
            else:
                self.ids[c], self.texts[c] = pair
                self.left -= 2 * len(c) + len(pair[0]) + 60
        return long

    def code(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, decoded text."""
        if not text:
            return 0, "", ""
        s = " " + text.replace(MARK, " ")
        chunks = _CHUNK.findall(s)
        if self.left < 0:
            self.ids.clear()
            self.texts.clear()
            self.left = self.room
        if long := self.add(set(chunks).difference(self.ids)):
            get = lambda k: lambda c: long[c][k] if c in long else (self.ids, self.texts)[k][c]
            ids, decoded = ",".join(map(get(0), chunks)), "".join(map(get(1), chunks))
        else:
            ids, decoded = ",".join(map(self.ids.__getitem__, chunks)), "".join(map(self.texts.__getitem__, chunks))
        return ids.count(",") + 1, ids, decoded[1:]


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: n_tokens, ids (decimal, joined by commas), decoded; no shuffle."""
    check_vocabulary(model_file)
    model = docs.sparkSession.sparkContext.broadcast(Path(model_file).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model.value)
        for b in batches:
            n, ids, decoded = [], [], []
            for text in b.column(1):
                row = table.code(text.as_py())
                n.append(row[0])
                ids.append(row[1])
                decoded.append(row[2])
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"])

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, SCHEMA)


def ids_array(ids: Column) -> Column:
    """The ids as an array of integers."""
    return F.when(ids == "", F.array().cast("array<int>")).otherwise(F.split(ids, ",").cast("array<int>"))


def digest(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
