"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..sources.packaging import ship
from ..sources.shared import save, shared_path

#: Bytes that a Python function gets at once.
PIECE_BYTES = 4_000_000

#: Whitespace of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = "\t\n\x0b\x0c\r"


def words(text: str | None) -> list[str]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` in order; None has none."""
    if not text:
        return []
    for c in SPACES:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    if text.isascii():
        return text.lower()
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def split_bytes(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Stretches between ASCII whitespace, some size bytes of text at a time."""
    start = 0
    while start < len(raw):
        end = start + size
        if end < len(raw):
            cut = raw.rfind(b" ", start + 1, end)
            end = cut if cut > 0 else raw.find(b" ", end)
            end = end if end > 0 else len(raw)
        yield raw[start:end].split()
        start = end


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    return save(df, shared_path(df.sparkSession, name))


def sized(df: DataFrame, tasks: float) -> DataFrame:
    """df in about so many partitions, if it has more: small tables make few files. No fewer than the cores' worth."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(tasks))
    return df.coalesce(n) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors. Long texts come in pieces of a batch, so that results are
    handed on in pieces too; workers wait for their next task with little memory."""
    ship(df.sparkSession)

    def tidy(batches):
        yield from run(pieces(batches))
        give_back()

    return df.mapInArrow(tidy, schema)


def pieces(batches):
    """Batches of more than PIECE_BYTES in parts of about that size."""
    for b in batches:
        step = b.num_rows if b.nbytes <= PIECE_BYTES else max(1, b.num_rows * PIECE_BYTES // b.nbytes)
        for i in range(0, b.num_rows, max(1, step)):
            yield b.slice(i, step)


def give_back() -> None:
    """Return memory that is free to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)
