"""Benchmark decontamination: pigeonhole edit matching.

An item of n words may appear in a document with up to e = floor(rate * n) words inserted,
deleted or replaced. Cut into e + 1 pieces, one piece at least must then appear unchanged.
All pieces of all items are found in one pass over a document with an Aho-Corasick
automaton; around each hit the whole item is aligned by Myers' bit-parallel edit distance,
one bit for each word of the item, so e.g. 60 words take one machine word's operations.

Words are runs of letters, digits and underscores, in lower case; in scripts without spaces
each character is a word. An item of fewer than 1 / rate words (5) has no budget and must
appear word for word; an item without a word is never matched.

The benchmark is read in blocks of bounded size. One block is the usual case and is matched
in one pass over the documents. More blocks take a pass each, whose hits are written and
then joined to the documents by the digest of their text, so that a large benchmark takes
more passes and no more memory, neither of the driver nor of a task.

Defined results: null and empty texts hold no item; null and empty items are skipped; items
without an id are matched, under a null item_id; repeated items are matched once each under
their own item_id; an empty benchmark leaves all documents clean; repeated documents are
judged each.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize

#: Share of an item's words that may differ: a similarity of 0.8 or more counts.
RATE = 0.2
#: Benchmark text sent to the executors at once.
BLOCK_BYTES = 8_000_000

#: Kana, ideographs, Thai, Lao, Burmese and Khmer: written without spaces.
_SINGLE = "\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_WORD = re.compile(rf"[{_SINGLE}]|[^\W{_SINGLE}]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def pieces(n: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 ranges that cover range(n), as even as can be."""
    cuts = [n * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:]))


def best_match(masks: dict[str, int], n: int, text: list[str]) -> tuple[int, int]:
    """Least edit distance of the item to a stretch of text, and the first end (exclusive) that has it. masks: item places of each word."""
    plus, minus, score = (1 << n) - 1, 0, n
    best, end, top, full = n, 0, 1 << (n - 1), (1 << n) - 1
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may start anywhere, so row 0 stays 0
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        import ahocorasick

        self.items, self.auto = [], ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            w = words(text)
            if not w:
                continue
            errors, masks = int(rate * len(w)), {}
            for i, x in enumerate(w):
                masks[x] = masks.get(x, 0) | 1 << i
            for a, b in pieces(len(w), errors):
                found.setdefault(f" {' '.join(w[a:b])} ", []).append((len(self.items), a))
            self.items.append((item_id, len(w), errors, masks))
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        self.auto.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item_id, least distance, place of the word after that match) of each item that the text holds."""
        if not text or not self.items:
            return []
        w = words(text)
        joined = f" {' '.join(w)} "
        starts, best, tried = None, {}, {}
        for at, (size, where) in self.auto.iter(joined):
            if starts is None:
                starts = [0, *accumulate(len(x) + 1 for x in w)]
            word = bisect_right(starts, at - size + 1) - 1
            for k, a in where:
                item_id, n, errors, masks = self.items[k]
                begin = word - a - errors
                # The last region tried also holds all matches of a hit that begins up to ``errors`` words later.
                if 0 <= begin - tried.get(k, begin + 1) <= errors:
                    continue
                tried[k] = begin
                low, high = max(0, begin), begin + n + 4 * errors
                distance, end = best_match(masks, n, w[low:high])
                if distance <= errors and distance < best.get(k, (errors + 1,))[0]:
                    best[k] = distance, low + end
        return sorted(((self.items[k][0], d, end) for k, (d, end) in best.items()), key=lambda m: (m[0] is None, m[0] or 0, m[1:]))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark's items, at most about block_bytes of text in each part."""
    items = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("text")).where("text <> ''").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


_ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.LongType()), T.StructField("end_word", T.LongType())])


def _pass(docs: DataFrame, block: DataFrame, rate: float, hits_only: bool) -> DataFrame:
    """The columns of docs but the last, text, and matches with the items of a block, which is of bounded size."""
    items = sorted((tuple(r) for r in block.collect()), key=str)
    schema = T.StructType([*docs.schema.fields, T.StructField("matches", T.ArrayType(_ITEM))])
    kind, at = pa.list_(pa.struct([pa.field(f.name, pa.int64()) for f in _ITEM.fields])), len(docs.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, names = Matcher(items, rate), _ITEM.names
        for b in batches:
            found = [[dict(zip(names, m)) for m in matcher.matches(text.as_py())] for text in b.column(at)]
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], schema.names)
            yield out.filter(pa.array([bool(m) for m in found], pa.bool_())) if hits_only else out

    return map_arrow(docs, run, schema)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    rate: float = RATE,
    block_bytes: int = BLOCK_BYTES,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The keep columns, text and matches (array of item_id, distance, end_word; empty if clean); one row for each row of docs. No shuffle if the benchmark is one block."""
    docs = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("text"))
    parts = blocks(benchmark, item_id_col, item_text_col, block_bytes)
    if len(parts) == 1:
        return _pass(docs, parts[0], rate, hits_only=False)
    texts = docs.select(F.sha2("text", 256).alias("digest"), "text")
    hits = [materialize(_pass(texts, block, rate, hits_only=True).select("digest", "matches").dropDuplicates(["digest"]), "hits") for block in parts]
    every = reduce(DataFrame.unionAll, hits).groupBy("digest").agg(F.flatten(F.collect_list("matches")).alias("matches"))
    joined = docs.withColumn("_digest", F.sha2("text", 256)).join(every, F.col("_digest") == F.col("digest"), "left")
    return joined.select(*[docs[c] for c in docs.columns], F.coalesce(F.array_sort("matches"), F.array().cast(T.ArrayType(_ITEM))).alias("matches"))


def report(found: DataFrame) -> DataFrame:
    """Per document: contaminated, how many items, their ids and the least distance."""
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_items"),
        F.array_sort(F.transform("matches", lambda m: m["item_id"])).alias("item_ids"),
        F.array_min(F.transform("matches", lambda m: m["distance"])).alias("least_distance"),
    )
