"""Source divergence audit: how far the word use of each source lies from that of every other source of its language, and in which terms.

Terms are counted within tasks and summed; a language keeps the terms that enough of its
documents hold. For each pair of sources a joint histogram tallies how often each combination of
counts (a, b) occurs among the kept terms: the terms that both hold are tallied pair by pair, a and b over zero, and
the cells with a zero are implied, from each source's own histogram less what the pair's has at that count;
(0, 0) is what is left of all kept terms. The divergence ``f`` is evaluated once for each
combination and multiplied by its number.

All arithmetic is in whole numbers: p = 1 + floor(10^9 (count + 2) / (N + 2V)) with decimals of 38 digits, f = floor((p - q)^2 / (p + q)) in longs.

Nothing is sent to the driver or broadcast by hand. No row is for a document and term: tasks send sums, of at most
``TERMS`` terms at once. What meets in one place is a row for each source (the holders of one term, the pairs
of one source), never for each document, so a source or term that holds a third of all rows weighs no more than others.

Defined results: null text, lang and source are ''; every row is a document, repeated rows too; a (lang, source)
without terms has its pairs, and no terms; a language without kept terms has pairs of value 0;
one with a single source has no pairs. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, split_bytes

#: Least number of a language's documents that hold a kept term; terms reported for a group.
LEAST_DOCS, TOP = 10, 10
#: Terms counted in a task before it hands their counts on, and pairs of counts tallied at once.
TERMS, PAIRS = 300_000, 1 << 20

#: Terms are [^\x00-\x40\x5B-\x60\x7B-\x7F]+ with A-Z lower-cased: ASCII letters and all bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of batches of (lang, source, text); each group has a row with the term '' too."""
    uses: defaultdict = defaultdict(Counter)
    holders: defaultdict = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), held in holders.items():
            terms = list(held)
            columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string())]
            n = uses[lang, source]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n[t] for t in terms], pa.int64()), pa.array([held[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
        uses.clear()
        holders.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            n, held, seen = uses[lang, source], holders[lang, source], {b""}
            size -= len(held)
            for words in split_bytes(text.as_buffer().to_pybytes().translate(_FOLD)):
                n.update(words)
                seen.update(words)
            held.update(seen)
            size += len(held)
            if size > TERMS:
                yield from out()
                size = 0
    yield from out()


def joint_tally(row: np.ndarray, source: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(source, source, count, count, number) for all pairs of entries of one row. Entries are ordered by row and source."""
    last = np.searchsorted(row, row, side="right")
    later = last - np.arange(len(row)) - 1
    left = np.repeat(np.arange(len(row)), later)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later)
    pair, pair_of = np.unique(source[left] * (source.max(initial=0) + 1) + source[right], return_inverse=True)
    counts, count_of = np.unique(n, return_inverse=True)
    cell, cell_of = np.unique(count_of[left] * len(counts) + count_of[right], return_inverse=True)
    both, times = np.unique(pair_of * max(1, len(cell)) + cell_of, return_counts=True)
    p, c = np.divmod(both, max(1, len(cell)))
    s, t = np.divmod(pair[p], source.max(initial=0) + 1)
    a, b = np.divmod(cell[c], max(1, len(counts)))
    return s, t, counts[a], counts[b], times


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, s, t, a, b, m) of batches of (lang, held), held ordered by source: m terms occur a times in s and b times in t."""
    for b in batches:
        held = b.column(1)
        size = np.diff(held.offsets.to_numpy())
        names, source = np.unique(held.flatten().field(0).to_numpy(zero_copy_only=False).astype(object), return_inverse=True) if size.sum() else (np.zeros(0, object), np.zeros(0, int))
        n, langs = held.flatten().field(1).to_numpy(), b.column(0).to_numpy(zero_copy_only=False)
        row, starts = np.repeat(np.arange(b.num_rows), size), np.cumsum(size) - size
        part = np.cumsum(size.astype(np.int64) ** 2 // 2) // PAIRS
        for lang in dict.fromkeys(langs.tolist()):
            for k in np.unique(part[langs == lang]):
                rows = np.flatnonzero((langs == lang) & (part == k))
                at = np.concatenate([np.arange(starts[r], starts[r] + size[r]) for r in rows])
                s, t, x, y, m = joint_tally(row[at], source[at], n[at])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(m), pa.string()), pa.array(names[s], pa.string()), pa.array(names[t], pa.string()), *(pa.array(c, pa.int64()) for c in (x, y, m))], ["lang", "s", "t", "a", "b", "m"])


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2v)); null if there are no terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (whole(count) + 2), F.nullif(whole(n) + whole(v) * 2, F.lit(0).cast("decimal(1,0)"))) + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the distances between sources (part pair) and the terms that set a source apart from its language (part term)."""
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    counted = map_arrow(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text")), _counted, "lang string, source string, term string, n long, docs long")
    cells = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-cells")
    held = F.array_sort(F.collect_list(F.struct("source", "n")))  # a row for each source, after the sums
    terms = cells.where("term <> ''").groupBy("lang", "term").agg(held.alias("held"), F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    terms = materialize(terms.select("lang", "held", "term", "total"), "divergence-terms")
    each = terms.select("lang", "term", "total", F.inline("held"))

    langs = cells.select("lang").distinct().join(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n")), "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"))
    sums = each.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = cells.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang")
    groups = materialize(groups.select("lang", "source", F.coalesce("group_n", F.lit(0)).alias("group_n"), "v", "lang_n"), "divergence-groups")

    pairs = groups.select("lang", F.col("source").alias("s"), F.col("group_n").alias("n"), "v").join(groups.select("lang", F.col("source").alias("t"), F.col("group_n").alias("o")), "lang").where("s < t")
    joint = map_arrow(terms.select("lang", "held"), _tallied, "lang string, s string, t string, a long, b long, m long")
    joint = materialize(joint.groupBy("lang", "s", "t", "a", "b").agg(F.sum("m").alias("m")), "divergence-joint")
    own = each.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    ends = pairs.select("lang", "s", "t")
    # Cells with one zero: all terms that one source holds so often, less those that the other holds too.
    zero = F.lit(0).cast("long")
    first = ends.join(own.withColumnRenamed("source", "s"), ["lang", "s"]).select("lang", "s", "t", F.col("n").alias("a"), zero.alias("b"), "m")
    second = ends.join(own.withColumnRenamed("source", "t"), ["lang", "t"]).select("lang", "s", "t", zero.alias("a"), F.col("n").alias("b"), "m")
    minus = joint.select("lang", "s", "t", F.inline(F.array(F.struct(F.col("a"), zero.alias("b"), (-F.col("m")).alias("m")), F.struct(zero.alias("a"), F.col("b"), (-F.col("m")).alias("m")))))
    implied = first.unionAll(second).unionAll(minus).groupBy("lang", "s", "t", "a", "b").agg(F.sum("m").alias("m")).where("m > 0")
    combos = joint.unionAll(implied).join(pairs, ["lang", "s", "t"])
    value = F.sum(F.col("m") * divergence(share(F.col("a"), F.col("n"), F.col("v")), share(F.col("b"), F.col("o"), F.col("v")))).alias("value")
    summed = combos.groupBy("lang", "s", "t").agg(value, F.sum("m").alias("m"))
    neither = F.coalesce((F.col("v") - F.coalesce("m", zero)) * divergence(share(zero, F.col("n"), F.col("v")), share(zero, F.col("o"), F.col("v"))), zero)
    between = pairs.join(summed, ["lang", "s", "t"], "left").select("lang", "s", "t", (F.coalesce("value", zero) + neither).alias("value"))
    both = between.select("lang", F.inline(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item")))), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    p, q = share(F.col("n"), F.col("group_n"), F.col("v")), share(F.col("total"), F.col("lang_n"), F.col("v"))
    apart = each.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(both, "pair").unionAll(ranked(apart, "term").where(F.col("rank") <= top))
