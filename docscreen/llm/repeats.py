"""Which windows of a fixed number of symbols occur again: the frame of both substring operators.

1. Each window of ``length`` symbols names an anchor: the run of ``gram`` symbols in it with the
   least hash, the last of equals. The choice rests on the window alone, so equal windows
   name equal anchors at equal offsets. The windows of one anchor are consecutive; the
   stretch they cover is its hull.
2. Within a task, hulls that are equal (found by a fingerprint, confirmed by their bytes)
   settle one another, so that copies of one text leave one row for each task.
3. Rows are dealt out by anchor hash; those whose anchor occurs in one row alone are done with.
   The hulls of the others are cut from the texts and sorted by their bytes: equal ones settle
   one another, and different ones of one anchor go through ``classes``, which numbers the
   hulls that agree for d symbols to the right, and to the left, of the anchor. Two windows
   are equal if they agree in both.
4. Anchors that may hold more than their share of a partition (a bounded list, found while
   reading) are not dealt out by their hash, and no task compares more than ``most`` hulls of
   one anchor: beyond that its windows are dealt out one by one by a keyed digest of 128 bits.

The rule decides which of the equal windows are covered: "any" (occurs elsewhere) or
"smaller" (occurs in a document with a smaller id).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, sized

#: Most hulls of one anchor that one task compares.
MOST = 8192
#: Anchors and bytes of text that a task settles at once, hulls and bytes that it compares at once.
FLUSH, FLUSH_BYTES = 100_000, 16_000_000
BLOCK, BLOCK_BYTES = 4096, 4_000_000
#: Anchors that are kept from being dealt out by their hash, at most.
HEAVY, HEAVY_LEAST = 1000, 512
#: Rows of anchors, and kB of text, for a task.
TASK_ROWS, TASK_KB = 1_000_000, 32_000
#: Stands for a null id: no id is greater.
NO_ID = (1 << 63) - 1
_POS = 20
_MASK = np.uint64((1 << _POS) - 1)


def fingerprint(raw: memoryview, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(raw, seed)


@dataclass(frozen=True)
class Plan:
    """How a kind of text is cut.

    length, gram: in symbols. normal: bytes of a text. symbols: array of such bytes. places: first byte
    and end of each symbol, None if symbols are bytes. grams: hash of each run of ``gram`` symbols.
    classes: see the module; it gets the hulls' bytes, the symbols before the anchor, and the groups.
    """

    length: int
    gram: int
    normal: Callable[[str], bytes]
    symbols: Callable[[bytes], np.ndarray]
    places: Callable[[bytes], tuple[np.ndarray, np.ndarray]] | None
    grams: Callable[[np.ndarray, int], np.ndarray]
    classes: Callable[[list[bytes], np.ndarray, np.ndarray, int, int], tuple[np.ndarray, np.ndarray]]
    rule: str
    most: int = MOST
    fingerprint: Callable[[memoryview, int], int] = fingerprint

    def __post_init__(self):
        if not 0 < self.gram <= self.length <= self.gram + 32767:
            raise ValueError(f"a gram of {self.gram} doesn't serve windows of {self.length} symbols")


def anchors(plan: Plan, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the least and greatest offset from its windows' starts to it."""
    n_windows, span = len(s) - plan.length + 1, plan.length - plan.gram + 1
    if n_windows < 1:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    g = plan.grams(s, plan.gram)
    places, first = [], []
    step = (1 << _POS) - span
    for low in range(0, n_windows, step):
        part = g[low : min(low + step, n_windows) + span - 1]
        m = (part & ~_MASK) | (_MASK - np.arange(len(part), dtype=np.uint64))
        size = 1
        while 2 * size <= span:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < span:
            m = np.minimum(m[: len(part) - span + 1], m[span - size :])
        places.append(low + (_MASK - (m & _MASK)).astype(np.int64))
    at = np.concatenate(places)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], n_windows) - 1
    at = at[first]
    return g[at], at, at - last, at - first


def _runs(*keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _merge(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of each doc, those that touch made one. Of one doc's, none holds another."""
    if not len(doc):
        return doc, begin, end
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1])
    first = np.flatnonzero(new)
    return doc[first], begin[first], end[np.append(first[1:], len(doc)) - 1]


#: kind 0: the stretch from p to r is covered. 1: an anchor at p, r holds its offsets. 2: the same, its hull is covered already. 3: h has p rows in this flush. 4: a task has read p kB.
_ROW = "kind byte, h long, d long, v long, p int, r int"
_NAMES = ["kind", "h", "d", "v", "p", "r"]
_KINDS = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _settled(rule: str, d: np.ndarray, first: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in runs (first: index of each row's run start; equal: whether it has that row's hull; runs sorted by d): which are covered, which stay to stand for their hull."""
    if rule == "any":
        covered = equal & (first != np.arange(len(d)))
        stays = ~covered
        covered[first[covered]] = True
        return covered, stays
    covered = equal & (d > d[first])
    return covered, ~covered


def _find(plan: Plan, share: float):
    """share: of a flush's rows, from which on an anchor is reported as one that may be heavy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (d, v, text): the anchors' rows, equal hulls of a flush settled."""
        raws: list[bytes] = []
        docs: list[tuple[int, int]] = []
        cuts: list[tuple] = []
        held: list[tuple] = []
        n = size = read = 0

        def flush() -> pa.RecordBatch:
            h, c, doc, at, lo, hi = (np.concatenate(x) for x in zip(*held))
            ids = np.array(docs, np.int64).reshape(-1, 2)
            order = np.lexsort((ids[doc, 0], c, h))
            h, c, doc, at, lo, hi = (x[order] for x in (h, c, doc, at, lo, hi))
            start = _runs(h, c)
            first = np.repeat(start, np.diff(start, append=len(h)))
            equal = first == np.arange(len(h))

            begins, ends, owner = (at - hi).tolist(), (at - lo + plan.length).tolist(), doc.tolist()

            def hull(i: int) -> bytes:
                return _slice(raws[owner[i]], cuts[owner[i]], begins[i], ends[i])

            last, seen = -1, b""
            for i in np.flatnonzero(~equal).tolist():  # a fingerprint is only taken for the bytes that confirm it
                if first[i] != last:
                    last = first[i]
                    seen = hull(last)
                equal[i] = hi[i] == hi[last] and lo[i] == lo[last] and hull(i) == seen
            covered, stays = _settled(plan.rule, ids[doc, 0], first, equal)
            done, begin, end = _merge(doc[covered], (at - hi)[covered], (at - lo + plan.length)[covered])
            kind = np.where(covered, 2, 1)[stays]
            groups = _runs(h[stays])
            many = np.diff(groups, append=int(stays.sum()))
            loud = many >= max(4, share * stays.sum())
            z = np.zeros(int(loud.sum()), np.int64)
            cols = [
                np.concatenate([kind, np.zeros(len(done), np.int64), z + 3]).astype(np.int8),
                np.concatenate([h[stays].view(np.int64), np.zeros(len(done), np.int64), h[stays][groups][loud].view(np.int64)]),
                np.concatenate([ids[doc[stays], 0], ids[done, 0], z]),
                np.concatenate([ids[doc[stays], 1], ids[done, 1], z]),
                np.concatenate([at[stays], begin, many[loud]]).astype(np.int32),
                np.concatenate([(lo << 16 | hi)[stays], end, z]).astype(np.int32),
            ]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], _NAMES)

        for b in batches:
            for d, v, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                if not text:
                    continue
                raw = plan.normal(text)
                read += len(raw)
                h, at, lo, hi = anchors(plan, plan.symbols(raw))
                if not len(h):
                    continue
                cut, view = plan.places(raw) if plan.places else None, memoryview(raw)
                ends = zip((at - hi).tolist(), (at - lo + plan.length).tolist(), lo.tolist())
                c = np.fromiter((plan.fingerprint(_slice(view, cut, a, e), seed) for a, e, seed in ends), np.uint64, len(h))
                held.append((h, c, np.full(len(h), len(raws)), at, lo, hi))
                raws.append(raw)
                docs.append((d, v))
                cuts.append(cut)
                n, size = n + len(h), size + len(raw)
                if n >= FLUSH or size >= FLUSH_BYTES:
                    yield flush()
                    for x in (raws, docs, cuts, held):
                        x.clear()
                    n = size = 0
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((4, 0, 0, 0, read // 1000 + 1, 0), _KINDS)], _NAMES)

    return run


def _slice(raw, cut, a: int, e: int):
    """Symbols a to e of a text's bytes."""
    return raw[a:e] if cut is None else raw[cut[0][a] : cut[1][e - 1]]


def _texts(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From (d, v, packed text, anchors): d, v, bytes, places of the symbols, anchors."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for d, v, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            raw = unpack(text.as_py())
            yield d, v, raw, plan.places(raw) if plan.places else None, found.as_py()


_HULL = "kind byte, h long, d long, v long, p int, r int, hull binary"


def _cut(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each anchor's hull."""
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), [*_KINDS, pa.binary()])], [*_NAMES, "hull"])

        for d, v, raw, cut, found in _texts(plan, batches):
            for a in found:
                at, r = a["p"], a["r"]
                hull = _slice(raw, cut, at - (r & 0xFFFF), at - (r >> 16) + plan.length)
                out.append((a["kind"], a["h"], d, v, at, r, hull))
                size += len(hull)
                if size > BLOCK_BYTES:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    return run


def _covered(plan: Plan, h: np.ndarray, d: np.ndarray, r: np.ndarray, twice: np.ndarray, hulls: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
    """(rows, offset) of the windows that the rule covers, among different hulls sorted by anchor hash."""
    n, size = len(h), plan.length
    lo, hi = r >> 16, r & 0xFFFF
    start = _runs(h)
    group = np.repeat(np.arange(len(start)), np.diff(start, append=n))
    right, left = plan.classes(hulls, hi, group, size, size - plan.gram)  # depth, row
    for o in range(int(lo.min()), int(hi.max()) + 1):
        rows = np.flatnonzero((lo <= o) & (o <= hi))
        if len(rows) < 2:
            continue
        key = right[size - o, rows].astype(np.int64) * n + left[o, rows]
        order = np.lexsort((d[rows], key)) if plan.rule == "smaller" else np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        first = _runs(key)
        many = np.diff(first, append=len(key))
        if plan.rule == "any":
            ok = np.repeat(many > 1, many) & ~twice[rows]
        else:
            ok = d[rows] > np.repeat(d[rows[first]], many)
        if ok.any():
            yield rows[ok], o


_SPAN = "d long, v long, begin int, end int"


def _spans(d: np.ndarray, v: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    cols = [d, v, begin.astype(np.int32), end.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["d", "v", "begin", "end"])


def compare(plan: Plan, kind: np.ndarray, h: np.ndarray, d: np.ndarray, p: np.ndarray, r: np.ndarray, hulls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, begin, end) of covered stretches among hulls sorted by (h, hull, r, d)."""
    n = len(h)
    new = np.ones(n, bool)
    for i in np.flatnonzero((h[1:] == h[:-1]) & (r[1:] == r[:-1])).tolist():
        new[i + 1] = hulls[i + 1] != hulls[i]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    covered, stays = _settled(plan.rule, d, first, np.ones(n, bool))
    known = kind == 2
    covered |= known & (plan.rule == "any")
    begin, end = p - (r & 0xFFFF), p - (r >> 16) + plan.length
    out = [(np.flatnonzero(covered & ~known), begin[covered & ~known], end[covered & ~known])]
    if plan.rule == "any":
        twice = np.zeros(n, bool)
        np.logical_or.at(twice, first, covered)
    else:
        twice = np.zeros(n, bool)
    rep = np.flatnonzero(stays)
    group = _runs(h[rep])
    many = np.diff(group, append=len(rep))
    rep = rep[np.repeat(many > 1, many)]
    if len(rep):
        found = list(_covered(plan, h[rep], d[rep], r[rep], twice[rep], [hulls[i] for i in rep]))
        if found:
            rows, offs = np.concatenate([x for x, _ in found]), np.concatenate([np.full(len(x), o) for x, o in found])
            order = np.lexsort((offs, rows))
            rows, offs = rows[order], offs[order]
            one = _runs(rows, offs - np.arange(len(offs)))  # consecutive offsets are one stretch
            last = np.append(one[1:], len(rows)) - 1
            rows = rep[rows[one]]
            out.append((rows, p[rows] - offs[last], p[rows] - offs[one] + plan.length))
    return tuple(np.concatenate(x) for x in zip(*out))


def _compare(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From hulls sorted by (h, hull, r, d): covered stretches."""
        held: list[list] = []
        hulls: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            kind, h, d, v, p, r = (np.concatenate(x) for x in zip(*held))
            rows, begin, end = compare(plan, kind, h, d, p.astype(np.int64), r.astype(np.int64), hulls)
            return _spans(d[rows], v[rows], begin, end)

        for b in batches:
            cols, more = [b.column(i).to_numpy() for i in range(6)], b.column(6).to_pylist()
            ends = np.append(_runs(cols[1])[1:], len(more))
            at = 0
            for e in ends.tolist():  # block borders are group borders
                if hulls and (len(hulls) + e - at > BLOCK or size > BLOCK_BYTES) and cols[1][at] != held[-1][1][-1]:
                    yield out()
                    held, hulls, size = [], [], 0
                if e - at:
                    held.append([c[at:e] for c in cols])
                    hulls += more[at:e]
                    size += sum(map(len, more[at:e]))
                at = e
        if hulls:
            yield out()

    return run


_WINDOW = "w1 long, w2 long, d long, v long, begin int, done boolean"


def _windows(plan: Plan, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the texts of heavy anchors: a digest of each window; within a batch equal windows settle one another."""
        import hashlib

        held: dict[bytes, list[tuple]] = {}
        n = 0

        def own(d: int, v: int, begin: int) -> tuple[int, int]:
            """In place of a digest, for a window that is done with: it needs no partner."""
            return v, d ^ begin << 20 & NO_ID

        def out() -> pa.RecordBatch:
            rows = []
            for w, places in held.items():
                digest = hashlib.blake2b(w, digest_size=16, key=key).digest()
                w1, w2 = int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
                places.sort()
                if plan.rule == "any":
                    rows.append((w1, w2, *places[0][:3], len(places) > 1 or places[0][3]))
                    rows += [(*own(*x[:3]), *x[:3], True) for x in places[1:]]
                else:
                    rows += [(w1, w2, *x[:3], False) if x[0] == places[0][0] else (*own(*x[:3]), *x[:3], True) for x in places]
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["w1", "w2", "d", "v", "begin", "done"])

        for d, v, raw, cut, found in _texts(plan, batches):
            for a in found:
                at, r, twice = a["p"], a["r"], a["kind"] == 2
                for o in range(r >> 16, (r & 0xFFFF) + 1):
                    held.setdefault(bytes(_slice(raw, cut, at - o, at - o + plan.length)), []).append((d, v, at - o, twice))
                    n += 1
            if n >= BLOCK * 4:
                yield out()
                held, n = {}, 0
        if held:
            yield out()

    return run


def _pack(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            packed = pa.array([pack(plan.normal(x.as_py() or "")) for x in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], ["d", "v", "packed"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d (id, NO_ID for null), v (hash of the text, odd for a null id), text."""
    text, i = docs[text_col].cast("string"), docs[id_col].cast("long")
    v = F.coalesce(F.xxhash64(text), F.lit(0)).bitwiseAND(F.lit(-2)).bitwiseOR(i.isNull().cast("long"))
    return docs.select(F.coalesce(i, F.lit(NO_ID)).alias("d"), v.alias("v"), text.alias("text"))


def id_of(d: int, v: int) -> int | None:
    return None if v & 1 else d


def _requests(rows: DataFrame, plan: Plan, partitions: int, total: int) -> DataFrame:
    """The rows of anchors that more rows share, and whether their windows are dealt out one by one."""
    loud = rows.where("kind = 3").groupBy("h").agg(F.sum("p").alias("n")).where(F.col("n") >= max(min(HEAVY_LEAST, plan.most), total / (4 * partitions)))
    heavy = [x.h for x in loud.orderBy(F.desc("n"), "h").limit(HEAVY).collect()]  # at most HEAVY numbers
    rows = rows.where("kind in (1, 2)")
    same = Window.partitionBy("h")
    some = F.max((F.col("kind") == 1).cast("int")).over(same) if plan.rule == "any" else (F.min("d").over(same) < F.max("d").over(same)).cast("int")
    cold = rows.where(~F.col("h").isin(heavy)) if heavy else rows
    cold = cold.select("*", F.count("*").over(same).alias("n"), some.alias("some")).where("n > 1 and some = 1")
    wanted = cold.select(*_NAMES, (F.col("n") > plan.most).alias("hot"))
    return wanted.unionAll(rows.where(F.col("h").isin(heavy)).select(*_NAMES, F.lit(True).alias("hot"))) if heavy else wanted


def spans(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d, v, packed (the text, zstandard) and spans (array of begin, end in symbols, to be merged; null if none) for each row of docs."""
    texts = keyed(docs, id_col, text_col)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(map_arrow(texts, _find(plan, 1 / (4 * partitions)), _ROW), "anchors")
    read = rows.agg(F.count(F.when(F.col("kind").isin(1, 2), 1)).alias("rows"), F.sum(F.when(F.col("kind") == 4, F.col("p"))).alias("kb")).first()
    requests = materialize(sized(_requests(rows, plan, partitions, read.rows), read.rows / TASK_ROWS), "requests")
    # The one shuffle of the texts: all joins below use it.
    packed = map_arrow(texts, _pack(plan), "d long not null, v long not null, packed binary").repartition(partitions, "d", "v")

    def placed(hot: bool) -> DataFrame:
        """The texts with a document's requests: no more of them than its text has anchors."""
        found = requests.where(F.col("hot") == hot).select("d", "v", F.struct("kind", "h", "p", "r").alias("a")).groupBy("d", "v").agg(F.collect_list("a").alias("found"))
        return packed.join(found, ["d", "v"]).select("d", "v", "packed", "found")

    hulls = map_arrow(placed(False), _cut(plan), _HULL).repartition(partitions, "h").sortWithinPartitions("h", "hull", "r", "d")
    covered = map_arrow(hulls, _compare(plan), _SPAN).unionAll(rows.where("kind = 0").select("d", "v", F.col("p").alias("begin"), F.col("r").alias("end")))
    if requests.where("hot").limit(1).count():
        each = map_arrow(placed(True), _windows(plan, os.urandom(16)), _WINDOW)
        same = Window.partitionBy("w1", "w2")  # no more rows than tasks have sent for one window
        again = F.count("*").over(same) > 1 if plan.rule == "any" else F.col("d") > F.min("d").over(same)
        again = each.select("*", again.alias("again")).where("again or done")
        covered = covered.unionAll(again.select("d", "v", "begin", (F.col("begin") + plan.length).cast("int").alias("end")))
    covered = covered.select("d", "v", F.struct("begin", "end").alias("s")).groupBy("d", "v").agg(F.collect_list("s").alias("spans"))
    return sized(packed.join(covered, ["d", "v"], "left").select("d", "v", "packed", "spans"), (read.kb or 0) / TASK_KB)


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Disjoint spans in order; those that touch are one."""
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in found or ()):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]
