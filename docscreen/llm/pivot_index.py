"""Embedding near-dedup over a pivot-permutation index.

Each vector is described by its nearest reference points (pivots), nearest first. Two vectors
at a small angle see the pivots in nearly the same order, so a linked pair shares at least
``shared`` of its ``near`` nearest pivots with a probability that ``tests/llm`` measures. The
inverted lists (label, pivot) -> vectors hold each vector under its ``near - shared + 1``
pivots that the fewest vectors have: two sets of ``near`` pivots with ``shared`` in common
must meet in one of these. A pair is counted, and its cosine verified in double precision, in the list of
the rarest pivot that both have, so once.

Equal vectors of a label are one class before anything is compared. A list of more than
``block`` classes is dealt out as pairs of blocks, each a group of its own, so no task holds a list;
no list is capped. A group returns a row for each of its classes: the number of vectors
linked and the least class reached there. The links themselves, which may be as many as a
group's square, are never written. Pivots come from a sample of at most ``SAMPLE`` classes (and
``SAMPLE_BYTES``), taken by a hash of their ids, each next one farthest from those chosen, so a
dense cluster gets few; a length that the sample lacks has fixed random directions.

Defined results: a vector that is null, empty, all zero or holds null or non-finite components, a
null label or a null id links with nothing; vectors of different lengths never link. Equal rows are vectors of
their own, linked with one another; different vectors under one id have their own ``n_links``
and one component. An empty table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.packaging import ship
from .common import map_arrow, materialize
from .components import components, forest

NEAR, SHARED = 12, 3
#: Classes that the pivots are chosen from, and their bytes, at most.
SAMPLE, SAMPLE_BYTES = 4096, 16_000_000
#: Pivots at least and at most; between them twice the root of the number of classes, so that lists grow with the root too.
PIVOTS_LEAST, PIVOTS_MOST = 64, 2048
BLOCK = 1024
#: Lists of more than a block whose sizes are broadcast; more are joined.
LONG_LISTS = 100_000
#: Pairs whose cosines are computed at once.
PAIRS = 1 << 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; large components don't overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each next one the farthest from those before."""
    chosen, close = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(close.argmin()))
        np.maximum(close, x @ x[chosen[-1]], out=close)
    return x[chosen]


def choose_pivots(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots by length of vector, from a sample whose size is bounded in rows and bytes."""
    size = classes.agg(F.max(F.size("v"))).first()[0] or 1
    rows = classes.orderBy(F.xxhash64("node"), "node").limit(max(2, min(SAMPLE, SAMPLE_BYTES // (8 * size)))).select("v").collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r.v), []).append(r.v)
    return {d: farthest_first(unit(np.array(v, float)), min(n, max(NEAR, SAMPLE_BYTES // (8 * d)))) for d, v in by_size.items()}


def pivots_of(pivots: dict[int, np.ndarray], d: int) -> np.ndarray:
    """The pivots for vectors of length d, filled up with random directions to NEAR at least."""
    if d not in pivots or len(pivots[d]) < NEAR:
        have = pivots.get(d, np.zeros((0, d)))
        pivots[d] = np.concatenate([have, unit(np.random.default_rng(d).normal(size=(NEAR - len(have), d)))])
    return pivots[d]


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the NEAR nearest pivots of each row, nearest first."""
    close = x @ pivots.T
    top = np.argpartition(-close, NEAR - 1, axis=1)[:, :NEAR]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable"), 1)


def _described(pivots: dict[int, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, node, size, label, dim, v, near) of batches of (cls, node, size, label, v); v as its unit vector's bytes."""
    for b in batches:
        v = b.column(4)
        dims = np.diff(v.offsets.to_numpy())
        for d in np.unique(dims):
            at = pa.array(np.flatnonzero(dims == d))
            x = unit(v.take(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d))
            near = nearest(x, pivots_of(pivots, int(d))).astype(np.int32)
            columns = [*b.take(at).columns[:4], pa.array(np.full(len(at), d, np.int32)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(near), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "node", "size", "label", "dim", "v", "near"])


def _listed(ranks: dict[int, np.ndarray], keys: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row once for each of its ``keys`` rarest pivots, with that pivot."""
    for b in batches:
        near = b.column(6).flatten().to_numpy().reshape(b.num_rows, -1)
        dims = b.column(4).to_numpy()
        rank = np.stack([ranks[d][n] for d, n in zip(dims.tolist(), near)]) if b.num_rows else near
        rarest = np.take_along_axis(near, np.argsort(rank, axis=1)[:, :keys], 1)
        at = pa.array(np.repeat(np.arange(b.num_rows), rarest.shape[1]))
        yield pa.RecordBatch.from_arrays([*b.take(at).columns, pa.array(rarest.ravel().astype(np.int32))], [*b.schema.names, "pivot"])


def linked_pairs(x: np.ndarray, near: np.ndarray, side: np.ndarray | None, pivot: int, ranks: np.ndarray, shared: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of x, i of side 0 and j of side 1 (any i < j if side is None), whose rarest common pivot is this one, that share enough pivots and reach the cosine."""
    used, column = np.unique(near, return_inverse=True)
    # A common pivot that is rarer than this list's weighs more than all others together: that pair belongs to another list.
    weight = np.where(ranks[used] < ranks[pivot], NEAR + 1, 1).astype(np.float32)
    has = np.zeros((len(x), len(used)), np.float32)
    has[np.arange(len(x))[:, None], column.reshape(near.shape)] = 1
    left, right = (np.arange(len(x)),) * 2 if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    found = [(np.zeros(0, np.int64),) * 2]
    for s in range(0, len(left), 512):
        rows = left[s : s + 512]
        common = (has[rows] * weight) @ has[right].T
        i, j = np.nonzero((common >= shared) & (common <= NEAR))
        i, j = rows[i], right[j]
        if side is None:
            i, j = i[i < j], j[i < j]
        for p in range(0, len(i), PAIRS):
            a, b = i[p : p + PAIRS], j[p : p + PAIRS]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= least
            found.append((a[ok], b[ok]))
    return tuple(np.concatenate(p) for p in zip(*found))


def _checked(t: pa.Table, pivot: int, dim: int, pair: bool, second: int, ranks: np.ndarray, shared: int, least: float) -> pa.Table:
    """Of a block, or a pair of blocks, of a list: each class with a link there, the vectors that it is linked with, and the least id that it reaches."""
    t = t.sort_by("node")
    node, size = t["node"].to_numpy(), t["size"].to_numpy()
    x = np.frombuffer(b"".join(t["v"].to_pylist()), float).reshape(len(node), dim)
    near = t["near"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    side = (t["block"].to_numpy() == second).astype(np.int8) if pair else None
    i, j = linked_pairs(x, near, side, pivot, ranks, shared, least)
    links = np.zeros(len(node), np.int64)
    np.add.at(links, i, size[j])
    np.add.at(links, j, size[i])
    at, reached = forest(i, j) if len(i) else (i, j)
    return pa.table({"cls": t["cls"].to_numpy()[at], "node": node[at], "links": links[at], "least": node[reached]})


def usable(id_: Column, label: Column, v: Column) -> Column:
    """Whether a row can be linked at all."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(id_.isNotNull() & label.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    good = usable(F.col("vec_id"), F.col("label"), F.col("v"))
    classes = rows.where(good).groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"))
    # Classes of different labels or vectors may have one id: cls tells them apart. The table is written, so it stays.
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    pivots = choose_pivots(classes, max(PIVOTS_LEAST, min(PIVOTS_MOST, math.ceil(2 * math.sqrt(classes.count())))))
    given = spark.sparkContext.broadcast(pivots)  # SAMPLE_BYTES at most for each length in the sample
    schema = f"cls long, node long, size long, label {classes.schema['label'].dataType.simpleString()}, dim int, v binary, near array<int>"
    index = materialize(map_arrow(classes.select("cls", "node", "size", "label", "v"), lambda b: _described(given.value, b), schema), "vector-index")

    ranks = pivot_ranks(index.select("dim", F.explode("near").alias("p")).groupBy("dim", "p").count().collect())  # a row for each pivot
    ranked = spark.sparkContext.broadcast(ranks)
    keys = NEAR - shared + 1
    lists = map_arrow(index, lambda b: _listed(ranked.value, keys, b), f"{schema}, pivot int")
    name = ["label", "dim", "pivot"]
    sizes = lists.groupBy(*name).count().where(F.col("count") > block).select(*name, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    sizes = materialize(sizes, "vector-long-lists")
    few = sizes.count() <= LONG_LISTS
    dealt = lists.join(F.broadcast(sizes) if few else sizes, name, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*name, F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "cls", "node", "size", "v", "near")
    if not few:  # else all blocks of a list would stay where the join has brought it
        dealt = dealt.repartition(*name, "first", "second")

    def check(key: tuple, t: pa.Table) -> pa.Table:
        dim, pivot, first, second = (k.as_py() for k in key[1:])
        return _checked(t, pivot, dim, first != second, second, ranked.value[dim], shared, cosine)

    found = materialize(dealt.groupBy(*name, "first", "second").applyInArrow(check, "cls long, node long, links long, least long"), "vector-links")
    reached = components(found.select(F.col("node").alias("a"), F.col("least").alias("b"))).select("node", F.col("component").alias("reached"))
    linked = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.join(linked, "cls", "left").join(reached, "node", "left")
    known = known.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("reached", "node").alias("component_id"))
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where(good).join(known, ["label", "v"]).select("vec_id", "n_links", "component_id").unionAll(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def pivot_ranks(counts: list) -> dict[int, np.ndarray]:
    """By length of vector: each pivot's place, those with the fewest vectors first. counts: rows (dim, p, count)."""
    ranks = {}
    for dim in {r.dim for r in counts}:
        held = {r.p: r["count"] for r in counts if r.dim == dim}
        order = sorted(range(max(held) + 1), key=lambda p: (held.get(p, 0), p))
        ranks[dim] = np.argsort(order)
    return ranks
