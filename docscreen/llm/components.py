"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove, save, shared_path
from .common import map_arrow, sized

#: So many edges at most are joined up in one task; their number is counted first.
LOCAL = 200_000
TASK_ROWS = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of edges (a, b), and the least node that it reaches."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) from all edges; there are at most LOCAL."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        node, least = forest(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["node", "component"])


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Each greater neighbour of u goes to the least of u's neighbourhood."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    """u and its lesser neighbours go to the least of them. Each edge is (greater, lesser)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 40, local: int = LOCAL, most: float = 0) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the least node that can be reached. Nodes without an edge are absent.

    If there are ``local`` edges or fewer, one task joins them up. Else the number of rounds grows with the logarithm of
    the longest path; a hub's edges are aggregated before the shuffle, and Spark splits its
    join as skewed. Raises if ``rounds`` don't settle them. most: an estimate of the edges' number.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    spark, before = edges.sparkSession, None
    edges = save(sized(edges.distinct(), most / TASK_ROWS), path := shared_path(spark, "edges"))
    for _ in range(rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state.n <= local:
            return map_arrow(edges.coalesce(1), _finish, "node long, component long")
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before, old = state, path
        edges = save(sized(_small(_large(edges).distinct()).distinct(), state.n / TASK_ROWS), path := shared_path(spark, "edges"))
        remove(spark, old)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
