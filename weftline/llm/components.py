"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stash


def find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def union(parent: np.ndarray, i: int, j: int) -> bool:
    """Join two sets under the smaller index; False if they were one."""
    i, j = find(parent, i), find(parent, j)
    if i == j:
        return False
    parent[max(i, j)] = min(i, j)
    return True


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


#: So many edges, after those of each batch were made stars, go to one task; more are dealt in rounds.
ALONE = 1 << 20


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """The components of some edges as stars around their smallest ids: as many edges as nodes at most."""
    ids, index = np.unique(np.concatenate((u, v)), return_inverse=True)
    parent = np.arange(len(ids))
    for i, j in zip(index[: len(u)].tolist(), index[len(u) :].tolist(), strict=True):
        union(parent, i, j)
    top = roots(parent)
    keep = np.flatnonzero(top != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[top[keep]])], names=["u", "v"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield _stars(b.column(0).to_numpy(), b.column(1).to_numpy())


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if every:
        yield _stars(np.concatenate([u for u, _ in every]), np.concatenate([v for _, v in every]))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (two long columns); label is the component's smallest node.

    The edges of each batch are made stars and written. At most ALONE of them, some 16 MB, are put together by one task;
    more go through rounds of joins (``_rounds``), with the same labels. No part of the graph reaches the driver.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = stash(e.mapInArrow(_forest, "u long, v long"), "edges")
    e = stash(e.coalesce(1).mapInArrow(_whole, "u long, v long"), "stars") if e.count() <= ALONE else _rounds(e.distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _rounds(e: DataFrame) -> DataFrame:
    """Stars around the smallest nodes, by alternate large-star and small-star steps (Kiveris et al., 2014) until nothing changes.

    Each step moves a row for each edge, and there are never more edges than at the start; the smallest neighbour is pre-aggregated
    before it is shuffled and is written, so that the join back is one of two plain tables, which adaptive execution splits at a hot node.
    """
    e, before = stash(e, "edges"), None
    while True:
        # Large star: every larger neighbour of a node goes to the smallest of the node and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        e = stash(e, "edges")
        least = stash(e.groupBy("u").agg(F.min("v").alias("m")), "least")
        e = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = stash(e, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e
        before = now
