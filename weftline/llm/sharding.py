"""Operator 1: longest-processing-time scheduling of document groups over shards."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stash

#: Groups of one size that are numbered together.
RANKED = 1 << 16
#: Cells by hash of which each shard's rows are numbered.
SLOT_CELLS = 1024


def schedule(classes: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """Longest processing time first: how many groups of each class each shard takes.

    ``classes`` holds (size, groups), from the largest size to the smallest. Each group goes to the least loaded shard,
    which a heap gives (ties: the lower shard). A shard comes to the top of the heap at its load, its load and one size, and so on;
    of more groups than shards all that come up below a level are dealt at once, the level being as high as the groups reach.
    So the result is the heap's, one by one.
    """
    heap = [(0, i) for i in range(shards)]
    out = []
    for size, n in classes:
        take = [0] * shards
        if n > shards:
            below = lambda level: sum(-(-(level - load) // size) for load, _ in heap if load < level)  # noqa: E731, B023
            lo, hi = heap[0][0], heap[0][0] + size * n + 1  # groups below lo: none
            while hi - lo > 1:
                level = (lo + hi) // 2
                lo, hi = (level, hi) if below(level) <= n else (lo, level)
            for k, (load, i) in enumerate(heap):
                if load < lo:
                    take[i] = -(-(lo - load) // size)
                    heap[k] = (load + take[i] * size, i)
            n -= sum(take)
            heapq.heapify(heap)
        for _ in range(n):
            load, i = heap[0]
            take[i] += 1
            heapq.heapreplace(heap, (load + size, i))
        out.append(take)
    return out


def lpt_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row on a shard, the rows of equal texts on one, bytes near equal.

    Size is the text's UTF-8 bytes plus 1; null texts have size 1, a null text_crc32 and are one group of their own, as
    are empty texts. Null or repeated doc_ids are rows like others; slots number a shard's rows from 0 without gaps,
    by doc_id within cells of its MD5. Extra columns are ignored. An empty table gives an empty one.

    The driver sees one row for each size that a group has. As different sizes add up, d of them take d^2 / 2 bytes at least, so there are at
    most 14 million for 100 TB. A group larger than an equal share of all bytes makes its shard larger, as groups must stay together.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("g"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = stash(rows, "shard-rows")
    groups = stash(rows.groupBy("g").agg(F.sum("size").alias("bytes")), "shard-groups")
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow().sort_by([("bytes", "descending")])
    take = np.array(schedule(list(zip(sizes["bytes"].to_pylist(), sizes["n"].to_pylist(), strict=True)), shards), np.int64).reshape(-1, shards)
    ends = pa.ListArray.from_arrays(np.arange(0, take.size + 1, shards, dtype=np.int32), take.cumsum(1).ravel())
    plan = pa.table({"bytes": sizes["bytes"], "cells": pa.array(-(-take.sum(1) // RANKED)), "ends": ends})
    plan = stash(spark.createDataFrame(plan, "bytes long, cells long, ends array<long>"), "shard-plan")
    # A group's number among those of its size: within a cell by hash, after the cells before.
    placed = groups.join(plan, "bytes").withColumn("cell", F.pmod(F.xxhash64("g"), F.col("cells")))
    earlier = Window.partitionBy("bytes").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.where("cells > 1").groupBy("bytes", "cell").count().select("bytes", "cell", F.sum("count").over(earlier).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bytes", "cell").orderBy("g"))
    placed = placed.withColumn("rank", rank).join(starts, ["bytes", "cell"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    placed = placed.select("g", F.expr("cast(size(filter(ends, e -> e < rank)) as int)").alias("shard"))
    # A hot group is one row here and may be a third of the rows there: adaptive execution splits that side of the join.
    dealt = rows.join(placed, "g").withColumn("cell", (F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "g")), 1, 8), 16, 10).cast("long") % SLOT_CELLS).cast("int"))
    dealt = stash(dealt.drop("g"), "shard-dealt")
    # At most shards x SLOT_CELLS rows.
    starts = dealt.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32"))
    out = dealt.withColumn("within", within).join(F.broadcast(starts), ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("within") - 1).alias("slot"))
