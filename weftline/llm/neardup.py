"""Operator 8: near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles. Documents with equal sets are one class from the start. Each of TREES independent
trees branches the classes by minwise tokens that the tree selects: classes go down together while their tokens agree.
Two tokens are always taken; a node of more than NODE classes is branched by further ones, REPEATS times independently,
until its children are small. Classes that meet in a node are compared exhaustively, by sketches. A pair of similarity s
meets in a tree with probability s^2, and below each further branching with 1 - (1 - s^2)^REPEATS of that: at s = 0.8
ten trees miss it with probability 4e-5, below one further branching 9e-5, below two 2e-4.

A node whose largest child keeps more than half of it holds classes that are like one another, so branching it does not
help. It is dealt out in parts with some pivots in common, and whatever such a node leaves apart is compared with all of it.

Sketches only say which pairs are looked at. A link holds if the full sets say so: first each class is confirmed with one
like it of a smaller number, so that most sets are read once; then the nodes of which that left something apart are
compared set by set. Only confirmed links are closed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, roots, union
from .groups import whole_groups
from .store import held, lean, stash
from .textvec import LOWER, Words, shingles, slices, utf8

TREES = 10
#: Bytes of a sketch, a minwise token's low byte each.
SKETCH = 128
#: Pairs whose sketches agree in a smaller part are not looked at: four standard deviations below 0.8, 5e-5 of the pairs at 0.8.
NEAR = 0.66
#: Sketches that agree so far are likely to be those of a link.
LIKELY = 0.8
#: Above so many classes a node is branched further, by two bytes of the sketches REPEATS times, at most STEPS times over.
NODE, REPEATS, STEPS = 1024, 3, 6
#: Classes that all parts of a dense node have.
PIVOTS = 8
#: Classes that are confirmed with the same one in a task.
BLOCK = 256

_RNG = np.random.default_rng(80)
_N = TREES * 2 + SKETCH
_MUL = (_RNG.integers(0, 1 << 31, _N, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 1 << 32, _N, dtype=np.uint32)[:, None]
_RAW = "th long, cid long, n_shingles long, paths array<long>, sketch binary"


def _minima(x: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set."""
    h = (x >> np.uint64(32)).astype(np.uint32) ^ x.astype(np.uint32)
    best = np.full(_N, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(h), 4096):
        v = h[None, lo : lo + 4096] * _MUL + _ADD
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(best, v.min(1), out=best)
    return best


def _class_id(x: np.ndarray) -> int:
    """64 bits that stand for a set."""
    v = int((x * np.uint64(0xC2B2AE3D27D4EB4F) ^ (x >> np.uint64(29))).sum()) * 0x9E3779B97F4A7C15 + len(x)
    v &= 0xFFFFFFFFFFFFFFFF
    v ^= v >> 32
    return v - (1 << 64) if v >> 63 else v


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        data, offsets = utf8(b.column(b.schema.get_field_index("text")))
        for lo, hi in slices(offsets):
            yield b.slice(lo, hi - lo), shingles(Words(data, offsets[lo : hi + 1], fold=LOWER), width)


def _describe(width: int):
    tree = np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("", dict)
        for b, sets in _sets(batches, width):
            some = [len(x) > 0 for x in sets]
            best = np.array([_minima(x) for x in sets if len(x)], np.uint32).reshape(-1, _N)
            path = tree[None]
            for k in range(2):
                path = (path ^ (best[:, k * TREES : (k + 1) * TREES].astype(np.uint64) + np.uint64(k + 1))) * np.uint64(0xBF58476D1CE4E5B9)
                path = path ^ (path >> np.uint64(29))
            paths = iter(path.view(np.int64).tolist() if len(best) else [])
            sketches = iter(best[:, 2 * TREES :].astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("th")),
                    pa.array([_class_id(x) if ok else None for x, ok in zip(sets, some, strict=True)], pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([next(paths) if ok else None for ok in some], pa.list_(pa.int64())), pa.array([next(sketches).tobytes() if ok else None for ok in some], pa.binary()),
                ],
                names=["doc_id", "th", "cid", "n_shingles", "paths", "sketch"],
            )

    return run


def _children() -> Column:
    """The nodes below a node that a class goes to, one for each repeat: by two bytes of its sketch, which the node selects."""
    byte = lambda r, k: F.substring("sketch", (F.pmod(F.xxhash64("path", F.lit(r), F.lit(k)), F.lit(SKETCH)) + 1).cast("int"), F.lit(1))
    return F.array(*[F.xxhash64("path", F.lit(r), byte(r, 0), byte(r, 1)) for r in range(REPEATS)])


def _branch(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(path, part, cid, sketch): the nodes of NODE classes at most, and the parts of dense ones; and (path, cid, sketch) of dense ones.

    Counts of large nodes are written; whether there are any is what the driver sees.
    """
    rows = classes.select(F.explode("paths").alias("path"), "cid", "sketch")
    zero = F.lit(0).cast("long")
    hot = stash(rows.groupBy("path").agg(F.count("*").alias("total")).where(F.col("total") > NODE), "hot")
    small, dense = [], []
    for step in range(STEPS + 1):
        if hot.isEmpty():
            small.append(rows)
            break
        small.append(rows.join(hot, "path", "left_anti"))
        large = rows.join(hot, "path")
        if step == STEPS:
            dense.append(large)
            break
        counts = large.select("path", "total", F.explode(_children()).alias("child")).groupBy("path", "total", "child").agg(F.count("*").alias("n")).where(F.col("n") > NODE)
        counts = stash(counts, "children")
        alike = counts.where(2 * F.col("n") > F.col("total")).select("path").distinct()
        dense.append(large.join(alike, "path", "left_semi"))
        rows = large.join(alike, "path", "left_anti").select(F.explode(_children()).alias("path"), "cid", "sketch")
        hot = stash(counts.join(alike, "path", "left_anti").select(F.col("child").alias("path"), F.col("n").alias("total")), "hot")
    out = small[0]
    for more in small[1:]:
        out = out.unionByName(more)
    out = out.select("path", zero.alias("part"), "cid", "sketch")
    if not dense:
        return out, None
    deep = dense[0]
    for more in dense[1:]:
        deep = deep.unionByName(more)
    deep = stash(deep.select("path", F.ceil(F.col("total") / NODE).cast("long").alias("parts"), "cid", "sketch"), "dense")
    pivot = F.array(*[F.min_by(F.struct("cid", "sketch"), F.xxhash64("cid", F.lit(k))) for k in range(PIVOTS)])
    pivots = deep.groupBy("path", "parts").agg(pivot.alias("p")).select("path", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"), F.explode(F.array_distinct("p")).alias("x"))
    parts = deep.select("path", F.pmod(F.xxhash64("cid", "path"), F.col("parts")).alias("part"), "cid", "sketch").unionByName(pivots.select("path", "part", "x.cid", "x.sketch"))
    return out.unionByName(parts), deep


_FOUND = "path long, part long, sub long, cid long, like long"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exhaustive comparison of the sketches in each node: a row for each class that comes near another.

    sub: the smallest class that it hangs together with there; like: the smallest class below it that it is likely linked with.
    """
    least, likely = int(np.ceil(NEAR * SKETCH)), int(np.ceil(LIKELY * SKETCH))
    for t, bounds in whole_groups(batches, ["path", "part"]):
        size = np.diff(bounds)
        node = np.repeat(np.arange(len(size)), size)
        ids = t.column("cid").to_numpy()
        order = np.lexsort((ids, node))
        order = order[np.append(True, (np.diff(node[order]) != 0) | (np.diff(ids[order]) != 0))]  # a pivot is in its own part twice
        cid, node = ids[order], node[order]
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)[order]
        n = len(cid)
        size = np.bincount(node, minlength=len(size))
        bounds = np.concatenate(([0], np.cumsum(size)))
        end = np.repeat(bounds[1:], size)
        parent, like = np.arange(n), np.full(n, n)
        # Small nodes of all sizes at once: each row with the next, the one after, and so on.
        rows = np.flatnonzero(np.repeat(size <= 48, size) & (np.arange(n) + 1 < end))
        step = 1
        while len(rows):
            for lo in range(0, len(rows), 1 << 15):
                r = rows[lo : lo + (1 << 15)]
                same = np.count_nonzero(sketch[r] == sketch[r + step], 1)
                for i in r[same >= least].tolist():
                    union(parent, i, i + step)
                i = r[same >= likely]
                like[i + step] = np.minimum(like[i + step], i)
            step += 1
            rows = rows[rows + step < end[rows]]
        # Others row by row: with those that don't hang together with it yet, or have no class that they are like.
        for k in np.flatnonzero(size > 48):
            lo, hi = bounds[k], bounds[k + 1]
            own, label, to = sketch[lo:hi], np.arange(hi - lo), like[lo:hi]
            for i in range(hi - lo - 1):
                others = np.flatnonzero((label[i + 1 :] != label[i]) | (to[i + 1 :] == n)) + i + 1
                if not len(others):
                    continue
                same = np.count_nonzero(own[others] == own[i], 1)
                to[others[(same >= likely) & (to[others] == n)]] = lo + i
                for v in np.unique(label[others[same >= least]]):
                    label[label == v] = label[i]
            parent[lo:hi] = lo + np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]
        top = roots(parent)
        keep = np.flatnonzero(np.bincount(top, minlength=n)[top] > 1)
        likes = pa.array(cid[np.minimum(like[keep], n - 1)], mask=like[keep] == n)
        at = order[keep]
        yield pa.RecordBatch.from_arrays([pa.array(t.column("path").to_numpy()[at]), pa.array(t.column("part").to_numpy()[at]), pa.array(cid[top[keep]]), pa.array(cid[keep]), likes], names=["path", "part", "sub", "cid", "like"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a dense node, classes of one block that are apart from its main part (side 1) with those of another block: pairs that come near, as _near has them."""
    least = int(np.ceil(NEAR * SKETCH))
    for t, bounds in whole_groups(batches, ["path", "block", "block2"]):
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            rows = t.slice(int(lo), int(hi - lo))
            cid, label, side = (rows.column(c).to_numpy() for c in ("cid", "label", "side"))
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            parent, base = np.arange(len(cid)), np.flatnonzero(side == 0)
            for i in np.flatnonzero(side == 1):
                others = base[label[base] != label[i]]
                for j in others[np.count_nonzero(sketch[others] == sketch[i], 1) >= least].tolist():
                    union(parent, int(i), j)
            top = roots(parent)
            keep = np.flatnonzero(np.bincount(top, minlength=len(cid))[top] > 1)
            fixed = lambda c: pa.array(np.full(len(keep), rows.column(c)[0].as_py(), np.int64))  # noqa: E731, B023
            # block2 of a node's blocks is told apart from its parts by its sign.
            part = pa.array(np.full(len(keep), -1 - (rows.column("block")[0].as_py() << 31) - rows.column("block2")[0].as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([fixed("path"), part, pa.array(cid[top[keep]]), pa.array(cid[keep]), pa.nulls(len(keep), pa.int64())], names=["path", "part", "sub", "cid", "like"])


def _linked(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of some sets are linked with one."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.searchsorted(own, flat)
    at[at == len(own)] = 0
    total = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(own[at] == flat, out=total[1:])
    common = np.diff(total[np.concatenate(([0], np.cumsum(sizes)))])
    return 100 * common >= percent * (len(own) + sizes - common)


def _read_sets(rows: pa.Table, at: np.ndarray) -> list[np.ndarray]:
    column = rows.column("shingles")
    return [np.frombuffer(column[int(i)].as_buffer(), np.uint64) for i in at]


def _confirm_likes(percent: int):
    """(u, v): the classes of each unit that are linked with the one on side 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["like", "block"]):
            us, vs = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                rows = t.slice(int(lo), int(hi - lo))
                side = rows.column("side").to_numpy()
                first, rest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                if len(first) and len(rest):
                    ok = _linked(_read_sets(rows, first[:1])[0], _read_sets(rows, rest), percent)
                    us += rows.column("cid").to_numpy()[rest[ok]].tolist()
                    vs += [rows.column("like")[0].as_py()] * int(ok.sum())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _confirm_units(percent: int):
    """(u, v): links between the labels of each unit that hold on full sets, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["unit"]):
            us, vs = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                rows = t.slice(int(lo), int(hi - lo))
                _, first = np.unique(rows.column("cid").to_numpy(), return_index=True)
                sets, names = _read_sets(rows, first), rows.column("label").to_numpy()[first]
                n, label = np.array([len(x) for x in sets]), names.copy()
                for i in np.argsort(n, kind="stable"):
                    others = np.flatnonzero((label != label[i]) & (n >= n[i]) & (100 * n[i] >= percent * n))
                    if not len(others):
                        continue
                    for j in others[_linked(sets[i], [sets[j] for j in others], percent)]:
                        if label[j] != label[i]:
                            us.append(names[i])
                            vs.append(names[j])
                            label[label == label[j]] = label[i]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # rows that repeat a document give its set once
        for b, sets in _sets(batches, width):
            at = b.schema.get_field_index("cid")
            keep = []
            for i, (x, c) in enumerate(zip(sets, b.column(at).to_pylist(), strict=True)):
                if c not in done and len(x) and _class_id(x) == c:
                    done.add(c)
                    keep.append(i)
            own = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(at), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["cid", "shingles"])

    return run


def _like_links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): each class and the smallest one that it is likely linked with, if it is. A class that many are like is dealt out with BLOCK of them a task."""
    likes = stash(near.where("like is not null").groupBy("cid").agg(F.min("like").alias("like")), "likes")
    blocks = likes.groupBy("like").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    blocks = stash(blocks, "like-blocks")
    one = likes.join(blocks, "like").select("cid", "like", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block"), F.lit(1).cast("long").alias("side")).join(sets, "cid")
    # Its own set is joined once and then given to each of its blocks.
    zero = blocks.withColumn("cid", F.col("like")).join(sets, "cid").select("cid", "like", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).cast("long").alias("side"), "shingles")
    dealt = one.unionByName(zero).repartition("like", "block").sortWithinPartitions("like", "block")
    return dealt.select("like", "block", "side", "cid", "shingles").mapInArrow(_confirm_likes(percent), "u long, v long")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (cid, ...) with the column label, a class's own number if it has no link."""
    return rows.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _unit_links(near: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between labels that the nodes show, confirmed on full sets. Nodes that are of one label already, or that repeat another, fall away."""
    unit = _labelled(near, labels).groupBy("path", "part", "sub").agg(F.sort_array(F.collect_set(F.struct("label", "cid"))).alias("members"), F.min("label").alias("least"), F.max("label").alias("most"))
    unit = unit.where("least <> most").select(F.xxhash64("members").alias("unit"), "members").dropDuplicates(["unit"])
    members = unit.select("unit", F.explode("members").alias("m")).select("unit", "m.label", "m.cid")
    dealt = members.join(sets, "cid").repartition("unit").sortWithinPartitions("unit")
    return dealt.select("unit", "label", "cid", "shingles").mapInArrow(_confirm_units(percent), "u long, v long")


def _rest_near(deep: DataFrame, labels: DataFrame) -> DataFrame:
    """As _near: what is near across the parts of dense nodes, of the classes apart from a node's main label with all of its classes, in blocks."""
    zero = F.lit(0).cast("long")
    large = stash(_labelled(deep.withColumnRenamed("parts", "blocks"), labels), "dense-labels")
    main = large.groupBy("path", "label").count().groupBy("path").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    main = stash(main, "dense-main")
    rest = large.join(main, "path").where("label <> main")
    rest_blocks = stash(rest.groupBy("path").agg(F.ceil(F.count("*") / NODE).cast("long").alias("rest_blocks")), "dense-rest")
    block = F.pmod(F.xxhash64("cid", "path"), F.col("blocks")).alias("block")
    base = large.join(rest_blocks, "path").select("path", block, F.explode(F.sequence(zero, F.col("rest_blocks") - 1)).alias("block2"), zero.alias("side"), "label", "cid", "sketch")
    query = rest.join(rest_blocks, "path").select("path", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("cid", F.lit(1)), F.col("rest_blocks")).alias("block2"), (zero + 1).alias("side"), "label", "cid", "sketch")
    dealt = base.unionByName(query).repartition("path", "block", "block2").sortWithinPartitions("path", "block", "block2")
    return dealt.mapInArrow(_across, _FOUND)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, th): each row's set size and the smallest doc_id reachable over links.

    A set holds the distinct runs of ``width`` words (``[^\\x20\\x09-\\x0D]+``) of the whole text with A-Z lower-cased; a text with fewer
    words is one shingle. Rows with 100 * intersection >= percent * union are linked. Null and empty texts, and those
    without words, have empty sets and are linked with nothing. Null doc_ids: such a row takes part in links; its
    component_id is the smallest other doc_id of the component, or null, and it is not kept. Rows that repeat a doc_id get their
    texts' components. Extra columns are ignored. An empty table gives an empty one. th is a hash of the text.

    Shingles go by 62 bits of their bytes, classes by 64 bits of their set: of n different sets some n^2 / 2^65 pairs are taken for
    equal. Only whether there are large nodes, and numbers of edges, reach the driver. A task that confirms links holds the sets of a
    node, NODE and PIVOTS at most.
    """
    text = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = stash(text.mapInArrow(_describe(width), f"doc_id long, {_RAW}"), "sets")
    # Equal sets are one class; its first row by (th, doc_id) stands for it.
    firsts = F.min(F.struct("th", "doc_id")).alias("rep")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least_id"), firsts, F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    classes = stash(classes, "classes")
    nodes, deep = _branch(classes)
    near = stash(nodes.repartition("path", "part").sortWithinPartitions("path", "part").mapInArrow(_near, _FOUND), "near")

    # The sets of classes that come near another, or lie in a dense node.
    wanted = near.select("cid")
    wanted = (wanted if deep is None else wanted.unionByName(deep.select("cid"))).distinct().join(classes.select("cid", "rep"), "cid")
    wanted = wanted.select("cid", F.col("rep.th").alias("th"), F.coalesce("rep.doc_id", F.lit(-1)).alias("_id"))
    bodies = text.withColumn("_id", F.coalesce("doc_id", F.lit(-1))).join(wanted, ["th", "_id"]).select("cid", "text")
    sets = stash(bodies.mapInArrow(_full_sets(width), "cid long, shingles binary"), "full")

    links = stash(_like_links(near, sets, percent), "links")
    labels = components(links)
    joined = stash(_unit_links(near, labels, sets, percent), "joined")
    labels = components(links.unionByName(joined))
    if deep is not None:
        more = stash(_rest_near(deep, labels), "rest")
        joined = joined.unionByName(stash(_unit_links(more, labels, sets, percent), "joined"))
        labels = components(links.unionByName(joined))

    # Written, so that the join is one of two plain tables and a large component's side is split.
    named = stash(_labelled(classes.select("cid", "least_id"), labels), "named")
    least = stash(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "least")
    named = named.join(least, "label").select("cid", "component_id")
    out = rows.select("doc_id", "n_shingles", "cid", "th").join(named, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "th")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "th")
