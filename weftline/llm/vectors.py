"""Operator 4: near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors are one class. Classes are dealt to overlapping cluster shards; a large shard is cut by a second level of
centroids (``_deeper``). Each shard builds a graph of its members, pruned robustly (Subramanya et al., 2019), and a class's
adjacency list is the union of its lists in all its shards. Every class is then searched in the shards of its nearest
centroids: a greedy beam from the shard's medoid finds the region, and the search expands over all neighbours within range
until no new one comes. Cosines of what is found are verified in double precision. Recall is audited against brute force,
over all links and for the mean query; if it is low, the shards overlap more and the search runs anew. If it is low still,
every class is compared with all of every shard that can hold one within range by the triangle inequality of angles
(``_exact``), which finds all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .groups import whole_groups
from .store import lean, stash

#: Classes of a shard before overlap, about; rows that centroids are fitted on at most; centroids at most.
SHARD, SAMPLE, CENTROIDS = 512, 16_384, 2048
#: Rows of one unit of work. A larger shard gets centroids of its own, fitted on about FIT of its rows for each, and a member is in CLOSE of the
#: parts; a part that is larger still, being dense, is split into blocks of half a unit, and every two blocks are a unit.
UNIT, FIT, CLOSE = 4096, 8, 2
#: Parts of a shard at most, and rows of a large shard that one task deals to them.
PARTS, DEALT = 1 << 20, 65_536
#: Neighbours that pruning chooses from and keeps, its slack, the beam, and the hops of the greedy search.
CANDIDATES, DEGREE, ALPHA, BEAM, HOPS = 32, 24, 1.2, 8, 24
#: Shards in which a class is searched for.
PROBES = 2
#: How far below the threshold the search still expands.
SLACK = 0.03
#: Queries of the audit at most, and the recall below which the overlap is widened.
AUDIT, RECALL = 256, 0.97
OVERLAPS = (4, 8, 16)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, dimension and float64 bytes of each vector; null where it links with nothing."""
    for b in batches:
        cls, dim, raw = [], [], []
        for v in b.column(1):
            x = None
            if v.is_valid and len(v) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                top = np.abs(x).max()
                x = x / top if np.isfinite(top) and top > 0 and np.isfinite(x).all() else None
            if x is None:
                cls.append(None)
                dim.append(None)
                raw.append(None)
                continue
            d = x.tobytes()
            cls.append(int.from_bytes(hashlib.blake2b(d, digest_size=8).digest(), "little", signed=True))
            dim.append(len(x))
            raw.append(d)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.int64()), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "cls", "dim", "vec"])


def _units(column: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from rows spread over ``x``; deterministic."""
    x = x.astype(np.float32)
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[lo : lo + 4096] @ c.T).argmax(1) for lo in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def _assign(models: dict[int, np.ndarray], overlap: int):
    """Rows (shard, cls, n, rank, near, vec): a class in the shards of its nearest centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for number, dim in enumerate(sorted(models)):
                rows = np.flatnonzero(dims == dim)
                for lo in range(0, len(rows), 1024):
                    at = rows[lo : lo + 1024]
                    own = b.take(pa.array(at))
                    raw = own.column(3).to_pylist()
                    c = models[dim]
                    w = min(overlap, len(c))
                    near = np.argsort(-(_units(raw, dim).astype(np.float32) @ c.T), axis=1, kind="stable")[:, :w].astype(np.int64) + number * CENTROIDS
                    flat = near.ravel()
                    lists = [x.tobytes() for x in near]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(flat), pa.array(np.repeat(own.column(0).to_numpy(), w)), pa.array(np.repeat(own.column(2).to_numpy(), w)), pa.array(np.tile(np.arange(w), len(at))),
                            pa.array([x for x in lists for _ in range(w)], pa.binary()), pa.array([x for x in raw for _ in range(w)], pa.binary()), pa.array(np.full(len(flat), dim, np.int64)),
                        ],
                        names=["shard", "cls", "n", "rank", "near", "vec", "dim"],
                    )

    return run


_SHARDED = "shard long, cls long, n long, rank long, near binary, vec binary, dim long"


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists of unit rows: the nearest CANDIDATES pruned robustly to DEGREE, and the edges' other directions."""
    m = len(x)
    k = min(CANDIDATES, m - 1)
    if k < 1:
        return [np.zeros(0, np.int64) for _ in range(m)]
    f = x.astype(np.float32)
    us, vs = [], []
    for lo in range(0, m, 512):
        s = f[lo : lo + 512] @ f.T
        rows = np.arange(len(s))
        s[rows, lo + rows] = -2
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        sim = np.take_along_axis(s, near, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
        far = np.sqrt(np.maximum(2 - 2 * sim, 0))
        among = np.sqrt(np.maximum(2 - 2 * np.einsum("ikd,ijd->ikj", f[near], f[near]), 0))
        alive, kept, degree = np.ones(near.shape, bool), np.zeros(near.shape, bool), np.zeros(len(s), int)
        for j in range(k):
            take = alive[:, j] & (degree < DEGREE)
            kept[:, j] = take
            degree += take
            alive &= ~(take[:, None] & (ALPHA * among[:, j] <= far))
        r, c = np.nonzero(kept)
        us.append(r + lo)
        vs.append(near[r, c])
    u, v = np.concatenate(us), np.concatenate(vs)
    key = np.unique(np.concatenate((u * m + v, v * m + u)))
    return np.split(key % m, np.searchsorted(key // m, np.arange(1, m)))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, adjacent): the lists of each shard, or of each block of a split one."""
    for t, bounds in whole_groups(batches, ["shard", "block"]):
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            rows = t.slice(int(lo), int(hi - lo))
            ids = rows.column("cls").to_numpy()
            x = _units(rows.column("vec").to_pylist(), int(rows.column("dim")[0].as_py()))
            lists = [ids[a].astype(np.int64).tolist() for a in pruned_graph(x)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lists, pa.list_(pa.int64()))], names=["cls", "adjacent"])


def range_search(x: np.ndarray, start: np.ndarray, flat: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) within range. ``start``, ``flat``: the adjacency lists, end to end."""
    m, f = len(x), x.astype(np.float32)
    medoid = int((f @ f.mean(0)).argmax())
    degree = np.diff(start)
    seen_q, seen_y = [queries[:0]], [queries[:0]]
    for lo in range(0, len(queries), 512):
        q = queries[lo : lo + 512]
        b = len(q)
        ids = np.full((b, BEAM), -1)
        sims = np.full((b, BEAM), -3, np.float32)
        ids[:, 0], sims[:, 0] = medoid, f[q] @ f[medoid]
        done = np.zeros((b, BEAM), bool)
        for _ in range(HOPS):
            pick = np.where(done | (ids < 0), -3, sims).argmax(1)
            r = np.arange(b)
            go = (ids[r, pick] >= 0) & ~done[r, pick]
            if not go.any():
                break
            done[r, pick] = True
            at = ids[r[go], pick[go]]
            n = degree[at]
            owner = np.repeat(r[go], n)
            y = flat[np.repeat(start[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            s = np.einsum("ij,ij->i", f[q[owner]], f[y])
            # The best neighbours of each query, with its beam.
            order = np.lexsort((-s, owner))
            owner, y, s = owner[order], y[order], s[order]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            ok = place < BEAM
            new_i, new_s = np.full((b, BEAM), -1), np.full((b, BEAM), -3, np.float32)
            new_i[owner[ok], place[ok]], new_s[owner[ok], place[ok]] = y[ok], s[ok]
            new_i[(new_i[:, :, None] == ids[:, None]).any(2)] = -1
            new_s[new_i < 0] = -3
            all_i, all_s, all_d = np.concatenate((ids, new_i), 1), np.concatenate((sims, new_s), 1), np.concatenate((done, np.zeros_like(done)), 1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :BEAM]
            ids, sims, done = (np.take_along_axis(v, top, 1) for v in (all_i, all_s, all_d))
        r, c = np.nonzero((sims >= least - SLACK) & (ids >= 0))
        seen_q.append(q[r])
        seen_y.append(ids[r, c])
    reached = np.zeros((m, m), bool)
    q, y = np.concatenate(seen_q), np.concatenate(seen_y)
    key = np.unique(q * m + y)
    found_q, found_y = [queries[:0]], [queries[:0]]
    while len(key):
        q, y = key // m, key % m
        reached[q, y] = True
        s = np.concatenate([np.einsum("ij,ij->i", x[q[lo : lo + 65536]], x[y[lo : lo + 65536]]) for lo in range(0, len(q), 65536)])
        hit = (s >= least) & (q != y)
        found_q.append(q[hit])
        found_y.append(y[hit])
        wide = s >= least - SLACK
        q, y = q[wide], y[wide]
        keys = []
        for lo in range(0, len(q), 16384):
            a, c = q[lo : lo + 16384], y[lo : lo + 16384]
            n = degree[c]
            z = flat[np.repeat(start[c] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            a = np.repeat(a, n)
            new = ~reached[a, z]
            keys.append(np.unique(a[new] * m + z[new]))
        key = np.unique(np.concatenate(keys)) if keys else key[:0]
    return np.concatenate(found_q), np.concatenate(found_y)


def _search(least: float):
    """(cls, found, u): links that a query has in a unit, copies counted; and the forest of the unit's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["shard", "block", "block2"]):
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                rows = t.slice(int(lo), int(hi - lo))
                order = np.argsort(rows.column("cls").to_numpy(), kind="stable")
                ids = rows.column("cls").to_numpy()[order]
                x = _units(rows.column("vec").to_pylist(), int(rows.column("dim")[0].as_py()))[order]
                n, rank, own = (rows.column(c).to_numpy()[order] for c in ("n", "rank", "own"))
                near = np.stack([np.frombuffer(v, np.int64) for v in rows.column("near").to_pylist()])[order]
                lists = rows.column("adjacent").combine_chunks()
                lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                sizes = np.diff(lists.offsets.to_numpy())
                to = lists.flatten().to_numpy(zero_copy_only=False)
                # The lists as places in the unit; members of other shards only fall away.
                place = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
                inside = ids[place] == to
                back = np.argsort(order, kind="stable")
                edge = np.unique(np.repeat(back, sizes)[inside] * len(ids) + place[inside])
                start = np.searchsorted(edge, np.arange(len(ids) + 1) * len(ids))
                q, y = range_search(x, start, edge % len(ids), np.flatnonzero(rank < PROBES), least)
                if rows.column("block")[0].as_py() != rows.column("block2")[0].as_py():
                    cross = own[q] != own[y]
                    q, y = q[cross], y[cross]
                # A link counts in the first shard that the query is searched in and the other belongs to.
                again = np.zeros(len(q), bool)
                for k in range(min(PROBES, near.shape[1])):
                    again |= (rank[q] > k) & (near[y] == near[q, k][:, None]).any(1)
                found = np.bincount(q[~again], weights=n[y[~again]], minlength=len(ids)).astype(np.int64)
                label = np.arange(len(ids))
                while True:
                    new = label.copy()
                    np.minimum.at(new, q, label[y])
                    np.minimum.at(new, y, label[q])
                    new = new[new]
                    if np.array_equal(new, label):
                        break
                    label = new
                keep = np.flatnonzero((found > 0) | (label != np.arange(len(ids))))
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(found[keep]), pa.array(ids[label[keep]])], names=["cls", "found", "u"])

    return run


def _audit(batches_of: np.ndarray, query_ids: np.ndarray, dim: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(query_ids), np.int64)
        for b in batches:
            rows = np.flatnonzero(b.column(1).to_numpy() == dim)
            for lo in range(0, len(rows), 2048):
                own = b.take(pa.array(rows[lo : lo + 2048]))
                ids, n = own.column(0).to_numpy(), own.column(2).to_numpy()
                hit = (_units(own.column(3).to_pylist(), dim) @ batches_of.T >= least) & (ids[:, None] != query_ids[None])
                total += (hit * n[:, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(total)], names=["cls", "links"])

    return run


def audit_recall(classes: DataFrame, found: DataFrame, least: float = 0.95, queries: int = AUDIT) -> float:
    """Recall on a bounded sample of classes, against brute force over all of them: the smaller of that of all links and the mean of the classes that have any."""
    true = got = of = share = 0
    for dim in [r["dim"] for r in classes.select("dim").distinct().collect()]:
        # The smallest hashes, first among what has links and then among all.
        sample = classes.where(F.col("dim") == dim).select("cls", "vec").orderBy(F.xxhash64("cls"), "cls").limit(queries).collect()
        near = found.where("found > 0").select("cls").join(classes.where(F.col("dim") == dim), "cls").select("cls", "vec").orderBy(F.xxhash64("cls"), "cls").limit(queries).collect()
        rows = {r["cls"]: bytes(r["vec"]) for r in [*near, *sample]}
        ids = np.array(list(rows), np.int64)
        links = classes.select("cls", "dim", "n", "vec").mapInArrow(_audit(_units(list(rows.values()), dim), ids, dim, least), "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))
        both = links.join(found.groupBy("cls").agg(F.sum("found").alias("found")), "cls", "left").withColumn("got", F.least("links", F.coalesce("found", F.lit(0)))).where("links > 0")
        both = both.agg(F.sum("links"), F.sum("got"), F.count("*"), F.sum(F.col("got") / F.col("links"))).first()
        true, got, of, share = (x + (y or 0) for x, y in zip((true, got, of, share), both, strict=True))
    return min(int(got) / int(true), float(share) / of) if of else 1.0


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): links of cosine ``least`` or more, and the smallest vec_id reachable.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths do not
    link. Equal vectors are one class, so a group of copies is one row in the search; its members count one another. Null
    vec_ids: such a row counts as a link of others; its component_id is the smallest id there, or null, and it is not kept. Rows that repeat an id are
    vectors like others. Extra columns, labels too, are ignored. An empty table gives an empty one.

    Ties of centroids go to the first. The driver sees at most SAMPLE vectors of each length, from which the centroids are fitted, the
    audit's sample, and a row for each shard.
    """
    rows = lean(vectors).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = stash(rows.mapInArrow(_prepare, "vec_id long, cls long, dim int, vec binary"), "vectors")
    classes = rows.where("cls is not null").groupBy("cls", "dim").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"), F.first("vec").alias("vec"))
    classes = stash(classes.select("cls", F.col("dim").cast("long").alias("dim"), "n", "vec", "least_id"), "vector-classes")
    models = {}
    for r in classes.groupBy("dim").count().collect():
        sample = classes.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("cls"), "cls").select("vec").limit(SAMPLE).collect()
        k = max(1, min(CENTROIDS, -(-r["count"] // SHARD), -(-len(sample) // 4)))
        models[r["dim"]] = centroids(_units([bytes(s["vec"]) for s in sample], r["dim"]), k)
    for overlap in OVERLAPS:
        found = _links(classes, models, least, overlap)
        if audit_recall(classes, found, least) >= RECALL:
            break
    else:
        found = _exact(classes, models, least)
    linked = found.where("cls <> u").select("cls", "u")
    labels = components(linked).withColumnRenamed("node", "cls")
    named = classes.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    counts = found.groupBy("cls").agg(F.sum("found").alias("found"))
    named = named.join(smallest, "label").join(counts, "cls", "left").select("cls", "component_id", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, vec): the second level's centroids of each large shard, end to end, from a sample of its members."""
    for t, bounds in whole_groups(batches, ["shard"]):
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            rows = t.slice(int(lo), int(hi - lo))
            x = _units(rows.column("vec").to_pylist(), int(rows.column("dim")[0].as_py()))
            c = centroids(x, max(1, min(int(rows.column("parts")[0].as_py()), len(x) // 4)))
            yield pa.RecordBatch.from_arrays([rows.column("shard").combine_chunks().slice(0, 1), pa.array([c.tobytes()], pa.binary())], names=["shard", "vec"])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, rank, close, unit): members of large shards in the parts of their nearest centroids; the centroids (side 0) come before the members."""
    model, of = None, None
    for b in batches:
        if not b.num_rows:
            continue
        shard, side, dims = (b.column(i).to_numpy() for i in (0, 2, 5))
        cut = np.flatnonzero(np.append(True, (np.diff(shard) != 0) | (np.diff(side) != 0)))
        for lo, hi in zip(cut, [*cut[1:], b.num_rows], strict=True):
            if side[lo] == 0:
                model, of = b.column(6)[int(lo)].as_py(), shard[lo]
                continue
            if of != shard[lo]:  # no member was in the sample: one part
                model, of = None, shard[lo]
            dim = int(dims[lo])
            c = None if model is None else np.frombuffer(model, np.float32).reshape(-1, dim)
            for k in range(int(lo), int(hi), 1024):
                own = b.slice(k, min(1024, int(hi) - k))
                near = np.zeros((own.num_rows, 1), np.int64)
                if c is not None:
                    near = np.argsort(-(_units(own.column(6).to_pylist(), dim).astype(np.float32) @ c.T), axis=1, kind="stable")[:, :CLOSE].astype(np.int64)
                w = near.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own.column(3).to_numpy(), w)), pa.array(np.repeat(own.column(4).to_numpy(), w)), pa.array(np.tile(np.arange(w), len(near))), pa.array(near.ravel() + shard[lo] * PARTS)],
                    names=["cls", "rank", "close", "unit"],
                )


def _listed(width: int):
    """(shard, cls, rank, near): a class in each of its units, with the list of them, filled up with -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.array(x, np.int64) for x in b.column(1).to_pylist()]
            if not lists:
                continue
            sizes = np.array([len(x) for x in lists])
            near = [np.append(x, np.full(width - len(x), -1)).tobytes() for x in lists]
            rank = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(lists)), pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(rank), pa.array([x for x, n in zip(near, sizes, strict=True) for _ in range(n)], pa.binary())],
                names=["shard", "cls", "rank", "near"],
            )

    return run


def _deeper(classes: DataFrame, sharded: DataFrame, overlap: int) -> DataFrame:
    """``sharded`` with each shard of over UNIT members cut by a second level of centroids, a member being in CLOSE of its parts.

    The driver sees no centroid of the second level: members of a large shard stream past its centroids, DEALT or so a task.
    """
    sizes = sharded.groupBy("shard").count().where(F.col("count") > UNIT)
    parts = F.least(F.ceil(F.col("count") * 2 * CLOSE / UNIT), F.lit(PARTS)).cast("long")
    large = stash(sizes.select("shard", "count", parts.alias("parts"), F.ceil(F.col("count") / DEALT).cast("long").alias("salts")), "large-shards")
    if large.isEmpty():
        return sharded
    # There are no more shards than centroids of the first level, which the driver holds.
    rows = sharded.join(F.broadcast(large), "shard", "left")
    inside = rows.where("parts is not null")
    drawn = F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < F.col("parts") * FIT / F.col("count") * (1 << 30)
    fitted = inside.where(drawn).repartition("shard").sortWithinPartitions("shard", "cls").select("shard", "parts", "dim", "vec").mapInArrow(_fit, "shard long, vec binary")
    none = F.lit(0).cast("long")
    models = fitted.join(F.broadcast(large), "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), none.alias("side"), none.alias("cls"), none.alias("rank"), none.alias("dim"), "vec")
    members = inside.select("shard", F.pmod(F.xxhash64("cls"), F.col("salts")).alias("salt"), (none + 1).alias("side"), "cls", "rank", "dim", "vec")
    dealt = models.unionByName(members).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "side")
    placed = dealt.mapInArrow(_place, "cls long, rank long, close long, unit long")
    small = rows.where("parts is null").select("cls", "rank", none.alias("close"), (F.col("shard") * PARTS).alias("unit"))
    order = F.array_sort(F.collect_list(F.struct((F.col("rank") + F.col("close")).alias("far"), "close", "rank", "unit")))
    lists = placed.unionByName(small).groupBy("cls").agg(order.alias("near")).select("cls", F.col("near.unit").alias("near"))
    units = lists.mapInArrow(_listed(overlap * CLOSE), "shard long, cls long, rank long, near binary")
    return stash(units.join(classes.select("cls", "dim", "n", "vec"), "cls").select("shard", "cls", "n", "rank", "near", "vec", "dim"), "vector-parts")


def _links(classes: DataFrame, models: dict[int, np.ndarray], least: float, overlap: int) -> DataFrame:
    sharded = stash(classes.select("cls", "dim", "n", "vec").mapInArrow(_assign(models, overlap), _SHARDED), "vector-shards")
    sharded = _deeper(classes, sharded, overlap)
    counts = stash(sharded.groupBy("shard").count().select("shard", F.when(F.col("count") > UNIT, F.ceil(F.col("count") * 2 / UNIT)).otherwise(1).cast("long").alias("blocks")), "shard-counts")
    own = F.pmod(F.xxhash64("cls", "shard"), F.col("blocks"))
    dealt = sharded.join(counts, "shard").withColumn("own", own)
    built = dealt.withColumn("block", F.col("own")).repartition("shard", "block").sortWithinPartitions("shard", "block").select("shard", "block", "cls", "vec", "dim").mapInArrow(_build, "cls long, adjacent array<bigint>")
    graph = built.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("adjacent"))).alias("adjacent"))
    graph = stash(graph, "graph")
    # Every two blocks of a split shard are a unit.
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.withColumn("block", F.least("own", "other")).withColumn("block2", F.greatest("own", "other")).join(graph, "cls")
    units = units.repartition("shard", "block", "block2").sortWithinPartitions("shard", "block", "block2")
    return stash(units.select("shard", "block", "block2", "cls", "n", "rank", "near", "vec", "dim", "own", "adjacent").mapInArrow(_search(least), "cls long, found long, u long"), "vector-links")


def _angles(raw: list[bytes], dim: int, model: np.ndarray) -> np.ndarray:
    """The angles between vectors and centroids, in double precision."""
    c = model.astype(np.float64)
    c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-300)
    return np.arccos(np.clip(_units(raw, dim) @ c.T, -1, 1))


def _radii(models: dict[int, np.ndarray]):
    """(shard, n, radius): of each batch, how many classes are nearest to a centroid and the largest angle of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for number, dim in enumerate(sorted(models)):
                own = b.take(pa.array(np.flatnonzero(dims == dim)))
                if own.num_rows:
                    angle = _angles(own.column(3).to_pylist(), dim, models[dim])
                    shard, at = np.unique(angle.argmin(1), return_inverse=True)
                    radius = np.zeros(len(shard))
                    np.maximum.at(radius, at, angle.min(1))
                    yield pa.RecordBatch.from_arrays([pa.array(shard + number * CENTROIDS), pa.array(np.bincount(at)), pa.array(radius)], names=["shard", "n", "radius"])

    return run


def _reaching(models: dict[int, np.ndarray], blocks: dict[int, tuple[int, float]], least: float):
    """(shard, block, side, cls, n, vec, dim): each class in a block of its own shard (side 0), and as a query (side 1) in all blocks of every shard that can have one within range."""
    angle_of = float(np.arccos(least)) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for number, dim in enumerate(sorted(models)):
                rows = np.flatnonzero(dims == dim)
                k = len(models[dim])
                count, radius = (np.array([blocks.get(number * CENTROIDS + i, (0, -9.0))[j] for i in range(k)]) for j in (0, 1))
                for lo in range(0, len(rows), 256):
                    own = b.take(pa.array(rows[lo : lo + 256]))
                    cls, raw = own.column(0).to_numpy(), own.column(3).to_pylist()
                    angle = _angles(raw, dim, models[dim])
                    home = angle.argmin(1)
                    q, shard = np.nonzero(angle <= radius[None] + angle_of)
                    each = count[shard]
                    block = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    q, shard = np.repeat(q, each), np.repeat(shard, each)
                    at = np.concatenate((np.arange(len(cls)), q))
                    side = np.repeat([0, 1], [len(cls), len(q)])
                    shard, block = np.concatenate((home, shard)) + number * CENTROIDS, np.concatenate(((cls % np.maximum(count[home], 1)), block))
                    for k0 in range(0, len(at), 4096):
                        c = slice(k0, k0 + 4096)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard[c]), pa.array(block[c]), pa.array(side[c]), pa.array(cls[at[c]]), pa.array(own.column(2).to_numpy()[at[c]]), pa.array([raw[i] for i in at[c]], pa.binary()), pa.array(np.full(len(at[c]), dim, np.int64))],
                            names=["shard", "block", "side", "cls", "n", "vec", "dim"],
                        )

    return run


def _compare_all(least: float):
    """(cls, found, u): every query against all members of a block; queries come in the order of the stream, members first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held_rows = None, []
        members = None
        for b in batches:
            if not b.num_rows:
                continue
            shard, block, side = (b.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero(np.append(True, (np.diff(shard) != 0) | (np.diff(block) != 0) | (np.diff(side) != 0)))
            for lo, hi in zip(cut, [*cut[1:], b.num_rows], strict=True):
                own = b.slice(int(lo), int(hi - lo))
                if key != (shard[lo], block[lo]):
                    key, held_rows, members = (shard[lo], block[lo]), [], None
                if side[lo] == 0:
                    held_rows.append(own)
                    members = None
                    continue
                if not held_rows:
                    continue
                dim = own.column(6)[0].as_py()
                if members is None:
                    t = pa.Table.from_batches(held_rows)
                    members = t.column("cls").to_numpy(), t.column("n").to_numpy(), _units(t.column("vec").to_pylist(), dim)
                ids, n, x = members
                for k in range(0, own.num_rows, 1024):
                    part = own.slice(k, 1024)
                    cls = part.column(3).to_numpy()
                    hit = (_units(part.column(5).to_pylist(), dim) @ x.T >= least) & (cls[:, None] != ids[None])
                    found = hit @ n
                    q, y = np.nonzero(hit)
                    # Each query with its smallest neighbour, and each member with its smallest query: the links' components.
                    some = np.flatnonzero(found)
                    to = np.full(len(cls), np.iinfo(np.int64).max)
                    np.minimum.at(to, q, ids[y])
                    back = np.full(len(ids), np.iinfo(np.int64).max)
                    np.minimum.at(back, y, cls[q])
                    linked = np.flatnonzero(back < np.iinfo(np.int64).max)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((cls[some], ids[linked]))), pa.array(np.concatenate((found[some], np.zeros(len(linked), np.int64)))), pa.array(np.concatenate((to[some], back[linked])))], names=["cls", "found", "u"])

    return run


def _exact(classes: DataFrame, models: dict[int, np.ndarray], least: float) -> DataFrame:
    """As _links, but with every link: each class is a query in all shards that its angle to the centroid and the shard's radius let in.

    A shard is split into blocks of UNIT classes; a task holds a block, and queries stream past it.
    """
    slim = classes.select("cls", "dim", "n", "vec")
    radii = slim.mapInArrow(_radii(models), "shard long, n long, radius double").groupBy("shard").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    blocks = {r["shard"]: (-(-r["n"] // UNIT), r["radius"] + 1e-6) for r in radii}
    dealt = slim.mapInArrow(_reaching(models, blocks, least), "shard long, block long, side long, cls long, n long, vec binary, dim long")
    dealt = dealt.repartition("shard", "block").sortWithinPartitions("shard", "block", "side")
    return stash(dealt.mapInArrow(_compare_all(least), "cls long, found long, u long"), "vector-links")
