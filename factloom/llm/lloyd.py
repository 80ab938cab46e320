"""Dual-tree Lloyd: exact k-means over whole-number vectors.

Components become floor(scale * x). Rows are cut, where they lie, into blocks of at most ROWS_A_BLOCK; each block's cover tree is made once, written with its vectors and read again in every
round, so rows never move. In a round every task holds the centroids (k is a parameter, not a share of the rows) and a tree over them, and walks each block level by level against both trees: a
pair of nodes whose lower distance bound exceeds the smallest upper bound of the vector node is pruned, a node that is left with one centroid is assigned whole, and vectors of leaves are compared with
the centroids that are left by whole-number distances. Bounds carry slack for the rounding of floats, so ties always reach that comparison, where the smaller number wins.
Tasks give a row of sums a cluster; Spark adds them up by cluster and component, and k rows of sums come to the driver, which divides them exactly.

Vectors take part that have `dims` components, none null or non-finite. Components may have any finite size: those whose floors are LARGE or more are kept in blocks of their own and compared and summed as
Python's whole numbers; a distance (or sum of distances) that no long can hold is null. The first centroids are the vectors with the smallest SHA-256 of "seed:id"; equal hashes (repeated ids) are ordered by
components, and rows without an id come last; with fewer vectors than k there are as many clusters as vectors. Repeated rows count each. Of an empty table, or one without a fitting vector, the
result is empty. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.store import written

ROWS_A_BLOCK, LEAF = 1024, 16
LARGE = 1 << 26  # below, squared distances of up to 128 components fit in a long
LIMB = 60  # binary digits of large sums in one row
SLACK = 1e-9
BLOCK = "ids array<long>, plain binary, digits array<string>, nodes binary, radius binary"
SUMS = "cluster int, limb int, n long, sums array<long>"


def fits(vector: Column, dims: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return (F.size(vector) == dims) & ~bad


def floors(rows: list[list[float]], scale: int) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """The scaled floors of the rows with small components as int64, those of the others as whole numbers, and which rows are small."""
    x = np.array(rows, np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    small = (np.abs(scaled) < LARGE).all(axis=1)
    return scaled[small].astype(np.int64), [[math.floor(v * scale) if abs(v) < 1e290 else int(v) * scale for v in x[i].tolist()] for i in np.flatnonzero(~small)], small


@dataclass
class CoverTree:
    """Vectors in the order of the tree. nodes: first vector (the centre), behind the last, first child, behind the last child; radius: of each node. Children follow their parents."""

    order: np.ndarray
    nodes: np.ndarray
    radius: np.ndarray


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """Centres of children are farther apart than half of the node's scale (a power of two), and each child's vectors are within it; the first child has the parent's centre."""
    points = points.astype(np.float64)
    order = np.arange(len(points))
    away = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    nodes, radius, at = [[0, len(points), 0, 0]], [float(away.max())], 0
    while at < len(nodes):
        lo, hi, _, _ = nodes[at]
        if hi - lo > leaf and radius[at] > 0:
            half = 2.0 ** (math.ceil(math.log2(radius[at])) - 1)
            rest, parts, d = order[lo:hi], [], np.sqrt(((points[order[lo:hi]] - points[order[lo]]) ** 2).sum(axis=1))
            while len(rest):
                near = d <= half
                near[0] = True
                parts.append((rest[near], float(d[near].max())))
                rest = rest[~near]
                if len(rest):
                    d = np.sqrt(((points[rest] - points[rest[0]]) ** 2).sum(axis=1))
            # the farthest vector is beyond half of the scale, so there are two parts at least
            nodes[at][2:] = [len(nodes), len(nodes) + len(parts)]
            order[lo:hi] = np.concatenate([p for p, _ in parts])
            for p, r in parts:
                nodes.append([lo, lo + len(p), 0, 0])
                radius.append(r)
                lo += len(p)
        at += 1
    return CoverTree(order, np.array(nodes, np.int32).reshape(-1, 4), np.array(radius))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from each lo to each hi, one range after the other."""
    n = (hi - lo).astype(np.int64)
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Float distances of all rows of a and b."""
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Centroids:
    """Centroids of a round with a tree of two levels over those that vectors of small components are compared with."""

    def __init__(self, values: list[list[int]]):
        self.values = values
        small = np.array([max(map(abs, v), default=0) < LARGE for v in values], bool)
        # a centroid beyond 2^40 is farther from such a vector than any small one
        near = [max(map(abs, v), default=0) < 1 << 40 for v in values]
        self.exact = not small.any()  # then vectors are compared one by one
        self.use = np.array([i for i in range(len(values)) if near[i]], np.int64)
        self.small = small[self.use] if len(self.use) else np.zeros(0, bool)
        self.whole = np.array([values[i] for i in self.use], np.int64).reshape(len(self.use), len(values[0]) if values else 0)
        self.points = self.whole.astype(np.float64)
        self.groups: list[np.ndarray] = []
        self.group_centre, self.group_radius = np.zeros((0, 0)), np.zeros(0)
        if len(self.use) and not self.exact:
            tree = cover_tree(self.points, max(2, math.isqrt(len(self.use))))
            leaves = [n for n in tree.nodes if n[2] == n[3]]
            self.groups = [tree.order[lo:hi] for lo, hi, _, _ in leaves]
            self.group_centre = self.points[[g[0] for g in self.groups]]
            self.group_radius = np.array([_distances(self.points[g], self.points[g[:1]]).max() for g in self.groups])
        self.group_of = np.zeros(len(self.use), np.int64)
        for i, g in enumerate(self.groups):
            self.group_of[g] = i

    def alone(self, vector: list[int]) -> tuple[int, int]:
        """Nearest centroid and squared distance, all compared as whole numbers."""
        return min((sum((a - b) ** 2 for a, b in zip(vector, c, strict=True)), i) for i, c in enumerate(self.values))[::-1]

    def nearest(self, points: np.ndarray, tree: CoverTree, distances: bool) -> tuple[np.ndarray, np.ndarray | None, int]:
        """Of each vector of a block (in the tree's order) its centroid and, if asked for, squared distance; and how many vectors were compared with centroids, counted by pair."""
        cluster = np.full(len(points), -1, np.int64)
        real = points.astype(np.float64)
        norm = np.sqrt((real**2).sum(axis=1))
        reach = float(norm.max(initial=0)) + float(np.sqrt((self.points**2).sum(axis=1)).max(initial=0)) + 1
        slack = SLACK * reach + 1e-6
        front = np.zeros(1, np.int64)  # nodes of one level
        alive = np.ones((1, len(self.use)), bool)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        while len(front):
            centre, radius = real[tree.nodes[front, 0]], tree.radius[front][:, None]
            # groups of centroids first, then their members
            some = np.zeros((len(front), len(self.groups)), bool)
            for g, members in enumerate(self.groups):
                some[:, g] = alive[:, members].any(axis=1)
            d = _distances(centre, self.group_centre)
            upper = np.where(some, d + radius + self.group_radius, np.inf).min(axis=1, keepdims=True)
            some &= d - radius - self.group_radius <= upper + slack
            alive &= some[:, self.group_of]
            d = _distances(centre, self.points)
            upper = np.where(alive, d + radius, np.inf).min(axis=1, keepdims=True)
            alive &= d - radius <= upper + slack
            left = alive.sum(axis=1)
            lo, hi, child, last = tree.nodes[front].T
            one, leaf = left == 1, child == last
            cluster[_ranges(lo[one], hi[one])] = np.repeat(alive[one].argmax(axis=1), (hi - lo)[one])
            end = ~one & leaf
            row, member = np.nonzero(np.repeat(alive[end], (hi - lo)[end], axis=0))
            pairs.append((_ranges(lo[end], hi[end])[row], member))
            inner = ~one & ~leaf
            front, alive = _ranges(child[inner], last[inner]), np.repeat(alive[inner], (last - child)[inner], axis=0)
        row, member = (np.concatenate(p) for p in zip(*pairs, strict=True))
        if len(row):
            # the pairs of a vector are neighbours
            start = np.flatnonzero(np.diff(row, prepend=-1))
            square = self._squares(points, row, member)
            best = np.repeat(np.minimum.reduceat(square, start), np.diff(start, append=len(row)))
            hit = np.flatnonzero(square == best)[::-1]  # members ascend within a vector, so the smallest is written last
            cluster[row[hit]] = member[hit]
        return self.use[cluster], self._squares(points, np.arange(len(points)), cluster) if distances else None, len(row)

    def _squares(self, points: np.ndarray, row: np.ndarray, member: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        out = np.empty(len(row), np.int64)
        for at in range(0, len(row), step):
            r, m = row[at : at + step], member[at : at + step]
            here = self.small[m]
            diff = points[r[here]] - self.whole[m[here]]
            part = np.empty(len(r), np.int64)
            part[here] = (diff * diff).sum(axis=1)
            for i in np.flatnonzero(~here).tolist():
                far = sum((int(a) - int(b)) ** 2 for a, b in zip(points[r[i]], self.whole[m[i]], strict=True))
                part[i] = min(far, np.iinfo(np.int64).max - 1)  # a small centroid is nearer than that
            out[at : at + step] = part
        return out


def _blocks(vectors: DataFrame, scale: int, dims: int) -> DataFrame:
    """vectors (vec_id, v) as blocks: ids and whole-number vectors in the order of the block's cover tree, or the digits of large ones."""
    names, kinds = [c.split()[0] for c in BLOCK.split(", ")], [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            points = np.stack(held)
            tree = cover_tree(points)
            row = ([ids[i] for i in tree.order], points[tree.order].astype("<i4").tobytes(), None, tree.nodes.astype("<i4").tobytes(), tree.radius.astype("<f8").tobytes())
            ids.clear(), held.clear()
            return made([row])

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            keys = batch.column(0).to_pylist()
            plain, large, small = floors(flat.tolist(), scale) if batch.num_rows else (np.zeros((0, dims), np.int64), [], np.zeros(0, bool))
            here = np.flatnonzero(small).tolist()
            for at, vector in zip(here, plain, strict=True):
                ids.append(keys[at])
                held.append(vector)
                if len(ids) == ROWS_A_BLOCK:
                    yield block()
            for at, vector in zip(np.flatnonzero(~small).tolist(), large, strict=True):
                yield made([([keys[at]], None, [str(x) for x in vector], None, None)])
        if ids:
            yield block()

    return vectors.mapInArrow(cut, BLOCK)


def _of_block(row: dict, dims: int) -> tuple[np.ndarray, CoverTree]:
    points = np.frombuffer(row["plain"], "<i4").reshape(-1, dims).astype(np.int64)
    return points, CoverTree(np.arange(len(points)), np.frombuffer(row["nodes"], "<i4").reshape(-1, 4), np.frombuffer(row["radius"], "<f8"))


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], dims: int, distances: bool) -> Iterator[tuple[list, np.ndarray | list, np.ndarray | list, np.ndarray | list]]:
    """ids, vectors, clusters and squared distances of each block."""
    made = Centroids(centroids)
    for batch in batches:
        for row in batch.to_pylist():
            if row["plain"] is None:
                vector = [int(x) for x in row["digits"]]
                cluster, square = made.alone(vector)
                yield row["ids"], [vector], [cluster], [square]
                continue
            points, tree = _of_block(row, dims)
            if made.exact:
                both = [made.alone(p) for p in points.tolist()]
                yield row["ids"], points, np.array([c for c, _ in both]), [s for _, s in both]
            else:
                cluster, square, _ = made.nearest(points, tree, distances)
                yield row["ids"], points, cluster, square if distances else []


def _sums(blocks: DataFrame, centroids: list[list[int]], dims: int) -> dict[int, tuple[int, list[int]]]:
    """Rows and sums of each non-empty cluster: k rows of dims whole numbers, whatever the size of the table."""
    k = len(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        large: dict[int, list[int]] = {}
        for _, points, cluster, _ in _assigned(batches, centroids, dims, False):
            if isinstance(points, list):
                count[cluster[0]] += 1
                large[cluster[0]] = [a + b for a, b in zip(large.get(cluster[0], [0] * dims), points[0], strict=True)]
            else:
                order = np.argsort(cluster, kind="stable")
                here, first = np.unique(cluster[order], return_index=True)
                total[here] += np.add.reduceat(points[order], first, axis=0)
                count += np.bincount(cluster, minlength=k)
        rows = [(c, 0, int(count[c]), total[c].tolist()) for c in np.flatnonzero(count).tolist()]
        for c, sums in large.items():
            signs, rest, limb = [-1 if x < 0 else 1 for x in sums], [abs(x) for x in sums], 0
            while any(rest):
                rows.append((c, limb, 0, [sign * (x & (1 << LIMB) - 1) for sign, x in zip(signs, rest, strict=True)]))
                rest, limb = [x >> LIMB for x in rest], limb + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["cluster", "limb", "n", "sums"])

    parts = blocks.mapInArrow(partial, SUMS).select("cluster", "limb", "n", F.posexplode("sums").alias("at", "x"))
    added = parts.groupBy("cluster", "limb", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in added:
        n, sums = out.get(r.cluster, (0, [0] * dims))
        sums[r.at] += int(r.x) << LIMB * r.limb
        out[r.cluster] = (max(n, r.n), sums)
    return out


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance (squared), cluster_inertia and inertia (distances summed over the cluster and over all), centroid_sha256 (of the centroid's components in decimal, joined by commas)."""
    spark = vectors.sparkSession
    rows = vectors.where(fits(F.col(vector_col), dims)).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    key = F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = [[math.floor(x * scale) if abs(x) < 1e290 else int(x) * scale for x in r.v] for r in first]
    blocks = written(_blocks(rows, scale, dims), "lloyd-blocks")
    for _ in range(rounds if centroids else 0):
        sums = _sums(blocks, centroids, dims)
        centroids = [[x // sums[c][0] for x in sums[c][1]] if c in sums else old for c, old in enumerate(centroids)]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, square in _assigned(batches, centroids, dims, True):
            kept = [int(s) if s < 1 << 63 else None for s in square]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(kept, pa.int64())], ["vec_id", "cluster", "distance"])

    out = written(blocks.mapInArrow(last, "vec_id long, cluster int, distance long"), "lloyd-clusters")
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    found = {r.cluster: r.inertia for r in out.groupBy("cluster").agg(whole.alias("inertia")).collect()}
    held = lambda x: int(x) if x is not None and x < 1 << 63 else None
    total = None if any(x is None for x in found.values()) else sum(found.values())
    lines = [(c, held(x), held(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, x in sorted(found.items())]
    summary = spark.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(summary), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
