"""Centroid clustering (Lloyd rounds on integer vectors) by the filtering algorithm over kd-trees (Kanungo et al., 2002).

Vectors are cut into blocks, each with a kd-tree of its own whose nodes hold a box, a count and the integer sum of their vectors. The
trees are written once. In each round a node keeps those centroids of its parent that may own a point of its box: one is pruned
when another is strictly nearer to every point of the box. A node with one centroid left is assigned as a whole, by its count and sum;
leaves with more are resolved by exact distances. Tasks send a count and a sum for each centroid, nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, table

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Vectors of a block's tree, and of a leaf.
BLOCK, LEAF = 8192, 32
#: Components beyond this have squared distances that 64 bits don't hold.
LARGEST = 1 << 27
#: Products of components up to this are exact in double precision, summed over ``DIMENSIONS`` of them.
EXACT_FLOAT = 1 << 22


class Tree:
    """A kd-tree in arrays: ``points`` in tree order, nodes from the root down; the children of node i are ``left[i]`` and the next one."""

    FIELDS = ("low", "high", "sums", "start", "end", "left")

    def __init__(self, points: np.ndarray, nodes: dict[str, np.ndarray]) -> None:
        self.points = points
        self.low, self.high, self.sums, self.start, self.end, self.left = (nodes[f] for f in self.FIELDS)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree of ``points`` (n x d integers) and the order in which it holds them. Nodes are halved along their longest side."""
        order = np.arange(len(points))
        spans, left, boxes = [(0, len(points))], [], []
        for lo, hi in spans:  # grows while it is read
            own = points[order[lo:hi]]
            low, high = own.min(0), own.max(0)
            boxes.append((low, high, own.sum(0)))
            side = high - low
            if hi - lo <= leaf or not side.any():
                left.append(-1)
                continue
            middle = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, int(side.argmax())], middle)]
            left.append(len(spans))
            spans += [(lo, lo + middle), (lo + middle, hi)]
        low, high, sums = (np.array(x) for x in zip(*boxes, strict=True))
        start, end = np.array(spans).T
        return cls(points[order], dict(zip(cls.FIELDS, (low, high, sums, start, end, np.array(left)), strict=True))), order

    def filtered(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]]]:
        """(node, centroid) of nodes that one centroid owns as a whole, and (leaf, its centroids) of the leaves that several may share."""
        whole: list[tuple[int, int]] = []
        open_: list[tuple[int, np.ndarray]] = []
        nodes, may = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            away = ((2 * centroids - (low + high)[:, None]) ** 2).sum(2)
            best = np.where(may, away, np.iinfo(np.int64).max).argmin(1)
            near = centroids[best][:, None]
            # The point of the box that favours a centroid most against the nearest: the corner on its side.
            corner = np.where(centroids > near, high[:, None], low[:, None])
            may &= ((centroids - near) * (centroids + near - 2 * corner)).sum(2) <= 0
            alone, leaf = may.sum(1) == 1, self.left[nodes] < 0
            whole += zip(nodes[alone].tolist(), best[alone].tolist(), strict=True)
            open_ += [(n, may[i]) for i, n in zip(np.flatnonzero(leaf & ~alone), nodes[leaf & ~alone].tolist(), strict=True)]
            down = ~alone & ~leaf
            children = self.left[nodes[down]]
            nodes, may = np.concatenate([children, children + 1]), np.concatenate([may[down]] * 2)
        return whole, open_

    def resolved(self, leaves: list[tuple[int, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(points, their nearest centroids) of leaves, by exact distances; ties go to the smaller number."""
        if not leaves:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.concatenate([np.arange(self.start[n], self.end[n]) for n, _ in leaves])
        may = np.repeat(np.array([m for _, m in leaves]), [self.end[n] - self.start[n] for n, _ in leaves], axis=0)
        away = distances(self.points[rows], centroids)
        return rows, np.where(may, away, np.iinfo(np.int64).max).argmin(1)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the vectors that each centroid owns."""
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        whole, leaves = self.filtered(centroids)
        for n, c in whole:
            count[c] += self.end[n] - self.start[n]
            total[c] += self.sums[n]
        rows, owner = self.resolved(leaves, centroids)
        count += np.bincount(owner, minlength=len(centroids))
        for c in np.unique(owner):
            total[c] += self.points[rows[owner == c]].sum(0)
        return count, total

    def owners(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each point, in tree order, and its squared distance."""
        owner = np.zeros(len(self.points), np.int64)
        whole, leaves = self.filtered(centroids)
        for n, c in whole:
            owner[self.start[n] : self.end[n]] = c
        rows, own = self.resolved(leaves, centroids)
        owner[rows] = own
        return owner, ((self.points - centroids[owner]) ** 2).sum(1)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (points x centroids) of integer vectors, exactly."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT_FLOAT:
        product = (points.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    else:
        product = points @ centroids.T
    return (points**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * product


_TREES = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), *((f, pa.binary()) for f in Tree.FIELDS)])
_TREES_DDL = "ids array<long>, points binary, " + ", ".join(f"{f} binary" for f in Tree.FIELDS)


def _tree_batches(dimensions: int, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, v) in, a row for each block's tree out. Numbers are kept in 32 bits, sums in 64."""

    def tree(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(part).combine_chunks()
        points = rows.column(1).combine_chunks().flatten().to_numpy().reshape(-1, dimensions)
        if len(points) and np.abs(points).max() >= LARGEST:
            raise ValueError(f"a component of {LARGEST} or more after scaling: squared distances don't fit 64 bits")
        built, order = Tree.build(points)
        ids = rows.column(0).take(pa.array(order)).to_pylist()
        small = [getattr(built, f).astype(np.int64 if f == "sums" else np.int32).tobytes() for f in Tree.FIELDS]
        return table(_TREES, [[ids], [built.points.astype(np.int32).tobytes()], *([x] for x in small)])

    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, block - n)
            held, n, b = [*held, part], n + part.num_rows, b.slice(part.num_rows)
            if n == block:
                yield tree(held)
                held, n = [], 0
    if n:
        yield tree(held)


def _trees(dimensions: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Tree]]:
    for b in batches:
        for i in range(b.num_rows):
            ids, points, *nodes = (b.column(j)[i] for j in range(b.num_columns))
            arrays = [np.frombuffer(x.as_py(), np.int64 if f == "sums" else np.int32).astype(np.int64) for f, x in zip(Tree.FIELDS, nodes, strict=True)]
            shaped = {f: x.reshape(-1, dimensions) if f in ("low", "high", "sums") else x for f, x in zip(Tree.FIELDS, arrays, strict=True)}
            yield ids, Tree(np.frombuffer(points.as_py(), np.int32).astype(np.int64).reshape(-1, dimensions), shaped)


_TOTALS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _total_batches(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for _, tree in _trees(centroids.shape[1], batches):
        n, sums = tree.totals(centroids)
        count, total = count + n, total + sums
    yield table(_TOTALS, [np.arange(len(centroids)), count, total.tolist()])


_OWNERS = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def _owner_batches(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, tree in _trees(centroids.shape[1], batches):
        yield table(_OWNERS, [ids.values, *tree.owners(centroids)])


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of exactly ``dimensions`` components, none null or non-finite, as integers floor(``scale`` * x)."""
    x = F.col("embedding").cast("array<double>")
    good = x.isNotNull() & (F.size(x) == dimensions) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def starts(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the ``clusters`` smallest SHA-256 of ``seed:vec_id``; equal ids by their components, null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return np.array([r["v"] for r in first], np.int64)


def moved(centroids: np.ndarray, totals: DataFrame) -> np.ndarray:
    """Centroids at the floored mean of their vectors; those without any stay. The driver sees one row for each centroid."""
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in totals.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).where("n > 0").collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``vectors`` has columns vec_id and embedding; other columns are ignored. Null vectors, those of another length and those with a null,
    NaN or infinite component don't come back. Every kept row counts, with a repeated or null vec_id too; a null id is never a start
    before others. Ties go to the smaller cluster number, whole boxes included. Fewer vectors than clusters make as many clusters as there are
    vectors, an empty table none. Components of 2**27 or more after scaling are an error, for their distances don't fit a long.
    """
    small_batches(vectors.sparkSession)
    rows = kept(vectors, dimensions, scale)
    centroids = starts(rows, clusters, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = materialise(rows.mapInArrow(partial(_tree_batches, dimensions, block), _TREES_DDL), "trees")
    for _ in range(rounds):
        centroids = moved(centroids, trees.mapInArrow(partial(_total_batches, centroids), "cluster int, n long, sums array<long>"))
    owned = materialise(trees.mapInArrow(partial(_owner_batches, centroids), "vec_id long, cluster int, distance long"), "owners")
    inertia = dict(owned.groupBy("cluster").agg(F.sum("distance")).collect())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return owned.select("vec_id", "cluster", "distance", own([inertia.get(i, 0) for i in range(len(centroids))]).cast("long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), own(digests).alias("centroid_sha256"))
