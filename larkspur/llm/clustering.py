"""Centroid clustering (Lloyd's rounds) of integer vectors, filtered by partition-local ball trees.

Vectors are packed once into blocks of bounded size, each with a metric tree over it, and written as a table: a node has
an integer centre, a radius, a count and the integer sum of its vectors. In a round the centroids, of which there are
few, go out with the tasks. A block's tree is walked level by level. The triangle inequality drops a centroid for a node
if it is farther from the centre than another by more than twice the radius; a node with one centroid left gives its
count and sum to that centroid as a whole, a leaf with more compares its vectors exactly, other nodes pass the centroids
that are left to their children. Distances are computed in integers (as exact floats or as 64-bit integers), radii are
rounded up, and a centroid is dropped only beyond a margin, so ties and results are exact: the floor of sum over count,
the smaller number at equal distances.

Tasks send at most one row for each centroid; they are summed in two levels, so no task gathers a row of every task.
Only centroids come to the driver. Equal vectors make nodes of radius 0, which never descend, however many there are.

Defined cases: rows whose vector is null, has another number of components, or a component that is null, NaN or infinite
are left out; a null id counts as the word "null" where ids are hashed; repeated rows and ids are vectors of their own,
and of those with equal hashes the smaller vector starts first; fewer vectors than centroids give fewer centroids, an
empty table an empty result; a component whose multiple is beyond 2**27 is an arithmetic overflow, which is an error as
in Spark's ANSI mode, since distances are longs; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import release, written

SCALE, DIMENSIONS, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, 2
#: Vectors of a block, and of a leaf at most (if they differ).
BLOCK, LEAF = 8192, 32
LARGEST = 1 << 27
#: Slots over which the rows of tasks are summed first.
SLOTS = 64


def kept(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """key, v: whole vectors times scale, rounded down."""
    doubles = F.transform(vectors[vector], lambda x: x.cast("double"))
    rows = vectors.select(vectors[key].alias("key"), doubles.alias("v")).where(
        (F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    whole = lambda x: F.when(F.abs(x * scale) <= LARGEST, F.floor(x * scale)).otherwise(F.raise_error("a component is beyond 2**27"))
    return rows.select("key", F.transform("v", lambda x: whole(x).cast("long")).alias("v"))


def first_centroids(rows: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors of the smallest hashes of seed and key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("null")))
    found = rows.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(count).collect()
    return np.array([r.v for r in found], dtype=np.int64)


class Tree:
    """A metric tree over vectors (float64 with whole values), which it puts in the order of its leaves."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        spans, children, at = [(0, len(vectors))], [], 0
        centres, radii = [], []
        while at < len(spans):
            low, high = spans[at]
            own = vectors[self.order[low:high]]
            centre = np.rint(own.mean(axis=0))
            apart = ((own - centre) ** 2).sum(axis=1)
            if not apart.max() or not (own - own[0]).any():
                centre, apart = own[0], apart * 0
            centres.append(centre)
            radii.append(np.nextafter(np.sqrt(apart.max()), np.inf) if apart.max() else 0.0)
            if high - low <= LEAF or not radii[-1]:
                children.append(-1)
            else:  # halves along the line between two far points; equal vectors stay together
                one = own[apart.argmax()]
                along = own @ (own[((own - one) ** 2).sum(axis=1).argmax()] - one)
                left = along < (cut := np.partition(along, len(along) // 2)[len(along) // 2])
                left = left if left.any() else along <= cut
                middle = int(left.sum())
                self.order[low:high] = np.concatenate((self.order[low:high][left], self.order[low:high][~left]))
                children.append(len(spans))
                spans += [(low, low + middle), (low + middle, high)]
            at += 1
        self.spans, self.children = np.array(spans, dtype=np.int64), np.array(children, dtype=np.int64)
        self.centres, self.radii = np.array(centres), np.array(radii)
        total = np.concatenate((np.zeros((1, vectors.shape[1])), np.cumsum(vectors[self.order], axis=0)))
        self.sums = total[self.spans[:, 1]] - total[self.spans[:, 0]]


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every point to every centroid; exact where `exact` says so, else rounded."""
    if not exact(points, centroids):
        return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    return (points**2).sum(axis=1)[:, None] - 2 * (points @ centroids.T) + (centroids**2).sum(axis=1)


def exact(points: np.ndarray, centroids: np.ndarray) -> bool:
    """Are all terms of all squared distances whole numbers below 2**53?"""
    most = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    return 4 * points.shape[1] * most * most < 2.0**53


def nearest(points: np.ndarray, centroids: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """The nearest centroid of each point, the smaller number of two; where given, among those allowed."""
    if exact(points, centroids):
        apart = distances(points, centroids)
    else:
        whole, to = points.astype(np.int64), centroids.astype(np.int64)
        apart = np.stack([((whole - c) ** 2).sum(axis=1) for c in to], axis=1)
    if allowed is not None:
        apart = np.where(allowed, apart, np.iinfo(np.int64).max if apart.dtype == np.int64 else np.inf)
    return apart.argmin(axis=1)


def walk(tree: Tree, vectors: np.ndarray, centroids: np.ndarray):
    """Nodes that go as a whole with the centroid of each, and places in the tree's order with the centroid of each."""
    nodes, left = np.zeros(1, dtype=np.int64), np.ones((1, len(centroids)), dtype=bool)
    whole, singles = [], []
    while len(nodes):
        centres, radii = tree.centres[nodes], tree.radii[nodes]
        # A margin well above what rounding does to squares and roots.
        apart = np.sqrt(np.maximum(distances(centres, centroids), 0)) + np.where(left, 0, np.inf)
        margin = 1e-6 * (1 + apart.min(axis=1) + radii)
        near = left & (apart - radii[:, None] <= (apart.min(axis=1) + radii + margin)[:, None])
        point = radii == 0
        if point.any():
            best = nearest(centres[point], centroids, left[point])
            near[point] = np.arange(len(centroids)) == best[:, None]
        done = near.sum(axis=1) == 1
        whole.append((nodes[done], near[done].argmax(axis=1)))
        leaf = ~done & (tree.children[nodes] < 0)
        if leaf.any():
            spans = tree.spans[nodes[leaf]]
            size = spans[:, 1] - spans[:, 0]
            places = np.repeat(spans[:, 0] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            singles.append((places, nearest(vectors[tree.order[places]], centroids, np.repeat(near[leaf], size, axis=0))))
        down = ~done & ~leaf
        first = tree.children[nodes[down]]
        nodes, left = np.concatenate((first, first + 1)), np.concatenate((near[down], near[down]))
    empty = (np.zeros(0, dtype=np.int64),) * 2
    return tuple(tuple(np.concatenate(x) for x in zip(empty, *parts, strict=True)) for parts in (whole, singles))


def assigned(tree: Tree, vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid of every vector."""
    (nodes, of_node), (places, of_place) = walk(tree, vectors, centroids)
    out = np.empty(len(vectors), dtype=np.int64)
    for node, c in zip(nodes.tolist(), of_node.tolist(), strict=True):
        low, high = tree.spans[node]
        out[tree.order[low:high]] = c
    out[tree.order[places]] = of_place
    return out


def gathered(tree: Tree, vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the vectors of each centroid."""
    (nodes, of_node), (places, of_place) = walk(tree, vectors, centroids)
    count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
    np.add.at(count, of_node, tree.spans[nodes, 1] - tree.spans[nodes, 0])
    np.add.at(total, of_node, tree.sums[nodes].astype(np.int64))
    np.add.at(count, of_place, 1)
    np.add.at(total, of_place, vectors[tree.order[places]].astype(np.int64))
    return count, total


PARTS = ("order", "spans", "children", "centres", "radii", "sums")


def packed(tree: Tree) -> list[bytes]:
    return [getattr(tree, p).tobytes() for p in PARTS]


def unpacked(row: dict, dimensions: int) -> tuple[Tree, np.ndarray]:
    tree = Tree.__new__(Tree)
    shapes = {"spans": (-1, 2), "centres": (-1, dimensions), "sums": (-1, dimensions)}
    for p in PARTS:
        kind = np.float64 if p in ("centres", "radii", "sums") else np.int64
        setattr(tree, p, np.frombuffer(row[p], dtype=kind).reshape(shapes.get(p, -1)))
    return tree, np.frombuffer(row["vectors"], dtype=np.int32).reshape(-1, dimensions).astype(np.float64)


def forest(rows: DataFrame, dimensions: int = DIMENSIONS, block: int = BLOCK) -> DataFrame:
    """A written table with a row for each block of vectors: its keys, its vectors and its tree."""

    def plant(batches):
        schema = pa.schema([("keys", pa.list_(pa.int64())), ("vectors", pa.binary()), *((p, pa.binary()) for p in PARTS)])
        held, size = [], 0

        def planted():
            table = pa.Table.from_batches(held)
            vectors = np.concatenate([c.flatten().to_numpy() for c in table["v"].chunks]).reshape(-1, dimensions)
            trees = packed(Tree(vectors.astype(np.float64)))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[table["key"].to_pylist()], [vectors.astype(np.int32).tobytes()], *([t] for t in trees)], schema, strict=True)], schema=schema)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, block - size))
                at += held[-1].num_rows
                size += held[-1].num_rows
                if size == block:
                    yield planted()
                    held, size = [], 0
        if size:
            yield planted()
        release()

    whole = rows.select(F.col("key").cast("long").alias("key"), "v")
    return written(whole.mapInArrow(plant, "keys array<long>, vectors binary, " + ", ".join(f"{p} binary" for p in PARTS)), "forest")


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    dimensions, floats = centroids.shape[1], centroids.astype(np.float64)

    def gather(batches):
        count, total = np.zeros(len(floats), dtype=np.int64), np.zeros(floats.shape, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                own = gathered(*unpacked(row, dimensions), floats)
                count, total = count + own[0], total + own[1]
        full = np.flatnonzero(count)
        slot = TaskContext.get().partitionId() % SLOTS
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(full), slot)), pa.array(full), pa.array(count[full]), *(pa.array(total[full, d]) for d in range(dimensions))],
            names=["slot", "cluster", "n", *(f"s{d}" for d in range(dimensions))],
        )

    sums = [F.sum(c).alias(c) for c in ("n", *(f"s{d}" for d in range(dimensions)))]
    rows = trees.mapInArrow(gather, "slot long, cluster long, n long, " + ", ".join(f"s{d} long" for d in range(dimensions)))
    out = centroids.copy()
    for r in rows.groupBy("slot", "cluster").agg(*sums).groupBy("cluster").agg(*sums).collect():  # a row for each centroid
        out[r.cluster] = [r[f"s{d}"] // r.n for d in range(dimensions)]
    return out


def clustered(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, centroids: int = CENTROIDS,
    rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """key, cluster and distance (squared) of every vector that is kept, as a written table, and the final centroids."""
    rows = kept(vectors, key, vector, dimensions, scale)
    centres = first_centroids(rows, centroids, seed)
    if not len(centres):
        return rows.sparkSession.createDataFrame([], "key long, cluster int, distance long"), np.zeros((0, dimensions), dtype=np.int64)
    trees = forest(rows, dimensions)
    for _ in range(rounds):
        centres = moved(trees, centres)
    whole = centres.astype(np.float64)

    def assign(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tree, own = unpacked(row, dimensions)
                of = assigned(tree, own, whole)
                apart = ((own.astype(np.int64) - centres[of]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array(of.astype(np.int32)), pa.array(apart)], names=["key", "cluster", "distance"])
        release()

    return written(trees.mapInArrow(assign, "key long, cluster int, distance long"), "clusters"), centres


def digests(vectors: DataFrame, **options) -> DataFrame:
    """Per vector: its cluster and distance, the inertia of the cluster and of all, and a digest of its centroid."""
    rows, centres = clustered(vectors.select("vec_id", "embedding"), **options)
    inertia = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # a row for each centroid
    told = [(c, inertia.get(c), sum(inertia.values()), ",".join(map(str, v))) for c, v in enumerate(centres.tolist())]
    of_cluster = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid string")
    return rows.join(F.broadcast(of_cluster), "cluster").select(
        F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256")
    )
