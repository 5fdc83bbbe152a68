"""Approximate nearest neighbours: an inverted file of coarse centroids.

Centroids are fitted on at most SAMPLE vectors, those of the smallest hashes of their ids, which is the only step on the
driver. Every vector is then filed under its nearest centroid, in blocks of at most BLOCK rows; a large list is dealt
over SALTS groups and has many blocks. A search assigns each query its nearest centroids, puts the queries of a list in
blocks too, and joins blocks by list: an equality, in which no vector meets a list that isn't probed. A block of queries
and one of vectors is one multiplication, which sends on the k best of each query. With as many probes as lists the
answer is that of `retrieval.nearest`, which stays the exact way.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.retrieval import _unit
from larkspur.operators.tables import held

SAMPLE, ROUNDS, BLOCK, SALTS, QUERY_BLOCK = 16_384, 10, 1024, 8, 256
#: Lists that a vector is in. Two find more than twice as many probes of single lists, where groups are weak.
FILED = 2


class Index(NamedTuple):
    """Written blocks (list, ids, units: rows of 64-bit floats), and the centroids, one row each."""

    blocks: DataFrame
    centroids: np.ndarray


def fitted(vectors: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of at most `lists` centroids, by rounds of means over a bounded sample of (id, vector)."""
    rows = vectors.where("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    units = _unit(pa.array([list(r.vector) for r in rows], pa.list_(pa.float64())))
    units = units[~np.isnan(units).any(axis=1)]
    # The sample is in the order of a hash, so its first different rows are a random start.
    centroids = units[np.sort(np.unique(units, axis=0, return_index=True)[1])[:lists]]
    for _ in range(rounds if len(centroids) else 0):
        of = (units @ centroids.T).argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, of, units)
        size = np.sqrt((total**2).sum(axis=1))
        centroids = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], centroids)
    return centroids


BLOCKS = "list int, ids array<long>, units binary"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (list, id, unit), sorted by list within tasks, in blocks of one list each."""

    def put(batches):
        for batch in batches:
            lists, ids = batch.column("list").to_numpy(), batch.column("id").to_numpy(zero_copy_only=False)
            width = len(batch.column("unit")[0].as_py()) if batch.num_rows else 0
            data = b"".join(batch.column("unit").to_pylist())
            edges = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
            for a, b in zip(edges, edges[1:], strict=False):
                for i in range(a, b, size):
                    j = min(b, i + size)
                    yield pa.RecordBatch.from_arrays([pa.array([lists[i]], pa.int32()), pa.array([ids[i:j].tolist()], pa.list_(pa.int64())), pa.array([data[i * width : j * width]], pa.binary())], names=["list", "ids", "units"])

    return rows.mapInArrow(put, BLOCKS)


def _filed(vectors: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """list, id, unit: each vector under its nearest centroids; those without direction, or of another length, are left out."""

    def file(batches):
        for batch in batches:
            units = _unit(batch.column("vector"))
            if units.shape[1] != centroids.shape[1]:
                continue
            good = np.flatnonzero(~np.isnan(units).any(axis=1))
            near = np.argsort(-(units[good] @ centroids.T), axis=1, kind="stable")[:, :probes]
            at = np.repeat(good, near.shape[1])
            raw = [units[i].tobytes() for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1).astype(np.int32)), batch.column("id").take(pa.array(at)), pa.array(raw, pa.binary())], names=["list", "id", "unit"])

    return vectors.select(F.col("id").cast("long").alias("id"), "vector").where("vector IS NOT NULL").mapInArrow(file, "list int, id long, unit binary")


def indexed(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, filed: int = FILED) -> Index:
    """An index of every vector (id, vector) that has a direction; lists: the square root of their number by default."""
    lists = lists or max(1, round(vectors.count() ** 0.5))
    centroids = fitted(vectors, lists, sample)
    dealt = _filed(vectors, centroids, filed).repartition("list", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("list", "id")
    return Index(held(_blocks(dealt, BLOCK), "index"), centroids)


def probed(index: Index, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """query, id, similarity, place: the k most similar vectors in the `probes` nearest lists of each query (id, vector),
    ties by id; similarities are rounded to nine digits."""
    dimensions = index.centroids.shape[1]
    asked = _filed(queries, index.centroids, probes).repartition("list", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("list", "id")
    asked = _blocks(asked, QUERY_BLOCK).select("list", F.col("ids").alias("queries"), F.col("units").alias("wanted"))

    def best(batches):
        for batch in batches:
            for row in batch.to_pylist():
                wanted, units = (np.frombuffer(row[c], dtype=np.float64).reshape(-1, dimensions) for c in ("wanted", "units"))
                own = np.array(row["ids"], dtype=np.int64)
                scores = np.round(wanted @ units.T, 9)
                # Ids ascend in a block, so a stable sort breaks ties by id.
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(row["queries"], dtype=np.int64), top.shape[1])), pa.array(own[top].reshape(-1)), pa.array(np.take_along_axis(scores, top, axis=1).reshape(-1))], names=["query", "id", "similarity"])

    found = asked.join(index.blocks, "list").select("queries", "wanted", "ids", "units").mapInArrow(best, "query long, id long, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    found = found.groupBy("query", "id").agg(F.max("similarity").alias("similarity"))  # a vector of two probed lists counts once
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours (query, id) that were found; those as similar as the last one count too."""
    last = exact.groupBy("query").agg(F.min("similarity").alias("least"), F.count("*").alias("n"))
    good = found.join(last, "query").where(F.col("similarity") >= F.col("least")).groupBy("query").agg(F.count("*").alias("found"), F.first("n").alias("n"))
    total = last.agg(F.sum("n")).first()[0] or 0
    return (good.agg(F.sum(F.least("found", "n"))).first()[0] or 0) / total if total else 1.0
