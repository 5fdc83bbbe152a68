"""Vector and text search, fused; and memories that replace their near duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = "[^a-z0-9à-öø-ÿ]+"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def query_blocks(queries: DataFrame, size: int = 512) -> Iterator[list]:
    """The rows of a query set in blocks of bounded size, read one partition at a time."""
    block: list = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _unit(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1; null vectors and zero vectors have no direction (not a number)."""
    lists = vectors.to_pylist()
    width = max((len(v) for v in lists if v), default=1)
    rows = np.array([v if v and len(v) == width else [np.nan] * width for v in lists], dtype=np.float64).reshape(len(lists), width)
    with np.errstate(all="ignore"):
        return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, floor: float | None = None, block: int = 512) -> DataFrame:
    """query, id, similarity, place: the k most similar vectors (id, vector) of each query (id, vector), ties by id; then
    those above the floor. Similarities are rounded to nine digits; vectors without direction are never found.

    Queries are broadcast in blocks of `block`; for each block every batch of vectors keeps its k best of each query, so
    what is shuffled and sorted is k rows for a batch and query.
    """
    spark, out = vectors.sparkSession, None
    for rows in query_blocks(queries.select("id", "vector").where("vector IS NOT NULL"), block):
        ids = spark.sparkContext.broadcast(([r[0] for r in rows], _unit(pa.array([list(r[1]) for r in rows]))))

        def best(batches, ids=ids):
            names, wanted = ids.value
            for batch in batches:
                own, found = batch.column("id").to_numpy(zero_copy_only=False), _unit(batch.column("vector"))
                if found.shape[1] != wanted.shape[1]:
                    continue
                for name, scores in zip(names, np.round(wanted @ found.T, 9), strict=True):
                    order = np.lexsort((own, -scores))[:k]
                    order = order[~np.isnan(scores[order])]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(order), pa.int64()), pa.array(own[order], pa.int64()), pa.array(scores[order])], names=["query", "id", "similarity"])

        found = vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(best, "query long, id long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query long, id long, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    placed = out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return placed if floor is None else placed.where(F.col("similarity") >= floor)


def postings(docs: DataFrame) -> DataFrame:
    """id, term, n: how often each term occurs in a document; the table that text search reads."""
    terms = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), TOKEN), lambda t: t != "")
    return docs.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


def term_stats(docs: DataFrame) -> DataFrame:
    """term, docs, n: in how many documents each term occurs and how often. Documents are counted inside their rows, so
    only terms are shuffled, after a sum on the map side."""
    terms = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), TOKEN), lambda t: t != "")
    rows = docs.select(terms.alias("t")).select(F.explode(F.concat(
        F.transform("t", lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("n"))),
        F.transform(F.array_distinct("t"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("n"))),
    )).alias("x"))
    return rows.groupBy("x.term").agg(F.sum("x.d").alias("docs"), F.sum("x.n").alias("n"))


def text_search(docs: DataFrame, all_of: list[str], none_of: list[str] | None = None, any_of: list[str] | None = None, k: int = 10) -> DataFrame:
    """The k documents with all of all_of, none of none_of and one of any_of, by occurrences of wanted terms, ties by id.

    Every document is judged in its row; each task hands on its k best.
    """
    none_of, any_of = none_of or [], any_of or []
    terms = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), TOKEN), lambda t: t.isin(*all_of, *none_of, *any_of))
    found = docs.select("id", terms.alias("t"))
    fits = F.lit(True)
    for t in all_of:
        fits = fits & F.array_contains("t", t)
    if none_of:
        fits = fits & ~F.arrays_overlap("t", F.array(*[F.lit(t) for t in none_of]))
    if any_of:
        fits = fits & F.arrays_overlap("t", F.array(*[F.lit(t) for t in any_of]))
    return found.where(fits).select("id", F.size("t").cast("long").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fused(lists: DataFrame, k: int = 60, by: list[str] | None = None) -> DataFrame:
    """id, score: reciprocal-rank fusion of (list, place, id), the sum of 1 / (k + place); ties by the first list, then
    place. by: columns that are fused apart, such as a query's."""
    by = by or []
    score = F.round(F.sum(1.0 / (k + F.col("place"))), 6)
    return lists.groupBy(*by, "id").agg(score.alias("score"), F.min(F.struct("list", "place")).alias("first")).orderBy(*by, F.desc("score"), "first").select(*by, "id", "score")


def live(memories: DataFrame, now: Column) -> DataFrame:
    """Memories that nothing replaced, that aren't deprecated and haven't expired."""
    return memories.where(F.col("superseded_by").isNull() & ~F.col("status").eqNullSafe("deprecated") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def superseded(memories: DataFrame, new: DataFrame, keys: list[str], least: float = 0.92) -> DataFrame:
    """What each new memory does: duplicate of an equal live one, replacing the most similar one, or created.

    memories and new have id, content, vector and keys, which are equal with nulls being equal; a row isn't its own
    match. New rows are broadcast in blocks, and every batch of memories tells the best for each of them, so memories of
    one key never meet. One new memory per key and batch: a batch with more is split by the caller, as later ones must
    see the earlier ones.
    """
    told = lambda df: df.select(F.col("id").cast("long").alias("id"), "content", "vector", F.to_json(F.struct(*keys)).alias("key"))
    spark, out = memories.sparkSession, new.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("struct<similarity:double,neg:bigint,other:bigint,same:boolean>").alias("m"))
    for rows in query_blocks(told(new)):
        shared = spark.sparkContext.broadcast(([tuple(r)[:2] + (r.key,) for r in rows], _unit(pa.array([None if r.vector is None else list(r.vector) for r in rows], pa.list_(pa.float64())))))

        def best(batches, shared=shared):
            wanted, units = shared.value
            for batch in batches:
                own, found = batch.column("id").to_numpy(zero_copy_only=False), _unit(batch.column("vector"))
                contents, of_key = batch.column("content").to_pylist(), {}
                for i, key in enumerate(batch.column("key").to_pylist()):
                    of_key.setdefault(key, []).append(i)
                picked = []
                for (id_, content, key), unit in zip(wanted, units, strict=True):
                    at = np.array(of_key.get(key, []), dtype=np.int64)
                    at = at[own[at] != id_]
                    scores = np.round(found[at] @ unit, 9) if len(at) and found.shape[1] == len(unit) else np.zeros(0)
                    at, scores = at[: len(scores)][~np.isnan(scores)], scores[~np.isnan(scores)]
                    if len(at):
                        j = np.lexsort((own[at], -scores))[0]
                        picked.append((id_, {"similarity": float(scores[j]), "neg": -int(own[at[j]]), "other": int(own[at[j]]), "same": contents[at[j]] == content}))
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in picked], pa.int64()), pa.array([p[1] for p in picked], kind)], names=["id", "m"])

        kind = pa.struct([("similarity", pa.float64()), ("neg", pa.int64()), ("other", pa.int64()), ("same", pa.bool_())])
        out = out.unionByName(told(memories).mapInArrow(best, "id long, m struct<similarity:double,neg:bigint,other:bigint,same:boolean>"))
    found = out.groupBy("id").agg(F.max("m").alias("best"))
    close = F.coalesce(F.col("best.similarity") >= least, F.lit(False))
    action = F.when(close & F.col("best.same"), "duplicate").when(close, "superseded").otherwise("created")
    return found.select("id", action.alias("action"), F.when(close, F.col("best.other")).alias("other"))
