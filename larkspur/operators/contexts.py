"""Contexts of tasks: standing and similar memories, then documents, under a budget of tokens, for a table of requests.

Standing memories don't depend on a request's words, so the best of each tenant, kind and place are taken first and then
joined to the requests. Similar ones are found by blocks of requests that are broadcast, a bounded number at a time; each
task keeps the best for each request among those of its tenant (and domain, or project), so no request meets all memories
of a hot tenant in one place. A request's items are then a bounded list, whose fold is one row's work.

memories: id, tenant, scope, domain, project, kind, content, importance, created_at, vector, and what `retrieval.live`
reads. requests: request, tenants (array), domain, project, task, project_text, vector, budget. hits: request, id,
content, snippet, score. Null domains and projects ask for none; a null vector gives importance alone; repeated rows of
memories count once by their id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.knowledge import rank
from larkspur.operators.retrieval import _unit, query_blocks

# Which memories stand in every context, which bind, which tell of decisions, and how many are looked at.
CONSTRAINTS, DECISIONS = ("rule", "constraint"), ("decision", "architecture")
STANDING = ("preference", "working_style", "communication", "rule", "constraint")
STANDING_EACH, WITHOUT_VECTOR, SIMILAR, SIMILAR_DOMAIN, SIMILAR_PROJECT, LEAST_SIMILARITY, DOCUMENTS = 10, 30, 20, 10, 15, 0.35, 8
OVERHEAD = 4
#: Requests that meet a batch of memories at a time.
STRIP = 256


def _best(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("importance"), F.desc("created_at"), "id")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def _asked(requests: DataFrame) -> DataFrame:
    return requests.select("request", F.explode(F.array_distinct("tenants")).alias("tenant"), "domain", "project", F.col("vector").isNull().alias("blind"))


def listed(memories: DataFrame, requests: DataFrame, keys: list[str], by: list[str], most: int) -> DataFrame:
    """request and id of the most important memories that agree with a request in keys (tenant among them), `most` for
    each of `by`."""
    best = _best(memories, [*keys, *by], most).select("id", "importance", "created_at", *keys, *by)
    return _best(requests.join(best, keys), ["request", *by], most).select("request", "id", F.lit(None).cast("double").alias("similarity"))


def standing(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """request, id, similarity (null) of what stands in a context whatever the task is."""
    asked = _asked(requests)
    scope = lambda s, kinds: memories.where((F.col("scope") == s) & F.col("kind").isin(*kinds))
    everything = [
        listed(scope("global", STANDING), asked, ["tenant"], ["kind"], STANDING_EACH), listed(scope("domain", CONSTRAINTS), asked, ["tenant", "domain"], ["kind"], STANDING_EACH),
        listed(scope("project", CONSTRAINTS), asked, ["tenant", "project"], ["kind"], STANDING_EACH),
        listed(memories, asked.where("blind AND domain IS NULL"), ["tenant"], [], WITHOUT_VECTOR), listed(memories, asked.where("blind"), ["tenant", "domain"], [], WITHOUT_VECTOR),
    ]
    return reduce(DataFrame.unionByName, everything)


def _leading(request: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first `most` of each request by falling score and id; equal ones once."""
    order = np.lexsort((ids, -scores, request))
    request, ids, scores = request[order], ids[order], scores[order]
    new = np.ones(len(request), dtype=bool)
    new[1:] = (request[1:] != request[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    request, ids, scores = request[new], ids[new], scores[new]
    kept = np.arange(len(request)) - np.searchsorted(request, request) < most
    return request[kept], ids[kept], scores[kept]


def similar(memories: DataFrame, requests: DataFrame, keys: list[str], most: int, least: float = LEAST_SIMILARITY, block: int = 8192) -> DataFrame:
    """request, id, similarity of the `most` nearest memories that agree with a request in keys, and are near enough.

    A block of requests is one pass over the memories. Each batch's memories of a key meet its requests, `STRIP` at a
    time, as a product of matrices; a task hands on its best for each request once, after its last batch."""
    key = lambda df: F.to_json(F.struct(*[df[k] for k in keys]))
    whole = lambda df: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, "vector"]])
    spark = memories.sparkSession
    asked = requests.select("request", F.explode(F.array_distinct("tenants")).alias("tenant"), "domain", "project", "vector")
    asked = asked.where(whole(asked)).select("request", "vector", key(asked).alias("key"))
    own, out = memories.where(whole(memories)).select(F.col("id").cast("long").alias("id"), "vector", key(memories).alias("key")), None
    for rows in query_blocks(asked, block):
        wanted: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            wanted.setdefault(r.key, []).append(i)
        shared = spark.sparkContext.broadcast((np.array([r.request for r in rows], dtype=np.int64), _unit(pa.array([list(r.vector) for r in rows], pa.list_(pa.float64()))), {k: np.array(v) for k, v in wanted.items()}))

        def best(batches, shared=shared):
            names, units_of, places = shared.value
            # Requests by number, ids, similarities.
            kept = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
            for batch in batches:
                ids, units, of_key = batch.column("id").to_numpy(), _unit(batch.column("vector")), {}
                if units.shape[1] != units_of.shape[1]:
                    continue
                for i, k in enumerate(batch.column("key").to_pylist()):
                    if k in places:
                        of_key.setdefault(k, []).append(i)
                found = [kept]
                for k, at in of_key.items():
                    at = np.array(at)
                    at = at[np.unique(ids[at], return_index=True)[1]]
                    for first in range(0, len(places[k]), STRIP):
                        asking = places[k][first : first + STRIP]
                        scores = np.nan_to_num(np.round(units_of[asking] @ units[at].T, 4), nan=-np.inf)
                        floor = np.partition(scores, -most, axis=1)[:, -most, None] if len(at) > most else -np.inf
                        i, j = np.nonzero(scores >= np.maximum(floor, least))
                        found.append(_leading(asking[i], ids[at[j]], scores[i, j], most))
                kept = _leading(*map(np.concatenate, zip(*found, strict=True)), most)
            yield pa.RecordBatch.from_arrays([pa.array(names[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["request", "id", "similarity"])

        found = own.mapInArrow(best, "request long, id long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "request long, id long, similarity double")
    order = Window.partitionBy("request").orderBy(F.desc("similarity"), "id")
    return out.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def candidates(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """request, similarity, bucket and the details of every memory that a context may hold."""
    near = [similar(memories, requests, ["tenant"], SIMILAR), similar(memories, requests, ["tenant", "domain"], SIMILAR_DOMAIN), similar(memories, requests, ["tenant", "project"], SIMILAR_PROJECT)]
    found = reduce(DataFrame.unionByName, [standing(memories, requests), *near]).groupBy("request", "id").agg(F.max("similarity").alias("similarity"))
    kind = F.col("kind")
    bucket = (
        F.when(kind.isin(*CONSTRAINTS), 0).when(kind.isin(*DECISIONS), 2).when((F.col("scope") == "global") & kind.isin(*STANDING), 1).otherwise(3)
    )
    return found.join(memories.dropDuplicates(["id"]).select("id", "kind", "scope", "content", "importance"), "id").withColumn("bucket", bucket)


ITEM = "struct<bucket:int,order:double,id:bigint,content:string,other:string>"


def compiled(memories: DataFrame, requests: DataFrame, hits: DataFrame) -> DataFrame:
    """request, used, dropped and items (bucket, id, content, cost) of each request's context.

    In order: constraints, preferences, decisions and other memories, each by falling rank and id, then DOCUMENTS hits by
    score. What doesn't fit is dropped and the next is tried; a document is shown by its snippet where its text doesn't
    fit. The task and the project's text are counted first."""
    cost = lambda text: F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4.0).cast("int") + OVERHEAD
    item = lambda bucket, order, other: F.struct(bucket.alias("bucket"), order.cast("double").alias("order"), F.col("id").cast("long").alias("id"), "content", other.alias("other")).cast(ITEM).alias("x")
    mine = candidates(memories, requests).select("request", item(F.col("bucket"), -rank(F.col("similarity"), F.col("importance")), F.col("content")))
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "id"))
    theirs = hits.withColumn("_n", place).where(F.col("_n") <= DOCUMENTS).select("request", item(F.lit(4), -F.col("score"), F.col("snippet")))
    lists = mine.unionByName(theirs).groupBy("request").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # bounded by the lists' sizes
    zero = F.struct(F.col("budget").cast("int").alias("left"), F.lit(0).alias("used"), F.lit(0).alias("dropped"), F.array().cast("array<struct<bucket:int,id:bigint,content:string,cost:int>>").alias("items"))

    def taken(s: Column, text: Column, kept: Column) -> Column:
        fits = cost(text) <= s["left"]
        return F.struct(
            (s["left"] - F.when(fits, cost(text)).otherwise(0)).alias("left"), (s["used"] + F.when(fits, cost(text)).otherwise(0)).alias("used"),
            (s["dropped"] + F.when(fits, 0).otherwise(1)).alias("dropped"), F.when(fits, F.concat(s["items"], kept)).otherwise(s["items"]).alias("items"),
        )

    def step(s: Column, x: Column) -> Column:
        text = F.when((x["bucket"] == 4) & (s["left"] <= cost(x["content"])), x["other"]).otherwise(x["content"])
        return taken(s, text, F.array(F.struct(x["bucket"].alias("bucket"), x["id"].alias("id"), text.alias("content"), cost(text).alias("cost"))))

    none = F.array().cast("array<struct<bucket:int,id:bigint,content:string,cost:int>>")
    # The task, and the project where there is one, are the first things that are taken; one-element arrays bind them.
    start = F.get(F.transform(F.array(zero), lambda s: taken(s, F.col("task"), none)), 0)
    start = F.get(F.transform(F.array(start), lambda s: F.when(F.coalesce("project_text", F.lit("")) != "", taken(s, F.col("project_text"), none)).otherwise(s)), 0)
    rows = requests.join(lists, "request", "left").withColumn("_start", start).withColumn("xs", F.coalesce("xs", F.array().cast(f"array<{ITEM}>")))
    return rows.withColumn("_f", F.aggregate("xs", F.col("_start"), step)).select("request", "_f.used", "_f.dropped", "_f.items")
