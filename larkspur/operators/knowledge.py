"""The store of documents and memories: what it holds, what an ingest does, and what fits into a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def store_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, inactive ones, chunks and the last update by tenant, domain and source type; chunks are counted per
    document first, so a document with very many is one row of the join."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    return (
        documents.join(n, "document_id", "left").groupBy("tenant", "domain", "source_type")
        .agg(F.count_if(active).alias("documents"), F.count_if(~active).alias("inactive_documents"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chunks"), F.max("updated_at").alias("last_updated"))
        .orderBy("tenant", F.col("domain").asc_nulls_first(), "source_type")
    )


def last_ingests(events: DataFrame, source: str = "kb", kind: str = "kb.ingest") -> DataFrame:
    """tenant and the time of its last ingest, of events (tenant, source, type, occurred_at)."""
    return events.where((F.col("source") == source) & (F.col("type") == kind)).groupBy("tenant").agg(F.max("occurred_at").alias("last_ingest"))


def ingest_actions(incoming: DataFrame, store: DataFrame, can_prune: bool = True) -> DataFrame:
    """uri, action: what an ingest does with each file and with stored documents that are gone.

    incoming: uri, hash, meta, supported, error; store: uri, hash, meta. The first case that holds: unsupported, error,
    unchanged, metadata, updated, duplicate (other stored or earlier incoming rows have its hash), new; a stored row that
    isn't incoming is prune, or would-prune.
    """
    old = store.select("uri", F.col("hash").alias("old_hash"), F.col("meta").alias("old_meta"), F.lit(True).alias("stored"))
    holders = store.groupBy("hash").agg(F.lit(True).alias("held"))
    first = incoming.groupBy("hash").agg(F.min("uri").alias("first"))
    rows = incoming.join(old, "uri", "full").join(holders, "hash", "left").join(first, "hash", "left")
    action = (
        F.when(F.col("supported").isNull(), "prune" if can_prune else "would-prune")
        .when(~F.col("supported"), "unsupported")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("old_hash").eqNullSafe(F.col("hash")) & F.col("stored"), F.when(F.col("old_meta").eqNullSafe(F.col("meta")), "unchanged").otherwise("metadata"))
        .when(F.col("stored"), "updated")
        .when(F.col("held") | (F.col("first") < F.col("uri")), "duplicate")
        .otherwise("new")
    )
    return rows.select("uri", action.alias("action"))


def candidates(*found: DataFrame) -> DataFrame:
    """The union of lists of memories (id, similarity, ...), each once with its highest similarity."""
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    best = Window.partitionBy("id").orderBy(F.desc_nulls_last("similarity"))
    return rows.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


def rank(similarity: Column, importance: Column) -> Column:
    """A memory's rank: mostly by similarity, half where there is none, and by importance."""
    return F.coalesce(similarity, F.lit(0.5)) * 0.7 + importance * 0.3


def compiled(memories: DataFrame, hits: DataFrame, budget: int, task: str = "", overhead: int = 4) -> DataFrame:
    """What of a bounded list of memories and search hits fits into a budget of tokens: bucket, id, content, cost, place.

    memories: id, kind, scope, content, similarity, importance; hits: id, content, snippet, score. In order: constraints,
    preferences, decisions, others, each by falling rank and id, then documents by score. What doesn't fit is left out
    and the next is tried; a document is shown by its snippet where its text doesn't fit. Both lists are results of
    top-k searches, tens of rows, so their fold is one row's expression.
    """
    cost = lambda text: F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4.0).cast("int") + overhead
    bucket = (
        F.when(F.col("kind").isin("rule", "constraint"), 0).when((F.col("scope") == "global") & F.col("kind").isin("preference", "working_style", "communication"), 1)
        .when(F.col("kind").isin("decision", "architecture"), 2).otherwise(3)
    )
    item = "struct<bucket:int,order:double,id:bigint,content:string,other:string>"
    mine = memories.select(F.struct(bucket.alias("bucket"), (-rank(F.col("similarity"), F.col("importance"))).alias("order"), F.col("id").cast("long").alias("id"), "content", F.col("content").alias("other")).cast(item).alias("x"))
    theirs = hits.select(F.struct(F.lit(4).alias("bucket"), (-F.col("score")).cast("double").alias("order"), F.col("id").cast("long").alias("id"), "content", F.col("snippet").alias("other")).cast(item).alias("x"))
    all_rows = mine.unionByName(theirs).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    start = max(0, budget - (-(-len(task) // 4) + overhead))

    def step(state: Column, x: Column) -> Column:
        text = F.when(state["left"] > cost(x["content"]), x["content"]).otherwise(x["other"])
        text = F.when(x["bucket"] == 4, text).otherwise(x["content"])
        fits = cost(text) <= state["left"]
        picked = F.struct(x["bucket"].alias("bucket"), x["id"].alias("id"), text.alias("content"), cost(text).alias("cost"))
        return F.struct(F.when(fits, state["left"] - cost(text)).otherwise(state["left"]).alias("left"), F.when(fits, F.concat(state["out"], F.array(picked))).otherwise(state["out"]).alias("out"))

    none = F.array().cast("array<struct<bucket:int,id:bigint,content:string,cost:int>>")
    out = F.aggregate("xs", F.struct(F.lit(start).alias("left"), none.alias("out")), step, lambda s: s["out"])
    return all_rows.select(F.posexplode(out).alias("place", "p")).select("p.bucket", "p.id", "p.content", "p.cost", "place")


def decided(approvals: DataFrame, decisions: DataFrame) -> DataFrame:
    """approvals (id, status, decided_by) after decisions (id, status, decided_by): the first by (status, decided_by) of
    an id counts, and only on what is pending; a decision on anything else changes nothing."""
    first = decisions.groupBy("id").agg(F.min(F.struct("status", "decided_by")).alias("d"))
    rows = approvals.join(first, "id", "left")
    now = (F.col("status") == "pending") & F.col("d").isNotNull()
    new = {"status": F.when(now, F.col("d.status")).otherwise(F.col("status")), "decided_by": F.when(now, F.col("d.decided_by")).otherwise(F.col("decided_by"))}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in approvals.columns])


def project_upserts(projects: DataFrame, rows: DataFrame) -> DataFrame:
    """slug, tenant, name, action: a row of a new slug is inserted, one of its own tenant updates the name where it has
    one, one of another tenant is a conflict and changes nothing. Of rows with equal slugs the first by tenant, name counts."""
    new = rows.groupBy("slug").agg(F.min(F.struct("tenant", "name")).alias("n"))
    both = projects.select("slug", F.col("tenant").alias("t"), F.col("name").alias("m"), F.lit(True).alias("old")).join(new, "slug", "full")
    action = F.when(F.col("old").isNull(), "inserted").when(F.col("n").isNull(), "kept").when(F.col("t") != F.col("n.tenant"), "conflict").otherwise("updated")
    name = F.when(action == "inserted", F.col("n.name")).when(action == "updated", F.coalesce("n.name", "m")).otherwise(F.col("m"))
    return both.select("slug", F.coalesce("t", "n.tenant").alias("tenant"), name.alias("name"), action.alias("action"))


def maintained(memories: DataFrame, now: Column, review_after_days: int = 90) -> DataFrame:
    """memories (status, expires_at, reviewed_at, ...) after maintenance, with `change`: expired ones are deprecated, active
    ones that nobody has looked at for long are due for review; the rest is as it was (null)."""
    active = F.col("status") == "active"
    change = F.when(active & (F.col("expires_at") <= now), "deprecated").when(active & (F.date_add(F.to_date("reviewed_at"), review_after_days) <= F.to_date(now)), "review")
    return memories.withColumn("change", change).withColumn("status", F.coalesce("change", "status"))


def without_orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document is there and active; chunks without a document id have none."""
    return chunks.join(documents.where("status = 'active'").select("document_id"), "document_id", "left_semi")


def kept_jobs(jobs: DataFrame, most: int) -> DataFrame:
    """Jobs (id, status, created) that stay: all that aren't finished, and the `most` last finished ones."""
    finished = F.col("status").isin("done", "failed")
    last = jobs.where(finished).orderBy(F.desc("created"), F.desc("id")).limit(most)
    return jobs.where(~finished).unionByName(last)
