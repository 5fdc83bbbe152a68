"""Conditional writes as merges: approvals, decisions, answers that are kept for a while, and plans of backends."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING_DAYS = 7
DAY = 86_400


def approvals_opened(approvals: DataFrame, requests: DataFrame, days: int = PENDING_DAYS) -> DataFrame:
    """approvals with a pending row for each request (id, session, kind, model, at) that no pending one equals.

    Requests equal one by session, kind and model, null models being equal; of equal requests the first opens it. at and
    expires_at are seconds. Equal keys meet in one sum, so a hot session is a row for each task."""
    same = lambda a: F.struct(a["session"], a["kind"], a["model"])
    first = requests.groupBy("session", "kind", "model").agg(F.min(F.struct("at", "id")).alias("first"))
    pending = approvals.where("status = 'pending'").select("session", "kind", "model").distinct()
    fresh = first.join(pending, same(first).eqNullSafe(same(pending)), "left_anti")
    opened = fresh.select(
        F.col("first.id").alias("id"), "session", "kind", "model", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("decided_by"),
        F.lit(None).cast("long").alias("decided_at"), F.col("first.at").alias("created_at"), (F.col("first.at") + days * DAY).alias("expires_at"),
    )
    return approvals.unionByName(opened)


def approvals_resolved(approvals: DataFrame, runs: DataFrame, decisions: DataFrame, tier_of: Column) -> tuple[DataFrame, DataFrame]:
    """approvals and runs after decisions (id, approve, by, at), each of which counts if its approval is still pending; of
    several for one approval the first does.

    An approved one of kind "tier" with a model moves its session's runs to it: model, tier (tier_of, of a column
    `moved`), status running, one escalation more, no failures. A rejected one fails its session's blocked runs and ends
    them at that time unless they ended before. Decisions on one session take effect in the order of their times; the
    outcome is made of sums and first and last ones, so no session's decisions need be together.
    """
    first = decisions.groupBy("id").agg(F.min(F.struct("at", "by", "approve")).alias("d"))
    told = approvals.join(first, "id", "left").withColumn("now", (F.col("status") == "pending") & F.col("d").isNotNull())
    pick = lambda new, old: F.when(F.col("now"), new).otherwise(F.col(old)).alias(old)
    verdict = F.when(F.col("d.approve"), "approved").otherwise("rejected")
    changed = {"status": pick(verdict, "status"), "decided_by": pick(F.col("d.by"), "decided_by"), "decided_at": pick(F.col("d.at"), "decided_at")}
    settled = told.select(*[changed.get(c, F.col(c)) for c in approvals.columns])

    moves = F.col("d.approve") & (F.col("kind") == "tier") & (F.coalesce("model", F.lit("")) != "")
    order = lambda: F.struct(F.col("d.at").alias("at"), F.col("id").alias("id"), F.col("model").alias("model"))
    effects = told.where("now").groupBy("session").agg(
        F.count(F.when(moves, 1)).alias("moves"), F.max(F.when(moves, order())).alias("last"), F.min(F.when(moves, order())).alias("first_move"), F.min(F.when(~F.col("d.approve"), order())).alias("first_no"),
    )
    after = runs.join(effects, "session", "left").withColumn("moved", F.col("last.model"))
    moved = F.coalesce(F.col("moves"), F.lit(0)) > 0
    fails = (F.col("status") == "blocked") & F.col("first_no").isNotNull() & (~moved | (F.col("first_no") < F.col("first_move")))
    new = {
        "model": F.when(moved, F.col("moved")).otherwise(F.col("model")), "tier": F.when(moved, tier_of).otherwise(F.col("tier")),
        "status": F.when(moved, "running").when(fails, "failed").otherwise(F.col("status")), "escalations": F.col("escalations") + F.coalesce("moves", F.lit(0)).cast("int"),
        "failures": F.when(moved, 0).otherwise(F.col("failures")), "ended_at": F.when(fails, F.coalesce("ended_at", F.col("first_no.at"))).otherwise(F.col("ended_at")),
    }
    return settled, after.select(*[new[c].alias(c) if c in new else F.col(c) for c in runs.columns])


def links_cleared(rows: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """rows whose link columns name rows that exist: where one of a row's links doesn't, all of them are cleared. parents:
    for each link column a table whose first column has the keys; empty links are null."""
    out, columns = rows, list(parents)
    for c in columns:
        key = parents[c].columns[0]
        known = parents[c].select(F.col(key).alias("_key")).distinct().withColumn("_has", F.lit(True))
        out = out.withColumn(c, F.nullif(F.col(c), F.lit(""))) if dict(rows.dtypes)[c] == "string" else out
        out = out.join(known, out[c] == known["_key"], "left").withColumn(f"_ok_{c}", F.col(c).isNull() | F.col("_has")).drop("_key", "_has")
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.coalesce(F.col(f"_ok_{c}"), F.lit(False))
    return out.select(*[F.when(whole, F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def cached(requests: DataFrame, ttl: int) -> DataFrame:
    """requests (id, key, at, needs_human, failed) with `cached`: was the answer still kept?

    An answer is kept for ttl seconds, and only if it was made anew, needs no human, and no backend failed; a hit doesn't
    renew it. Requests of a key are read in order of time, then id, as a stream that holds one time: a hot key is one
    task's work, but not its memory. Requests without a key are never cached."""
    names = requests.columns

    def read(batches):
        last, until = None, None
        for batch in batches:
            hits = []
            for key, at, human, failed in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "needs_human", "failed")), strict=True):
                if key != last:
                    last, until = key, None
                hit = key is not None and until is not None and at < until
                if not hit and not human and not failed:
                    until = at + ttl
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], names=[*names, "cached"])

    ordered = requests.repartition("key").sortWithinPartitions("key", "at", "id")
    return ordered.mapInArrow(read, requests.select("*", F.lit(False).alias("cached")).schema)


def plan(override: Column, has_images: Column, order: list[str], for_images: str) -> Column:
    """The backends that a question visits: its own list or the usual order, the one for images first where there are
    any, each once. A struct of plan and unknown, the first name in the list that isn't there, which makes plan null."""
    usual = F.array(*[F.lit(b) for b in order])
    own = F.when(F.size(override) > 0, override).otherwise(usual)
    unknown = F.get(F.filter(own, lambda b: b.isNull() | ~b.isin(order)), 0)
    first = F.concat(F.array(F.lit(for_images)), own) if for_images in order else own
    made = F.array_distinct(F.when(has_images, first).otherwise(own))
    bad = F.exists(own, lambda b: b.isNull() | ~b.isin(order))
    return F.struct(F.when(~bad, made).alias("plan"), F.when(bad, F.coalesce(unknown, F.lit("null"))).alias("unknown"))


def memories_listed(memories: DataFrame, limit: int = 100) -> DataFrame:
    """The most important memories, newer ones first, then by id."""
    return memories.orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(limit)

