"""The ledger as streams: idempotent ingestion, totals by session, windows, and a session's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLOSED = ("succeeded", "failed", "cancelled")


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(rows: DataFrame, key: str, ts: str | None = None, horizon: str = "1 day") -> DataFrame:
    """Rows whose key wasn't seen; without ts for ever, else within the watermark. Rows without a key all pass."""
    has_key = F.coalesce(F.col(key).cast("string") != "", F.lit(False))
    keyed = rows.where(has_key) if ts is None else rows.where(has_key).withWatermark(ts, horizon)
    seen = keyed.dropDuplicates([key]) if ts is None else keyed.dropDuplicatesWithinWatermark([key])
    return seen.unionByName(rows.where(~has_key))  # these need no state


def session_totals(rows: DataFrame, session: str, cost: str) -> DataFrame:
    """Running totals by session; update mode."""
    return rows.groupBy(session).agg(F.count("*").alias("calls"), F.sum(cost).alias("cost"))


def windows(rows: DataFrame, ts: str, size: str, slide: str | None = None, late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Counts by window of event time; append mode after the watermark."""
    at = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.withWatermark(ts, late).groupBy(at.alias("w"), *(keys or [])).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *(keys or []), "n")


def session_windows(rows: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def session_states(rows: DataFrame, session: str = "session") -> DataFrame:
    """session, status, failures, escalations after each batch: the fold over events (session, seq, type) in order.

    A repair counts a failure, an escalation or success resets them, the first close stays unless a failure follows.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, failures, escalations = state.get if state.exists else ("running", 0, 0)
        for kind in pd.concat(list(batches)).sort_values("seq")["type"]:
            if kind == "repair":
                failures += 1
            elif kind == "escalate":
                failures, escalations = 0, escalations + 1
            elif kind in CLOSED:
                failures = 0 if kind == "succeeded" else failures
                status = kind if status == "running" or kind == "failed" else status
        state.update((status, failures, escalations))
        yield pd.DataFrame([(*key, status, failures, escalations)], columns=[session, "status", "failures", "escalations"])

    return rows.groupBy(session).applyInPandasWithState(
        fold, f"{session} long, status string, failures int, escalations int", "status string, failures int, escalations int", "update", "NoTimeout"
    )


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there and writes its rows as Parquet, batch by batch."""

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")  # the same batch again replaces itself

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
