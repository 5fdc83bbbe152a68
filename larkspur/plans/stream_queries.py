"""Event-time windows; the same expressions run on streams and on tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.plans.registry import query, table


@query("event_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """An extension: tumbling windows of an hour."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


@query("user_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark, sf_dir):
    """An extension: sessions that end after 30 minutes of rest."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = rows.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("usage_once", """
SELECT user_id, count(*) AS calls, round(sum(value), 4) AS cost FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) = 1) GROUP BY user_id""")
def usage_once(spark, sf_dir):
    """Totals of usage where a repeated request key counts once, the first time."""
    first = F.row_number().over(Window.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("n", first).where("n = 1")
    return rows.groupBy("user_id").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"))


@query("price_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")
def price_percentiles(spark, sf_dir):
    """An extension: exact percentiles."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 4).alias("median"), F.round(F.percentile("value", F.lit(0.95)), 4).alias("p95"))
