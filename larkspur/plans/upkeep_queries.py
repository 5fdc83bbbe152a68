"""Retention, inventories, answers and instalments over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import finance, upkeep
from larkspur.plans.registry import query, table

NOW = "2024-02-01"


@query("retention_sweep", f"""
WITH f AS (SELECT CASE event_id % 3 WHEN 0 THEN 'tmp/' WHEN 1 THEN 'out/' ELSE 'keep/' END AS prefix, ts, user_id AS bytes FROM events)
SELECT prefix, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM f WHERE prefix <> 'keep/' AND ts < TIMESTAMP '{NOW}' - to_days(CASE prefix WHEN 'tmp/' THEN 7 ELSE 14 END) GROUP BY prefix""")
def retention_sweep(spark, sf_dir):
    folder = F.element_at(F.array(F.lit("tmp/"), F.lit("out/"), F.lit("keep/")), (F.col("event_id") % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "events").select(F.concat(folder, "event_id").alias("path"), F.col("ts").cast("timestamp").alias("modified"), F.col("user_id").alias("bytes"))
    return upkeep.swept(upkeep.expired(files, [("tmp/", 7), ("out/", 14)], F.lit(NOW).cast("timestamp")))


@query("file_inventory", """
SELECT event_type AS folder, CASE user_id % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' WHEN 2 THEN 'Markdown' ELSE 'other' END AS language, count(*) AS files FROM events GROUP BY ALL""")
def file_inventory(spark, sf_dir):
    end = F.element_at(F.array(F.lit(".py"), F.lit(".GO"), F.lit(".md"), F.lit("")), (F.col("user_id") % 4 + 1).cast("int"))
    return upkeep.inventory(table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/src/f"), "event_id", end).alias("path")))


@query("answer_summary", """
SELECT user_id, min(value) AS confidence, bool_or(value < 5) AS needs_human, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE 'cascade' END AS backend FROM events GROUP BY user_id""")
def answer_summary(spark, sf_dir):
    answers = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("backend"), F.col("value").alias("confidence"), (F.col("value") < 5).alias("needs_human"))
    return upkeep.answer_summary(answers, "user_id")


@query("outstanding_parts", """
SELECT o_orderpriority, count(*) AS purchases, sum((11 - o_orderkey % 12) * CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS outstanding FROM orders GROUP BY 1""")
def outstanding_parts(spark, sf_dir):
    part = F.concat((F.col("o_orderkey") % 12 + 1).cast("string"), F.lit("/12"))
    rest = finance.outstanding(part, F.col("o_totalprice").cast("decimal(18,2)"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("purchases"), F.sum(rest).cast("double").alias("outstanding"))


@query("income_shares", """
WITH s AS (SELECT o_orderpriority AS kind, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1)
SELECT kind, total::DOUBLE AS total, round(total::DOUBLE / (SELECT sum(total)::DOUBLE FROM s WHERE kind = '1-URGENT') * 100, 1) AS pct FROM s WHERE kind <> '1-URGENT'""")
def income_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return finance.income_shares(rows, "o_orderpriority", "amount", "1-URGENT")
