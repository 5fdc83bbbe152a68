"""Policy tables and the cascade over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import routing
from larkspur.plans.registry import query, table

PRICES = "(VALUES ('view', 1.0::DOUBLE, 4.0::DOUBLE), ('click', 0.5, 2.0), ('m0', 3.0, 15.0), ('m1', 0.0, 0.0))"


@query("price_lookup", f"""
WITH p(model, i, o) AS {PRICES}, c AS (SELECT event_id, event_type AS alias, 'm' || (user_id % 3) AS run_model, user_id AS t, event_id % 100 AS u FROM events)
SELECT event_id, round((t * coalesce(a.i, b.i) + u * coalesce(a.o, b.o)) / 1e6, 9) AS usd FROM c LEFT JOIN p a ON a.model = alias LEFT JOIN p b ON b.model = run_model""")
def price_lookup(spark, sf_dir):
    prices = spark.createDataFrame([("view", 1.0, 4.0), ("click", 0.5, 2.0), ("m0", 3.0, 15.0), ("m1", 0.0, 0.0)], "model string, price_in double, price_out double")
    calls = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("alias"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("run_model"), F.col("user_id").alias("tokens_in"), (F.col("event_id") % 100).alias("tokens_out"))
    return routing.priced(calls, prices).select("event_id", "usd")


@query("route_models", """
SELECT event_id, CASE WHEN event_type = 'view' AND user_id % 3 = 2 THEN 'large' WHEN event_type = 'view' THEN 'small' WHEN event_type = 'click' AND user_id % 3 = 0 THEN 'tiny' ELSE 'other' END AS model FROM events""")
def route_models(spark, sf_dir):
    routes = spark.createDataFrame([("view", 2, "large"), ("view", None, "small"), ("click", 0, "tiny")], "task_type string, complexity long, model string")
    tasks = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("task_type"), (F.col("user_id") % 3).alias("complexity"))
    return routing.routed(tasks, routes, "other").select("event_id", "model")


@query("next_models", """
SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'c' WHEN 2 THEN '-' ELSE CASE WHEN event_id % 4 < 1 THEN 'b' WHEN event_id % 4 < 3 THEN 'c' ELSE '-' END END AS next FROM events""")
def next_models(spark, sf_dir):
    ladder = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, "c", 3)], "place int, model string, tier long")
    model = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("off")), (F.col("user_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", model.alias("model"), (F.col("event_id") % 4).alias("tier"))
    return routing.next_models(rows, ladder).select("event_id", F.coalesce("next", F.lit("-")).alias("next"))


@query("cascade", """
WITH q AS (SELECT event_id AS question, value / 200 AS v, user_id % 10 AS u FROM events),
a AS (SELECT question, CASE WHEN u = 0 THEN NULL WHEN v >= 0.4 THEN 'rule' ELSE 'model' END AS settled, v, u FROM q)
SELECT question, CASE WHEN u > 0 AND v >= 0.4 THEN 'yes' WHEN 1 - v >= 0.4 THEN 'no' WHEN u > 0 AND v > 1 - v THEN 'yes' ELSE 'no' END AS answer,
  CASE WHEN u > 0 AND v >= 0.4 THEN 'rule' WHEN 1 - v >= 0.4 THEN 'model' WHEN u > 0 AND v > 1 - v THEN 'rule' ELSE 'model' END AS backend, NOT (u > 0 AND v >= 0.4) AND 1 - v < 0.4 AS needs_human FROM a""")
def cascade(spark, sf_dir):
    questions = table(spark, sf_dir, "events").select(F.col("event_id").alias("question"), (F.col("value") / 200).alias("v"), (F.col("user_id") % 10).alias("u"))
    rule = lambda q: q.select("question", F.lit("yes").alias("answer"), F.col("v").alias("confidence"), (F.col("u") == 0).alias("refused"))
    model = lambda q: q.select("question", F.lit("no").alias("answer"), (1 - F.col("v")).alias("confidence"), F.lit(False).alias("refused"))
    return routing.cascade(questions, [("rule", rule), ("model", model)], 0.4).select("question", "answer", "backend", "needs_human")
