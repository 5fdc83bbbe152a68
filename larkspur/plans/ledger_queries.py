"""The ledger's queries over the events table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.plans import ledger_reports as ledger
from larkspur.plans.registry import query, table

R = f"WITH r AS ({ledger.RUNS_SQL})\n"
WON = "count(*) FILTER (WHERE status = 'succeeded')"


@query("rpt_costs", R + f"""
SELECT task_type, start_model, count(*) AS runs, {WON} AS succeeded, count(*) FILTER (WHERE status = 'succeeded' AND escalations = 0) AS solved_without_escalation,
  round({WON}::DOUBLE / count(*), 6) AS success_rate, sum(cost_usd)::DOUBLE AS total_cost, round(sum(cost_usd)::DOUBLE / nullif({WON}, 0), 6) AS cost_per_success,
  round(avg(iterations), 6) AS avg_iterations, round(avg(repairs), 6) AS avg_repairs, round(avg(escalations), 6) AS avg_escalations
FROM r WHERE status IN ('succeeded', 'failed') AND task_type IS NOT NULL GROUP BY task_type, start_model""")
def rpt_costs(spark, sf_dir):
    return ledger.costs(ledger.runs(spark, sf_dir))


@query("rpt_models", R + f"""
SELECT model, {WON} AS solved, count(*) AS runs, round(avg((status = 'succeeded')::INT), 3) AS success_rate, sum(cost_usd)::DOUBLE AS cost_usd
FROM r WHERE status IN ('succeeded', 'failed') GROUP BY model""")
def rpt_models(spark, sf_dir):
    return ledger.models(ledger.runs(spark, sf_dir))


@query("rpt_agents", R + """
SELECT 'agent' || agent_id AS agent, count(*) AS runs, sum(cost_usd)::DOUBLE AS cost_usd, round(sum(cost_usd)::DOUBLE / count(cost_usd), 6) AS avg_cost_usd, sum(input_tokens + output_tokens)::BIGINT AS tokens FROM r GROUP BY agent_id""")
def rpt_agents(spark, sf_dir):
    names = spark.range(6).select(F.col("id").cast("int").alias("agent_id"), F.concat(F.lit("agent"), F.col("id").cast("string")).alias("agent"))
    return ledger.agents(ledger.runs(spark, sf_dir), names)


@query("rpt_skills", R + """
SELECT skill, count(*) AS calls, sum(input_tokens + output_tokens)::BIGINT AS tokens, sum(cost_usd)::DOUBLE AS cost_usd FROM
  (SELECT cost_usd, input_tokens, output_tokens, unnest(['s' || repairs, 'e' || escalations]) AS skill FROM r WHERE iterations > 0) GROUP BY skill""")
def rpt_skills(spark, sf_dir):
    listed = F.when(F.col("iterations") > 0, F.to_json(F.array(F.concat(F.lit("s"), "repairs"), F.concat(F.lit("e"), "escalations"))))
    return ledger.skills(ledger.runs(spark, sf_dir).withColumn("skills", listed))


@query("rpt_loops", R + """
SELECT coalesce(task_type, '(unclassified)') AS task_type, count(*) AS runs, round(avg(repairs), 6) AS avg_repairs, max(repairs) AS max_repairs, count(*) FILTER (WHERE repairs >= 3) AS runs_with_3plus_repairs, round(avg(iterations), 6) AS avg_iterations
FROM r GROUP BY 1""")
def rpt_loops(spark, sf_dir):
    return ledger.loops(ledger.runs(spark, sf_dir))


@query("rpt_routes", R + f"""
SELECT coalesce(domain, '-') AS domain, coalesce(task_type, '-') AS task_type, coalesce(complexity, '-') AS complexity, start_model, count(*) AS runs,
  round(avg((status = 'succeeded')::INT), 3) AS success_rate, round(sum(cost_usd)::DOUBLE / nullif({WON}, 0), 9) AS cost_per_success_usd
FROM r WHERE status IN ('succeeded', 'failed') GROUP BY 1, 2, 3, 4""")
def rpt_routes(spark, sf_dir):
    return ledger.routes(ledger.runs(spark, sf_dir))


@query("rpt_escalations", R + """
SELECT started_at::DATE::VARCHAR AS day, count(*) FILTER (WHERE gate = 'escalate') AS escalations, count(*) FILTER (WHERE gate = 'ask_human') AS asked_human, count(*) AS gates,
  round(avg((gate = 'escalate')::INT), 3) AS escalation_rate, string_agg(DISTINCT path, ',' ORDER BY path) FILTER (WHERE gate = 'escalate') AS paths
FROM (SELECT *, start_model || '->' || coalesce(CASE WHEN repairs + iterations > 0 THEN model END, '-') AS path FROM r) GROUP BY 1 ORDER BY 1 DESC LIMIT 60""")
def rpt_escalations(spark, sf_dir):
    to = F.when(F.col("repairs") + F.col("iterations") > 0, F.col("model"))
    gates = ledger.runs(spark, sf_dir).select(F.col("started_at").alias("occurred_at"), F.col("gate").alias("action"), F.col("start_model").alias("from_model"), to.alias("to_model"))
    return ledger.escalations(gates)


@query("rpt_spend", R + """
SELECT started_at::DATE::VARCHAR AS day, model AS model_alias, purpose, sum(cost_usd)::DOUBLE AS usd, sum(input_tokens)::BIGINT AS in_tok, sum(output_tokens)::BIGINT AS out_tok, count(*) AS calls
FROM r GROUP BY ALL ORDER BY day DESC, usd DESC, model_alias, purpose LIMIT 200""")
def rpt_spend(spark, sf_dir):
    return ledger.spend(ledger.runs(spark, sf_dir))


STATS = f"""
SELECT task_type, start_model, count(*) AS runs, count(*) FILTER (WHERE status = 'succeeded' AND escalations = 0) AS solved, coalesce(round(sum(cost_usd)::DOUBLE / nullif({WON}, 0), 6), 0.0) AS cost_per_success
FROM r WHERE status IN ('succeeded', 'failed') AND started_at > (SELECT max(started_at) FROM r) - INTERVAL 90 DAYS GROUP BY ALL"""


@query("learned_stats", R + STATS)
def learned_stats(spark, sf_dir):
    return ledger.learned_stats(ledger.runs(spark, sf_dir))


@query("best_model", R + f""", s AS ({STATS}), p AS (SELECT *, runs >= 5 AND solved / runs >= 0.3 AND solved > 0 AS proven FROM s),
b AS (SELECT * FROM p WHERE proven AND start_model <> 'm7' QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY cost_per_success, start_model) = 1)
SELECT b.task_type, 'm' || length(b.task_type) % 8 AS policy_model, b.start_model AS model, b.cost_per_success, b.runs FROM b
LEFT JOIN p ON p.task_type = b.task_type AND p.start_model = 'm' || length(b.task_type) % 8 AND p.proven
WHERE b.start_model <> 'm' || length(b.task_type) % 8 AND (p.cost_per_success IS NULL OR p.cost_per_success > b.cost_per_success)""")
def best_model(spark, sf_dir):
    stats = ledger.learned_stats(ledger.runs(spark, sf_dir))
    policy = stats.select("task_type", F.concat(F.lit("m"), F.length("task_type") % 8).alias("policy_model")).distinct()
    return ledger.best_models(stats, policy, [f"m{i}" for i in range(7)])


@query("budget_state", R + """, l(period, limit_usd) AS (VALUES ('day', 5.0::DOUBLE), ('month', 1e9::DOUBLE), ('month', -1.0::DOUBLE)),
n AS (SELECT max(started_at) - INTERVAL 3 HOURS AS now FROM r),
s AS (SELECT period, limit_usd, coalesce(sum(cost_usd), 0)::DOUBLE AS spent FROM l CROSS JOIN n LEFT JOIN r ON started_at - INTERVAL 3 HOURS >= date_trunc(period, now) GROUP BY ALL)
SELECT period, limit_usd, round(spent, 2) AS spent, CASE WHEN limit_usd < 0 THEN 'unlimited' WHEN spent / limit_usd >= 1 THEN 'exhausted' WHEN spent / limit_usd >= 0.8 THEN 'warn' ELSE 'ok' END AS state FROM s""")
def budget_state(spark, sf_dir):
    limits = spark.createDataFrame([("day", 5.0), ("month", 1e9), ("month", -1.0)], "period string, limit_usd double")
    return ledger.budget_states(ledger.runs(spark, sf_dir), limits)


@query("mau_growth", """
WITH m AS (SELECT date_trunc('month', ts)::DATE AS month, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT month::VARCHAR AS month, users, round(100.0::DOUBLE * (users - lag(users) OVER (ORDER BY month)) / lag(users) OVER (ORDER BY month), 1) AS growth_pct FROM m""")
def mau_growth(spark, sf_dir):
    return ledger.monthly_active(table(spark, sf_dir, "events"))


@query("session_close", R + """
SELECT agent_id, started_at::DATE::VARCHAR AS day, count(*) AS n, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE arg_min(status, (started_at, run_id)) END AS final_status,
  arg_max(run_id, (started_at, run_id)) FILTER (WHERE status <> 'cancelled') AS last_run FROM r GROUP BY 1, 2""")
def session_close(spark, sf_dir):
    return ledger.session_runs(ledger.runs(spark, sf_dir))


@query("failure_streaks", R + """, b AS (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING) AS block FROM r),
s AS (SELECT agent_id, block, count(*) AS n FROM b WHERE status = 'failed' GROUP BY ALL)
SELECT agent_id, max(n) AS longest, count(*) AS streaks FROM s GROUP BY agent_id""")
def failure_streaks(spark, sf_dir):
    return ledger.failure_streaks(ledger.runs(spark, sf_dir))
