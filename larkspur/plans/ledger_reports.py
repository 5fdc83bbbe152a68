"""The ledger's named reports: one grouped aggregate each, over the runs relation."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs relation, projected from the events table: one row per finished or cancelled run."""
    k = F.get_json_object("props", "$.k").cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), (F.col("user_id") % 6).cast("int").alias("agent_id"),
        F.col("event_type").alias("task_type"), F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")).alias("start_model"),
        F.when(k % 5 < 3, "succeeded").when(k % 5 == 3, "failed").otherwise("cancelled").alias("status"),
        F.col("value").cast("decimal(18,2)").alias("cost_usd"), (k % 8).alias("iterations"), (k % 4).alias("repairs"), (k % 3).alias("escalations"),
        F.concat(F.lit("m"), ((F.col("user_id") + k % 3) % 8).cast("string")).alias("model"),
        F.when(k % 4 == 1, "work").when(k % 4 == 2, "home").when(k % 4 == 3, "study").alias("domain"),
        F.when(k % 5 == 0, None).when(k % 2 == 0, "low").otherwise("high").alias("complexity"),
        (F.col("event_id") % 1000).alias("input_tokens"), (10 * k).cast("long").alias("output_tokens"),
        F.when(k % 3 == 0, "plan").when(k % 3 == 1, "act").otherwise("check").alias("purpose"),
        F.when(k % 4 == 0, "escalate").when(k % 4 == 1, "ask_human").when(k % 4 == 2, "repair").otherwise("done").alias("gate"),
    )


def newest(runs: DataFrame):
    """The latest start, read first so that a filter on time is a literal that reaches the scan; None without runs."""
    return runs.agg(F.max("started_at")).first()[0]


def last_days(runs: DataFrame, days: int) -> DataFrame:
    """Runs of the last days before the newest run."""
    latest = newest(runs)
    return runs.where("false") if latest is None else runs.where(F.col("started_at") > F.lit(latest - timedelta(days=days)))


#: The same relation for DuckDB.
RUNS_SQL = """
  SELECT event_id AS run_id, ts AS started_at, (user_id % 6)::INT AS agent_id, event_type AS task_type, 'm' || (user_id % 8) AS start_model,
    CASE WHEN k % 5 < 3 THEN 'succeeded' WHEN k % 5 = 3 THEN 'failed' ELSE 'cancelled' END AS status,
    CAST(value AS DECIMAL(18,2)) AS cost_usd, k % 8 AS iterations, k % 4 AS repairs, k % 3 AS escalations, 'm' || ((user_id + k % 3) % 8) AS model,
    CASE k % 4 WHEN 1 THEN 'work' WHEN 2 THEN 'home' WHEN 3 THEN 'study' END AS domain, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN 'low' ELSE 'high' END AS complexity,
    event_id % 1000 AS input_tokens, 10 * k AS output_tokens, CASE k % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'act' ELSE 'check' END AS purpose,
    CASE k % 4 WHEN 0 THEN 'escalate' WHEN 1 THEN 'ask_human' WHEN 2 THEN 'repair' ELSE 'done' END AS gate
  FROM (SELECT *, CAST(props ->> '$.k' AS INT) AS k FROM events)
"""


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def ratio(top: Column, bottom: Column, digits: int = 6) -> Column:
    """top / bottom as a rounded double; null where bottom is 0."""
    return F.round(F.try_divide(top.cast("double"), bottom.cast("double")), digits)


def costs(runs: DataFrame) -> DataFrame:
    """Cost per successful task by task type and first model; closed runs with a task type only."""
    won = F.col("status") == "succeeded"
    return (
        runs.where(F.col("status").isin("succeeded", "failed") & F.col("task_type").isNotNull())
        .groupBy("task_type", "start_model")
        .agg(
            F.count("*").alias("runs"), count_if(won).alias("succeeded"), count_if(won & (F.col("escalations") == 0)).alias("solved_without_escalation"),
            ratio(count_if(won), F.count("*")).alias("success_rate"), F.sum("cost_usd").cast("double").alias("total_cost"),
            ratio(F.sum("cost_usd"), count_if(won)).alias("cost_per_success"), ratio(F.sum("iterations"), F.count("iterations")).alias("avg_iterations"),
            ratio(F.sum("repairs"), F.count("repairs")).alias("avg_repairs"), ratio(F.sum("escalations"), F.count("escalations")).alias("avg_escalations"),
        )
        .orderBy(F.col("cost_per_success").asc_nulls_last(), "task_type", "start_model")
    )


def models(runs: DataFrame) -> DataFrame:
    """Runs that succeeded, all closed runs, success rate and cost by the model that a run ended with."""
    won = F.col("status") == "succeeded"
    return (
        runs.where(F.col("status").isin("succeeded", "failed"))
        .groupBy("model")
        .agg(count_if(won).alias("solved"), F.count("*").alias("runs"), ratio(count_if(won), F.count("*"), 3).alias("success_rate"), F.sum("cost_usd").cast("double").alias("cost_usd"))
        .orderBy(F.desc("solved"), "model")
    )


def agents(runs: DataFrame, names: DataFrame) -> DataFrame:
    """Runs, cost and tokens by agent; names is a small table of agent_id and agent, checked by Spark's own threshold."""
    return runs.join(names, "agent_id").groupBy("agent").agg(
        F.count("*").alias("runs"), F.sum("cost_usd").cast("double").alias("cost_usd"), ratio(F.sum("cost_usd"), F.count("cost_usd")).alias("avg_cost_usd"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
    )


def skills(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost by skill; a call lists its skills as a JSON array, and calls without skills drop out."""
    listed = calls.withColumn("skill", F.explode(F.from_json("skills", "array<string>")))
    return listed.groupBy("skill").agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost_usd").cast("double").alias("cost_usd"))


def loops(runs: DataFrame) -> DataFrame:
    """Runs, repairs and iterations by task type."""
    return runs.groupBy(F.coalesce("task_type", F.lit("(unclassified)")).alias("task_type")).agg(
        F.count("*").alias("runs"), ratio(F.sum("repairs"), F.count("repairs")).alias("avg_repairs"), F.max("repairs").alias("max_repairs"),
        count_if(F.col("repairs") >= 3).alias("runs_with_3plus_repairs"), ratio(F.sum("iterations"), F.count("iterations")).alias("avg_iterations"),
    )


def routes(runs: DataFrame) -> DataFrame:
    """Closed runs, success rate and cost per success by domain, task type, complexity and first model."""
    won = F.col("status") == "succeeded"
    keys = [F.coalesce(F.col(c), F.lit("-")).alias(c) for c in ("domain", "task_type", "complexity")]
    return (
        runs.where(F.col("status").isin("succeeded", "failed"))
        .groupBy(*keys, "start_model")
        .agg(F.count("*").alias("runs"), ratio(count_if(won), F.count("*"), 3).alias("success_rate"), ratio(F.sum("cost_usd"), count_if(won), 9).alias("cost_per_success_usd"))
        .orderBy(F.col("cost_per_success_usd").asc_nulls_last(), *("domain", "task_type", "complexity", "start_model"))
    )


def escalations(gates: DataFrame, most_days: int = 60) -> DataFrame:
    """The newest days' gate events (occurred_at, action, from_model, to_model): escalations, questions to people, all,
    the rate of escalations, and the paths that they took; paths is null on a day without any."""
    up = F.col("action") == "escalate"
    paths = F.sort_array(F.collect_set(F.when(up, F.concat("from_model", F.lit("->"), F.coalesce("to_model", F.lit("-"))))))
    return (
        gates.groupBy(F.to_date("occurred_at").alias("day"))
        .agg(
            count_if(up).alias("escalations"), count_if(F.col("action") == "ask_human").alias("asked_human"), F.count("*").alias("gates"),
            ratio(count_if(up), F.count("*"), 3).alias("escalation_rate"), F.array_join(F.when(F.size(paths) > 0, paths), ",").alias("paths"),
        )
        .orderBy(F.desc("day")).limit(most_days)
    )


def spend(calls: DataFrame, most: int = 200) -> DataFrame:
    """Cost, tokens and calls by day, model and purpose; the report's most rows, newest and dearest first."""
    return (
        calls.groupBy(F.to_date("started_at").alias("day"), F.col("model").alias("model_alias"), "purpose")
        .agg(F.sum("cost_usd").cast("double").alias("usd"), F.sum("input_tokens").alias("in_tok"), F.sum("output_tokens").alias("out_tok"), F.count("*").alias("calls"))
        .orderBy(F.desc("day"), F.desc("usd"), "model_alias", "purpose").limit(most)
    )


def learned_stats(runs: DataFrame, days: int = 90) -> DataFrame:
    """What each model has shown in the last `days`: runs, solved without escalation, cost per success (0 without one)."""
    recent = last_days(runs, days)
    won = F.col("status") == "succeeded"
    return recent.where(F.col("status").isin("succeeded", "failed")).groupBy("task_type", "start_model").agg(
        F.count("*").alias("runs"), count_if(won & (F.col("escalations") == 0)).alias("solved"),
        F.coalesce(ratio(F.sum("cost_usd"), count_if(won)), F.lit(0.0)).alias("cost_per_success"),
    )


def best_models(stats: DataFrame, policy: DataFrame, known: list[str], least_runs: int = 5, least_rate: float = 0.3) -> DataFrame:
    """Per task type the cheapest proven model, where that changes what policy (task_type, policy_model) says.

    Proven: known, least_runs runs, least_rate of them solved, one at least. Ties go to the first by name. Nothing is
    said where the best is the policy's model, or where that one is proven and no dearer.
    """
    rate = F.col("solved") / F.col("runs")
    proven = (F.col("runs") >= least_runs) & (rate >= least_rate) & (F.col("solved") > 0)
    rows = F.struct("cost_per_success", F.col("start_model").alias("model"), "runs")
    best = stats.where(proven & F.col("start_model").isin(known)).groupBy("task_type").agg(F.min(rows).alias("best"))
    own = stats.where(proven).select("task_type", F.col("start_model").alias("policy_model"), F.col("cost_per_success").alias("policy_cost"))
    found = best.join(policy, "task_type").join(own, ["task_type", "policy_model"], "left")
    moves = (F.col("best.model") != F.col("policy_model")) & (F.col("policy_cost").isNull() | (F.col("policy_cost") > F.col("best.cost_per_success")))
    return found.where(moves).select("task_type", "policy_model", "best.model", "best.cost_per_success", "best.runs")


def local_day(ts: Column, zone: str, unit: str = "day") -> Column:
    """The start of ts's day or month in a time zone, as an instant."""
    return F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(ts, zone)), zone)


def budget_states(runs: DataFrame, limits: DataFrame, zone: str = "America/Sao_Paulo", warn: float = 0.8) -> DataFrame:
    """Spend of the newest run's day and month against limits (period, limit_usd; below 0: none).

    Spend is summed per local day first, so what is joined by `>=` to the limits is a row for each day.
    """
    days = runs.groupBy(local_day(F.col("started_at"), zone).alias("day")).agg(F.sum("cost_usd").alias("cost"))
    now = F.lit(newest(runs))
    since = limits.withColumn("since", F.when(F.col("period") == "day", local_day(now, zone)).otherwise(local_day(now, zone, "month")))
    spent = since.join(days, F.col("day") >= F.col("since"), "left").groupBy("period", "limit_usd").agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("spent"))
    used = F.try_divide(F.col("spent"), F.col("limit_usd"))
    state = F.when(F.col("limit_usd") < 0, "unlimited").when(used.isNull() | (used >= 1), "exhausted").when(used >= warn, "warn").otherwise("ok")
    return spent.select("period", "limit_usd", F.round("spent", 2).alias("spent"), state.alias("state"))


def monthly_active(events: DataFrame) -> DataFrame:
    """Distinct users per month with the growth on the month before in percent."""
    months = events.groupBy(F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.count_distinct("user_id").alias("users"))
    before = F.lag("users").over(Window.orderBy("month"))  # a row for each month: small at any size
    return months.select("month", "users", F.round(100.0 * (F.col("users") - before) / before, 1).alias("growth_pct"))


def session_runs(runs: DataFrame) -> DataFrame:
    """First close wins, a failure sticks: per agent and day the state that its runs leave, in order of time."""
    day = F.to_date("started_at").alias("day")
    rows = F.struct("started_at", "run_id", "status")
    return runs.groupBy("agent_id", day).agg(
        F.max(F.col("status") == "failed").alias("any_failed"), F.min(rows).alias("first"), F.max(F.when(F.col("status") != "cancelled", rows)).alias("last"), F.count("*").alias("n")
    ).select("agent_id", "day", "n", F.when(F.col("any_failed"), "failed").otherwise(F.col("first.status")).alias("final_status"), F.col("last.run_id").alias("last_run"))


def failure_streaks(runs: DataFrame) -> DataFrame:
    """The longest run of failures per agent, in order of time, and how many there are; anything else resets it.

    Windows are cut by agent and day; what touches a day's edge is put together over the agent's days, a row for each.
    """
    day = [F.col("agent_id"), F.to_date("started_at").alias("day")]
    rows = runs.select(*day, "started_at", "run_id", (F.col("status") == "failed").alias("failed"))
    own = Window.partitionBy("agent_id", "day")
    good = (~F.col("failed")).cast("long")
    rows = rows.withColumns({"block": F.sum(good).over(own.orderBy("started_at", "run_id")), "oks": F.sum(good).over(own)})
    streaks = rows.groupBy("agent_id", "day", "oks", "block").agg(F.count_if("failed").alias("n"))
    head, tail = F.col("block") == 0, F.col("block") == F.col("oks")
    n = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    inside = ~head & ~tail & (F.col("n") > 0)
    days = streaks.groupBy("agent_id", "day", "oks").agg(
        n(head & tail).alias("whole"), n(head & ~tail).alias("head"), n(tail & ~head).alias("tail"), F.max(F.when(inside, F.col("n"))).alias("longest"), F.count_if(inside).alias("streaks")
    )
    before = F.sum((F.col("oks") > 0).cast("long")).over(Window.partitionBy("agent_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumn("chain", F.coalesce(before, F.lit(0)))
    part = lambda chain, n: F.struct(chain.alias("chain"), n.alias("n"))
    edges = days.select("agent_id", F.explode(F.array(part(F.col("chain"), F.col("whole") + F.col("head")), part(F.col("chain") + 1, F.col("tail")))).alias("e"))
    chains = edges.groupBy("agent_id", "e.chain").agg(F.sum("e.n").alias("n")).where("n > 0").groupBy("agent_id").agg(F.max("n").alias("longest"), F.count("*").alias("streaks"))
    inner = days.groupBy("agent_id").agg(F.max("longest").alias("longest"), F.sum("streaks").alias("streaks"))
    both = inner.unionByName(chains).groupBy("agent_id").agg(F.max("longest").alias("longest"), F.sum("streaks").alias("streaks"))
    return both.where("streaks > 0")
