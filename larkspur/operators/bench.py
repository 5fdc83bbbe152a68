"""What a benchmark of the assistant showed: runs by any keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(flag: Column) -> Column:
    """The share of true among those that aren't null."""
    return F.avg(flag.cast("int"))


def summary(runs: DataFrame) -> DataFrame:
    """Runs without an error by category and first model."""
    return runs.where("error IS NULL").groupBy("category", "start_model").agg(
        F.count("*").alias("runs"), F.count_if("success").alias("succeeded"), F.round(_share(F.col("success")), 3).alias("success_rate"),
        F.sum("cost_usd").cast("double").alias("total_cost_usd"), F.round(F.try_divide(F.sum("cost_usd").cast("double"), F.count_if("success")), 9).alias("cost_per_success_usd"),
        F.round(F.avg(F.col("input_tokens") + F.col("output_tokens")), 6).alias("avg_tokens"), F.round(F.avg("iterations"), 6).alias("avg_iterations"),
        F.round(_share(F.col("escalations") > 0), 3).alias("escalation_rate"), F.round(_share(F.col("router_task_type_ok")), 3).alias("router_task_type_accuracy"),
        F.round(_share(F.col("router_domain_ok")), 3).alias("router_domain_accuracy"),
    )


def stats(runs: DataFrame, *keys: Column) -> DataFrame:
    """The same by any keys, with errors counted apart; here an empty error is none, other than in `summary`."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    own = lambda c: F.when(~failed, c)
    return runs.groupBy(*keys).agg(
        F.count(own(F.lit(1))).alias("runs"), F.count_if(~failed & F.coalesce("success", F.lit(False))).alias("successes"), F.count_if(failed).alias("errors"),
        F.coalesce(F.round(F.sum(own(F.col("cost_usd"))), 6), F.lit(0)).cast("double").alias("total_cost_usd"),
        F.round(F.avg(own(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))), 6).alias("avg_tokens"),
        F.round(_share(own(F.coalesce("escalations", F.lit(0)) > 0)), 6).alias("escalation_rate"), F.round(_share(own(F.col("router_domain_ok"))), 6).alias("router_domain_accuracy"),
        F.array_join(F.sort_array(F.collect_set(own(F.nullif("complexity", F.lit(""))))), ",").alias("complexities"),
    )


def better_routes(suggested: DataFrame, routing: DataFrame) -> DataFrame:
    """Rows of a routing table (task_type, complexities, model) that suggestions (task_type, complexity, model) change,
    one for each of their complexities."""
    rows = routing.select("task_type", F.explode("complexities").alias("complexity"), F.col("model").alias("from_model"))
    return rows.join(suggested, ["task_type", "complexity"]).where("model != from_model").select("task_type", "complexity", "from_model", F.col("model").alias("to_model"))
