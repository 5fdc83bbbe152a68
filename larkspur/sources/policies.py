"""Policies and tasks as relations: nested settings (JSON) taken apart by Spark, and every fault in them listed.

Each policy is a row (policy, body); a table holds as many as there are tenants and versions. References between parts
are checked by anti-joins, so a policy with ten mistakes gets ten rows, and a good one none.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import answers

# What a policy may name, and what holds where it says nothing.
COMPLEXITIES = ("trivial", "simple", "medium", "hard", "critical")
VALIDATORS = ("none", "command", "review", "schema")
MOST_TIER = 7
ESCALATE_AFTER, LOW_CONFIDENCE, WARN_RATIO, MIN_SAMPLES, TARGET_RATE = 2, 0.5, 0.8, 10, 0.8

BODY = (
    "default_model string, escalate_after_failures int, low_confidence double, budget_warn_ratio double, learning struct<min_samples: int, target_success_rate: double>, ladder array<string>,"
    " models map<string, struct<tier: int, price: map<string, double>, requires_approval: boolean>>, task_types map<string, struct<validator: string, tier_by_complexity: map<string, string>, skills: array<string>>>,"
    " domain_default_task_type map<string, string>, domain_agent map<string, string>,"
    " agents map<string, struct<domain: string, default_model: string, max_tier: int, allowed_tenants: array<string>, allowed_tools: array<string>, deny_domains: array<string>>>"
)


def relations(policies: DataFrame) -> dict[str, DataFrame]:
    """The parts of policies (policy, body) as tables: settings, models, prices, ladder, task_types, starts,
    domain_types, domain_agents, agents, permissions. A body that is no JSON object is a policy without parts."""
    read = policies.select("policy", F.from_json("body", BODY).alias("b")).select("policy", "b.*")
    positive = lambda c, other: F.when(F.col(c) > 0, F.col(c)).otherwise(other)
    models = read.select("policy", F.explode("models").alias("model", "m")).select("policy", "model", "m.tier", "m.price", F.coalesce("m.requires_approval", F.lit(False)).alias("requires_approval"))
    types = read.select("policy", F.explode("task_types").alias("task_type", "t"))
    agents = read.select("policy", F.explode("agents").alias("agent", "a"))
    many = lambda kind, c: agents.select("policy", "agent", F.lit(kind).alias("kind"), F.explode(f"a.{c}").alias("value"))
    return {
        "settings": read.select(
            "policy", "default_model", positive("escalate_after_failures", ESCALATE_AFTER).alias("escalate_after_failures"), positive("low_confidence", LOW_CONFIDENCE).alias("low_confidence"),
            F.when((F.col("budget_warn_ratio") > 0) & (F.col("budget_warn_ratio") < 1), F.col("budget_warn_ratio")).otherwise(WARN_RATIO).alias("budget_warn_ratio"),
            positive("learning.min_samples", MIN_SAMPLES).alias("min_samples"), positive("learning.target_success_rate", TARGET_RATE).alias("target_success_rate"),
        ),
        "models": models.drop("price"), "prices": models.select("policy", "model", F.explode("price").alias("kind", "usd")),
        "ladder": read.select("policy", F.posexplode("ladder").alias("place", "model")), "task_types": types.select("policy", "task_type", "t.validator"),
        "starts": types.select("policy", "task_type", F.explode("t.tier_by_complexity").alias("complexity", "model")),
        "domain_types": read.select("policy", F.explode("domain_default_task_type").alias("domain", "task_type")), "domain_agents": read.select("policy", F.explode("domain_agent").alias("domain", "agent")),
        "agents": agents.select("policy", "agent", "a.domain", "a.default_model", "a.max_tier"), "permissions": reduce(DataFrame.unionByName, [many("tenant", "allowed_tenants"), many("tool", "allowed_tools"), many("deny", "deny_domains")]),
    }


def faults(policies: DataFrame, domains: list[str]) -> DataFrame:
    """policy, place and fault of everything in policies that doesn't fit together; domains are those that must have an
    agent."""
    r = relations(policies)
    known = r["models"].select("policy", "model")

    def told(rows: DataFrame, place: Column, fault: Column) -> DataFrame:
        return rows.select("policy", place.alias("place"), fault.alias("fault"))

    def no_model(rows: DataFrame, column: str, place: Column) -> DataFrame:
        named = rows.withColumn("_m", F.coalesce(column, F.lit("")))
        missing = named.join(known.withColumnRenamed("model", "_m"), ["policy", "_m"], "left_anti")
        return told(missing, place, F.concat(F.lit("unknown model "), F.col("_m")))

    s, ladder = r["settings"], r["ladder"].join(r["models"].select("policy", "model", "tier"), ["policy", "model"])
    below = ladder.alias("a").join(ladder.alias("b"), (F.col("a.policy") == F.col("b.policy")) & (F.col("a.place") == F.col("b.place") - 1) & (F.col("a.tier") > F.col("b.tier")))
    all_complexities = r["task_types"].select("policy", "task_type", F.explode(F.array(*map(F.lit, COMPLEXITIES))).alias("complexity"))
    all_domains = policies.select("policy", F.explode(F.array(*map(F.lit, domains))).alias("domain"))
    path = lambda *p: F.concat_ws(".", *p)
    return reduce(DataFrame.unionByName, [
        no_model(s, "default_model", F.lit("default_model")), no_model(r["ladder"], "model", path(F.lit("ladder"), F.col("place"))),
        told(s.join(r["ladder"].select("policy").distinct(), "policy", "left_anti"), F.lit("ladder"), F.lit("empty")),
        told(below.select("b.*"), path(F.lit("ladder"), F.col("place")), F.lit("a lower tier than before")),
        told(r["task_types"].where(~F.coalesce(F.col("validator").isin(*VALIDATORS), F.lit(False))), path(F.lit("task_types"), "task_type", F.lit("validator")), F.concat(F.lit("unknown validator "), F.coalesce("validator", F.lit("")))),
        told(all_complexities.join(r["starts"].select("policy", "task_type", "complexity"), ["policy", "task_type", "complexity"], "left_anti"), path(F.lit("task_types"), "task_type", "complexity"), F.lit("missing")),
        no_model(r["starts"].where(F.col("complexity").isin(*COMPLEXITIES)), "model", path(F.lit("task_types"), "task_type", "complexity")),
        told(r["domain_types"].join(r["task_types"].select("policy", "task_type"), ["policy", "task_type"], "left_anti"), path(F.lit("domain_default_task_type"), "domain"), F.concat(F.lit("unknown task type "), F.coalesce("task_type", F.lit("")))),
        told(all_domains.join(r["domain_agents"].select("policy", "domain"), ["policy", "domain"], "left_anti"), path(F.lit("domain_agent"), "domain"), F.lit("missing")),
        told(r["agents"].where(~F.coalesce(F.col("domain").isin(*domains), F.lit(False))), path(F.lit("agents"), "agent"), F.concat(F.lit("unknown domain "), F.coalesce("domain", F.lit("")))),
        no_model(r["agents"], "default_model", path(F.lit("agents"), "agent")),
        told(r["agents"].where(~F.coalesce(F.col("max_tier").between(1, MOST_TIER), F.lit(False))), path(F.lit("agents"), "agent"), F.lit(f"max_tier isn't 1 to {MOST_TIER}")),
    ])


def tasks(files: DataFrame, schema: Any, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tasks (path, key, category, body) of files (path, body) that fit the schema, by the order of categories, then key;
    and path and problem of what is wrong: a body that is no JSON object, faults by the schema, keys that are given twice."""
    judged = files.join(answers.schema_checks(files, schema, "path", "body"), "path")
    objects = F.json_object_keys("body").isNotNull()
    place = F.array_position(F.array(*map(F.lit, categories)), F.get_json_object("body", "$.category"))
    good = judged.where(objects & F.col("valid")).select("path", F.get_json_object("body", "$.key").alias("key"), F.get_json_object("body", "$.category").alias("category"), "body", place.alias("_place"))
    twice = good.groupBy("key").agg(F.min("path").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = good.join(twice, "key").where("path <> first").select("path", F.concat(F.lit("key "), "key", F.lit(" is given in "), "first", F.lit(" too")).alias("problem"))
    broken = judged.where(~F.coalesce(objects, F.lit(False))).select("path", F.lit("no JSON object").alias("problem"))
    wrong = judged.where(objects & ~F.col("valid")).select("path", F.explode("errors").alias("problem"))
    found = good.join(repeated, "path", "left_anti").orderBy("_place", "key").drop("_place")
    return found, broken.unionByName(wrong).unionByName(repeated)
