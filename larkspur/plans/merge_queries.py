"""Conditional writes over events: approvals, links of decisions, kept answers, planned backends."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import joins, knowledge, merges, routing
from larkspur.plans.registry import query, table

APPROVALS = """WITH e AS (SELECT event_id, user_id % 40 AS s, CASE event_id % 3 WHEN 0 THEN 'tier' WHEN 1 THEN 'tool' ELSE 'cost' END AS kind, CASE WHEN event_id % 4 > 0 THEN 'm' || event_id % 5 END AS model, floor(epoch(ts))::BIGINT AS t FROM events),
a AS (SELECT event_id AS id, s AS session, kind, model, CASE WHEN event_id % 2 = 0 THEN 'pending' ELSE 'rejected' END AS status, t AS created_at FROM e WHERE event_id % 11 = 0),
r AS (SELECT event_id AS id, s AS session, kind, model, t FROM e WHERE event_id % 11 > 0)"""


def _events(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("id"), (F.col("user_id") % 40).alias("session"), F.when(i % 3 == 0, "tier").when(i % 3 == 1, "tool").otherwise("cost").alias("kind"),
        F.when(i % 4 > 0, F.concat(F.lit("m"), (i % 5).cast("string"))).alias("model"), F.unix_timestamp("ts").alias("at"),
    )


def _approvals(spark, sf_dir):
    return _events(spark, sf_dir).where("id % 11 = 0").select(
        "id", "session", "kind", "model", F.when(F.col("id") % 2 == 0, "pending").otherwise("rejected").alias("status"), F.lit(None).cast("string").alias("decided_by"), F.lit(None).cast("long").alias("decided_at"),
        F.col("at").alias("created_at"), (F.col("at") + 7 * 86_400).alias("expires_at"),
    )


@query("approvals_opened", APPROVALS + """,
f AS (SELECT * FROM r WHERE NOT EXISTS (FROM a WHERE a.status = 'pending' AND a.session = r.session AND a.kind = r.kind AND a.model IS NOT DISTINCT FROM r.model) QUALIFY row_number() OVER (PARTITION BY session, kind, model ORDER BY t, id) = 1)
SELECT id, session, kind, model, status, created_at, created_at + 604800 AS expires_at FROM (SELECT id, session, kind, model, status, created_at FROM a UNION ALL SELECT id, session, kind, model, 'pending', t FROM f)""")
def approvals_opened(spark, sf_dir):
    requests = _events(spark, sf_dir).where("id % 11 > 0")
    return merges.approvals_opened(_approvals(spark, sf_dir), requests).drop("decided_by", "decided_at")


@query("approvals_resolved", APPROVALS + """,
d AS (SELECT a.id, r.t, r.id % 3 > 0 AS approve FROM r JOIN a ON a.id = r.id - r.id % 11 WHERE r.id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY r.t, 'u' || r.id % 7, r.id % 3 > 0) = 1),
n AS (SELECT a.session, d.t, a.id, a.kind = 'tier' AND a.model IS NOT NULL AND approve AS moves, NOT approve AS no, a.model FROM a JOIN d USING (id) WHERE status = 'pending'),
x AS (SELECT session, count(*) FILTER (WHERE moves) AS m, arg_max(model, (t, id)) FILTER (WHERE moves) AS last, min((t, id)) FILTER (WHERE moves) AS fm, min((t, id)) FILTER (WHERE no) AS fn FROM n GROUP BY 1),
u AS (SELECT s AS session, CASE WHEN s % 2 = 0 THEN 'blocked' ELSE 'running' END AS status FROM e GROUP BY 1, 2)
SELECT u.session, CASE WHEN m > 0 THEN last ELSE 'm0' END AS model, CASE WHEN m > 0 THEN 'running' WHEN u.status = 'blocked' AND fn IS NOT NULL THEN 'failed' ELSE u.status END AS status, coalesce(m, 0)::INT AS escalations,
  CASE WHEN m > 0 THEN 0 ELSE 2 END AS failures, CASE WHEN u.status = 'blocked' AND fn IS NOT NULL AND (coalesce(m, 0) = 0 OR fn < fm) THEN fn[1] END AS ended_at FROM u LEFT JOIN x USING (session)""")
def approvals_resolved(spark, sf_dir):
    rows = _events(spark, sf_dir)
    i = F.col("id")
    decisions = rows.where("id % 11 > 0 AND id % 2 = 0").select((i - i % 11).alias("id"), (i % 3 > 0).alias("approve"), F.concat(F.lit("u"), (i % 7).cast("string")).alias("by"), "at")
    runs = rows.select("session").distinct().select(
        "session", F.lit("m0").alias("model"), F.lit(0).alias("tier"), F.when(F.col("session") % 2 == 0, "blocked").otherwise("running").alias("status"),
        F.lit(0).alias("escalations"), F.lit(2).alias("failures"), F.lit(None).cast("long").alias("ended_at"),
    )
    tier = F.substring("moved", 2, 1).cast("int")
    return merges.approvals_resolved(_approvals(spark, sf_dir), runs, decisions, tier)[1].drop("tier")


@query("links_cleared", """
WITH d AS (SELECT event_id, CASE WHEN event_id % 6 > 0 THEN user_id * 3 END AS run_id, CASE WHEN event_id % 5 > 0 THEN event_id * 2 END AS task_id FROM events),
k AS (SELECT *, (run_id IS NULL OR run_id IN (SELECT c_custkey FROM customer)) AND (task_id IS NULL OR task_id IN (SELECT o_orderkey FROM orders)) AS whole FROM d)
SELECT event_id, CASE WHEN whole THEN run_id END AS run_id, CASE WHEN whole THEN task_id END AS task_id FROM k""")
def links_cleared(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(i, F.when(i % 6 > 0, F.col("user_id") * 3).alias("run_id"), F.when(i % 5 > 0, i * 2).alias("task_id"))
    parents = {"run_id": table(spark, sf_dir, "customer").select("c_custkey"), "task_id": table(spark, sf_dir, "orders").select("o_orderkey")}
    return merges.links_cleared(rows, parents)


@query("answer_cache", """
WITH RECURSIVE q AS (SELECT event_id AS id, CASE WHEN user_id % 9 > 0 THEN event_type || user_id % 5 END AS key, floor(epoch(ts))::BIGINT AS t, event_id % 4 = 0 AS human, event_id % 7 = 0 AS failed FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, id) AS n FROM q WHERE key IS NOT NULL),
s AS (SELECT key, min(n) AS n FROM o WHERE NOT human AND NOT failed GROUP BY key
  UNION ALL SELECT s.key, (SELECT min(x.n) FROM o x WHERE x.key = s.key AND x.t >= p.t + 43200 AND NOT x.human AND NOT x.failed) FROM s JOIN o p ON p.key = s.key AND p.n = s.n),
k AS (SELECT o.key, o.n, o.t FROM s JOIN o USING (key, n)),
h AS (SELECT q.id, count(*) AS hits FROM o q JOIN k ON k.key = q.key AND k.n < q.n AND q.t < k.t + 43200 GROUP BY 1)
SELECT q.id, q.key, coalesce(hits, 0) > 0 AS cached FROM q LEFT JOIN h USING (id)""")
def answer_cache(spark, sf_dir):
    i, user = F.col("event_id"), F.col("user_id")
    key = F.when(user % 9 > 0, F.concat("event_type", (user % 5).cast("string")))
    rows = table(spark, sf_dir, "events").select(i.alias("id"), key.alias("key"), F.unix_timestamp("ts").alias("at"), (i % 4 == 0).alias("needs_human"), (i % 7 == 0).alias("failed"))
    return merges.cached(rows, 43_200).select("id", "key", "cached")


@query("planned_cascade", """
WITH q AS (SELECT event_id AS question, value / 200 AS v, CASE event_id % 4 WHEN 0 THEN ['model', 'rule', 'model'] WHEN 1 THEN ['rule'] WHEN 2 THEN [] END AS own, event_id % 5 = 0 AS images FROM events),
p AS (SELECT question, v, CASE WHEN images THEN ['vision'] ELSE [] END || CASE WHEN len(own) > 0 THEN own ELSE ['rule', 'model', 'vision'] END AS l FROM q),
b AS (SELECT question, v, list_filter(l, lambda x, i: list_position(l, x) = i) AS plan FROM p),
s AS (SELECT question, plan, x AS backend, i - 1 AS place, CASE x WHEN 'rule' THEN v WHEN 'model' THEN 1 - v ELSE 0.3 END AS confidence FROM (SELECT question, v, plan, unnest(plan) AS x, generate_subscripts(plan, 1) AS i FROM b)),
w AS (SELECT *, min(CASE WHEN confidence >= 0.6 THEN place END) OVER (PARTITION BY question) AS stop FROM s),
a AS (SELECT * FROM w WHERE stop IS NULL OR place <= stop)
SELECT question, array_to_string(any_value(plan), ',') AS plan, arg_max(backend, (confidence, -place)) AS backend, count(*) AS asked, max(confidence) < 0.6 AS needs_human FROM a GROUP BY question""")
def planned_cascade(spark, sf_dir):
    i = F.col("event_id")
    own = F.when(i % 4 == 0, F.array(F.lit("model"), F.lit("rule"), F.lit("model"))).when(i % 4 == 1, F.array(F.lit("rule"))).when(i % 4 == 2, F.array().cast("array<string>"))
    questions = table(spark, sf_dir, "events").select(i.alias("question"), (F.col("value") / 200).alias("v"), merges.plan(own, i % 5 == 0, ["rule", "model", "vision"], "vision")["plan"].alias("plan"))
    says = lambda confidence: lambda q: q.select("question", F.lit("yes").alias("answer"), confidence.alias("confidence"), F.lit(False).alias("refused"))
    backends = {"rule": says(F.col("v")), "model": says(1 - F.col("v")), "vision": says(F.lit(0.3).cast("double"))}
    told = routing.planned_cascade(questions, backends, 0.6).select("question", "backend", "asked", "needs_human")
    return told.join(questions.select("question", F.array_join("plan", ",").alias("plan")), "question")


@query("last_ingests", """
SELECT 't' || user_id % 4 AS tenant, max(floor(epoch(ts))::BIGINT) AS last_ingest FROM events WHERE event_id % 3 > 0 AND event_type = 'signup' GROUP BY 1""")
def last_ingests(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant"), F.when(F.col("event_id") % 3 > 0, "kb").otherwise("web").alias("source"),
        F.when(F.col("event_type") == "signup", "kb.ingest").otherwise(F.col("event_type")).alias("type"), F.unix_timestamp("ts").alias("occurred_at"),
    )
    return knowledge.last_ingests(rows)


@query("memories_listed", """
SELECT vec_id AS id, (vec_id % 11) / 10 AS importance, label AS created_at FROM embeddings ORDER BY importance DESC, created_at DESC, id LIMIT 100""")
def memories_listed(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), ((F.col("vec_id") % 11) / 10).alias("importance"), F.col("label").alias("created_at"))
    return merges.memories_listed(rows)


TYPED_RULES = [("article", "The"), ("pair", "of the"), ("and", "and"), ("odd", "re: sh[aeiou]{2,}n"), ("french", "\u00e0 l\u00e0")]


@query("typed_categories", """
WITH d AS (SELECT doc_id, translate(lower(coalesce(text, '')), '\u00e1\u00e0\u00e2\u00e3\u00e4\u00e5\u00e9\u00e8\u00ea\u00eb\u00ed\u00ec\u00ee\u00ef\u00f3\u00f2\u00f4\u00f5\u00f6\u00fa\u00f9\u00fb\u00fc\u00fd\u00ff\u00e7\u00f1', 'aaaaaaeeeeiiiiooooouuuuyycn') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract(t, 'sh[aeiou]{2,}n') AS odd, regexp_matches(t, '(^|[^a-z0-9])of the($|[^a-z0-9])') AS pair, regexp_matches(t, '(^|[^a-z0-9])the($|[^a-z0-9])') AS article,
  regexp_matches(t, '(^|[^a-z0-9])and($|[^a-z0-9])') AS y, regexp_matches(t, '(^|[^a-z0-9])a la($|[^a-z0-9])') AS french FROM d)
SELECT doc_id, CASE WHEN pair AND length(odd) <= 6 THEN 'pair' WHEN odd <> '' THEN 'odd' WHEN french THEN 'french' WHEN article THEN 'article' WHEN y THEN 'and' END AS category FROM m""")
def typed_categories(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return joins.categorize_typed(docs, TYPED_RULES, F.col("text")).select("doc_id", "category")
