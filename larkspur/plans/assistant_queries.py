"""Benchmarks, the knowledge store, search as typed, categorised rows and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import numbers, texts
from larkspur.operators import answers, bench, contexts, finance, knowledge, search
from larkspur.plans.registry import query, table

BENCH = """WITH e AS (SELECT *, CAST(props ->> '$.k' AS INT) AS k FROM events),
b AS (SELECT event_type AS category, 'm' || user_id % 4 AS start_model, k % 3 = 0 AS success, CAST(value AS DECIMAL(18,2)) AS cost_usd, event_id % 700 AS input_tokens, k * 3 AS output_tokens, k % 6 AS iterations, k % 4 - 1 AS escalations,
  CASE k % 5 WHEN 0 THEN NULL ELSE k % 5 < 3 END AS router_task_type_ok, CASE k % 7 WHEN 0 THEN NULL ELSE k % 7 < 5 END AS router_domain_ok, CASE k % 11 WHEN 0 THEN '' WHEN 1 THEN 'timeout' END AS error,
  CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE '' END AS complexity FROM e)
"""


def _bench(spark, sf_dir):
    k = F.col("k")
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.select(
        F.col("event_type").alias("category"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("start_model"), (k % 3 == 0).alias("success"), F.col("value").cast("decimal(18,2)").alias("cost_usd"),
        (F.col("event_id") % 700).alias("input_tokens"), (k * 3).alias("output_tokens"), (k % 6).alias("iterations"), (k % 4 - 1).alias("escalations"),
        F.when(k % 5 != 0, k % 5 < 3).alias("router_task_type_ok"), F.when(k % 7 != 0, k % 7 < 5).alias("router_domain_ok"), F.when(k % 11 == 0, "").when(k % 11 == 1, "timeout").alias("error"),
        F.when(k % 3 == 0, "low").when(k % 3 == 1, "high").otherwise("").alias("complexity"),
    )


@query("bench_summary", BENCH + """
SELECT category, start_model, count(*) AS runs, count(*) FILTER (WHERE success) AS succeeded, round(avg(success::INT), 3) AS success_rate, sum(cost_usd)::DOUBLE AS total_cost_usd,
  round(sum(cost_usd)::DOUBLE / nullif(count(*) FILTER (WHERE success), 0), 9) AS cost_per_success_usd, round(avg(input_tokens + output_tokens), 6) AS avg_tokens, round(avg(iterations), 6) AS avg_iterations,
  round(avg((escalations > 0)::INT), 3) AS escalation_rate, round(avg(router_task_type_ok::INT), 3) AS router_task_type_accuracy, round(avg(router_domain_ok::INT), 3) AS router_domain_accuracy
FROM b WHERE error IS NULL GROUP BY 1, 2""")
def bench_summary(spark, sf_dir):
    return bench.summary(_bench(spark, sf_dir))


@query("bench_stats", BENCH + """, g AS (SELECT *, coalesce(error <> '', false) AS bad FROM b)
SELECT start_model, count(*) FILTER (WHERE NOT bad) AS runs, count(*) FILTER (WHERE NOT bad AND success) AS successes, count(*) FILTER (WHERE bad) AS errors, coalesce(sum(cost_usd) FILTER (WHERE NOT bad), 0)::DOUBLE AS total_cost_usd,
  round(avg(input_tokens + output_tokens) FILTER (WHERE NOT bad), 6) AS avg_tokens, round(avg((escalations > 0)::INT) FILTER (WHERE NOT bad), 6) AS escalation_rate, round(avg(router_domain_ok::INT) FILTER (WHERE NOT bad), 6) AS router_domain_accuracy,
  string_agg(DISTINCT nullif(complexity, ''), ',' ORDER BY nullif(complexity, '')) FILTER (WHERE NOT bad) AS complexities FROM g GROUP BY 1""")
def bench_stats(spark, sf_dir):
    return bench.stats(_bench(spark, sf_dir), F.col("start_model"))


@query("kb_stats", """
WITH d AS (SELECT doc_id, source AS tenant, CASE WHEN doc_id % 3 > 0 THEN lang END AS domain, 't' || doc_id % 2 AS source_type, doc_id % 5 > 0 AS active, n_chars FROM documents),
c AS (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT tenant, domain, source_type, count(*) FILTER (WHERE active) AS documents, count(*) FILTER (WHERE NOT active) AS inactive_documents, coalesce(sum(n), 0)::BIGINT AS chunks, max(n_chars) AS last_updated
FROM d LEFT JOIN c USING (doc_id) GROUP BY 1, 2, 3""")
def kb_stats(spark, sf_dir):
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        i.alias("document_id"), F.col("source").alias("tenant"), F.when(i % 3 > 0, F.col("lang")).alias("domain"), F.concat(F.lit("t"), (i % 2).cast("string")).alias("source_type"),
        F.when(i % 5 > 0, "active").otherwise("archived").alias("status"), F.col("n_chars").alias("updated_at"),
    )
    return knowledge.store_stats(docs, table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id")))


@query("ingest_actions", """
WITH n AS (SELECT doc_id AS uri, md5(coalesce(text, '')) AS hash, doc_id % 10 AS meta, doc_id % 17 > 0 AS supported, CASE WHEN doc_id % 19 = 0 THEN 'bad' END AS error FROM documents WHERE doc_id % 4 > 0),
s AS (SELECT doc_id AS uri, CASE WHEN doc_id % 7 = 0 THEN 'old' || doc_id ELSE md5(coalesce(text, '')) END AS hash, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id % 10 END AS meta FROM documents WHERE doc_id % 5 > 0),
j AS (SELECT coalesce(n.uri, s.uri) AS uri, n.hash, n.meta, supported, error, s.hash AS old_hash, s.meta AS old_meta, s.uri IS NOT NULL AS stored,
    n.hash IN (SELECT hash FROM s) AS held, (SELECT min(m.uri) FROM n m WHERE m.hash = n.hash) AS first FROM n FULL JOIN s ON n.uri = s.uri)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN supported IS NULL THEN 'prune' WHEN NOT supported THEN 'unsupported' WHEN error IS NOT NULL THEN 'error'
  WHEN stored AND hash = old_hash THEN CASE WHEN meta = old_meta THEN 'unchanged' ELSE 'metadata' END WHEN stored THEN 'updated' WHEN held OR first < uri THEN 'duplicate' ELSE 'new' END AS action FROM j) GROUP BY 1""")
def ingest_actions(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").withColumn("hash", F.md5(F.coalesce("text", F.lit(""))))
    incoming = rows.where(i % 4 > 0).select(i.alias("uri"), "hash", (i % 10).alias("meta"), (i % 17 > 0).alias("supported"), F.when(i % 19 == 0, "bad").alias("error"))
    store = rows.where(i % 5 > 0).select(
        i.alias("uri"), F.when(i % 7 == 0, F.concat(F.lit("old"), i.cast("string"))).otherwise(F.col("hash")).alias("hash"), F.when(i % 3 == 0, -1).otherwise(i % 10).alias("meta")
    )
    return knowledge.ingest_actions(incoming, store).groupBy("action").agg(F.count("*").alias("n"))


FOLDED = f"' ' || trim(regexp_replace(translate(lower(coalesce(text, '')), '{search.MARKED}', '{search.PLAIN}'), '[^a-z0-9ß]+', ' ', 'g')) || ' '"
TYPED = '"of the" that -moron or shin'
FOUND = f"""w AS (SELECT doc_id AS id, text, source, lang, {FOLDED} AS w FROM documents),
f AS (SELECT *, replace(w, ' ', '  ') AS x FROM w WHERE (contains(w, ' of the ') AND contains(w, ' that ') AND NOT contains(w, ' moron ')) OR contains(w, ' shin ')),
t AS (SELECT *, len(string_split(x, ' of  the ')) + len(string_split(x, ' that ')) + len(string_split(x, ' shin ')) - 3 AS score FROM f)"""


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


@query("websearch", f"WITH {FOUND} SELECT id, score::BIGINT AS score FROM t ORDER BY score DESC, id LIMIT 25")
def websearch(spark, sf_dir):
    return search.websearch(_documents(spark, sf_dir), TYPED, 25)


# The minimal covers as rows: where each wanted item last started, and where the latest complete stretch starts.
COVERS = """h AS (SELECT id, pos, x, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM
  (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM (SELECT id, string_split(trim({words}), ' ') AS l FROM {found})) WHERE x IN ('{of}', '{the}', '{that}', '{shin}')),
s AS (SELECT *, CASE WHEN x = '{the}' AND lag(x) OVER o = '{of}' AND lag(pos) OVER o = pos - 1 THEN k - 1 END AS phrase, CASE WHEN x = '{that}' THEN k END AS word, CASE WHEN x = '{shin}' THEN k END AS other FROM h
  WINDOW o AS (PARTITION BY id ORDER BY pos)),
m AS (SELECT *, max(phrase) OVER o AS a, max(word) OVER o AS b, max(other) OVER o AS c FROM s WINDOW o AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, greatest(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END, c) AS start FROM m),
n AS (SELECT *, coalesce(max(start) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
r AS (SELECT n.id, round(sum(0.1::DOUBLE / (1 + n.pos - h.pos - n.k + n.start)), 6) AS score FROM n JOIN h ON h.id = n.id AND h.k = n.start WHERE n.start > n.before GROUP BY 1)
SELECT id, score FROM r ORDER BY score DESC, id LIMIT 25"""


@query("cover_search", f"WITH {FOUND}, " + COVERS.format(words="w", found="f", of="of", the="the", that="that", shin="shin"))
def cover_search(spark, sf_dir):
    return search.ranked(_documents(spark, sf_dir), TYPED, 25)


STEM_SQL = "replace(w, 'ß', 'ss')"
for _pattern, _ending in search.ENDINGS:
    STEM_SQL = f"regexp_replace({STEM_SQL}, '{_pattern}', '\\1{_ending}', 'g')"
STEMMED = f"""w AS (SELECT doc_id AS id, {FOLDED} AS w FROM documents), z AS MATERIALIZED (SELECT id, {STEM_SQL} AS w FROM w),
f AS (SELECT * FROM z WHERE (contains(w, ' of the ') AND contains(w, ' that ') AND NOT contains(w, ' moron ')) OR contains(w, ' shin '))"""


@query("stemmed_search", f"WITH {STEMMED}, " + COVERS.format(words="w", found="f", of="of", the="the", that="that", shin="shin"))
def stemmed_search(spark, sf_dir):
    return search.ranked(_documents(spark, sf_dir), TYPED, 25, stemming=True)


@query("tenant_search", f"""WITH {FOUND.replace("FROM documents)", "FROM documents WHERE source IN ('s1', 'shared', (SELECT min(source) FROM documents)) AND doc_id % 6 > 0 AND (lang = 'en' OR doc_id % 4 = 0))")}
SELECT id, score::BIGINT AS score FROM t ORDER BY score DESC, id LIMIT 25""")
def tenant_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    least = docs.agg(F.min("source")).first()[0]
    i = F.col("doc_id")
    rows = docs.select(i.alias("id"), "text", F.col("source").alias("tenant"), F.when(i % 4 > 0, F.col("lang")).alias("domain"), F.when(i % 6 > 0, "active").otherwise("gone").alias("status"))
    scope = search.tenant_scope(least, True, (least, "shared"))
    return search.websearch(search.scoped(rows, [*scope, "s1"], "en", domain_strict=False), TYPED, 25)


@query("headline", """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
m AS (SELECT doc_id, w, list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z0-9ß]+', '', 'g') IN ('that', 'shin')) AS h FROM d),
p AS (SELECT *, list_position(h, true) AS a FROM m), s AS (SELECT *, CASE WHEN a > 0 THEN greatest(a - 6, 0) ELSE 0 END AS b FROM p)
SELECT doc_id, array_to_string(list_transform(range(b + 1, least(len(w), b + 15) + 1), lambda i: CASE WHEN h[i] THEN '«' || w[i] || '»' ELSE w[i] END), ' ') AS headline FROM s""")
def headline(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", search.headline(F.col("text"), "that or shin", most=1).alias("headline"))


CATEGORISED = "r AS (SELECT p_partkey AS row, p_type AS key, p_name AS text, CAST(p_retailprice AS DECIMAL(18,2)) AS amount, CASE WHEN p_size % 3 = 0 THEN p_brand END AS category FROM part)"


def _categorised(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row"), F.col("p_type").alias("key"), F.col("p_name").alias("text"), F.col("p_retailprice").cast("decimal(18,2)").alias("amount"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("category")
    )


@query("category_coverage", f"WITH {CATEGORISED} SELECT count(*) AS total_rows, count(category) AS categorized, count(*) - count(category) AS unknown, round(100.0::DOUBLE * count(category) / count(*), 1) AS coverage_pct FROM r")
def category_coverage(spark, sf_dir):
    return finance.coverage(_categorised(spark, sf_dir))


@query("unknown_groups", f"""WITH {CATEGORISED}, u AS (SELECT * FROM r WHERE category IS NULL), f AS (SELECT key, text, min(row) AS row FROM u GROUP BY 1, 2),
e AS (SELECT key, string_agg(text, '|' ORDER BY row) AS examples FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY row) <= 3) GROUP BY 1),
n AS (SELECT key, string_agg(row::VARCHAR, '|' ORDER BY row) AS rows FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY row) <= 10) GROUP BY 1)
SELECT key, count(*) AS count, sum(amount)::DOUBLE AS total, any_value(examples) AS examples, any_value(rows) AS rows FROM u JOIN e USING (key) JOIN n USING (key) GROUP BY key ORDER BY count DESC, abs(sum(amount)) DESC, key LIMIT 20""")
def unknown_groups(spark, sf_dir):
    return finance.unknown_groups(_categorised(spark, sf_dir))


@query("net_spend", """
SELECT o_orderpriority AS category, sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * round(CAST(o_totalprice AS DECIMAL(18,2)) * 100)::BIGINT)::BIGINT AS cents FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def net_spend(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "refund").when(F.col("o_orderstatus") == "O", "purchase").otherwise("income")
    return finance.net_spend(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("amount"), kind.alias("kind")))


@query("budget_severity", """
WITH c AS (SELECT c_mktsegment AS category, c_nationkey AS n, 40000.0::DOUBLE AS lim, round(sum(c_acctbal), 2) AS spent FROM customer GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN spent > lim THEN 'over' WHEN spent >= 0.8 * lim THEN 'warn' ELSE 'ok' END AS status FROM c)
SELECT status, count(*) AS n, round(sum(lim), 2) AS budgeted, round(sum(spent), 2) AS spent FROM s GROUP BY 1""")
def budget_severity(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("category"), "c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("spent")).withColumn("limit", F.lit(40000.0))
    status = F.when(F.col("spent") > F.col("limit"), "over").when(F.col("spent") >= 0.8 * F.col("limit"), "warn").otherwise("ok")
    return finance.status_totals(rows.withColumn("status", status))


@query("approvals_decided", """
WITH a AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'approved' ELSE 'pending' END AS status, CASE o_orderstatus WHEN 'P' THEN 'x' END AS decided_by FROM orders),
d AS (SELECT l_orderkey AS id, min(struct_pack(status := CASE l_returnflag WHEN 'R' THEN 'rejected' ELSE 'approved' END, decided_by := l_linestatus)) AS d FROM lineitem WHERE l_linenumber = 2 GROUP BY 1)
SELECT id, CASE WHEN status = 'pending' AND d IS NOT NULL THEN d.status ELSE status END AS status, CASE WHEN status = 'pending' AND d IS NOT NULL THEN d.decided_by ELSE decided_by END AS decided_by FROM a LEFT JOIN d USING (id)""")
def approvals_decided(spark, sf_dir):
    done = F.col("o_orderstatus") == "P"
    approvals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(done, "approved").otherwise("pending").alias("status"), F.when(done, "x").alias("decided_by"))
    decisions = table(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("approved").alias("status"), F.col("l_linestatus").alias("decided_by"))
    return knowledge.decided(approvals, decisions)


@query("project_upserts", """
WITH p AS (SELECT c_custkey AS slug, 't' || c_nationkey % 3 AS tenant, c_name AS name FROM customer WHERE c_custkey % 3 > 0),
r AS (SELECT c_custkey AS slug, 't' || CASE WHEN c_custkey % 5 = 0 THEN 7 ELSE c_nationkey % 3 END AS tenant, CASE WHEN c_custkey % 4 > 0 THEN upper(c_mktsegment) END AS name FROM customer WHERE c_custkey % 2 = 0)
SELECT slug, coalesce(p.tenant, r.tenant) AS tenant, CASE WHEN p.slug IS NULL THEN r.name WHEN p.tenant = r.tenant THEN coalesce(r.name, p.name) ELSE p.name END AS name,
  CASE WHEN p.slug IS NULL THEN 'inserted' WHEN r.slug IS NULL THEN 'kept' WHEN p.tenant <> r.tenant THEN 'conflict' ELSE 'updated' END AS action FROM p FULL JOIN r USING (slug)""".replace("SELECT slug,", "SELECT coalesce(p.slug, r.slug) AS slug,").replace("USING (slug)", "ON p.slug = r.slug"))
def project_upserts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    tenant = lambda x: F.concat(F.lit("t"), x.cast("string")).alias("tenant")
    projects = rows.where(k % 3 > 0).select(k.alias("slug"), tenant(n % 3), F.col("c_name").alias("name"))
    new = rows.where(k % 2 == 0).select(k.alias("slug"), tenant(F.when(k % 5 == 0, 7).otherwise(n % 3)), F.when(k % 4 > 0, F.upper("c_mktsegment")).alias("name"))
    return knowledge.project_upserts(projects, new)


@query("scalar_checks", """
SELECT page_id, regexp_matches(url, '^[a-z][a-z0-9+.-]*://[^\\s]+$') AS is_uri, regexp_full_match(split_part(url, '/', 4), '[a-z0-9]+(-[a-z0-9]+)*') AS is_slug,
  round(1000 + 1000 * (pow(1.1, page_id / 365.0::DOUBLE) - 1) * 0.85, 2) AS grown FROM pages""")
def scalar_checks(spark, sf_dir):
    i = F.col("page_id")
    part = F.coalesce(F.try_element_at(F.split("url", "/"), F.lit(4)), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", texts.is_uri(F.col("url")).alias("is_uri"), texts.is_slug(part).alias("is_slug"), numbers.grown(F.lit(1000.0), F.lit(0.1), i, F.lit(0.15)).alias("grown"))


ANSWER_SCHEMA = {"type": "object", "required": ["k", "who"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 80}}}


@query("schema_checks", """
WITH e AS (SELECT event_id, CAST(props ->> '$.k' AS INT) AS k, event_id % 3 AS r FROM events),
f AS (SELECT *, r < 2 AS whole, CASE WHEN r < 2 THEN [] ELSE ['<root>: ''who'' is a required property'] END || CASE WHEN k < 10 THEN ['k: ' || k || ' is less than the minimum of 10'] WHEN k > 80 THEN ['k: ' || k || ' is greater than the maximum of 80'] ELSE [] END AS faults FROM e)
SELECT event_id, r > 0 AND len(faults) = 0 AS valid, CASE WHEN r > 0 AND len(faults) = 0 THEN '{"k": ' || k || ', "who": "u"}' ELSE '' END AS value,
  CASE WHEN r = 0 THEN 'no JSON value found in the answer' ELSE array_to_string(faults, '; ') END AS errors FROM f""")
def schema_checks(spark, sf_dir):
    k, r = F.get_json_object("props", "$.k"), F.col("event_id") % 3
    text = F.when(r == 0, F.concat(F.lit("k is "), k)).when(r == 1, F.concat(F.lit('So [it] is {"k": '), k, F.lit(', "who": "u"}, I think {'))).otherwise(F.concat(F.lit('```json\n{"k": '), k, F.lit("}\n```")))
    found = answers.schema_checks(table(spark, sf_dir, "events").select("event_id", text.alias("text")), ANSWER_SCHEMA, "event_id")
    return found.select("event_id", "valid", F.coalesce("value", F.lit("")).alias("value"), F.array_join("errors", "; ").alias("errors"))


@query("contexts")
def compiled_contexts(spark, sf_dir):
    """A context for every vector whose id is divisible by 50, of all vectors as memories and the documents of its id's
    neighbourhood as hits."""
    i = F.col("vec_id")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    scope = pick(["global", "domain", "project"], i)
    rows = table(spark, sf_dir, "embeddings").select(
        i.alias("id"), pick(["a", "b", "shared"], F.col("label")).alias("tenant"), scope.alias("scope"), F.when(scope == "domain", pick(["x", "y"], F.col("label"))).alias("domain"),
        F.when(scope == "project", pick(["p", "q"], F.col("label"))).alias("project"), pick([*contexts.STANDING, *contexts.DECISIONS, "fact"], F.floor(i / 3)).alias("kind"),
        F.concat(F.lit("memory "), i.cast("string")).alias("content"), ((i % 11) / 10).alias("importance"), i.alias("created_at"), F.col("embedding").alias("vector"),
    )
    asked = rows.where("id % 50 = 0")
    requests = asked.select(
        F.col("id").alias("request"), F.array(F.col("tenant"), F.lit("shared")).alias("tenants"), F.lit("x").alias("domain"), F.lit("p").alias("project"), F.col("content").alias("task"), F.lit(None).cast("string").alias("project_text"), "vector", F.lit(300).alias("budget")
    )
    docs = table(spark, sf_dir, "documents").select((F.floor(F.col("doc_id") / 50) * 50).alias("request"), F.col("doc_id").alias("id"), F.col("text").alias("content"), texts.snippet(F.col("text")).alias("snippet"), (F.col("doc_id") % 50).cast("double").alias("score"))
    found = contexts.compiled(rows, requests, docs.join(requests.select("request"), "request", "left_semi"))
    return found.select("request", "used", "dropped", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["bucket"], x["id"], x["cost"])), " ").alias("items"))
