"""Joins, set operations and top lists over the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import joins
from larkspur.plans.registry import query, table

NET = "l_extendedprice * (1 - l_discount)"


@query("top_products", """
SELECT p_partkey, p_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE o_orderstatus = 'F' GROUP BY ALL ORDER BY revenue DESC, p_partkey LIMIT 10""")
def top_products(spark, sf_dir):
    closed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    sold = table(spark, sf_dir, "lineitem").join(closed, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(F.round(F.sum(F.expr(NET)), 2).alias("revenue"))
    # The names are joined to the totals, a row for each part, not to every line.
    named = sold.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return named.select("p_partkey", "p_name", "revenue").orderBy(F.desc("revenue"), "p_partkey").limit(10)


@query("top_customers", """
SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS spent, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY spent DESC, c_custkey LIMIT 20""")
def top_customers(spark, sf_dir):
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count("*").alias("orders"))
    named = spent.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return named.select("c_custkey", "c_name", "spent", "orders").orderBy(F.desc("spent"), "c_custkey").limit(20)


@query("reconcile_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def reconcile_anti(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return joins.unmatched(customers, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("reconcile_two_keys", """
SELECT l_orderkey, l_shipdate::DATE::VARCHAR AS day, count(*) AS lines FROM lineitem WHERE NOT EXISTS
  (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND date_diff('day', o_orderdate::DATE, l_shipdate::DATE) = 30) GROUP BY ALL""")
def reconcile_two_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("day"))
    due = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_add(F.to_date("o_orderdate"), 30).alias("day"))
    return joins.unmatched(lines, due, ["l_orderkey", "day"]).groupBy("l_orderkey", "day").agg(F.count("*").alias("lines"))


@query("semi_active", "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') GROUP BY 1")
def semi_active(spark, sf_dir):
    active = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(active, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


@query("left_join_counts", """
SELECT n_name, r_name, count(c_custkey) AS customers, round(coalesce(sum(c_acctbal), 0), 2) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def left_join_counts(spark, sf_dir):
    by_nation = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = places.join(by_nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.round(F.coalesce("balance", F.lit(0.0)), 2).alias("balance"))


@query("overlap_join", """
WITH s AS (SELECT event_id AS id, user_id, epoch(ts) AS a, epoch(ts) + value AS b FROM events WHERE event_type = 'view'),
t AS (SELECT user_id, event_type AS label, epoch(ts) - 60 AS a, epoch(ts) + 3600 AS b FROM events WHERE event_type <> 'view'),
o AS (SELECT s.user_id, id, label, round(sum(least(s.b, t.b) - greatest(s.a, t.a)), 6) AS seconds FROM s JOIN t ON s.user_id = t.user_id AND s.a < t.b AND t.a < s.b GROUP BY ALL),
w AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY user_id, id ORDER BY seconds DESC, label) = 1)
SELECT s.user_id, s.id, w.label, round(w.seconds, 3) AS seconds FROM s LEFT JOIN w ON w.user_id = s.user_id AND w.id = s.id""")
def overlap_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    segments = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), F.col("at").alias("start"), (F.col("at") + F.col("value")).alias("end"))
    turns = events.where("event_type <> 'view'").select("user_id", F.col("event_type").alias("label"), (F.col("at") - 60).alias("start"), (F.col("at") + 3600).alias("end"))
    return joins.best_overlap(segments, turns, 600.0, ["user_id"], earliest=False).withColumn("seconds", F.round("seconds", 3))


RULES = [("transport", "the"), ("food", "tion[a-z]*"), ("home", "er[a-z]+"), ("other", "[a-z]+ing")]


@query("rule_categorize", """
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
m AS (SELECT doc_id, [{'n': length(regexp_extract(t, '(the)', 1)), 'o': 0, 'c': 'transport', 'r': 'the'}, {'n': length(regexp_extract(t, '(tion[a-z]*)', 1)), 'o': -1, 'c': 'food', 'r': 'tion[a-z]*'},
  {'n': length(regexp_extract(t, '(er[a-z]+)', 1)), 'o': -2, 'c': 'home', 'r': 'er[a-z]+'}, {'n': length(regexp_extract(t, '([a-z]+ing)', 1)), 'o': -3, 'c': 'other', 'r': '[a-z]+ing'}] AS l FROM t),
b AS (SELECT doc_id, list_max(list_filter(l, lambda x: x.n > 0)) AS b FROM m)
SELECT doc_id, b.c AS category, b.r AS rule FROM b""")
def rule_categorize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return joins.categorize(docs, RULES, F.lower(F.coalesce("text", F.lit("")))).select("doc_id", "category", "rule")


@query("upsert_customers", """
WITH new AS (SELECT c_custkey + 100 AS c_custkey, 'new' AS c_name, CASE WHEN c_custkey % 2 = 0 THEN 'X' END AS c_mktsegment FROM customer WHERE c_custkey % 10 = 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.c_name ELSE n.c_name END AS c_name,
  CASE WHEN n.c_custkey IS NULL THEN o.c_mktsegment ELSE coalesce(n.c_mktsegment, o.c_mktsegment) END AS c_mktsegment,
  CASE WHEN o.c_custkey IS NULL THEN 'created' WHEN n.c_custkey IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM (SELECT c_custkey, c_name, c_mktsegment FROM customer) o FULL JOIN new n USING (c_custkey)""")
def upsert_customers(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = old.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 100).alias("c_custkey"), F.lit("new").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, "X").alias("c_mktsegment"))
    return joins.upsert(old, new, ["c_custkey"], keep=("c_mktsegment",))


@query("insert_absent", "SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey + 1000000000, min(o_custkey) FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1")
def insert_absent(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    new = old.where("o_orderkey % 7 = 0")
    return joins.insert_if_absent(old, new.unionByName(new.withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)), "o_orderkey")


@query("prune_pages", """
SELECT page_id, CASE WHEN (starts_with(url, 'http://m.') OR starts_with(url, 'https://m.')) AND page_id % 3 <> 0 THEN 'deleted' ELSE 'active' END AS status FROM pages""")
def prune_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat_ws("\x01", "url", "page_id").alias("uri"), F.lit("active").alias("status"))
    seen = pages.where("page_id % 3 = 0").select("uri")
    return joins.prune(pages, seen, "uri", ["http://m.", "https://m."]).select("page_id", "status")


@query("metadata_changes", "SELECT doc_id, source FROM documents WHERE doc_id % 5 = 0 OR lang IS DISTINCT FROM (CASE WHEN lang = 'en' THEN 'en' ELSE NULL END)")
def metadata_changes(spark, sf_dir):
    new = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    old = new.where("doc_id % 5 <> 0").withColumn("lang", F.when(F.col("lang") == "en", "en"))
    return joins.changed(old, new, "doc_id", ["lang", "source"]).select("doc_id", "source")


@query("set_difference", """
SELECT l_partkey AS k, 'left' AS side FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_discount > 0.05)
UNION ALL SELECT l_partkey, 'right' FROM (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def set_difference(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return joins.set_difference(lines.where("l_quantity > 45").select(F.col("l_partkey").alias("k")), lines.where("l_discount > 0.05").select(F.col("l_partkey").alias("k")))


@query("explode_json", "SELECT j.key, count(*) AS n, sum(CAST(j.value AS BIGINT))::BIGINT AS total FROM events, json_each(props::JSON) AS j GROUP BY j.key")
def explode_json(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,bigint>")))
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("quality_join", "SELECT lang, quality, toxic, count(*) AS docs, round(avg(n_chars), 4) AS avg_chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def quality_join(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("lang", "quality", "toxic").agg(F.count("*").alias("docs"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))


@query("ladder_next", """
SELECT p_partkey, p_brand, coalesce(lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey), -1) AS next_part FROM part""")
def ladder_next(spark, sf_dir):
    order = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.coalesce(F.lead("p_partkey").over(order), F.lit(-1)).alias("next_part"))


@query("collision_names", """
SELECT s_suppkey, name || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS name FROM
  (SELECT s_suppkey, 's' || s_nationkey AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)""")
def collision_names(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("s"), "s_nationkey").alias("base"), n.alias("n"))
    return rows.select("s_suppkey", F.concat("base", F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("_"), "n"))).alias("name"))
