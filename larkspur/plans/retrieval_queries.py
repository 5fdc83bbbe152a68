"""Search over the embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import ann, retrieval
from larkspur.plans.registry import query, table

TERMS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9à-öø-ÿ]+'), lambda x: x <> '')"
SIMILAR = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 9)"
VECTOR = f"""v AS (SELECT q.vec_id AS query, e.vec_id AS id, {SIMILAR} AS similarity FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q),
vk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM v QUALIFY place <= 20)"""
TEXT = f"""t AS (SELECT doc_id AS id, {TERMS} AS w FROM documents),
tk AS (SELECT id, len(list_filter(w, lambda x: x IN ('the', 'that', 'shin'))) AS score FROM t WHERE list_has_all(w, ['the', 'that']) AND NOT list_contains(w, 'moron') AND list_contains(w, 'shin'))"""


def _queries(spark, sf_dir):
    """The query vectors: every row whose id is divisible by 50."""
    return _vectors(spark, sf_dir).where("id % 50 = 0")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("vec_topk", f"WITH {VECTOR} SELECT query, id, round(similarity, 6) AS similarity, place FROM vk")
def vec_topk(spark, sf_dir):
    best = retrieval.nearest(_vectors(spark, sf_dir), _queries(spark, sf_dir), 20)
    return best.select("query", "id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@query("vec_index")
def vec_index(spark, sf_dir):
    index = ann.indexed(_vectors(spark, sf_dir))
    best = ann.probed(index, _queries(spark, sf_dir), 20, probes=max(16, 2 * len(index.centroids) // 5))
    return best.select("query", "id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@query("vec_floor", f"WITH {VECTOR} SELECT query, count(*) AS n FROM vk WHERE similarity >= 0.3 GROUP BY query")
def vec_floor(spark, sf_dir):
    return retrieval.nearest(_vectors(spark, sf_dir), _queries(spark, sf_dir), 20, 0.3).groupBy("query").agg(F.count("*").alias("n"))


@query("nn_label", f"""WITH {VECTOR}
SELECT k.query, e.label FROM vk k JOIN embeddings e ON e.vec_id = k.id WHERE k.place = 2""")
def nn_label(spark, sf_dir):
    best = retrieval.nearest(_vectors(spark, sf_dir), _queries(spark, sf_dir), 2).where("place = 2")
    return best.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id").select("query", "label")


@query("text_search", f"WITH {TEXT} SELECT id, score::BIGINT AS score FROM tk ORDER BY score DESC, id LIMIT 20")
def text_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.text_search(docs, ["the", "that"], ["moron"], ["shin"], 20)


@query("rrf_hybrid", f"""WITH {VECTOR}, {TEXT}, x AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS place, id FROM (SELECT * FROM tk ORDER BY score DESC, id LIMIT 20)),
l AS (SELECT query, place, id FROM vk UNION ALL SELECT query, x.place, x.id FROM (SELECT DISTINCT query FROM vk), x)
SELECT query, id, round(sum(1.0::DOUBLE / (60 + place)), 6) AS score FROM l GROUP BY query, id""")
def rrf_hybrid(spark, sf_dir):
    """Every query vector's list fused with the list of one text query."""
    vector = retrieval.nearest(_vectors(spark, sf_dir), _queries(spark, sf_dir), 20).select("query", F.lit(0).alias("list"), "place", "id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = retrieval.text_search(docs, ["the", "that"], ["moron"], ["shin"], 20)
    place = F.row_number().over(retrieval.Window.orderBy(F.desc("score"), "id"))  # 20 rows
    text = found.select(F.lit(1).alias("list"), place.alias("place"), "id")
    own = _queries(spark, sf_dir).select(F.col("id").alias("query"), F.lit(1).alias("list")).join(F.broadcast(text), "list")  # 20 rows
    return retrieval.fused(vector.unionByName(own.select("query", "list", "place", "id")), by=["query"])


@query("term_counts", f"SELECT term, count(*) AS docs, sum(n)::BIGINT AS n FROM (SELECT doc_id, unnest({TERMS}) AS term, 1 AS n FROM documents) GROUP BY term HAVING count(DISTINCT doc_id) > 50".replace("count(*) AS docs", "count(DISTINCT doc_id) AS docs"))
def term_counts(spark, sf_dir):
    return retrieval.term_stats(table(spark, sf_dir, "documents").select("text")).where("docs > 50")


@query("memory_supersede", f"""
WITH o AS (SELECT vec_id AS vec_id, embedding, label, 'c' || (vec_id % 3) AS content FROM embeddings),
p AS (SELECT q.vec_id AS id, e.vec_id AS other, {SIMILAR} AS similarity, e.content = q.content AS same FROM (SELECT * FROM o WHERE vec_id % 50 = 0) q LEFT JOIN o e ON e.label = q.label AND e.vec_id <> q.vec_id),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) = 1)
SELECT id, CASE WHEN similarity >= 0.5 AND same THEN 'duplicate' WHEN similarity >= 0.5 THEN 'superseded' ELSE 'created' END AS action, CASE WHEN similarity >= 0.5 THEN other ELSE -1 END AS other FROM b""")
def memory_supersede(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")).alias("content"))
    return retrieval.superseded(rows, rows.where("id % 50 = 0"), ["label"], 0.5).withColumn("other", F.coalesce("other", F.lit(-1)))
