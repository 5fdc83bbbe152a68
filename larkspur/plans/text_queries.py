"""Documents, pages and conversations as texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import texts
from larkspur.operators import chunking, passages
from larkspur.plans.registry import query, table


@query("content_hash", "SELECT doc_id, sha256('1' || chr(10) || coalesce(text, '')) AS hash, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.content_hash(F.col("text")).alias("hash"), texts.token_estimate(F.col("text")).alias("tokens"))


@query("doc_dedup", "SELECT sha256(text) AS hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1")
def doc_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))


@query("lang_stats", "SELECT lang, source, count(*) AS docs, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY ALL")
def lang_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("lang_rollup", "SELECT lang, source, count(*) AS docs FROM documents GROUP BY ROLLUP (lang, source)")
def lang_rollup(spark, sf_dir):
    """An extension: totals at every level."""
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("docs"))


@query("route_normalize", """
SELECT array_to_string(list_transform(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '{id}' ELSE x END), '/') AS route, count(*) AS pages
FROM pages GROUP BY 1""")
def route_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(texts.route(F.col("url")).alias("route")).agg(F.count("*").alias("pages"))


@query("snippets", """
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 280 THEN t ELSE regexp_extract(substr(t, 1, 281), '^(.*)\\s', 1) END AS snippet FROM f""")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.snippet(F.col("text")).alias("snippet"))


@query("conv_runs", """
WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations)
SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE before IS NULL OR role <> before) AS runs, arg_min(role, (turn, role)) AS first_role, arg_max(role, (turn, role)) AS last_role FROM t GROUP BY conv_id""")
def conv_runs(spark, sf_dir):
    """Runs of turns by one role, and the first and the last role."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = table(spark, sf_dir, "conversations").withColumn("before", before)
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count(F.when(F.col("before").isNull() | (F.col("role") != F.col("before")), 1)).alias("runs"),
        F.min_by("role", F.struct("turn", "role")).alias("first_role"), F.max_by("role", F.struct("turn", "role")).alias("last_role"),
    )


@query("srt_times", """
SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS at FROM (SELECT event_id, round(value * 1000)::BIGINT AS ms FROM events)""")
def srt_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", texts.srt_time(F.col("value")).alias("at"))


@query("chunk_docs")
def chunk_docs(spark, sf_dir):
    return passages.chunked(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", "chunk_index", "heading", "n_tokens", F.sha2("content", 256).alias("content_sha256"))


FILL = """
SELECT source, doc_id, n_tokens FROM (SELECT source, doc_id, ceil(length(text) / 4.0)::BIGINT + {overhead} AS n_tokens FROM documents)
QUALIFY sum(n_tokens) OVER (PARTITION BY source ORDER BY n_tokens, doc_id ROWS UNBOUNDED PRECEDING) <= 5000"""


def _filled(spark, sf_dir, overhead):
    # Shortest first, so what fits is a prefix.
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", (texts.token_estimate(F.col("text")) + overhead).alias("n_tokens"))
    return chunking.fill_budget(rows, "source", ["n_tokens", "doc_id"], "n_tokens", 5000)


@query("context_fill", FILL.format(overhead=0))
def context_fill(spark, sf_dir):
    return _filled(spark, sf_dir, 0)


@query("context_budget", FILL.format(overhead=4))
def context_budget(spark, sf_dir):
    """As a compiled context is filled: every item costs 4 tokens more, for the list that it stands in."""
    return _filled(spark, sf_dir, 4)


SENTENCE, BLANK = r"(?<=[.!?])[ \t\r\n]+", r"[ \t\r\n]+"


def _longest(sentences):
    """The longest of an array of texts; of those as long, the least."""
    return F.array_min(F.transform(sentences, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))["s"]


def _noted(text):
    """A whole text as a summary: turns, words, characters and sum of CRC-32, then its longest sentence on a line of its own."""
    t = F.coalesce(text, F.lit(""))
    words = F.size(F.array_remove(F.split(t, BLANK), ""))
    return F.concat_ws("\n", F.concat_ws(" ", F.lit("1"), words, F.length(t), F.crc32(t.cast("binary"))), _longest(F.split(t, SENTENCE)))


def _merged(summaries):
    """One summary of several, of the same form; in any grouping and order the same."""
    split = F.transform(summaries, lambda s: F.split(s, "\n", 2))
    total = lambda i: F.aggregate(split, F.lit(0).cast("long"), lambda a, s: a + F.split(s[0], " ")[i].cast("long"))
    return F.concat_ws("\n", F.concat_ws(" ", *[total(i) for i in range(4)]), _longest(F.transform(split, lambda s: s[1])))


@query("summarize")
def summarize(spark, sf_dir):
    """A map-reduce with a stand-in for the model: counts, check sum and longest sentence of whole conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", _noted(F.col("text")).alias("text"))
    return chunking.map_reduce(turns, "conv_id", "turn", "text", _merged)
