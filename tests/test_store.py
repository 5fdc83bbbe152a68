"""Versions of parents with child rows: whole, or not there."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators.tables import Store


def rows(spark, ids, version, chunks=3):
    docs = spark.createDataFrame([(i, f"title {version}") for i in ids], "document_id long, title string")
    parts = spark.createDataFrame([(i, n, f"{version}") for i in ids for n in range(chunks)], "document_id long, chunk_index int, content string")
    return docs, parts


def whole(store):
    docs, parts = store.read()
    return sorted((r.document_id is None, r.document_id or 0, r.title, r.n, r.contents) for r in docs.join(
        parts.groupBy("document_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("content")), ",").alias("contents")).withColumnRenamed("document_id", "d"),
        F.col("document_id").eqNullSafe(F.col("d")), "left",
    ).collect())


def test_replacement(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    with pytest.raises(LookupError):
        store.read()
    assert store.replace(*rows(spark, [1, 2, None], 1)) == 1
    assert store.replace(*rows(spark, [2, 3, None], 2, chunks=2)) == 2
    assert whole(store) == [(False, 1, "title 1", 3, "1"), (False, 2, "title 2", 2, "2"), (False, 3, "title 2", 2, "2"), (True, 0, "title 2", 2, "2")]
    assert store.read(1)[1].count() == 9
    store.removed(spark.createDataFrame([(1,), (7,)], "document_id long"))
    assert [r[1] for r in whole(store)] == [2, 3, 0]
    assert store.cleared() == ["v1", "v1.done", "v2", "v2.done"] and len(whole(store)) == 3


def test_a_job_that_breaks_is_never_seen(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.replace(*rows(spark, [1, 2], 1))
    before = whole(store)
    docs, parts = rows(spark, [2], 2)
    broken = parts.withColumn("content", F.when(F.col("chunk_index") == 2, F.raise_error("lost")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        store.replace(docs, broken)  # parents are written by then
    assert whole(store) == before and store.versions() == [1]
    assert store.replace(docs, parts) > 1 and [r[4] for r in whole(store)] == ["1", "2"]
    assert any("-" in n for n in store.cleared())


def test_readers_keep_what_they_opened(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", "agents", "permissions", "agent_id")
    agents = spark.createDataFrame([(1, "a")], "agent_id long, name string")
    store.write(agents, spark.createDataFrame([(1, "files"), (1, "web")], "agent_id long, tool string"))
    opened = store.read()
    store.replace(agents, spark.createDataFrame([(1, "web")], "agent_id long, tool string"))
    assert opened[1].count() == 2 and store.read()[1].count() == 1
