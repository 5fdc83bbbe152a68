"""The registered queries against their SQL, and the plans that scale depends on."""

import math
import re
import zlib

import duckdb
import pytest

from larkspur.plans import registry
from larkspur.plans.registry import QUERIES, SQL, table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows, columns, order):
    text = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    at = [columns.index(c) for c in order]
    return sorted(tuple(text(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert len(rows) > 0
    if name in SQL:
        cursor = duck.execute(SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, df.columns, sorted(columns)) == plain(cursor.fetchall(), columns, sorted(columns))


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]  # noqa: SLF001


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["semi_active"](spark, sf))
    assert "EqualTo(o_orderstatus,O)" in text and "o_totalprice" not in text
    assert "text" not in plan(QUERIES["lang_stats"](spark, sf)).split("ReadSchema")[1].split("\n")[0]


def test_limits_are_taken_before_the_shuffle(spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_products"](spark, sf))


def test_interval_join_is_an_equality(spark, sf):
    text = plan(QUERIES["overlap_join"](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_registry_reads_any_folder(spark, sf):
    assert table(spark, sf, "nation").count() == 25
    assert set(SQL) <= set(QUERIES) and registry.QUERIES is QUERIES


def summary(texts):
    """What summarize says of a conversation, by a plain fold of its whole texts."""
    texts = [t or "" for t in texts]
    words = sum(len([w for w in re.split("[ \t\r\n]+", t) if w]) for t in texts)
    longest = min((s for t in texts for s in re.split("(?<=[.!?])[ \t\r\n]+", t)), key=lambda s: (-len(s), s))
    return f"{len(texts)} {words} {sum(map(len, texts))} {sum(zlib.crc32(t.encode()) for t in texts)}\n{longest}"


def test_summaries_are_of_whole_conversations(spark, sf, tmp_path):
    rows = [(1, i, f"Turn {i}. " + "word " * i + "end") for i in range(150)] + [(2, 0, "a\nb.  c? \u00e9\u00e9"), (3, 0, None), (3, 1, ""), (None, 0, "x"), (None, 1, "y" * 900 + ". z")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for folder in (sf, str(tmp_path)):
        expected = {}
        for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
            expected.setdefault(r.conv_id, []).append(r.text)
        found = {r.conv_id: r.text for r in QUERIES["summarize"](spark, folder).collect()}
        assert found == {k: summary(ts) for k, ts in expected.items()}
