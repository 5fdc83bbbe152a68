"""Cases that went wrong once: packed files, null permissions, exit codes."""

import json
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.functions import decisions, texts
from larkspur.operators import chunking, joins
from larkspur.plans.registry import QUERIES, SQL
from larkspur.sources import delimited


def test_packed_files_each_lose_their_header(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i:02}.csv").write_text(f"sep report {i}\n\nname;amount\na{i};1,5\n\"b\n{i}\";2\n")
    rows = delimited.read(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.amount) for r in rows) == sorted([(f"a{i}", "1,5") for i in range(40)] + [(f"b\n{i}", "2") for i in range(40)])
    assert {r["_row"] for r in rows} == {2, 3}
    assert delimited.read(spark, str(tmp_path), max_rows=1).count() == 40


def test_split_files_skipped_lines_and_notes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "1,2\n" * 100)
    assert delimited.read(spark, f"{tmp_path}/a.csv", line_breaks=False).columns == ["x", "y"] and delimited.read(spark, f"{tmp_path}/a.csv", line_breaks=False).count() == 100
    (tmp_path / "b.csv").write_bytes("título\nz,w\n\nx,y\n1,2\n".encode("cp1252"))
    assert delimited.notes(spark, f"{tmp_path}/b.csv") == ["not UTF-8: read as Windows-1252", "1 lines before the header in line 2 left out"]
    assert delimited.read(spark, f"{tmp_path}/b.csv", skip_rows=2).columns == ["_row", "x", "y"] and delimited.read(spark, f"{tmp_path}/b.csv", skip_rows=2).count() == 1
    with pytest.raises(ValueError):
        delimited.read(spark, f"{tmp_path}/b.csv", line_breaks=False)
    with pytest.raises(ValueError):
        delimited.read(spark, f"{tmp_path}/b.csv", skip_rows=9)


def test_unsure_permissions_deny(spark):
    array = lambda v: F.lit(None).cast("array<string>") if v is None else F.array(*[F.lit(x).cast("string") for x in v]).cast("array<string>")
    call = {"tool": F.lit("terminal"), "paths": array(None), "command": F.lit("ls"), "tenant": F.lit("t"), "domain": F.lit("d")}

    def verdict(tools, tenants=(), deny=None):
        agent = {"known": F.lit(True), "tools": array(tools), "tenants": array(tenants), "deny_domains": array(deny)}
        return tuple(spark.range(1).select(decisions.tool_verdict(call, agent, F.lit("t")).alias("v")).first().v)

    category = spark.range(1).select(decisions.tool_category(F.lit("terminal"))).first()[0]
    for tools in (None, [], [None], ["other", None]):
        assert verdict(tools) == (False, "category")
    for tools in ([category], ["*"], [None, category], ["*", None]):
        assert verdict(tools) == (True, "")
    assert verdict([category], [None]) == (False, "tenant") and verdict([category], ["t", None]) == (True, "") and verdict([category], None) == (True, "")
    assert verdict([category], deny=["d", None]) == (False, "domain")


def test_test_commands_and_exit_codes(spark):
    commands = ["npx jest --ci", "vitest run", "pnpm run test", "uv run pytest -x", "python -m unittest", "cd a && make check", "echo contest", "testing", None]
    found = spark.createDataFrame([(c,) for c in commands], "c string").select(texts.is_test_command(F.col("c"))).collect()
    assert [r[0] for r in found] == [True] * 6 + [False] * 3
    own = spark.createDataFrame([("our-check --json x",), ("ourcheck",)], "c string").select(texts.is_test_command(F.col("c"), ("our-check",))).collect()
    assert [r[0] for r in own] == [True, False]
    outputs = {
        "exit code 1 ... exit code: 2": 1, 'said "exit_code": 7': 7, "Exit status -3": -3, "all good": 0, json.dumps({"exit_code": 3, "output": "exit code 9"}): 3, json.dumps({"returncode": 4}): 4,
        json.dumps({"exit_code": None, "returncode": 4}): 0, json.dumps({"output": "exit code 9"}): 0, json.dumps({"exit_code": "5"}): 5, json.dumps({"exit_code": "bad", "x": "exit code 8"}): 8, json.dumps([1]): 0, None: 0, "": 0,
    }
    found = spark.createDataFrame([(o,) for o in outputs], "o string").select(texts.exit_code(F.col("o"))).collect()
    assert [r[0] for r in found] == list(outputs.values())


def test_ties_of_overlaps_go_to_the_first_turn(spark):
    left = spark.createDataFrame([(1, 0.0, 10.0), (2, 20.0, 21.0)], "id long, start double, end double")
    right = spark.createDataFrame([("zoe", 0.0, 2.0), ("adam", 2.0, 6.0), ("zoe", 6.0, 8.0)], "label string, start double, end double")
    assert {r.id: (r.label, r.seconds) for r in joins.best_overlap(left, right, 3.0).collect()} == {1: ("zoe", 4.0), 2: (None, None)}


def test_ties_of_overlaps_as_in_sql(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 12) + timedelta(seconds=s)
    rows = [(1, at(0), 1, "view", 10.0), (2, at(-20), 1, "signup", 0.0), (3, at(-10), 1, "error", 0.0), (4, at(9000), 1, "view", 5.0), (5, at(0), None, "view", 5.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        expected = duck.execute(f"SELECT id, label, seconds FROM ({SQL['overlap_join']}) ORDER BY id").fetchall()
    found = [tuple(r) for r in QUERIES["overlap_join"](spark, str(tmp_path)).select("id", "label", "seconds").orderBy("id").collect()]
    assert found == expected == [(1, "error", 10.0), (4, None, None), (5, None, None)]


def test_parts_of_unmatched_stay_small(spark):
    left = spark.createDataFrame([(i % 50, i % 3) for i in range(300)] + [(None, 1)], "a long, b long")
    right = spark.createDataFrame([(i % 40, 1) for i in range(200)] + [(None, 1)], "a long, b long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = joins.unmatched(left, right, ["a", "b"])
        assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = {(i % 40, 1) for i in range(200)}
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(str(k) for k in [(i % 50, i % 3) for i in range(300)] + [(None, 1)] if k not in keys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_upsert_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a")], "k long, name string")
    new = spark.createDataFrame([(1, "b"), (1, "c"), (2, None), (2, "d")], "k long, name string")
    assert sorted(map(tuple, joins.upsert(old, new, ["k"]).collect())) == [(1, "c", "updated"), (2, "d", "created")]


def test_places_in_a_hot_key(spark):
    rows = [("hot", i) for i in range(3000)] + [(None, i) for i in range(50)] + [(f"k{i}", i) for i in range(40)]
    found = chunking.numbered(spark.createDataFrame(rows, "k string, o int").repartition(7), "k", "o")
    assert all(r["_i"] == (0 if r.k and r.k != "hot" else r.o) for r in found.collect()) and found.count() == len(rows)


def test_typed_rules_stand_alone(spark):
    rows = spark.createDataFrame([("UBER *trip",), ("Uberlandia",), ("p\u00e3o de a\u00e7\u00facar 12",), ("paodeacucar",), ("a-b",), (None,), ("taxi 99",)], "text string")
    rules = [("ride", "uber"), ("food", "P\u00e3o de A\u00e7\u00facar"), ("dash", "a-b"), ("cab", r"re: taxi \d+")]
    found = joins.categorize_typed(rows, rules, F.col("text")).collect()
    assert [r.category for r in found] == ["ride", None, "food", None, "dash", None, "cab"] and found[2].rule == "P\u00e3o de A\u00e7\u00facar"
