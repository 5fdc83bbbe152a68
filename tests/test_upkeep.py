"""Upkeep and instalments on rows written by hand."""

import datetime as dt

from pyspark.sql import functions as F

from larkspur.operators import finance, upkeep


def test_expired_takes_the_first_rule_and_keeps_what_has_no_time(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    files = spark.createDataFrame(
        [("tmp/x_y/a", day(1), 3), ("tmp/b", day(1), 5), ("tmp/c", None, 7), ("tmpx", day(1), 1), ("out/d", day(9), 2), (None, day(1), 1)], "path string, modified timestamp, bytes long"
    )
    rules = [("tmp/x_", 30), ("tmp/", 2), ("out/", 2)]
    plan = upkeep.expired(files, rules, F.lit("2024-01-10").cast("timestamp"))
    assert [(r.path, r.prefix) for r in plan.collect()] == [("tmp/b", "tmp/")]
    assert [tuple(r) for r in upkeep.swept(plan).collect()] == [("tmp/", 1, 5)]
    assert upkeep.expired(files, [], F.current_timestamp()).count() == 0


def test_inventory_and_answers(spark):
    files = spark.createDataFrame([("a/b/c.PY",), ("a/d.py",), ("Makefile",), ("a/x.zzz",)], "path string")
    assert sorted(map(tuple, upkeep.inventory(files).collect())) == [(".", "other", 1), ("a", "Python", 2), ("a", "other", 1)]
    answers = spark.createDataFrame([(1, "rules", 0.9, False), (1, "local", 0.4, True), (2, "rules", 0.7, None)], "q long, backend string, confidence double, needs_human boolean")
    assert sorted(map(tuple, upkeep.answer_summary(answers, "q").collect())) == [(1, 0.4, True, "cascade"), (2, 0.7, False, "rules")]


def test_instalments_and_shares(spark):
    rows = spark.createDataFrame([("3/10", 10), (" 12 / 12 ", 5), ("5/3", 5), ("once", 5), (None, 5)], "part string, amount int")
    assert [r[0] for r in rows.select(finance.outstanding(F.col("part"), F.col("amount"))).collect()] == [70, 0, 0, None, None]
    spent = spark.createDataFrame([("income", 200.0), ("needs", 100.0), ("wants", 33.0)], "kind string, amount double")
    assert sorted(map(tuple, finance.income_shares(spent, "kind", "amount", "income").collect())) == [("needs", 100.0, 50.0), ("wants", 33.0, 16.5)]
    assert [r.pct for r in finance.income_shares(spent.where("kind = 'wants'"), "kind", "amount", "income").collect()] == [None]
