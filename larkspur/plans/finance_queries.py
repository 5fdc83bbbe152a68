"""Profiles, totals and budgets over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import numbers
from larkspur.operators import finance
from larkspur.plans.registry import query, table

#: Signed amounts: closed orders come in, the others go out.
AMOUNT = "CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2))"
ROWS = "r AS (SELECT o_orderpriority AS category, o_orderdate::DATE AS day, " + AMOUNT + " AS amount FROM orders)"
TOTALS = """count(amount) AS count, sum(amount)::DOUBLE AS total, coalesce(sum(amount) FILTER (WHERE amount > 0), 0)::DOUBLE AS inflow, coalesce(sum(amount) FILTER (WHERE amount <= 0), 0)::DOUBLE AS outflow"""


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.to_date("o_orderdate").alias("day"), F.expr(AMOUNT).alias("amount"))


PROFILED = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@query("profile_columns", "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column, {c}::VARCHAR AS value FROM orders" for c in PROFILED) + """),
c AS (SELECT "column", value, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT "column", string_agg(value || '=' || n, ';' ORDER BY n DESC, value) AS top FROM (SELECT * FROM c WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 5) GROUP BY 1)
SELECT "column", coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0)::BIGINT AS non_null, coalesce(sum(n) FILTER (WHERE value IS NULL), 0)::BIGINT AS nulls, count(value) AS "distinct", min(value) AS least, max(value) AS most, any_value(top) AS top
FROM c LEFT JOIN t USING ("column") GROUP BY "column" """)
def profile_columns(spark, sf_dir):
    return finance.profile(table(spark, sf_dir, "orders"), PROFILED)


@query("totals_by_category", f"WITH {ROWS} SELECT category, {TOTALS} FROM r GROUP BY category")
def totals_by_category(spark, sf_dir):
    return finance.by_category(_rows(spark, sf_dir), "category", "amount")


@query("totals_by_month", f"WITH {ROWS} SELECT strftime(day, '%Y-%m') AS month, {TOTALS} FROM r WHERE day IS NOT NULL GROUP BY 1")
def totals_by_month(spark, sf_dir):
    return finance.by_month(_rows(spark, sf_dir), "day", "amount")


@query("mom", f"""WITH {ROWS}, m AS (SELECT strftime(day, '%Y-%m') AS month, sum(amount)::DOUBLE AS total FROM r GROUP BY 1),
p AS (SELECT month, total, lag(total) OVER (ORDER BY month) AS p, substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT AS i FROM m)
SELECT month, round(total, 2) AS total, round(p, 2) AS previous, round(total - p, 2) AS delta, round(CASE WHEN p <> 0 THEN 100 * (total - p) / abs(p) END, 1) AS delta_pct, coalesce(i - lag(i) OVER (ORDER BY month) > 1, false) AS gap FROM p""")
def mom(spark, sf_dir):
    return finance.month_over_month(finance.by_month(_rows(spark, sf_dir), "day", "amount"))


@query("cat_month_pivot", f"""WITH {ROWS}, g AS (SELECT category FROM r GROUP BY category ORDER BY abs(sum(amount)) DESC, category LIMIT 3)
SELECT category, strftime(day, '%Y-%m') AS month, sum(amount)::DOUBLE AS total FROM r WHERE category IN (SELECT category FROM g) GROUP BY ALL""")
def cat_month_pivot(spark, sf_dir):
    return finance.category_months(_rows(spark, sf_dir), "category", "day", "amount", 3)


@query("top_amounts", f"WITH {ROWS} SELECT category, day::VARCHAR AS day, amount::DOUBLE AS amount FROM r ORDER BY abs(amount) DESC, day, category LIMIT 10")
def top_amounts(spark, sf_dir):
    return _rows(spark, sf_dir).orderBy(F.abs("amount").desc(), "day", "category").limit(10).withColumn("amount", F.col("amount").cast("double"))


@query("budget_review", f"""WITH {ROWS}, a AS (SELECT category, -sum(amount)::DOUBLE AS spent FROM r WHERE amount < 0 GROUP BY 1),
b(category, lim) AS (VALUES ('1-URGENT', 1000.0::DOUBLE), ('2-HIGH', 1e12::DOUBLE), ('9-NONE', 0.0::DOUBLE)),
j AS (SELECT coalesce(a.category, b.category) AS category, lim, coalesce(spent, 0) AS spent FROM b FULL JOIN a ON a.category = b.category),
s AS (SELECT *, CASE WHEN lim > 0 THEN spent / lim WHEN spent > 0 THEN 'inf'::DOUBLE ELSE 1.0 END AS share FROM j)
SELECT category, lim AS "limit", round(spent, 2) AS spent, round(lim - spent, 2) AS "left", CASE WHEN lim IS NOT NULL AND share < 'inf'::DOUBLE THEN round(100 * share, 1) END AS used_pct,
  CASE WHEN lim IS NULL THEN 'unbudgeted' WHEN share > 1 THEN 'over' WHEN share >= 0.8 THEN 'warn' ELSE 'ok' END AS status FROM s""")
def budget_review(spark, sf_dir):
    spent = _rows(spark, sf_dir).where("amount < 0").groupBy("category").agg((-F.sum("amount")).cast("double").alias("spent"))
    budget = spark.createDataFrame([("1-URGENT", 1000.0), ("2-HIGH", 1e12), ("9-NONE", 0.0)], "category string, limit double")
    return finance.budget_review(spent, budget)


@query("parsed_numbers", """
SELECT o_orderkey, round(o_totalprice, 2) AS back, CASE WHEN o_orderkey % 2 = 0 THEN -o_custkey ELSE o_custkey END::DOUBLE AS whole FROM orders""")
def parsed_numbers(spark, sf_dir):
    """Amounts written in Brazilian form and read back."""
    orders = table(spark, sf_dir, "orders")
    us = F.format_number("o_totalprice", 2)
    written = F.concat(F.lit("R$ "), F.translate(us, ",.", ".,"))
    accounted = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("("), "o_custkey", F.lit(")"))).otherwise(F.col("o_custkey").cast("string"))
    return orders.select("o_orderkey", numbers.parsed_number(written, ",").cast("double").alias("back"), numbers.parsed_number(accounted, ".").cast("double").alias("whole"))


@query("parsed_dates", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders")
def parsed_dates(spark, sf_dir):
    """Dates in four writings, read back."""
    day, kind = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.date_format(day, "dd/MM/yyyy")).when(kind == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm")).when(kind == 2, F.date_format(day, "d-M-yyyy")).otherwise(F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.parsed_date(text).alias("day"))


@query("call_costs", "SELECT event_id, round((greatest(user_id * 10 - event_id % 500, 0) * 3.0 + (event_id % 500) * CASE WHEN user_id % 2 = 0 THEN 0.3 ELSE 3.0 END + user_id * 15.0) / 1000000, 9)::DOUBLE AS usd FROM events")
def call_costs(spark, sf_dir):
    cached = F.col("event_id") % 500
    usd = numbers.cost(F.col("user_id") * 10, cached, F.col("user_id"), F.lit(3.0), F.when(F.col("user_id") % 2 == 0, 0.3).otherwise(0.0), F.lit(15.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(usd, 9).alias("usd"))
