"""Spreadsheet profiles, totals by category and month, and budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_CATEGORY = "(sem categoria)"


def profile(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """Per column: non-null, nulls, exact distinct, least and greatest value as text, and the most frequent values.

    Columns become rows (column, value) counted by value first, so the second grouping has a row for each value.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    full = F.col("value").isNotNull()
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    # A column's values are ranked within slices first, so no task ranks all values of a column.
    slices = Window.partitionBy("column", F.pmod(F.hash("value"), F.lit(64))).orderBy(F.desc("n"), "value")
    best = counts.where(full).withColumn("_n", F.row_number().over(slices)).where(F.col("_n") <= top).withColumn("_n", place).where(F.col("_n") <= top)
    tops = best.groupBy("column").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "value", "n"))), lambda r: F.concat(r["value"], F.lit("="), r["n"].cast("string"))), ";").alias("top"))
    stats = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).alias("non_null"), F.coalesce(F.sum(F.when(~full, F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"), F.min("value").alias("least"), F.max("value").alias("most"),
    )
    return stats.join(tops, "column", "left")


def totals(amount: Column) -> list[Column]:
    """Count, sum, what came in (above 0) and what went out (the rest, zeros too)."""
    return [
        F.count(amount).alias("count"), F.sum(amount).cast("double").alias("total"), F.coalesce(F.sum(F.when(amount > 0, amount)), F.lit(0)).cast("double").alias("inflow"),
        F.coalesce(F.sum(F.when(amount <= 0, amount)), F.lit(0)).cast("double").alias("outflow"),
    ]


def by_category(rows: DataFrame, category: str, amount: str) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim(F.col(category)), F.lit("")), F.lit(NO_CATEGORY))
    return rows.groupBy(name.alias("category")).agg(*totals(F.col(amount))).orderBy(F.abs("total").desc(), "category")


def by_month(rows: DataFrame, day: str, amount: str) -> DataFrame:
    """Totals by month; rows without a day are left out here."""
    return rows.where(F.col(day).isNotNull()).groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(*totals(F.col(amount)))


def month_over_month(months: DataFrame) -> DataFrame:
    """months with the one before, the change, its percentage of the absolute value before, and whether months lack between."""
    order = Window.orderBy("month")  # a row for each month: small at any size
    before, number = F.lag("total").over(order), F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    change = F.col("total") - before
    return months.select(
        "month", F.round("total", 2).alias("total"), F.round(before, 2).alias("previous"), F.round(change, 2).alias("delta"),
        F.round(F.when(before != 0, 100 * change / F.abs(before)), 1).alias("delta_pct"), F.coalesce(number - F.lag(number).over(order) > 1, F.lit(False)).alias("gap"),
    )


def category_months(rows: DataFrame, category: str, day: str, amount: str, most: int = 12) -> DataFrame:
    """category, month, total for the `most` categories of the greatest absolute totals."""
    cells = rows.where(F.col(day).isNotNull()).groupBy(F.col(category).alias("category"), F.date_format(day, "yyyy-MM").alias("month")).agg(F.sum(amount).alias("total"))
    greatest = cells.groupBy("category").agg(F.abs(F.sum("total")).alias("size")).orderBy(F.desc("size"), "category").limit(most).select("category")
    return cells.join(greatest, "category", "left_semi").select("category", "month", F.col("total").cast("double").alias("total"))


def spending_sign(rows: DataFrame, amount: str) -> Column:
    """-1 if half of the amounts or more are below 0, else 1; over all rows given."""
    return F.when(2 * F.count(F.when(F.col(amount) < 0, 1)) >= F.count(amount), -1).otherwise(1)


def budget_review(actual: DataFrame, budget: DataFrame, warn: float = 0.8) -> DataFrame:
    """category, limit, spent, left, used_pct, status for a budget (category, limit) and spending (category, spent)."""
    both = budget.join(actual, "category", "full_outer").withColumn("spent", F.coalesce("spent", F.lit(0)))
    share = F.when(F.col("limit") > 0, F.col("spent") / F.col("limit")).when(F.col("spent") > 0, float("inf")).otherwise(1.0)
    status = F.when(F.col("limit").isNull(), "unbudgeted").when(share > 1, "over").when(share >= warn, "warn").otherwise("ok")
    return both.select(
        "category", F.col("limit").cast("double").alias("limit"), F.round(F.col("spent").cast("double"), 2).alias("spent"), F.round((F.col("limit") - F.col("spent")).cast("double"), 2).alias("left"),
        F.round(F.when(F.col("limit").isNotNull() & (share < float("inf")), 100 * share), 1).alias("used_pct"), status.alias("status"),
    )


def widths(lines: DataFrame, delimiters: tuple[str, ...] = (",", ";", "\t", "|")) -> DataFrame:
    """Per delimiter: the commonest number of cells of a line and how many lines agree; of a sample of lines (line)."""
    counted = [lines.select(F.lit(d).alias("delimiter"), (F.length("line") - F.length(F.replace("line", F.lit(d), F.lit(""))) + 1).alias("width")) for d in delimiters]
    sizes = reduce(DataFrame.unionByName, counted).groupBy("delimiter", "width").agg(F.count("*").alias("lines"))
    return sizes.where("width > 1").groupBy("delimiter").agg(F.max(F.struct("lines", "width")).alias("best")).select("delimiter", "best.lines", "best.width")


def outstanding(part: Column, amount: Column) -> Column:
    """What is still to pay of an instalment written as 3/12: the parts after it; null where it isn't written so."""
    number, total = (F.regexp_extract(part, r"^\s*([0-9]+)\s*/\s*([0-9]+)\s*$", i).try_cast("int") for i in (1, 2))
    return F.when(total > number, total - number).when(total <= number, 0) * amount


def income_shares(rows: DataFrame, kind: str, amount: str, income: str) -> DataFrame:
    """Per kind of spending: its sum and its percentage of all rows of the kind `income`; null without income."""
    sums = rows.groupBy(F.col(kind).alias("kind")).agg(F.sum(amount).alias("total"))
    earned = sums.agg(F.sum(F.when(F.col("kind") == income, F.col("total"))).alias("_earned"))
    spent = sums.where(F.col("kind") != income).crossJoin(F.broadcast(earned))  # one row
    return spent.select("kind", F.col("total").cast("double").alias("total"), F.round(F.try_divide(F.col("total").cast("double"), F.col("_earned").cast("double")) * 100, 1).alias("pct"))


def coverage(rows: DataFrame) -> DataFrame:
    """total_rows, categorized, unknown and the share that has a category, in percent (0 without rows)."""
    has = F.count("category")
    return rows.agg(F.count("*").alias("total_rows"), has.alias("categorized"), (F.count("*") - has).alias("unknown"), F.coalesce(F.round(F.try_divide(100.0 * has, F.count("*")), 1), F.lit(0.0)).alias("coverage_pct"))


def unknown_groups(rows: DataFrame, most: int = 20, examples: int = 3, first_rows: int = 10) -> DataFrame:
    """Rows (row, key, text, amount, category) without a category by key: count, total, the first different texts and the
    first row numbers; the report's `most` groups by count, size of the total, and key.

    Only a group's first rows are gathered: both lists are cut by a numbered window before they meet.
    """
    left = rows.where("category IS NULL").select("row", "key", "text", F.coalesce("amount", F.lit(0)).cast("decimal(18,2)").alias("amount"))
    totals = left.groupBy("key").agg(F.count("*").alias("count"), F.sum("amount").alias("total"))
    best = totals.orderBy(F.desc("count"), F.desc(F.abs("total")), "key").limit(most)
    own = left.join(F.broadcast(best.select("key")), "key", "left_semi")  # `most` keys
    firsts = own.groupBy("key", "text").agg(F.min("row").alias("row"))
    by_row = Window.partitionBy("key").orderBy("row")
    told = lambda df, n, value, name: df.withColumn("_n", F.row_number().over(by_row)).where(F.col("_n") <= n).groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", value))), lambda x: x[value].cast("string")), "|").alias(name))
    out = best.join(told(firsts, examples, "text", "examples"), "key").join(told(own.select("key", "row"), first_rows, "row", "rows"), "key")
    return out.select("key", "count", F.col("total").cast("double").alias("total"), "examples", "rows")


def net_spend(rows: DataFrame) -> DataFrame:
    """Cents spent by category: kind purchase adds, refund subtracts, anything else (income) is left out."""
    cents = F.round(F.col("amount").cast("decimal(18,2)") * 100).cast("long")
    return rows.where(F.col("kind").isin("purchase", "refund")).groupBy("category").agg(F.sum(F.when(F.col("kind") == "refund", -cents).otherwise(cents)).alias("cents"))


def by_severity(review: DataFrame) -> DataFrame:
    """Budget rows (category, status, used_pct), the worst status first, then by falling use; no limit counts as most."""
    severity = F.when(F.col("status") == "over", 0).when(F.col("status") == "warn", 1).otherwise(2)
    return review.orderBy(severity, F.col("used_pct").desc_nulls_first(), "category")


def status_totals(review: DataFrame) -> DataFrame:
    """Budget rows (status, limit, spent) by status."""
    return review.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("limit"), 2).alias("budgeted"), F.round(F.sum("spent"), 2).alias("spent"))
