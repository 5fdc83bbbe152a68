"""What is written for people: Markdown tables, and delimited files with added columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_lines(rows: DataFrame, order: list[Column]) -> DataFrame:
    """place, line: a table of a report's few rows as Markdown; pipes in cells are escaped, null is empty."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |"))
    made = rows.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), line.alias("line")).agg(F.sort_array(F.collect_list(F.struct("o", "line"))).alias("x"))
    head = [f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}"]
    return made.select(F.posexplode(F.concat(F.array(*[F.lit(h) for h in head]), F.transform("x", lambda r: r["line"]))).alias("place", "line"))


def free_name(columns: list[str], wanted: str, other: str) -> str:
    """wanted, or other where a column has that name already, in any case."""
    return other if wanted.lower() in {c.lower() for c in columns} else wanted


def categorised(rows: DataFrame, category: Column, rule: Column) -> DataFrame:
    """rows with a category and the rule that gave it, under names that no column has."""
    names = free_name(rows.columns, "categoria", "categoria_regra"), free_name(rows.columns, "regra", "regra_aplicada")
    return rows.select("*", category.alias(names[0]), rule.alias(names[1]))


def export(rows: DataFrame, path: str) -> None:
    """rows as UTF-8 files with commas and a header, a file for each task."""
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
