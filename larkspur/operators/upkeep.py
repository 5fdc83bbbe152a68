"""Upkeep of stored files and answers: what has expired, what there is, and how answers came about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by the end of a file's name.
LANGUAGES = {"py": "Python", "go": "Go", "rs": "Rust", "js": "JavaScript", "ts": "TypeScript", "java": "Java", "sh": "Shell", "sql": "SQL", "md": "Markdown", "yaml": "YAML", "yml": "YAML"}


def expired(files: DataFrame, rules: list[tuple[str, int]], now: Column) -> DataFrame:
    """Files (path, modified, bytes) below a rule's prefix and older than its days, with that prefix; the first rule that fits counts.

    Files of no rule and files without a time stay. Nothing is deleted: the rows are the plan of a sweep.
    """
    prefix, days = F.lit(None).cast("string"), F.lit(None).cast("int")
    for p, d in reversed(rules):
        below = F.startswith(F.col("path"), F.lit(p))
        prefix, days = F.when(below, F.lit(p)).otherwise(prefix), F.when(below, F.lit(d)).otherwise(days)
    return files.withColumns({"prefix": prefix, "_days": days}).where(F.col("modified") < now - F.make_interval(days=F.col("_days"))).drop("_days")


def swept(plan: DataFrame) -> DataFrame:
    """Files and bytes that a sweep frees, by prefix."""
    return plan.groupBy("prefix").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def inventory(files: DataFrame) -> DataFrame:
    """Files by top folder ("." for none) and language ("other" for unknown ends)."""
    end = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    named = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    folder = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(F.lit("."))
    return files.groupBy(folder.alias("folder"), F.coalesce(F.try_element_at(named, end), F.lit("other")).alias("language")).agg(F.count("*").alias("files"))


def answer_summary(answers: DataFrame, key: str) -> DataFrame:
    """Per request: the least confidence, whether any answer needs a human, and the one backend or "cascade" for several."""
    first, last = F.min("backend"), F.max("backend")
    return answers.groupBy(key).agg(
        F.min("confidence").alias("confidence"), F.coalesce(F.bool_or("needs_human"), F.lit(False)).alias("needs_human"), F.when(first == last, first).otherwise(F.lit("cascade")).alias("backend")
    )
