"""Joins that are more than an equality: intervals, patterns, reconciliation, upserts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.numbers import MARKED, PLAIN


def _overlaps(left: DataFrame, right: DataFrame, bucket_seconds: float, keys: list[str]) -> DataFrame:
    """keys, id, label, seconds and r_start of the pairs of `overlap_join`."""

    def dealt(df: DataFrame, names: list[str], side: str) -> DataFrame:
        first, last = (F.floor(F.col(c) / bucket_seconds) for c in ("start", "end"))
        own = df.select(*keys, *names, F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), F.sequence(first, last).alias("_bucket"))
        return own.withColumn("_bucket", F.explode("_bucket"))

    both = dealt(left, ["id"], "l").join(dealt(right, ["label"], "r"), [*keys, "_bucket"])
    begins = F.greatest("l_start", "r_start")
    shared = F.least("l_end", "r_end") - begins
    return both.where((shared > 0) & (F.floor(begins / bucket_seconds) == F.col("_bucket"))).select(*keys, "id", "label", shared.alias("seconds"), "r_start")


def overlap_join(left: DataFrame, right: DataFrame, bucket_seconds: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose [start, end) intervals overlap, with the seconds they share.

    left has id, start, end; right has label, start, end; keys are equal in both. Intervals are dealt into time buckets
    and joined by bucket, so the join is an equality that shuffles; a pair is told once, in the bucket in which its
    overlap begins.
    """
    return _overlaps(left, right, bucket_seconds, keys or []).drop("r_start")


def best_overlap(left: DataFrame, right: DataFrame, bucket_seconds: float = 60.0, keys: list[str] | None = None, earliest: bool = True) -> DataFrame:
    """Each left interval with the label that it overlaps most in total; ties go to the label whose first overlapping
    interval starts first (where earliest), then to the smaller label; null without one."""
    keys = keys or []
    total = _overlaps(left, right, bucket_seconds, keys).groupBy(*keys, "id", "label").agg(F.round(F.sum("seconds"), 6).alias("seconds"), F.min("r_start").alias("_first"))
    order = Window.partitionBy(*keys, "id").orderBy(F.desc("seconds"), *(["_first"] if earliest else []), "label")
    best = total.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_first")
    return left.select(*keys, "id").join(best, [*keys, "id"], "left")


def categorize(rows: DataFrame, rules: list[tuple[str, str]], text: Column) -> DataFrame:
    """rows with category and rule: of the rules whose pattern matches, the longest match, ties to the rule declared first.

    The rules are a list in the driver's program, so they become one expression: no join, no Python.
    """
    found = F.array(*[
        F.struct(F.length(F.regexp_extract(text, f"({pattern})", 1)).alias("n"), F.lit(-i).alias("order"), F.lit(category).alias("category"), F.lit(pattern).alias("rule"))
        for i, (category, pattern) in enumerate(rules)
    ])
    best = F.array_max(F.filter(found, lambda r: r["n"] > 0))
    return rows.select("*", best["category"].alias("category"), best["rule"].alias("rule"))


def rule_pattern(raw: str) -> str:
    """The pattern of a rule as people write it, for folded text: "re:" and a pattern, or words that stand alone, so that
    "uber" isn't found in "uberlandia"."""
    if raw.startswith("re:"):
        return raw[3:].strip()
    folded = raw.lower().translate(str.maketrans(MARKED, PLAIN)).strip()
    return f"(?<![a-z0-9]){re.escape(folded)}(?![a-z0-9])"


def categorize_typed(rows: DataFrame, rules: list[tuple[str, str]], text: Column) -> DataFrame:
    """rows with category and rule (as written) by rules of `rule_pattern`, over the text in lower case without marks."""
    patterns = {rule_pattern(raw): raw for _, raw in reversed(rules)}
    found = categorize(rows, [(c, rule_pattern(raw)) for c, raw in rules], F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN))
    names = F.create_map(*[F.lit(x) for pair in patterns.items() for x in pair])
    return found.withColumn("rule", F.try_element_at(names, "rule"))


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left without a row of right that is equal in `on`; each row of right answers for any number of them.

    Keys are dealt into as many parts as the session's shuffles have, which aren't put together again, so what is held
    and sorted at a time, here and where the rest is counted by `on`, falls with that number. Equal keys of right meet
    only there: no task holds a whole file's keys."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.join(right.select(*on).repartition(parts, *on).distinct(), on, "left_anti")


def insert_if_absent(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target and those rows whose key it lacks; the first of equal new keys, rows with a null key always."""
    order = Window.partitionBy(key).orderBy(*[c for c in rows.columns if c != key])
    first = rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    fresh = first.join(target.select(key), key, "left_anti").select(*rows.columns)
    return target.unionByName(fresh).unionByName(rows.where(F.col(key).isNull()))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """target with rows put over it by keys; columns in keep stay as they were where the new value is null. Of rows with
    equal keys the greatest counts, in the order of their columns, so a key of target is never told twice."""
    others = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row")) if others else rows.select(*keys).distinct()
    new = one.select(*keys, *[F.col("_row")[c].alias(f"_new_{c}") for c in others], F.lit(True).alias("_new"))
    both = target.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        fresh = F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in keep else F.col(f"_new_{c}")
        return F.when(F.col("_new"), fresh).otherwise(F.col(c)).alias(c)

    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return both.select(*[value(c) for c in target.columns], action.alias("action"))


def prune(target: DataFrame, seen: DataFrame, uri: str, prefixes: list[str]) -> DataFrame:
    """target with status "deleted" for rows below one of the prefixes whose uri wasn't seen."""
    below = F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.col(uri), p)) if prefixes else F.lit(False)
    marked = target.join(seen.select(uri, F.lit(True).alias("_seen")).distinct(), uri, "left")
    return marked.withColumn("status", F.when(below & F.col("_seen").isNull(), "deleted").otherwise(F.col("status"))).drop("_seen")


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of new whose columns differ from old's, nulls being equal to each other, or whose key is new."""
    before = old.select(key, F.struct(*columns).alias("_before"))
    return new.join(before, key, "left").where(~F.struct(*columns).eqNullSafe(F.col("_before"))).drop("_before")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, told by side; repeated rows count."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
