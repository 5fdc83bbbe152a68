"""All queries of the library but those of the training-data subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
SQL = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dates_as_text(df: DataFrame) -> DataFrame:
    """Dates read alike in every engine once they are text."""
    return df.withColumns({c: df[c].cast("string") for c, t in df.dtypes if t == "date"})


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: dates_as_text(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


for _family in ("ledger_queries", "relational_queries", "retrieval_queries", "finance_queries", "text_queries", "policy_queries", "routing_queries", "stream_queries", "upkeep_queries", "assistant_queries", "merge_queries"):
    importlib.import_module(f"larkspur.plans.{_family}")
