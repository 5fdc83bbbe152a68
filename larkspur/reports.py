"""The ledger's reports by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans import registry

NAMES = ("costs", "models", "agents", "skills", "loops", "routes", "escalations", "spend")


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """A report over the tables of a folder; an unknown name is an error that lists the known ones."""
    if name not in NAMES:
        raise ValueError(f"no report is called {name}; there are {', '.join(NAMES)}")
    return registry.QUERIES[f"rpt_{name}"](spark, sf_dir)
