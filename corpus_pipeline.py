"""From raw documents to token ids: quality, near duplicates, repeated passages, benchmark leaks, encoding.

Every stage takes and, but for the last, returns the columns of documents. A stage's result is written as Parquet to the
shared folder and read again as the next one's input, so no lineage outlives a stage.

1. quality: failing lines leave their documents, and documents that fail the base rules or lose too much go.
2. near_duplicates: one document of each component of SimHash links stays, that of the smallest id.
3. repeated_passages: bytes of passages that a smaller id has too leave, in whole characters.
4. decontamination: documents with a window of a benchmark item go.
5. encoding: doc_id, n_tokens and digests of the ids and of the decoded text.

Defined cases: null, empty and blank texts fail the first stage; rows with a null id are documents like any other, and
stay as the one of their component only where it has no row with an id; of rows with equal ids and texts, or of a
component's rows with the same smallest id, one stays, chosen by hashes; an empty table gives an empty result with the
columns of encoding; other columns pass through all stages but the last, whatever their names, and n_chars is counted
anew by stages that change texts. Texts of any length are worked on whole, each in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import bpe, decontaminate, quality, simhash, suffix_array
from larkspur.llm.shared import written

#: The stages aren't SQL as a whole; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_array.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this stage needs it

    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
