"""A corpus pipeline of the operators in ``spanloom.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. Between stages the rows are written as Parquet and read again.

Defined results: an empty table gives an empty table at every stage; null text
counts as empty, so it fails the quality rules; rows with a null doc_id or source
take part like any other; repeated rows fall together as near-duplicates; other
columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import mixing, near_dedup, packing, quality_rules, secrets
from spanloom.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judged_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts."""
    return secrets.redacted_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and the sequence that each is in."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("near-duplicates", dedup), ("secret scan", redact), ("source mixing", mix), ("best-fit packing", pack)]
#: Decoding, sampling and balancing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
