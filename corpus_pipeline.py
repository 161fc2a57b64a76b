"""Corpus pipeline over ``documents``: each stage takes (spark, docs, sf_dir) and returns the next stage's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontaminate, jaccard, mixing, pii, quality
from tidemill.llm.common import table
from tidemill.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of documents that links of Jaccard 0.8 connect, the one with the smallest id stays."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a passage of the benchmark go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: personal data is replaced by marks; every document stays."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the documents that the mix takes, with their copies and words taken."""
    return mixing.draw(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("source mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs, "corpus")
    return docs


#: EM and the cube method have no SQL form; tests/llm/test_pipeline.py checks each stage against plain loops.
ORACLE_SQL = None
