"""A corpus cleaning pipeline of five operators, each applied to all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrivium.llm import decontamination, exact_dedup, ngram_join, piece_encoding, toxicity
from quadrivium.llm.common import discard, materialise, table

#: (name, stage): a stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_join", ngram_join.stage),
    ("decontamination", decontamination.stage),
    ("piece_encoding", piece_encoding.stage),
]

#: Toxicity scores and subword ids have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, each written and read again."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if read is not None:
            discard(read)  # what the stage before wrote has been used up
        read = docs
    return docs
