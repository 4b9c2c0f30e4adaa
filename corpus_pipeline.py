"""A corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontamination, mixing, near_dedup, quality, token_output
from ledgerline.llm.common import stored, table

STAGES = [
    ("quality rules", quality.stage),
    ("MinHash near-dedup", near_dedup.stage),
    ("benchmark decontamination", decontamination.stage),
    ("mixing to target weights", mixing.stage),
    ("token-ID output", token_output.stage),
]
#: The stages rest on hashes and tokenizers that SQL has no functions for; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of token ids that the documents become."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
