"""A training-data pipeline over ``documents``: judge, deduplicate, decontaminate, mix, tokenise.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomset.llm.base import Scratch, table
from loomset.llm.contamination import without_benchmarks
from loomset.llm.mixing import mixed
from loomset.llm.quality import good_documents
from loomset.llm.similar import one_of_each
from loomset.llm.tokens import token_digests

# Quality is learned, and tokens are a binary format: no SQL states them. The tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    return one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return without_benchmarks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated (or left out) to bring their sources to the target weights, and shuffled."""
    return mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the binary format, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), literal=False)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated),
          ("mixture", mixture), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    scratch = Scratch(spark)
    docs, written = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.cut(docs)
            if written is not None:
                scratch.drop(written)
            written = docs
    return docs
