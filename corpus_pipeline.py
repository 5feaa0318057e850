"""From raw documents to token ids: rules, near-dedup, secrets, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm import bpe, dedup, mixing, quality, secrets
from churnscope.llm.common import materialize, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_stage(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.dedup_stage(docs, dedup.DedupOptions(percent=80))


def take_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.secrets_stage(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixing_stage(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids as packed 32-bit integers beside doc_id, source and lang; the mix's copies stay rows."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.bpe_encode(docs.select("doc_id", "source", "lang", "text"), ranks, pattern)
    return encoded.select("doc_id", "source", "lang", bpe.n_ids(F.col("_ids")).alias("n_tokens"), F.col("_ids").alias("ids"))


STAGES = [
    ("quality rules", drop_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("secret scans", take_out_secrets),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Connected components, and merges of byte pairs, are not expressible in one SQL query.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
