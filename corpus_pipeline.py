"""A corpus pipeline of operators from ``postlytics.llm``; each stage is written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
works on every row its predecessor kept.  Each call keeps its operator's rules
for nulls, empty texts and repeated rows; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from postlytics.llm import bpe, decontaminate, langid, secret_scan, simhash
from postlytics.llm.common import crc_mod
from postlytics.session import checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: learns from the labelled documents and drops texts without a language of their own."""
    model = langid.fit(docs.where(crc_mod("doc_id", 3) != 1))
    return langid.keep_known(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the document with the smallest id of each group stays."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked; every document stays and n_chars follows its text."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each kept text, checked by decoding them again."""
    import public_tokenizers

    # small tables: the stage's workers share their executor's memory with what the stages before keep
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                      transitions=60_000, pieces=100_000)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secrets), ("byte_bpe", tokens)]

#: The stages use a trained language model, XXH64 votes and a tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:  # the stage's input has served
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{base}/{name}"
    return docs
