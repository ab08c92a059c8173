"""The thin registered queries of this package and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.llm import (bpe, bwt_dedup, chaining, decontaminate, filter_audit, imatch, langid, lexical, oracle, quality,
                            secret_scan, simhash, token_table, toxicity)
from postlytics.llm.common import crc_mod, documents
from postlytics.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    kind = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return secret_scan.scan(_documents(spark, sf_dir)).select(
        "doc_id", *[kind(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.digest(base), 256).alias("base_sha256"), secret_scan.digest(spans).alias("spans"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.dedup(_documents(spark, sf_dir), size=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _held_out(mod: int, rest: int):
    return F.coalesce(crc_mod("doc_id", mod) == rest, F.lit(False)).alias("held_out")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(crc_mod("doc_id", 5) != 0), max_rows=12_000)
    return quality.score(docs, model, attention=False).select(
        "doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN, with_ids=False)


def op6_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(_documents(spark, sf_dir))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return imatch.edited_likeness(docs, imatch.lexicon(documents(docs)))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs.where(crc_mod("doc_id", 3) != 1))
    return langid.predict(docs, model, spans=False).select("doc_id", _held_out(3, 1), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 5) != 0), max_rows=4_000)
    return toxicity.score(docs, model).select(
        "doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("evidence.doc_id").alias("evidence"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_documents(spark, sf_dir), shingle=3, max_bits=3)
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filter_audit.mask_counts(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filter_audit.audit(counts)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_table.write(_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_table.summary(token_table.tokens(spark, path))


def queries() -> dict[str, Query]:
    found = (op1_secret_scan, op2_suffix_dedup, op3_quality, op4_decontaminate, op5_byte_bpe, op6_chaining,
             op7_imatch, op8_language, op9_toxicity, op10_simhash, op11_filter_audit, op12_lexical_search, op13_token_table)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": oracle.OP11, "op12_lexical_search": oracle.OP12}
