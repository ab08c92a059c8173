"""Rows every operator has to live with: nulls, empty and long texts, repeats, extra columns with clashing names."""

from __future__ import annotations

from pyspark.sql import functions as F

SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog and runs away into the deep dark wood again. " * 3000


def awkward(spark):
    rows = [(1, "a small plain text of few words", "en", "s", 31), (2, None, None, None, None), (3, "", "en", "s", 0),
            (4, "   \n\t ", None, "s", 6), (5, LONG, "en", "s", len(LONG)), (6, LONG, "en", None, None),
            (1, "a small plain text of few words", "en", "s", 31), (None, "no id here at all", "en", "s", 17),
            (7, "123 456 !!! ???", None, "s", 15), (8, "İstanbul ſtraße K   日本語 \U0001F600", "xx", "s", 20)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """Extra columns named as the operators name theirs."""
    names = ("score", "spans", "fp", "key", "a", "b", "kind", "doc", "block", "words", "label", "term", "dest", "tail",
             "keep_id", "gone_id", "sample_id", "component_id", "lang_pred", "of", "todo", "part")
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def same_rows(a, b) -> bool:
    key = lambda r: repr(tuple(r))
    return sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
