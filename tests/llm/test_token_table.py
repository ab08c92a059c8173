import random
import uuid
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from llm_cases import SF_MID, SF_SMALL, awkward, clashing, empty, same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlytics.llm import registry, token_table
from postlytics.session import checkpoint_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return token_table.Encoder(PATH)


def folder(spark):
    return f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"


def plain(library, rows):
    out, start = [], 0
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_library(spark, library):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in registry.op13_token_table(spark, SF_SMALL).collect())
    assert got == plain(library, rows)


def test_any_characters(library, encoder):
    rng = random.Random(7)
    every = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1F300, 0x1F700)]
    texts = ["".join(rng.choice(every) if rng.random() < share else rng.choice("ab'stmdrevl A1.\n é<|") for _ in range(14))
             for share in (0, 0.05, 0.5) for _ in range(700)]
    texts += ["", "'re''s 's's", "<|endoftext|> x<|startoftext|>y", "각 각 각", "a\x1cb\x85c z", "x" * 500, "don't DON'T we'LL"]
    ids, n = encoder.batch([t.encode() for t in texts])
    assert [a.tolist() for a in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_table, "KNOWN", 5)
    e = token_table.Encoder(PATH)
    for text in ("one two three four five six seven", "one two three", "seven eight nine ten one") * 2:
        assert e(text.encode()) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("encoding, used", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_layout(spark, encoding, used):
    path = folder(spark)
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    token_table.write(docs, path, PATH, 1, encoding=encoding, row_group_bytes=256 << 10, page_rows=50)
    files = [r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()]
    last, groups = -1, 0
    for meta in sorted((pq.ParquetFile(f.replace("file://", "")).metadata for f in files), key=lambda m: m.row_group(0).column(0).statistics.min):
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert used in cols["tokens.list.element"].encodings
            assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings
            assert all(c.has_offset_index for c in cols.values()) and cols["doc_id"].has_column_index
            assert cols["doc_id"].statistics.min > last  # ascending over row groups and files
            last, groups = cols["doc_id"].statistics.max, groups + 1
    assert groups > len(files)


def test_selective_reads(spark, library):
    path = folder(spark)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    token_table.write(docs, path, PATH, 1)
    want = plain(library, sorted(tuple(r) for r in docs.select("doc_id", "text").collect()))
    assert sorted(tuple(r) for r in token_table.index(spark, path).collect()) == [w[:3] for w in want]
    plan = token_table.index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan
    some = token_table.tokens(spark, path, 20, 40)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,20), LessThanOrEqual(doc_id,40)" in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in token_table.summary(some).collect()) == [w for w in want if 20 <= w[0] <= 40]


def test_awkward_rows(spark, library):
    def run(df):
        path = folder(spark)
        token_table.write(df, path, PATH, 1)
        return token_table.summary(token_table.tokens(spark, path))

    a = run(awkward(spark))
    assert same_rows(a, run(clashing(awkward(spark))))
    rows = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in a.collect()}
    assert rows == {(i, n, c) for i, _, n, c in plain(library, [(r["doc_id"], r["text"]) for r in awkward(spark).collect()])}
    got = a.orderBy("start").collect()
    assert got[0]["doc_id"] is None and [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
    assert run(empty(spark)).count() == 0


def test_many_rows_without_id(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("some text").alias("text"))
        shards = token_table.encode(docs.repartition(4), PATH, 1).groupBy("shard").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in shards) == 4000 and max(r["count"] for r in shards) < 2000
