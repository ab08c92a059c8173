import re
from collections import Counter
from itertools import permutations

import pytest
from llm_cases import SF_SMALL, awkward, clashing, empty, same_rows, texts
from pyspark.sql import functions as F

from postlytics.llm import filter_audit, registry


def plain_audit(rows, labels):
    """The contract, row by row; rows are (id, text, part)."""
    good, bad = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    fails = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
             "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
             "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in rows)}
        fails.append((part or "", {k for k, v in f.items() if v}, i in good, i in bad))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [x[1:] for x in fails if x[0] == part]
        first = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                first[name] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(name in x[0] for x in mine) - len(gone),
                                                   sum(x[0] == {name} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(first[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


@pytest.fixture(scope="module")
def copies(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, (long, "short", long + " $", None, "X" * 9)[i % 5], ("a", None, "b")[i % 3]) for i in range(40)]
    rows += [(100, long, "a"), (100, long, "a"), (None, long, "c"), (None, long, "c"), (-5, "same id", "a"), (-5, "same id too", "a")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (100, 1, 0), (None, 1, 1), (999, 1, 1), (5, None, 1)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("bits, cells", [(64, 1 << 29), (2, 1 << 29), (64, 0)])
def test_equals_plain_version(spark, copies, bits, cells):
    """With 2-bit hashes different texts share a hash; with the least sketch few texts are cleared."""
    docs, labels = frames(spark, *copies)
    counts = filter_audit.mask_counts(docs, labels, hash_bits=bits, max_cells=cells)
    assert got(filter_audit.audit(counts)) == plain_audit(*copies)


def test_query_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "source").collect()
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()
    assert got(registry.op11_filter_audit(spark, SF_SMALL)) == plain_audit([tuple(r) for r in docs], [tuple(r) for r in labels])


def test_sketch_clears_no_repeat(spark):
    """Every text that has a copy may be repeated, and most of the others are cleared."""
    h = spark.range(5000).select(F.xxhash64((F.col("id") % 4000).cast("string")).alias("h")).repartition(4)
    bitmap = filter_audit.sketch(h, 5000, 1 << 29)
    import numpy as np
    rows = h.groupBy("h").count().collect()
    maybe = filter_audit._maybe(bitmap, np.array([r["h"] for r in rows]))
    assert all(m for m, r in zip(maybe, rows) if r["count"] > 1)
    assert sum(m for m, r in zip(maybe, rows) if r["count"] == 1) < 0.1 * 3000


def test_hot_copy_stays_few_rows(spark):
    """A text that a third of all rows hold reaches the shuffle once per task."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot copy"))
                                    .otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source"))
    rows = filter_audit._rows(docs.repartition(4), "doc_id", "text", "source", 64)
    bitmap = spark.sparkContext.broadcast(filter_audit.sketch(rows.select("h"), 3000, 1 << 29))
    least = {bytes(r["text"]).decode(): (r["lo"], r["n"]) for r in filter_audit._least_ids(rows, bitmap).collect()}
    assert least["hot copy"] == (0, 1000) and len(least) < 400


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    run = lambda d: filter_audit.audit(filter_audit.mask_counts(d, labels))
    a = run(awkward(spark))
    assert same_rows(a, run(clashing(awkward(spark)).withColumnRenamed("part", "part_")))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in awkward(spark).collect()]
    assert got(a) == plain_audit(rows, [(1, 1, 0), (5, 0, 1)])
    assert run(empty(spark)).count() == 0


def test_sums(spark):
    """Over all orders, shapley shares of a part add up to what any order removes, 120 times."""
    rows = registry.op11_filter_audit(spark, SF_SMALL)
    assert texts(spark, SF_SMALL)
    by = rows.groupBy("part", "filter_order").agg(F.sum("removed").alias("r"), F.sum("shapley").alias("s"))
    assert by.where("120 * r <> s").count() == 0
