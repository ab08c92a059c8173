import math
import re
from collections import Counter

from llm_cases import SF_SMALL, awkward, clashing, empty, same_rows

from postlytics.llm import lexical, registry

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain_search(docs, items, k=10):
    """All scores of all documents, by the contract's formula in Python integers."""
    rows = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n, length = len(rows), sum(r[2] for r in rows)
    df = Counter(w for _, tf, _ in rows for w in tf)
    out = set()
    for item, text in items:
        want, best = Counter(terms(text)), []
        for place, (i, tf, size) in enumerate(rows):
            m = 100 - 75 + (75 * size * n) // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 8 * m))
                        for w, q in want.items() if w in tf)
            if score > 0:
                best.append((-score, i is None, i or 0, place, i))
        out |= {(item, rank, i, -s) for rank, (s, _, _, _, i) in enumerate(sorted(best)[:k], 1)}
    return out


def pairs(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


def test_query_equals_plain_version(spark):
    docs = pairs(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), "doc_id", "text")
    items = pairs(spark.read.parquet(f"{SF_SMALL}/benchmark.parquet"), "item_id", "text")
    assert {tuple(r) for r in registry.op12_lexical_search(spark, SF_SMALL).collect()} == plain_search(docs, items)


def test_shards_and_small_pieces_change_nothing(spark):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = lexical.search(docs, items)
    assert len(list(lexical.shards(items, "item_id", "text", 500))) > 3
    assert same_rows(whole, lexical.search(docs.repartition(7), items, shard_terms=500))


def test_guards_repeats_and_ties(spark):
    docs = [(1, "the cat"), (2, "cathedral cat cat"), (3, "CAT-cat'cat"), (4, "concat"), (5, "the cat"), (5, "the cat"), (None, "the cat"),
            (6, None), (7, ""), (8, "été Été"), (9, "été")]
    items = [(1, "cat cat the"), (2, "cat"), (2, "cat"), (2, "été"), (3, None), (4, "nowhere"), (None, "the")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(repr, map(tuple, lexical.search(d, i).collect())))
    distinct = list(dict.fromkeys(items))
    assert sorted(set(got)) == sorted(map(repr, plain_search(docs, distinct)))
    assert lexical.search(d, i, k=2).where("rank > 2").count() == 0


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "quick few id 日本語 istanbul"), (2, "")], "item_id long, text string")
    a = lexical.search(awkward(spark), items)
    assert same_rows(a, lexical.search(clashing(awkward(spark)), clashing(items.withColumnRenamed("x", "x"))))
    assert {tuple(r) for r in a.collect()} == plain_search(pairs(awkward(spark), "doc_id", "text"), [(1, "quick few id 日本語 istanbul")])
    assert lexical.search(empty(spark), items).count() == 0
    assert lexical.search(awkward(spark), items.where("item_id > 9")).count() == 0
