import hashlib
from collections import Counter

import numpy as np
from llm_cases import SF_SMALL, awkward, clashing, empty, same_rows, texts

from postlytics.llm import imatch as I
from postlytics.llm import registry
from postlytics.llm.common import documents


def test_lexicon_is_the_band(spark, monkeypatch):
    monkeypatch.setattr(I, "MAX_COUNTED", 500)  # counters that are emptied often count the same
    docs = texts(spark, SF_SMALL)
    df = Counter(t for text in docs.values() for t in I.terms(text))
    got = I.lexicon(documents(spark.read.parquet(f"{SF_SMALL}/documents.parquet")), 0.02, 0.2)
    assert got == sorted(t for t, n in df.items() if 0.02 * len(docs) <= n <= 0.2 * len(docs) and n >= 2)


def test_query_equals_brute_force(spark):
    docs = sorted(texts(spark, SF_SMALL).items())
    words = I.lexicon(documents(spark.read.parquet(f"{SF_SMALL}/documents.parquet")))
    f = I.Fingerprinter(words)
    got = {r["doc_id"]: r for r in registry.op7_imatch(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    for i, (doc, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        k = len(text) // 2
        edited = text[:len(text) - k] + after[:k]
        mine, other, nxt = f.of(text), f.of(edited), f.of(after)
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (I.as_text(mine), I.as_text(other))
        assert (r["near_edited"], r["near_next"]) == (I.likeness(mine, other), I.likeness(mine, nxt))
    edited, nxt = (np.array([r[c] for r in got.values()]) for c in ("near_edited", "near_next"))
    assert edited.mean() > 0.2 and nxt.mean() < 0.05 and (edited > nxt).mean() > 0.9


def test_order_wraps_over_many_ranges(spark):
    ids = [7, 3, 1000, -5, 12, 13, 14, 500, 501, 2, 99999]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(3)
    for buckets in (1, 2, 5, 50):
        rows = [tuple(r) for r in I.in_order(df, buckets).collect()]
        pairs = set()
        for dest in {r[0] for r in rows}:
            run = [r for r in rows if r[0] == dest]
            homes = sorted(r[2] for r in run if not r[1])
            tails = sorted(r[2] for r in run if r[1])
            pairs |= set(zip(homes, homes[1:] + tails[:1]))
        want = sorted(ids)
        assert pairs == set(zip(want, want[1:] + want[:1]))


def test_likeness():
    f = I.Fingerprinter([f"w{i}" for i in range(2000)])
    words = [f"w{i}" for i in range(0, 2000, 10)]
    a = f.of(" ".join(words))
    assert I.likeness(a, f.of(" ".join(reversed(words)) + " unknown")) == 1.0
    half = I.likeness(a, f.of(" ".join(words[:100] + [f"w{i}" for i in range(5, 1000, 10)])))
    assert 0.05 < half < 0.7
    assert I.likeness(a, f.of(" ".join(f"w{i}" for i in range(1, 2000, 10)))) < 0.1
    assert I.likeness(f.of("x"), f.of("x")) == 1.0 and I.likeness(f.of("x"), f.of("y")) == 0.0 == I.likeness(f.of("x"), a)


def test_awkward_rows(spark):
    rows = awkward(spark)
    words = I.lexicon(documents(rows), 0.1, 1.0)
    got = I.edited_likeness(rows, words)
    assert got.count() == rows.count()
    prints = {(r["doc_id"], r["fingerprint"]) for r in I.fingerprint(rows, words).collect()}
    assert prints == {(r["doc_id"], r["fingerprint"]) for r in got.collect()}
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[5]["fingerprint"] == by[6]["fingerprint"] and by[5]["near_next"] == 1.0
    assert same_rows(got, I.edited_likeness(clashing(rows), words))
    assert I.edited_likeness(empty(spark), words).count() == 0 and I.lexicon(documents(empty(spark))) == []
    one = I.edited_likeness(rows.where("doc_id = 7"), words).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
