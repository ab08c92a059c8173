import math
import random
import zlib
from collections import Counter

import numpy as np
from llm_cases import SF_MID, SF_SMALL, awkward, clashing, empty, same_rows

from postlytics.llm import registry
from postlytics.llm import toxicity as X
from postlytics.llm.common import lower


def words(text):
    return Counter(w for w in "".join(c if c.isalnum() else " " for c in lower(text)).split())


def plain(rows, k=15):
    """Entries and a function that scores a text against every one of them, from (id, label, text)."""
    n, n1 = len(rows), sum(y for _, y, _ in rows)
    df = [Counter(w for _, y, t in rows if y == c for w in words(t)) for c in (0, 1)]

    def weight(w):
        p = (df[0][w] + df[1][w]) / n
        z2 = (df[1][w] / n1 - df[0][w] / (n - n1)) ** 2 / max(p * (1 - p) * (1 / n1 + 1 / (n - n1)), 1e-12)
        return math.log(1 + n / (df[0][w] + df[1][w])) * (1 + z2) / (36 + z2)

    of = {w: weight(w) for w in {*df[0], *df[1]}}

    def unit(text):
        v = {w: (1 + math.log(c)) * of[w] for w, c in words(text).items() if w in of}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    entries, empty = {}, [1, 1]
    for i, y, t in rows:
        if not words(t):
            empty[y] += 1
            continue
        e = entries.setdefault(frozenset(words(t).items()), [unit(t), [0, 0], i])
        e[1][y] += 1
        e[2] = min(e[2], i)

    def score(text):
        q = unit(text)
        sims = sorted(((sum(x * v.get(w, 0) for w, x in q.items()), c) for v, c, _ in entries.values()), key=lambda s: -s[0])
        sims = [(s, c) for s, c in sims if s > 0 and (len(sims) <= k or s >= sims[k - 1][0] - 1e-9)]
        if not sims:
            return empty[1] / sum(empty)
        weights = [(1 + math.log(sum(c))) / (1.05 - min(1, s)) for s, c in sims]
        return (sum(w * c[1] / sum(c) for w, (_, c) in zip(weights, sims)) + n1 / n) / (sum(weights) + 1)

    return score


def test_query_equals_all_cosines(spark):
    """The registered query against every example for every text."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    score = plain([(i, y, texts[i]) for i, y in labels.items() if i in texts and zlib.crc32(str(i).encode()) % 5])
    got = {r["doc_id"]: r["score"] for r in registry.op9_toxicity(spark, SF_SMALL).collect()}
    assert got.keys() == texts.keys()
    assert all(math.isclose(got[i], score(t), abs_tol=1e-6) for i, t in texts.items())


def test_blocks_are_skipped_and_none_is_missed(monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 32)
    rng = random.Random(3)
    topics = [[f"t{j}x{i}" for i in range(30)] for j in range(40)]
    rows = []
    for i in range(3000):
        text = " ".join(rng.choices(topics[i % 40], k=rng.randint(3, 12)) + rng.choices(["the", "of", "and"], k=3))
        rows.append((i, int(i % 40 < 4), *X.term_counts([text])[0]))
    m = X.Model.build(rows, 15)
    blocks = -(-len(m.example) // X.BLOCK)
    for j in range(60):
        text = " ".join(rng.choices(topics[j % 40], k=8) + ["the"])
        term, n = X.term_counts([text], m.terms)[0]
        q = (1 + np.log(n)) * m.weight[term.astype(int)]
        q /= np.sqrt(q @ q)
        every = np.zeros(len(m.example))
        for t, x in zip(term.astype(int), q):
            for b in range(m.at[t], m.at[t + 1]):
                at = slice(m.first[b], m.first[b + 1])
                assert m.most[b] == m.value[at].max() and (m.entry[at] // X.BLOCK == m.blocks[b]).all()
                every[m.entry[at]] += x * m.value[at]
        sims, at = m.nearest(term.astype(int), q)
        bar = np.sort(every)[-15]
        assert set(at) == set(np.flatnonzero(every >= bar - 1e-9)) and np.allclose(sims, every[at])
    assert m.opened < 0.5 * 60 * blocks


def test_scores_are_calibrated(spark):
    """Of held-out texts scored about p, about the share p is toxic."""
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    got = [(r["score"], toxic[r["doc_id"]]) for r in registry.op9_toxicity(spark, SF_MID).collect() if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([(s - y) ** 2 for s, y in got]) < 0.5 * np.var([y for _, y in got])
    assert abs(np.mean([s for s, _ in got]) - np.mean([y for _, y in got])) < 0.1


def test_copies_of_examples_find_them(spark):
    """All terms of the examples are in every labelled row or in one of them only."""
    docs = spark.createDataFrame([(1, "bad word"), (2, "bad word nice"), (3, "bad word"), (4, "bad word nice"), (5, "bad word")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in X.score(docs, X.fit(docs, labels)).collect()}
    assert [got[i]["evidence"][0]["doc_id"] for i in (1, 2, 3, 4, 5)] == [1, 2, 1, 2, 1]
    assert got[3]["evidence"][0]["similarity"] > 0.999 and got[3]["score"] > got[4]["score"]


def test_held_out(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    got = registry.op9_toxicity(spark, SF_MID).collect()
    assert len(got) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    held = [(r["score"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    better = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert better > 0.8 and np.mean([s < 0.5 for s in good]) > 0.95


def test_evidence_names_examples(spark):
    rows = [(i, f"you stupid clown number{i}" if i % 3 == 0 else f"a kind and gentle remark number{i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    m = X.fit(docs, labels)
    got = {r["doc_id"]: r for r in X.score(docs, m).collect()}
    assert all((got[i]["score"] >= 0.5) == (i % 3 == 0) for i in range(90))
    assert all(e["toxic"] and e["doc_id"] % 3 == 0 for e in got[0]["evidence"]) and got[0]["evidence"]


def test_every_text_is_searched(spark):
    """Few labelled rows, and a toxic example whose words occur nowhere else."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("bcdfghklmnprstaeiou", k=rng.randint(4, 9)))
    for n in (8, 300):
        rows = [(i, " ".join(word() for _ in range(12))) for i in range(n)]
        labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)], "doc_id long, toxic int")
        near = [(1000 + i, t + " again") for i, t in rows]
        docs = spark.createDataFrame(rows + near, "doc_id long, text string")
        got = {r["doc_id"]: r for r in X.score(docs, X.fit(docs, labels)).collect()}
        for i in range(n):
            assert got[1000 + i]["evidence"][0]["doc_id"] == i
            assert (got[1000 + i]["score"] >= 0.5) == (i % 4 == 0)


def test_awkward_rows(spark):
    rows = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    m = X.fit(rows, labels)
    got = X.score(rows, m)
    assert got.count() == rows.count()
    by = {r["doc_id"]: r["score"] for r in got.collect()}
    assert by[2] == by[3] and by[5] == by[6]
    assert same_rows(got, X.score(clashing(rows), m))
    assert X.score(empty(spark), m).count() == 0
    nothing = X.fit(rows, labels.where("false"))
    assert {r["score"] for r in X.score(rows, nothing).collect()} == {0.0}
