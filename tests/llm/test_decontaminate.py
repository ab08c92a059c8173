import math
import random
from collections import Counter

from llm_cases import SF_SMALL, awkward, clashing, empty, same_rows, texts

from postlytics.llm import decontaminate as D
from postlytics.llm import registry


def plain_bm25(passage, items, df, n):
    """Share of each item's own BM25 weight that the passage holds, by the formula."""
    mean = sum(len(i) for i in items) / len(items)
    out = []
    for it in items:
        tf = Counter(it)
        weight = {t: math.log(1 + (n - df.get(t, 0) + .5) / (df.get(t, 0) + .5)) * c * 2.2
                  / (c + 1.2 * (0.25 + 0.75 * len(it) / mean)) for t, c in tf.items()}
        out.append(sum(w for t, w in weight.items() if t in passage) / sum(weight.values()))
    return out


def test_wand_equals_scoring_all_items():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [f"c{i}" for i in range(15)]
    items = [[rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(5, 50))] for _ in range(100)]
    df = {w: rng.randint(1, 20) for w in vocabulary} | {c: rng.randint(300, 900) for c in common}
    shard = D.Shard([(i, it, []) for i, it in enumerate(items)], df, 1000, sum(map(len, items)) / len(items), 0.5)
    found = 0
    for _ in range(300):
        it = rng.choice(items)
        passage = rng.sample(it, rng.randint(len(it) // 3, len(it))) + rng.choices(vocabulary + common, k=30)
        terms = sorted({shard.term[w] for w in passage if w in shard.term})
        want = {i: s for i, s in enumerate(plain_bm25(set(passage), items, df, 1000)) if s >= 0.5 - 1e-6}
        got = dict(shard.search(terms))
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)
        if want:  # the terms that lead to passages are among them
            assert shard.essential[terms].any()
        found += len(want)
    assert found > 100


def brute(docs, items, need=0.8):
    out = set()
    for doc, text in docs.items():
        words = D.words_of(text)
        for item, body in items.items():
            q = D.words_of(body)
            cut = -(-2 * len(q) // 3)
            q, a = q[:cut], q[cut:]
            grams = {tuple(q[i:i + 5]) for i in range(max(1, len(q) - 4))}
            size = min(5, len(q))
            hits = [i for i in range(len(words) - size + 1) if tuple(words[i:i + size]) in grams]
            if len({tuple(words[i:i + size]) for i in hits}) >= need * len(grams) and D.ordered_overlap(a, words[hits[0]:]) >= need:
                out.add((doc, item))
    return out


def test_query_equals_brute_force(spark):
    docs = texts(spark, SF_SMALL)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in registry.op4_decontaminate(spark, SF_SMALL).collect()}
    assert got == brute(docs, items)
    assert got >= {(d, i) for d, t in docs.items() for i, b in items.items() if b in t}


def _case(spark):
    q = "what is the name of the river that flows by the old town of ellingham near the sea"
    bench = spark.createDataFrame([(1, q, "the river wend"), (2, None, None), (3, "", ""), (3, "unrelated question about copper mines", "tin")],
                                  "item_id long, question string, answer string")
    filler = "lorem ipsum dolor sit amet " * 60
    docs = spark.createDataFrame([(1, filler + q + " it is called the river wend " + filler), (2, filler + q + " nobody knows " + filler),
                                  (3, filler), (4, None), (5, "the river wend"), (6, q.upper() + "?? The *river* Wend!"), (6, None)],
                                 "doc_id long, text string")
    return docs, bench


def test_question_and_answer_are_both_needed(spark):
    docs, bench = _case(spark)
    how = dict(item_text_col="question", answer_col="answer")
    got = D.leaks(docs, bench, **how)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 1), (6, 1)}
    kept = D.drop_contaminated(clashing(docs), bench, **how)
    assert kept.columns == clashing(docs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 6]
    assert same_rows(got, D.leaks(clashing(docs), clashing(bench), **how))


def test_many_shards_find_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    one = D.leaks(docs, bench).select("doc_id", "item_id", "passage_word")
    monkeypatch.setattr(D, "SHARD_ITEMS", 13)
    assert same_rows(one, D.leaks(docs, bench).select("doc_id", "item_id", "passage_word"))


def test_empty_tables(spark):
    _, bench = _case(spark)
    none = bench.where("false")
    assert D.leaks(awkward(spark), none, item_text_col="question").count() == 0
    assert D.leaks(empty(spark), bench, item_text_col="question").count() == 0
    assert D.drop_contaminated(awkward(spark), none, item_text_col="question").count() == awkward(spark).count()
