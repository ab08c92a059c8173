import zlib

import numpy as np
import pytest
from llm_cases import SF_MID, awkward, clashing, empty, same_rows

from postlytics.llm import quality as Q
from postlytics.llm import registry


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    per = np.array([3, 1, 4])
    x, y = rng.normal(size=(8, 5)), np.array([1.0, 0.0, 1.0])
    w = {"e": rng.normal(size=(5, 4)), "eb": rng.normal(size=4), "v": rng.normal(size=(4, 3)), "vb": rng.normal(size=3),
         "u": rng.normal(size=(4, 3)), "ub": rng.normal(size=3), "w": rng.normal(size=3), "o": rng.normal(size=4),
         "ob": np.array(0.3)}

    def loss():
        p = Q._forward(w, x, per)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = Q._gradient(w, x, per, y)
    for k, g in grad.items():
        for at in np.ndindex(w[k].shape):
            old = w[k][at]
            w[k][at] = old + 1e-5
            up = loss()
            w[k][at] = old - 1e-5
            down = loss()
            w[k][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_passages_by_plain_counts():
    text = "One two two three.  FOUR|five 66 !!\n" * 20
    x, per = Q.encode([text, "", "a b"])
    words = text.split()
    assert per.tolist() == [-(-len(words) // Q.PASSAGE), 1, 1]
    first = words[:Q.PASSAGE]
    at = Q.CLASSES
    assert x[0, at] == pytest.approx(np.mean([len(w) for w in first]) / 10)
    assert x[0, at + 1] == pytest.approx(sum(a == b for a, b in zip(first, first[1:])) / len(first))
    assert x[0, at + 2] == pytest.approx(len(set(first)) / len(first))
    assert x[0, at + 3] == pytest.approx(len(set(zip(first, first[1:]))) / (len(first) - 1))
    assert not x[-2].any()


def test_attention_finds_the_passage_that_counts():
    rng = np.random.default_rng(3)
    per = rng.integers(1, 9, 600)
    x = rng.normal(size=(per.sum(), 6)).astype(np.float32)
    begin = np.cumsum(per) - per
    y = rng.integers(0, 2, 600)
    bad = begin + rng.integers(0, per)
    x[bad[y == 0], 0] = 6.0
    m = Q.train(x, per, y, epochs=30)
    p, a = m.scores(x, per)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.97
    many = (y == 0) & (per > 3)
    assert np.median(a[bad[many]]) > 2 / 6


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    got = registry.op3_quality(spark, SF_MID).collect()
    assert len(got) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) >= 0.9


def test_awkward_rows(spark):
    rows = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (7, None), (99, 1), (None, 1)], "doc_id long, quality int")
    model = Q.fit(rows, labels)
    got = Q.score(rows, model)
    assert got.count() == rows.count()
    by = {r["doc_id"]: r["score"] for r in got.collect()}
    assert by[2] == by[3] and by[5] == by[6]
    assert same_rows(got, Q.score(clashing(rows), model))
    assert Q.score(empty(spark), model).count() == 0
    assert Q.fit(empty(spark), labels).constant == 0.5
    assert {r["score"] for r in Q.score(rows, Q.fit(rows, labels.where("quality = 0"))).collect()} == {0.0}
