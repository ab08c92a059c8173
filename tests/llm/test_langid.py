import random
import zlib

import numpy as np
import pytest
from llm_cases import SF_MID, awkward, clashing, empty, same_rows

from postlytics.llm import langid as L
from postlytics.llm import registry


def value(scores, path, penalty):
    return sum(scores[i, x] for i, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def plain(scores, penalty):
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        step = best[:, None] - penalty * (1 - np.eye(len(best)))
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_viterbi_by_segments_is_exact(segment, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", segment)
    rng = np.random.default_rng(segment)
    for _ in range(60):
        sizes = rng.integers(1, 25, rng.integers(1, 6))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        scores = rng.normal(size=(starts[-1], 3)).astype(np.float32)
        labels = L.viterbi(scores, starts, 1.2)
        for a, b in zip(starts, starts[1:]):
            assert value(scores[a:b], labels[a:b], 1.2) == pytest.approx(value(scores[a:b], plain(scores[a:b], 1.2), 1.2), abs=1e-3)


@pytest.fixture(scope="module")
def model(spark):
    rows = [("the cat and the dog went to the house with the old man", "en"), ("der hund und die katze gehen in das alte haus", "de"),
            ("кошка и собака пошли в старый дом у реки", "ru"), (None, "en"), ("nothing learned", None)] * 5
    return L.fit(spark.createDataFrame(rows, "text string, lang string"), penalty=4.0)


def test_spans_of_mixed_text(model):
    text = "the old man and the dog went to the house. " + "die katze und der hund gehen in das haus. " + "собака и кошка у реки"
    _, _, [spans] = L.label_texts([text], model)
    assert [s["lang"] for s in spans] == ["en", "de", "ru"]
    assert text[spans[2]["start"]:spans[2]["end"]] == "собака и кошка у реки"
    assert text[spans[1]["start"]:].startswith("die katze")


def test_script_narrows_candidates(model):
    preds, _, _ = L.label_texts(["жжщщ ъъэ", "qqxx zzk", "日本語"], model)
    assert preds[0] == "ru" and preds[1] in ("de", "en") and preds[2] in model.langs


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    got = registry.op8_language(spark, SF_MID).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]) >= 0.97


def test_awkward_rows(spark, model):
    rows = awkward(spark)
    got = L.predict(rows, model)
    assert got.count() == rows.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["spans"] == [] for i in (2, 3, 4, 7))
    assert by[5]["lang_pred"] == "en"
    assert same_rows(got, L.predict(clashing(rows), model))
    assert L.predict(empty(spark), model).count() == 0
    none = L.fit(empty(spark))
    assert {r["lang_pred"] for r in L.predict(rows, none, spans=False).collect()} == {"und"}
    kept = L.keep_known(clashing(rows), model)
    assert kept.columns == clashing(rows).columns
    assert not {2, 3, 4, 7} & {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_many_languages():
    """Labels past 255, and the two ways of search agree."""
    rng = np.random.default_rng(5)
    scores = rng.normal(0, 1, (40, 300)).astype(np.float32)
    scores[:, 290] += 50
    starts = np.array([0, 1, 25, 40])
    assert (L.viterbi(scores, starts, 12.0) == 290).all()
    few = rng.normal(0, 8, (3000, 5)).astype(np.float32)
    starts = np.array([0, 7, 8, 2500, 3000])
    assert (L._viterbi_by_text(few, starts, 12.0) == L.viterbi(few, starts, 12.0)).all()


def test_texts_in_several_languages_stay(spark):
    """A notice in three languages stays, a salad of their words goes."""
    rng = random.Random(9)
    rows = [r for r in spark.read.parquet(f"{SF_MID}/documents.parquet").where("lang is not null").select("text", "lang").collect()]
    model = L.fit(spark.read.parquet(f"{SF_MID}/documents.parquet"))
    by = {}
    for r in rows:
        if r["text"] and len(r["text"]) > 800:
            by.setdefault(r["lang"], []).append(r["text"].replace("\n", " "))
    langs = sorted(by)[:3]
    assert len(langs) == 3
    notice = " ".join(rng.choice(by[x])[:n] for x, n in zip(langs, (350, 350, 300)))
    docs = spark.createDataFrame([(1, notice), (2, by[langs[0]][0]), (3, "12 !!"), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in L.keep_known(docs, model).collect()) == [1, 2]
