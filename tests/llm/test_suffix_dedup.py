import hashlib
import random

import numpy as np
import pytest
from llm_cases import SF_SMALL, awkward, clashing, empty, same_rows, texts

from postlytics.llm import bwt_dedup as B
from postlytics.llm import registry


def brute(rows, size):
    seen, out = set(), {}
    for doc, raw in rows:
        cover = np.zeros(len(raw) + 1, np.int64)
        for at in range(len(raw) - size + 1):
            s = raw[at:at + size]
            if s in seen:
                cover[at] += 1
                cover[at + size] -= 1
            seen.add(s)
        gone = np.cumsum(cover)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc] = (len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_merged_transform_groups_equal_prefixes():
    rng = random.Random(1)
    for step, depth in ((1, 40), (5, 40), (20, 40)):
        for _ in range(15):
            parts = [[bytes(rng.choices(b"ab", k=rng.randint(1, 90))) for _ in range(rng.randint(1, 5))] for _ in range(3)]
            shards = [B.transform(p, depth, step) for p in parts]
            order, lcp = B.merge(shards, depth, step)
            rows = [(part[i], o) for part, s in zip(parts, shards) for i, o in zip(s[1], s[2])]

            def spell(s, o):  # the suffix's first ``depth`` symbols, read round and round with its end marks
                ring = [x + 1 for x in s] + [0] * (-(len(s) + 1) % step + 1)
                return [ring[(o + i) % len(ring)] for i in range(depth)]

            words = [spell(*rows[i]) for i in order]
            for a, b, n in zip(words, words[1:], lcp[1:].tolist()):
                common = next((i for i in range(depth) if a[i] != b[i]), depth)
                assert n == common // step * step
            blocks = [tuple(w) for w in words]
            assert len(set(blocks)) == sum(n < depth for n in lcp.tolist())  # equal prefixes stand together


@pytest.mark.parametrize("size", [32, 100])
def test_repeats_equal_brute_force(size, monkeypatch):
    rng = random.Random(size)
    for _ in range(30):
        base = [bytes(rng.choices(b"ab", k=rng.randint(size, size + 40))) for _ in range(4)]
        strings = []
        for _ in range(rng.randint(2, 12)):
            s = rng.choice(base)
            strings.append(s[rng.randint(0, len(s) - size):] + bytes(rng.choices(b"ab", k=rng.randint(0, 30))))
        counts = [len(s) - size + 1 for s in strings]
        monkeypatch.setattr(B, "SHARD", rng.choice([50, 200, 10_000]))
        hits = set(zip(*(x.tolist() for x in B.repeated(strings, counts, np.arange(len(strings)), size))))
        seen = set()
        for i, s in enumerate(strings):
            for o in range(counts[i]):
                assert ((i, o) in hits) == (s[o:o + size] in seen)
                seen.add(s[o:o + size])


def test_query_equals_brute_force(spark):
    rows = sorted(texts(spark, SF_SMALL).items())
    want = brute([(d, t.encode()) for d, t in rows], 100)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in registry.op2_suffix_dedup(spark, SF_SMALL).collect()}
    assert got == want


def test_overlaps_periods_and_letters_of_many_bytes(spark):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh éß日", k=150))
    rows = [(3, passage + "x" + passage), (1, "lead " + passage + " tail"), (2, "ab" * 200), (4, "b" * 99), (5, "b" * 101),
            (6, passage[:90]), (7, ("é" * 60) + passage[20:140]), (8, "ab" * 130), (9, "é" * 61)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([(d, t.encode()) for d, t in sorted(rows)], 100)
    got = {r["doc_id"]: tuple(r)[1:5] for r in B.dedup(df).collect()}
    assert got == want


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 500)
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefgh", k=700))
    run = [(1, (passage + "".join(rng.choices("xyz", k=900)) + passage)), (2, passage[100:400])]
    parts = list(B._pieces([d for d, _ in run], [t for _, t in run], 100))
    seen = {}
    for part in parts:
        for doc, off, raw in part:
            for i in range(len(raw) - 99):
                seen.setdefault((doc, off + i), raw[i:i + 100])
    assert seen == {(d, i): t[i:i + 100].encode() for d, t in run for i in range(len(t) - 99)}
    assert len(seen) == sum(len(r) - 99 for part in parts for _, _, r in part)


def test_texts_of_one_id_are_judged_on_their_own(spark):
    """Different texts of one id, or of none, are documents of their own; equal rows are one."""
    rng = random.Random(17)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    copied, own, loose = word(300), word(430), word(250)
    rows = [(1, copied), (7, word(50) + copied), (7, own), (9, own), (None, loose), (None, word(200)), (8, loose), (8, loose)]
    got = B.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=100).collect()
    lost = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got)
    assert lost == sorted([(0, 250, 0), (0, 200, 0), (1, 300, 0), (7, 350, 300), (7, 430, 0), (8, 250, 250), (8, 250, 250), (9, 430, 430)])


def test_awkward_rows(spark):
    rows = awkward(spark)
    got = B.dedup(rows)
    assert got.count() == rows.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[2]["n_bytes"] == 0 and by[6]["n_removed"] == by[6]["n_bytes"] and by[None]["n_removed"] == 0
    assert same_rows(got, B.dedup(clashing(rows)))
    assert B.dedup(empty(spark)).count() == 0
