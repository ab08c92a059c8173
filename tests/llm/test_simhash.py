import numpy as np
import pytest
import xxhash
from llm_cases import SF_MID, awkward, clashing, empty, same_rows, texts
from pyspark.sql import functions as F

from postlytics.llm import registry, simhash as S
from postlytics.llm.common import connected_components


def plain(text, size=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ")
             .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs):
    """ids -> smallest id reachable, by comparing all fingerprints."""
    ids = sorted(pairs)
    fps = np.array([pairs[i] for i in ids], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = list(range(len(ids)))
    todo = set(range(len(ids)))
    while todo:
        seed = min(todo)
        stack = [seed]
        todo.discard(seed)
        while stack:
            i = stack.pop()
            label[i] = seed
            for j in np.flatnonzero(near[i]).tolist():
                if j in todo:
                    todo.discard(j)
                    stack.append(j)
    return {ids[i]: ids[label[i]] for i in range(len(ids))}


@pytest.mark.parametrize("text", ["", "a", "a b", "A b C", "a b c d a b c d", "x\x0by z w", "É é \x85 q r s t", "And " * 500])
def test_fingerprint_by_definition(text):
    assert S.fingerprint(text) == plain(text)


def test_query_equals_all_pairs(spark):
    got = {r["doc_id"]: r for r in registry.op10_simhash(spark, SF_MID).collect()}
    fps = {d: plain(t) for d, t in texts(spark, SF_MID).items()}
    want = components(fps)
    for d, fp in fps.items():
        assert (got[d]["fingerprint"], got[d]["component_id"]) == (f"{fp:016x}", want[d])


@pytest.mark.parametrize("hot_key", [S.HOT_KEY, 8])
def test_dense_ball_of_fingerprints(spark, hot_key):
    """Thousands of fingerprints around few centres: keys are shared by many, links stay a forest."""
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 62, 5).astype(np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(400):
            x = c
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = S.links(df, hot_key=hot_key).cache()
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    want = components({int(i): int(x) for i, x in enumerate(fps)})
    groups = {}
    for i, x in enumerate(fps.view(np.int64).tolist()):
        groups.setdefault(want[i], set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in edges.collect())
    if hot_key == S.HOT_KEY:
        assert edges.count() <= 68 * len(fps)


def test_longer_keys_bring_every_near_pair_together():
    """A template's fingerprints under one key: all pairs within the budgets meet under some longer key, keys stay small."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    fps = np.unique((np.uint64(0x1234ABCD) | rng.integers(0, 1 << 32, 3000).astype(np.uint64) << np.uint64(32)))
    fps = np.unique(np.concatenate([fps, fps[:300] ^ np.uint64(1 << 40), fps[:300] ^ np.uint64(3 << 35), fps[:300] ^ np.uint64(1 << 20 | 1 << 60)]))
    keyed = S._keys(3)(pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"]))
    hot = np.ones(len(keyed["key"]), bool)
    rows = S._longer(3)(pa.RecordBatch.from_arrays([pa.array(c) for c in (keyed["key"], keyed["probe"], keyed["fp"], hot)], list("kpfh")))
    own, other = {}, {}
    for k, t, p, f in zip(*(rows[c].tolist() for c in ("key", "third", "probe", "fp"))):
        (other if p else own).setdefault((k, t), set()).add(f)
    assert max(map(len, own.values())) < 100 < np.unique(keyed["key"][keyed["probe"] == 0], return_counts=True)[1].max()
    met = {frozenset((a, b)) for key, base in own.items() for a in base for b in base | other.get(key, set()) if a != b}
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    signed = fps.view(np.int64).tolist()
    assert len(near) >= 900 and all(frozenset((signed[i], signed[j])) in met for i, j in near)


def test_components_of_a_long_chain(spark):
    edges = spark.range(3000).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    got = connected_components(edges)
    assert got.count() == 3001 and got.select("root").distinct().count() == 1


def test_awkward_rows(spark):
    rows = awkward(spark)
    got = S.near_duplicates(rows)
    assert got.count() == rows.count()
    by = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert by[2] == by[3] == by[4] == 2 and by[5] == by[6] == 5
    assert same_rows(got, S.near_duplicates(clashing(rows)))
    assert S.near_duplicates(empty(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = clashing(awkward(spark))
    kept = S.drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i) == [1, 1, 2, 5, 7, 8] and None in ids
