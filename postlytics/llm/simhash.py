"""SimHash near-duplicates: pigeonring candidates, then the full Hamming check.

A fingerprint has four 16-bit segments in a ring.  If two fingerprints differ
in at most ``d`` bits, the pigeonring principle gives a start segment from
which every chain of l consecutive segments differs in at most
floor(l * d / 4) bits in all.  For d = 3 the budgets are 0, 1, 2, 3.  The
first two budgets make an exact key: a start segment, equal on both sides, and
the next one, equal or with one bit turned.  So each distinct fingerprint is
written once under its own 32-bit key and its 16 neighbours, for each of four
starts; the rows under one key are compared in blocks, the remaining chain
budgets prune, and the full Hamming distance decides.

Keys are counted first.  Where more than ``HOT_KEY`` fingerprints have one key
(near copies of a template), the third chain budget (2) makes it longer: the
third segment, equal or with as many bits turned as the budget has left.  Then
three segments are fixed, so at most 2^16 fingerprints have the same key,
whatever the number of documents.

Equal fingerprints are one vertex from the start (copies never make pairs),
and the rows of a key leave as a spanning forest of their links, never as all
pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.functions.columns import broadcast_groups
from postlytics.llm.common import connected_components, documents, fresh, map_batches, trimmed

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
SEGMENTS, BITS = 4, 16
#: Fingerprints with one 32-bit key beyond which the key is made longer (changes no result).
HOT_KEY = 4096
#: Fingerprints compared at once, and pairs of a block.
PROBES, BLOCK = 1 << 15, 1 << 20


def shingle_hashes(text: str, size: int = 3) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; words are split at ASCII blanks only."""
    words = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = [0]
    at = 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts, starts[size:])], np.uint64)


def fingerprint(text: str, size: int = 3) -> int:
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):  # bounded scratch memory for very long texts
        part = h[at:at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row; ``fp`` is the fingerprint as a signed long, 0 for a text without words."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return {"doc_id": batch.column(0), "fp": fps.view(np.int64)}

    return map_batches(documents(docs, id_col, text_col), "doc_id long, fp long", run)


def _segments(fps: np.ndarray) -> np.ndarray:
    return np.stack([(fps >> np.uint64(BITS * i)) & np.uint64(0xFFFF) for i in range(SEGMENTS)])


def _keys(max_bits: int):
    """Rows (key, probe, fp): probe 0 under the own key, probe 1 under each neighbour key."""
    first, second = max_bits // SEGMENTS, 2 * max_bits // SEGMENTS
    if first or second > 1:
        raise ValueError("the pigeonring keys are made for at most 3 differing bits")
    flips = np.array([0] + [1 << i for i in range(BITS) if second], np.uint64)

    def run(batch: pa.RecordBatch) -> dict:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        seg = _segments(fps)
        keys, probes, out = [], [], []
        for i in range(SEGMENTS):
            a, b = seg[i], seg[(i + 1) % SEGMENTS]
            k = (np.uint64(i) << np.uint64(32)) | (a << np.uint64(16))
            keys.append((k[:, None] | (b[:, None] ^ flips[None, :])).ravel())
            probes.append(np.tile((flips > 0).astype(np.int8), len(fps)))
            out.append(np.repeat(fps, len(flips)))
        return {"key": np.concatenate(keys).view(np.int64), "probe": np.concatenate(probes),
                "fp": np.concatenate(out).view(np.int64)}

    return run


def _own_keys(max_bits: int):
    """Rows (key): the fingerprints' own keys, one for each start."""
    keys = _keys(max_bits)

    def run(batch: pa.RecordBatch) -> dict:
        out = keys(batch)
        return {"key": out["key"][out["probe"] == 0]}

    return run


def _longer(max_bits: int):
    """Rows (key, third, probe, fp): a hot key's rows once for each third segment the budget allows, others once with -1.

    Probe 0 stays for a fingerprint's own key and third segment alone.
    """
    budget = 3 * max_bits // SEGMENTS
    one = np.array([1 << i for i in range(BITS)], np.int64)
    two = np.array([1 << i | 1 << j for i in range(BITS) for j in range(i)], np.int64)
    masks = [np.concatenate([np.zeros(1, np.int64), *(one, two)[:n]]) for n in range(3)]

    def run(batch: pa.RecordBatch) -> dict:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        probe = batch.column(1).to_numpy(zero_copy_only=False)
        fp = batch.column(2).to_numpy(zero_copy_only=False)
        hot = batch.column(3).to_numpy(zero_copy_only=False)
        cols = [(key[~hot], np.full((~hot).sum(), -1, np.int64), probe[~hot], fp[~hot])]
        for used in (0, 1):  # bits the second segment differs in
            at = hot & (probe == used)
            k, f, turned = key[at], fp[at], masks[budget - used]
            third = np.choose(((k >> 32) + 2) % SEGMENTS, _segments(f.view(np.uint64)).astype(np.int64)) if len(k) else k
            cols.append((np.repeat(k, len(turned)), (third[:, None] ^ turned[None, :]).ravel(),
                         np.tile(((turned > 0) | (used > 0)).astype(np.int8), len(k)), np.repeat(f, len(turned))))
        return dict(zip(("key", "third", "probe", "fp"), (np.concatenate(c) for c in zip(*cols))))

    return run


def _links(budgets: np.ndarray, max_bits: int):
    """Streams rows sorted by (key, third, probe); emits a spanning forest of the links under each key.

    Probe-0 rows of a key come first and are kept: ``HOT_KEY`` of a short key,
    2^16 of a longer one, at most.  Further rows are compared with them as they
    come, ``PROBES`` at a time, so a key's other rows may be any number.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(base: np.ndarray, start: int, rows: np.ndarray, own: bool, parent: dict, out: list) -> None:
        seg_b = _segments(base)
        block = max(1, BLOCK // len(base))
        for at in range(0, len(rows), block):
            part = rows[at:at + block]
            x = part[:, None] ^ base[None, :]
            near = np.bitwise_count(x) <= max_bits
            if own:
                near &= part[:, None] < base[None, :]
            if not near.any():
                continue
            i, j = np.nonzero(near)
            diff = np.bitwise_count(_segments(part)[:, i] ^ seg_b[:, j])
            chain = np.cumsum(np.stack([diff[(start + s) % SEGMENTS] for s in range(SEGMENTS)]), axis=0)
            ok = (chain <= budgets[:, None]).all(axis=0)
            for u, v in zip(part[i[ok]].tolist(), base[j[ok]].tolist()):
                ru, rv = _find(parent, u), _find(parent, v)
                if ru != rv:
                    parent[max(ru, rv)] = min(ru, rv)
                    out.append((u, v))

    def run(batches):
        key, base, probes, held, own_done = None, [], [], 0, False
        parent: dict = {}
        pending: list = []

        def flush():
            nonlocal base, probes, held, own_done
            if not own_done and (probes or len(base) > 1):
                base = np.array(base, np.uint64)
                if len(base) > 1:
                    compare(base, key[0] >> 32, base, True, parent, pending)
                own_done = True
            if probes:
                compare(base, key[0] >> 32, np.concatenate(probes), False, parent, pending)
            probes, held = [], 0

        for batch in batches:
            ks, ts, ps, fs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fs = fs.view(np.uint64)
            bounds = [0, *(np.flatnonzero((np.diff(ks) != 0) | (np.diff(ts) != 0)) + 1).tolist(), len(ks)]
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                if (int(ks[lo]), int(ts[lo])) != key:
                    flush()
                    key, base, own_done, parent = (int(ks[lo]), int(ts[lo])), [], False, {}
                split = lo if ps[lo] else lo + int(np.count_nonzero(ps[lo:hi] == 0))
                if split > lo:
                    base += fs[lo:split].tolist()
                if split < hi and len(base):  # without an own row nothing is compared under this key
                    probes.append(fs[split:hi].copy())
                    held += hi - split
                    if held >= PROBES:
                        flush()
            while len(pending) > 10_000:
                part, pending[:] = pending[:100_000], pending[100_000:]
                yield _edges(part, schema)
        flush()
        yield _edges(pending, schema)

    return run


def _find(parent: dict, x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def _edges(pairs: list, schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array([p[i] for p in pairs], np.uint64).view(np.int64)) for i in (0, 1)], schema=schema)


def links(fps: DataFrame, max_bits: int = 3, hot_key: int = HOT_KEY) -> DataFrame:
    """Edges (a, b) between different fingerprints of column ``fp``: they connect exactly what distance links connect."""
    budgets = np.array([(s + 1) * max_bits // SEGMENTS for s in range(SEGMENTS)])
    distinct = fps.select("fp").distinct()
    hot = broadcast_groups(map_batches(distinct, "key long", _own_keys(max_bits), rows=2000)
                           .groupBy("key").count().where(F.col("count") > hot_key).select("key", F.lit(True).alias("hot")))
    keyed = map_batches(distinct, "key long, probe byte, fp long", _keys(max_bits), rows=2000) \
        .join(hot, "key", "left").select("key", "probe", "fp", F.coalesce("hot", F.lit(False)).alias("hot"))
    return (map_batches(keyed, "key long, third long, probe byte, fp long", _longer(max_bits), rows=2000)
            .repartition("key", "third").sortWithinPartitions("key", "third", "probe")
            .mapInArrow(trimmed(_links(budgets, max_bits)), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row; component_id is the smallest doc_id reachable by links.

    Texts without words have fingerprint 0 and are linked like any other; a
    null id counts as no id (it never is a component's smallest one unless
    the component has no other); repeated rows give repeated rows.
    """
    from postlytics.llm.common import cut_lineage

    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = connected_components(links(groups, max_bits))
    rooted = groups.join(comp, groups["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = cut_lineage(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         max_bits: int = 3) -> DataFrame:
    """One document of each group stays: the one with the smallest id; columns as given.

    Rows that repeat the id of a kept document are one document and stay
    together; groups whose rows all lack an id stay whole.
    """
    near = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    name = fresh(docs, "gone_id")
    gone = near.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
