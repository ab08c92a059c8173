"""Exact substring dedup by merging shard Burrows-Wheeler transforms.

A byte goes if a ``size``-byte string that covers it also starts earlier.  All
strings are judged, but few need their bytes compared:

1. Every start of a ``size``-byte string belongs to an anchor, the leftmost
   least hash of the GRAM-byte grams inside the string.  Equal strings have the
   same anchor at the same place, so strings are only ever compared under one
   anchor hash.  Neighbouring starts with one anchor make a *context* of up to
   184 bytes, named by its hash; a text gives a context every 43 bytes or so.
2. Contexts with one name are copies; the first one stays, the rest goes, and
   only it can hold strings of other contexts.  Tasks do this for their own
   texts first, so a copied passage is sent once a task.
3. Where an anchor has different contexts, these are cut further by their
   strings' *greatest* gram (again shared by equal strings) and meet in
   groups.  Each group's contexts form shards of bounded size; every shard's
   suffixes are sorted and its transform is made, and the transforms are
   merged by refining their interleave: round h moves the interleave, sorted
   by h - 1 symbols, by the symbols of the transforms, and marks where prefixes
   first differ.  The marks are the common prefix lengths; stretches without a
   mark after the last round are the repeated intervals.  Suffixes are never
   sorted again.  A symbol is a block of 25 bytes (suffixes still start at
   every byte), so 100 bytes take four rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.llm.common import cut_lineage, documents, mix64, slices, spark_schema

GRAM = 16
CHUNK = 1 << 21
SHARD, MERGE = 60_000, 1 << 19
_LOW = np.uint64(0xFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS[0], _POWERS[1]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position (by doubling)."""
    with np.errstate(over="ignore"):
        h, size, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
        while size < GRAM:
            h = h[:len(h) - size] + h[size:] * np.uint64(power)
            size, power = 2 * size, power * power & (1 << 64) - 1
    return mix64(h)


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """Position of the leftmost least upper half of the hash in each window."""
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= window:
        low = np.minimum(low[:len(low) - size], low[size:])
        size *= 2
    rest = window - size
    if rest:
        low = np.minimum(low[:len(low) - rest], low[rest:])
    return (low & _LOW).astype(np.int64)


def _pieces(ids: list[int], texts: list[str], size: int):
    """Runs of (doc, offset, bytes) of about CHUNK bytes; very long texts come in pieces that overlap by size - 1 bytes."""
    run, n = [], 0
    for doc, text in zip(ids, texts):
        raw = text.encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - size + 1), CHUNK):
            part = raw[at:at + CHUNK + size - 1]
            if len(part) >= size:
                run.append((doc, at, part))
                n += len(part)
            if n >= CHUNK:
                yield run
                run, n = [], 0
    if run:
        yield run


def contexts(run: list[tuple[int, int, bytes]], size: int) -> tuple[np.ndarray, ...]:
    """(key, name, doc, start, count, lead) of each context: its anchor's hash, its hash, where its first string
    starts, how many strings start in it, and how far before the anchor the first one starts."""
    data = np.frombuffer(b"".join(p for _, _, p in run), np.uint8)
    sizes = np.fromiter((len(p) for _, _, p in run), np.int64, len(run))
    ends = np.cumsum(sizes)
    h = _grams(data)
    anchor = _least(h, size - GRAM + 1)
    piece = np.repeat(np.arange(len(run)), sizes - size + 1)
    begin = ends - sizes
    starts = np.arange(len(piece)) - np.repeat(np.cumsum(sizes - size + 1) - (sizes - size + 1), sizes - size + 1) + begin[piece]
    a = anchor[starts]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (piece[1:] != piece[:-1])]))
    count = np.diff(np.append(head, len(a)))
    s, a, piece = starts[head], a[head], piece[head]
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)])])
        stop = s + count + size - 1
        name = mix64((total[stop] - total[s]) * inverse[s] + (a - s).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                     + count.astype(np.uint64))
    doc = np.fromiter((d for d, _, _ in run), np.int64, len(run))
    off = np.fromiter((o for _, o, _ in run), np.int64, len(run))
    return h[a], name, doc[piece], s - begin[piece] + off[piece], count, a - s


#: loc packs (start, count, lead): count and lead are under 256.
ROWS = "kind int, key long, name long, doc long, loc long"


def _batch(arrays: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema(ddl))


def _context_rows(size: int):
    """kind 0: the first context of its name in this chunk; kind 1: a later copy, which goes."""
    schema = _arrow(ROWS)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 4000):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                texts = batch.column(1).to_pylist()
                for part in _pieces(ids[order].tolist(), [texts[i] for i in order], size):
                    key, name, doc, start, count, lead = contexts(part, size)
                    by = np.lexsort((start, doc, name))
                    n, d = name[by], doc[by]
                    copy = np.concatenate([[False], n[1:] == n[:-1]])
                    loc = (start << 16) | (count << 8) | lead
                    yield _batch([copy.astype(np.int32), key[by].view(np.int64), n.view(np.int64), d, loc[by]], schema)

    return run


def _by_name():
    """Rows sorted by (key, name, doc, loc).  Kind 1: all copies; kind 2: first contexts of a key that has several."""
    schema = _arrow("kind int, key long, doc long, loc long")

    def run(batches):
        last = None  # (key, name) of the row before
        held = None  # the only first context of the key so far, until it has a second
        for batch in batches:
            kind, key, name, doc, loc = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            ready = kind == 1
            out = [[np.ones(int(ready.sum()), np.int32)], [key[ready]], [doc[ready]], [loc[ready]]]
            key, name, doc, loc = key[~ready], name[~ready], doc[~ready], loc[~ready]
            if len(key):
                same_key = np.concatenate([[last is not None and last[0] == key[0]], key[1:] == key[:-1]])
                same = same_key & np.concatenate([[last is not None and last[1] == name[0]], name[1:] == name[:-1]])
                first = np.flatnonzero(~same)
                for o, v in zip(out, (np.ones(int(same.sum()), np.int32), key[same], doc[same], loc[same])):
                    o.append(v)
                # first contexts by key, with the one held from before
                k, d, x = key[first], doc[first], loc[first]
                open_before = last is not None and len(key) and last[0] == key[0]
                group = np.cumsum(~same_key)[first]
                sizes = np.bincount(group, minlength=int(group.max()) + 1 if len(group) else 1)
                many = sizes > 1
                if open_before and sizes[0]:
                    many[0] = True
                    if held is not None:
                        for o, v in zip(out, ([2], [held[0]], [held[1]], [held[2]])):
                            o.append(np.array(v))
                        held = None
                end_group = int(np.cumsum(~same_key)[-1])
                if not (open_before and end_group == 0):
                    held = None  # the key held from before has ended or has been given out
                take = many[group] if len(group) else np.zeros(0, bool)
                for o, v in zip(out, (np.full(int(take.sum()), 2, np.int32), k[take], d[take], x[take])):
                    o.append(v)
                if end_group < len(sizes) and sizes[end_group] == 1 and not many[end_group]:
                    i = np.flatnonzero(group == end_group)[0]
                    held = (k[i], d[i], x[i])
                last = (key[-1], name[-1])
            yield _batch([np.concatenate(o) for o in out], schema)

    return run


GROUPED = "grp long, doc long, start long, count int, bytes binary"


def _cut(size: int):
    """Texts with the contexts to compare: cut by each string's greatest gram."""
    schema = _arrow(GROUPED)
    width = size - GRAM + 1

    def one(docs: list, raws: list[bytes], items: list[list]) -> list:
        data = b"".join(raws)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        ends = np.cumsum(sizes)
        per = np.fromiter(map(len, items), np.int64, len(items))
        of = np.repeat(np.arange(len(raws)), per)
        flat = [t for todo in items for t in todo]
        key = np.fromiter((t["key"] for t in flat), np.int64, len(flat)).view(np.uint64)
        loc = np.fromiter((t["loc"] for t in flat), np.int64, len(flat))
        start, count, lead = (loc >> 16) + (ends - sizes)[of], loc >> 8 & 255, loc & 255
        fits = start + count + size - 1 <= ends[of]  # else another row of the same id
        key, of, start, count, lead = key[fits], of[fits], start[fits], count[fits], lead[fits]
        if not len(start):
            return [[], [], [], [], []]
        h = _grams(np.frombuffer(data, np.uint8))
        top = _least(~h, width)
        item = np.repeat(np.arange(len(start)), count)
        at = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + start[item]
        t = top[at]
        head = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (item[1:] != item[:-1])]))
        n = np.diff(np.append(head, len(t)))
        item, at, t = item[head], at[head], t[head]
        with np.errstate(over="ignore"):
            ahead = (t - (start + lead)[item]).astype(np.uint64)  # from the one gram to the other
            grp = mix64(key[item] * np.uint64(3) + h[t] + ahead * np.uint64(_BASE))
        owner = of[item]
        return [grp.view(np.int64), np.array(docs, np.int64)[owner], at - (ends - sizes)[owner], n.astype(np.int32),
                [data[x:y] for x, y in zip(at.tolist(), (at + n + size - 1).tolist())]]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1000):
                docs = batch.column(0).to_pylist()
                raws = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
                items = batch.column(2).to_pylist()
                lo = n = 0
                for i in range(len(docs) + 1):
                    if i == len(docs) or n > CHUNK:
                        if i > lo:
                            yield _batch(one(docs[lo:i], raws[lo:i], items[lo:i]), schema)
                        lo, n = i, 0
                    if i < len(docs):
                        n += len(raws[i])

    return run


def _stable(ids: np.ndarray) -> np.ndarray:
    """Stable order of non-negative integers, 16 bits at a time (each pass is a radix sort)."""
    order = np.argsort((ids & 0xFFFF).astype(np.uint16), kind="stable")
    high = int(ids.max(initial=0)) >> 16
    shift = 16
    while high:
        order = order[np.argsort((ids[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        high >>= 16
        shift += 16
    return order


def _ranks(values: np.ndarray) -> np.ndarray:
    """Dense ranks of 64-bit hashes."""
    order = _stable(values)
    v = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], v[1:] != v[:-1]]))
    return out


def block_size(size: int) -> int:
    """Bytes that make one symbol: the greatest divisor of ``size`` up to 25."""
    return max(d for d in range(1, 26) if size % d == 0)


def transform(strings: list[bytes], depth: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's transform over an alphabet of ``step``-byte blocks: (symbols, string, offset).

    Suffixes start at every byte and are read block by block, round and round
    within their string (an end mark fills it up to whole blocks); symbols are
    the blocks' hashes and give the order.  Suffixes are in order of their
    first ``depth`` bytes; the symbol of each is the block before it.
    """
    sizes = np.fromiter((-(-(len(s) + 1) // step) * step for s in strings), np.int64, len(strings))
    text = np.zeros(int(sizes.sum()), np.uint64)
    ends = np.cumsum(sizes)
    n = len(text)
    owner = np.repeat(np.arange(len(strings)), sizes)
    begin, length = (ends - sizes)[owner], sizes[owner]
    pos = np.arange(n)
    inside = pos - begin < np.fromiter(map(len, strings), np.int64, len(strings))[owner]
    text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64) + np.uint64(1)
    along = lambda k: begin + (pos - begin + k) % length
    with np.errstate(over="ignore"):
        block = np.zeros(n, np.uint64)
        for k in range(step):
            block = block * np.uint64(_BASE) + text[along(k)] if k else text.copy()
        block = mix64(block)
    rank, done = _ranks(block), step
    order = None
    while done < depth:
        nxt = rank[along(done)]
        order = _stable(nxt)
        order = order[_stable(rank[order])]
        a, b = rank[order], nxt[order]
        new = np.cumsum(np.concatenate([[False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        done *= 2
        if new[-1] == n - 1:
            break
    if order is None:
        order = _stable(rank)
    return block[along(-step)][order], owner[order], (pos - begin)[order]


def merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int, step: int):
    """Interleaves transforms until suffixes are in order of ``depth`` bytes.

    Gives the order (positions in the joined transforms) and for each place the
    bytes in whole blocks it shares with the place before, ``depth`` at most.
    """
    symbols = _ranks(np.concatenate([p[0] for p in parts]))
    n = len(symbols)
    z = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(p[0]) for p in parts])
    mark = np.zeros(n, np.int32)
    mark[0] = 1
    order = np.arange(n)
    for rnd in range(1, depth // step + 1):
        c = symbols[order]
        block = np.cumsum(mark > 0, dtype=np.int32)
        move = _stable(c)
        c, block, z = c[move], block[move], z[move]
        fresh = np.concatenate([[True], (c[1:] != c[:-1]) | (block[1:] != block[:-1])]) & (mark == 0)
        order = np.empty(n, np.int64)
        order[np.argsort(z, kind="stable")] = np.arange(n)
        if not fresh.any() and rnd > 1:
            break
        mark[fresh] = rnd
    return order, np.where(mark > 0, (mark - 1) * step, depth)


def repeated(strings: list[bytes], counts: list[int], order_key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of each of the contexts' first ``counts`` strings that occurs earlier (by ``order_key``, then offset)."""
    step = block_size(size)
    shards, part, n = [], [], 0
    bounds = [0]
    for i, s in enumerate(strings):
        part.append(s)
        n += len(s) + step
        if n >= SHARD or i == len(strings) - 1:
            shards.append(transform(part, size, step))
            bounds.append(i + 1)
            part, n = [], 0
    order, lcp = merge(shards, size, step)
    owner = np.concatenate([s[1] + b for s, b in zip(shards, bounds)])[order]
    offset = np.concatenate([s[2] for s in shards])[order]
    interval = np.cumsum(lcp < size)
    is_start = offset < np.asarray(counts)[owner]
    interval, owner, offset = interval[is_start], owner[is_start], offset[is_start]
    by = _stable(offset)
    by = by[_stable(order_key[owner[by]])]
    by = by[_stable(interval[by])]
    interval, owner, offset = interval[by], owner[by], offset[by]
    later = np.concatenate([[False], interval[1:] == interval[:-1]])
    owner, offset = owner[later], offset[later]
    by = _stable(offset)
    by = by[_stable(owner[by])]
    return owner[by], offset[by]


SPANS = "doc long, start long, stop long"


def _compare(size: int):
    """Rows sorted by (grp, doc, start): finds the repeated strings of each group by merged transforms."""
    schema = _arrow(SPANS)

    def close(group: list, spans: list, ready: list) -> int:
        """Equal contexts are settled at once; what is left of groups of two or more waits for a merge."""
        seen: set[bytes] = set()
        left = []
        for row in group:
            if row[3] in seen:
                spans.append((row[0], row[1], row[1] + row[2] - 1 + size))
            else:
                seen.add(row[3])
                left.append(row)
        if len(left) > 1:
            ready += left
            return sum(len(r[3]) for r in left)
        return 0

    def settle(ready: list, spans: list) -> None:
        key = np.empty(len(ready), np.int64)
        key[np.lexsort(([r[1] for r in ready], [r[0] for r in ready]))] = np.arange(len(ready))
        owner, offset = repeated([r[3] for r in ready], [r[2] for r in ready], key, size)
        if len(owner):
            head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]))
            tail = np.append(head[1:], len(owner)) - 1
            for o, x, y in zip(owner[head].tolist(), offset[head].tolist(), offset[tail].tolist()):
                spans.append((ready[o][0], ready[o][1] + x, ready[o][1] + y + size))

    def run(batches):
        now, group, ready, spans, n = None, [], [], [], 0
        for batch in batches:
            grp = batch.column(0).to_numpy(zero_copy_only=False)
            rows = batch.slice(0)
            cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if grp[lo] != now:
                    if len(group) > 1:
                        n += close(group, spans, ready)
                        if n > MERGE:
                            settle(ready, spans)
                            ready, n = [], 0
                    group, now = [], grp[lo]
                if hi - lo > 1 or group or hi == len(grp):
                    group += zip(*(rows.column(i).slice(lo, hi - lo).to_pylist() for i in (1, 2, 3, 4)))
                elif lo:
                    group = []  # a group of one has nothing to compare
                else:
                    group += zip(*(rows.column(i).slice(lo, 1).to_pylist() for i in (1, 2, 3, 4)))
            yield _batch([[s[i] for s in spans] for i in range(3)], schema)
            spans = []
        if len(group) > 1:
            close(group, spans, ready)
        if ready:
            settle(ready, spans)
        yield _batch([[s[i] for s in spans] for i in range(3)], schema)

    return run


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, doc_id, text): ``doc`` orders the documents, a null id first, and is the id where every id has one text.

    Else it numbers the different (id, text), those of one id by their text's hash, over range partitions.
    """
    rows = documents(docs, id_col, text_col)
    h = F.xxhash64("text").alias("h")
    many = cut_lineage(rows.select("doc_id", h).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi"))
    if many.isEmpty():
        return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "doc_id", "text")
    order = cut_lineage(rows.select("doc_id", h).distinct().repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
                        .withColumn("doc", F.monotonically_increasing_id()))
    order = order.withColumnsRenamed({"doc_id": "of", "h": "oh"})
    return (rows.withColumn("h", h).join(order, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("oh")))
            .select("doc", "doc_id", "text"))


def repeated_spans(source: DataFrame, size: int = 100) -> DataFrame:
    """(doc, start, stop): byte stretches of (doc, text) that ``size``-byte strings starting earlier cover; they may overlap."""
    if not 2 * GRAM <= size <= 255:
        raise ValueError(f"size must be between {2 * GRAM} and 255")
    source = source.select("doc", "text")
    named = source.mapInArrow(_context_rows(size), ROWS)
    # ready rows need no partner, so they are spread by place, not gathered under their key
    part = F.when(F.col("kind") == 1, F.xxhash64("doc", "loc")).otherwise(F.col("key"))
    judged = cut_lineage(named.repartition(part).sortWithinPartitions("key", "name", "doc", "loc")
                         .mapInArrow(_by_name(), "kind int, key long, doc long, loc long"))
    copies = judged.where("kind = 1").select("doc", F.shiftrightunsigned("loc", 16).alias("start"),
                                             (F.shiftrightunsigned("loc", 16) + F.shiftright("loc", 8).bitwiseAND(255) - 1 + size).alias("stop"))
    todo = (judged.where("kind = 2").groupBy(F.col("doc").alias("of"))
            .agg(F.collect_list(F.struct("key", "loc")).alias("todo")))
    grouped = source.join(todo, F.col("doc") == F.col("of")).select("doc", "text", "todo").mapInArrow(_cut(size), GROUPED)
    compared = grouped.repartition("grp").sortWithinPartitions("grp", "doc", "start").mapInArrow(_compare(size), SPANS)
    return copies.unionByName(compared)


NO_ID = -(1 << 63)
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def _keep():
    schema = _arrow(KEPT)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 500):
                rows = []
                for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = text.encode("utf-8", "surrogatepass")
                    merged: list[list[int]] = []
                    for s, e in sorted((s["start"], min(s["stop"], len(raw))) for s in spans or []):
                        if s >= e:
                            continue
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    digest, at = hashlib.sha256(), 0
                    for s, e in merged:
                        digest.update(raw[at:s])
                        at = e
                    digest.update(raw[at:])
                    rows.append((doc, len(raw), sum(e - s for s, e in merged), len(merged),
                                 digest.hexdigest(), [{"start": s, "stop": e} for s, e in merged]))
                yield _batch([[r[i] for r in rows] for i in range(len(schema))], schema)

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row per input row; spans: the maximal removed runs.

    Earlier means a smaller id (a null id comes first) or, in the same text, an
    earlier start.  A null text is empty; texts shorter than ``size`` lose
    nothing.  Equal rows (same id, same text) are one document and get the same
    result; different texts of one id, or of none, are documents of their own,
    in the order of their hash.
    """
    source = numbered(docs, id_col, text_col)
    spans = repeated_spans(source, size).groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return (source.join(spans, F.col("doc") == F.col("of"), "left").select("doc_id", "text", "spans")
            .mapInArrow(_keep(), KEPT))
