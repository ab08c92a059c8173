"""Ranked lexical search of many short items over all documents, without an index of the documents.

The distinct terms of the items become one Aho-Corasick automaton of guarded words (a space on both sides), which
is broadcast.  A document is folded to lower-case words with single-byte gaps and run through the automaton once:
what it emits are the document's term frequencies.  A first scan counts documents, lengths and document
frequencies, a second one scores: each output term is mapped to the items that hold it, and a task keeps the best
documents of each item only.  Integer scores make the result independent of how the rows lie.

Items are taken in shards of at most ``shard_terms`` terms (an item longer than that is a shard of its own), which
bounds the automaton and what the driver holds at a time; each shard scans the documents.

Rules: a null text has no terms; such documents count nowhere.  Every document row counts, repeated ones as well.
Rows without an id come last among equal scores.  Items that share id and text are one; items of one id with
different texts are ranked apart under that id.  An empty table on either side gives no row.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlytics.llm.common import ship, slices

#: digits, letters and all bytes from 0x80 make terms; A-Z are folded, everything else is a gap
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SALTS = 64
NO_ID = np.iinfo(np.int64).max


def fold(raw: bytes) -> bytes:
    return b" " + raw.translate(FOLD) + b" "


def n_terms(folded: bytes) -> int:
    a = np.frombuffer(folded, np.uint8) != 32
    return int(np.count_nonzero(a[1:] & ~a[:-1]))


class Shard:
    """Items as lists of terms, and the automaton of their distinct terms (built once in each worker)."""

    _built: dict[str, ahocorasick.Automaton] = {}

    def __init__(self, texts: list[bytes]):
        self.key = uuid.uuid4().hex
        counts = [Counter(fold(t).split()) for t in texts]
        self.terms = sorted({w for c in counts for w in c})
        number = {w: i for i, w in enumerate(self.terms)}
        # by term: the items that hold it and how often
        pairs = sorted((number[w], i, k) for i, c in enumerate(counts) for w, k in c.items())
        self.items, self.times = (np.array([p[j] for p in pairs], np.int64) for j in (1, 2))
        self.at = np.searchsorted([p[0] for p in pairs], np.arange(len(self.terms) + 1))
        self.n_items = len(texts)

    def automaton(self) -> ahocorasick.Automaton:
        if self.key not in self._built:
            self._built.clear()
            made = ahocorasick.Automaton()
            for i, w in enumerate(self.terms):
                made.add_word(f" {w.decode('latin-1')} ", i)
            made.make_automaton()
            self._built[self.key] = made
        return self._built[self.key]

    def frequencies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, then (text, term, tf) of each item term found."""
        found, number = self.automaton().iter, itemgetter(1)
        n, docs, terms, tfs = [], [], [], []
        for i, raw in enumerate(column.cast(pa.binary()).to_pylist()):
            folded = fold(raw or b"")
            n.append(n_terms(folded))
            tf = Counter(map(number, found(folded.decode("latin-1"))))
            docs += [i] * len(tf)
            terms += tf.keys()
            tfs += tf.values()
        return tuple(np.array(x, np.int64) for x in (n, docs, terms, tfs))


def _counts(docs: DataFrame, shard) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, their terms, and the document frequency of each of the shard's terms."""
    def run(batches):
        s = shard.value
        df, n, length = np.zeros(len(s.terms), np.int64), 0, 0
        for whole in batches:
            for batch in slices(whole, 500):
                per, _, terms, _ = s.frequencies(batch.column("text"))
                df += np.bincount(terms, minlength=len(df))
                n, length = n + int(np.count_nonzero(per)), length + int(per.sum())
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *used], pa.int64()), pa.array([n, length, *df[used]], pa.int64())], ["k", "v"])

    got = dict(map(tuple, docs.select("text").mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()))
    return got.pop(-2, 0), got.pop(-1, 0), got


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each item."""
    order = np.lexsort((doc, -score, item))
    item = item[order]
    first = np.flatnonzero(np.diff(item, prepend=-1))
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    return order[rank < k]


def _candidates(docs: DataFrame, shard, weights: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """(item, score, doc_id): the k best documents of each item in each task."""
    def scored(s: Shard, batch: pa.RecordBatch):
        per, row, term, tf = s.frequencies(batch.column("text"))
        m = np.array([100 - 75 + (75 * int(x) * n_docs) // length for x in per], np.int64)
        ids = batch.column("doc_id")
        ids = np.where(ids.is_null().to_numpy(zero_copy_only=False), NO_ID, ids.fill_null(0).to_numpy(zero_copy_only=False))
        part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        fan = s.at[term + 1] - s.at[term]
        # rows of a text stay together; a piece expands to about a million (text, item) pairs
        ends = np.flatnonzero(np.diff(row, append=-1)) + 1
        lo = 0
        for piece in _pieces(np.add.reduceat(fan, np.concatenate([[0], ends[:-1]])) if len(ends) else fan, 1_000_000):
            hi = ends[piece - 1]
            f = fan[lo:hi]
            at = np.repeat(s.at[term[lo:hi]] - np.concatenate([[0], np.cumsum(f)[:-1]]), f) + np.arange(f.sum())
            code = np.repeat(row[lo:hi], f) * s.n_items + s.items[at]
            value = np.repeat(part[lo:hi], f) * s.times[at]
            order = np.argsort(code, kind="stable")
            code, value = code[order], value[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            yield code[first] % s.n_items, np.add.reduceat(value, first), ids[code[first] // s.n_items]
            lo = hi

    def run(batches):
        s = shard.value
        bar = np.zeros(s.n_items, np.int64)  # k-th best score of each item so far
        kept = [np.zeros(0, np.int64)] * 3
        for whole in batches:
            for batch in slices(whole, 500):
                for item, score, doc in scored(s, batch):
                    ok = (score > 0) & (score >= bar[item])
                    if not ok.any():
                        continue
                    kept = [np.concatenate([a, b[ok]]) for a, b in zip(kept, (item, score, doc))]
                    best = _best(*kept, k)
                    kept = [a[best] for a in kept]
                    last = np.flatnonzero(np.diff(kept[0], append=-1))
                    full = np.bincount(kept[0], minlength=s.n_items)[kept[0][last]] == k
                    bar[kept[0][last[full]]] = kept[1][last[full]]
        for lo in range(0, len(kept[0]), 10_000):
            item, score, doc = (a[lo:lo + 10_000] for a in kept)
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc, mask=doc == NO_ID)], ["item", "score", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "item long, score long, doc_id long")


def _pieces(sizes: np.ndarray, most: int):
    """Ends of runs of whole texts with about ``most`` pairs."""
    total = 0
    for i, n in enumerate(sizes.tolist(), 1):
        total += n
        if total >= most or i == len(sizes):
            yield i
            total = 0


def shards(items: DataFrame, id_col: str, text_col: str, shard_terms: int):
    """Rows (id, text) of each shard of items in turn; equal rows are one item."""
    items = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").distinct()
    # a term has a byte at least and a gap
    size = items.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / 2 / shard_terms))
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        rows = items.where(bucket == i).collect()
        if rows:
            yield [r["item_id"] for r in rows], [r["text"].encode() for r in rows]


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text", shard_terms: int = 500_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(items.dtypes)[item_id]
    out = None
    for ids, texts in shards(items, item_id, item_text, shard_terms):
        shard = Shard(texts)
        sent = spark.sparkContext.broadcast(shard)
        n, length, df = _counts(rows, sent)
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(shard.terms))], np.int64)
        if not n or not len(weights):
            continue
        found = _candidates(rows, sent, weights, n, length, k)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        # a task's best, then the best of a salt, then of all
        some = Window.partitionBy("item", "salt").orderBy(*order)
        found = (found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("rank", F.row_number().over(some))
                 .where(F.col("rank") <= k).drop("salt", "rank"))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind}")
        found = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out
