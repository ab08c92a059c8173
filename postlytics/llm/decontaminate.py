"""Benchmark decontamination: block-max WAND over a BM25 index of the test items.

The benchmark is the stated query set's index: items are cut into shards of
bounded size, and each shard's inverted index goes to the tasks that scan the
training texts.  A posting holds the BM25 weight of a term in an item (document
frequencies are those of the whole training corpus) divided by the weight the
item gives itself, so one threshold fits all items: an item is retrieved by a
passage that holds at least ``threshold`` of its weight.
Items lie in blocks of ``BLOCK``; the block's best weight of each term bounds
what a passage can reach in it, and only blocks that can reach the threshold
are opened.  Inside, WAND moves the term cursors to the first item whose bounds
can reach it.

Passages are overlapping windows over the whole text, so wide that any item
lies whole in one.  A retrieved item counts as leaked if the passage holds 0.8
or more of the five-word shingles of its question and, after that, 0.8 or more
of its answer's words in order.  An item without an answer column is split:
its first two thirds of words are the question.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.llm.common import documents, lower, map_batches, ship, slices, trimmed

WORD = re.compile(r"[^\W_]+")
BLOCK = 16
SHARD_ITEMS, SHARD_WORDS = 2048, 200_000
K1, B = 1.2, 0.75
SHINGLE = 5


def words_of(text: str) -> list[str]:
    return WORD.findall(lower(text))


class Shard:
    """Index of some items: postings, block maxima, and the terms an item can't be retrieved without."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], df: dict[str, int], n_texts: int, mean_len: float,
                 threshold: float):
        """``df``: in how many of the ``n_texts`` training texts a term occurs."""
        self.items, self.threshold = items, threshold
        weights = []
        for _, q, a in items:
            tf = Counter(q + a)
            norm = K1 * (1 - B + B * max(1, sum(tf.values())) / mean_len)
            w = {t: math.log(1 + (n_texts - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) * n * (K1 + 1) / (n + norm)
                 for t, n in tf.items()}
            whole = sum(w.values()) or 1.0
            weights.append({t: x / whole for t, x in w.items()})
        terms = sorted({t for w in weights for t in w})
        self.term = {t: i for i, t in enumerate(terms)}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in terms]
        self.block_max = np.zeros((len(terms) + 1, -(-len(items) // BLOCK)), np.float32)
        essential = np.zeros(len(terms) + 1, bool)
        for o, w in enumerate(weights):
            for t, x in w.items():
                i = self.term[t]
                self.postings[i].append((o, x))
                self.block_max[i, o // BLOCK] = max(self.block_max[i, o // BLOCK], x)
            # commonest terms first, as long as they can't reach the threshold by themselves
            rest = 0.0
            for t in sorted(w, key=lambda t: (-df.get(t, 0), t)):
                rest += w[t]
                if rest >= threshold - 1e-6:
                    essential[self.term[t]] = True
        self.essential = essential
        self.shingles = [{tuple(q[i:i + SHINGLE]) for i in range(max(1, len(q) - SHINGLE + 1))} for _, q, _ in items]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items that the distinct ``terms`` give at least the threshold: block-max WAND."""
        found = []
        limit = self.threshold - 1e-6
        bounds = self.block_max[terms]
        for block in np.flatnonzero(bounds.sum(axis=0) >= limit).tolist():
            top = bounds[:, block]
            lo, hi = block * BLOCK, (block + 1) * BLOCK
            lists = [[p for p in self.postings[t] if lo <= p[0] < hi] for t, b in zip(terms, top.tolist()) if b > 0]
            best = [b for b in top.tolist() if b > 0]
            at = [0] * len(lists)
            order = sorted(range(len(lists)), key=lambda i: lists[i][0][0])
            while order:
                total, pivot = 0.0, None
                for i in order:
                    total += best[i]
                    if total >= limit:
                        pivot = lists[i][at[i]][0]
                        break
                if pivot is None:
                    break
                if lists[order[0]][at[order[0]]][0] == pivot:
                    score = 0.0
                    for i in order:
                        if lists[i][at[i]][0] != pivot:
                            break
                        score += lists[i][at[i]][1]
                        at[i] += 1
                    if score >= limit:
                        found.append((pivot, score))
                else:
                    for i in order:
                        while at[i] < len(lists[i]) and lists[i][at[i]][0] < pivot:
                            at[i] += 1
                order = sorted((i for i in order if at[i] < len(lists[i])), key=lambda i: lists[i][at[i]][0])
        return found

    def verify(self, item: int, passage: list[str], need: float) -> tuple[float, float] | None:
        """Overlaps of question and answer, if both are enough."""
        _, q, a = self.items[item]
        want = self.shingles[item]
        size = min(SHINGLE, len(q))
        hits = [i for i in range(len(passage) - size + 1) if tuple(passage[i:i + size]) in want]
        question = len({tuple(passage[i:i + size]) for i in hits}) / len(want) if q else 1.0
        if question < need:
            return None
        answer = ordered_overlap(a, passage[hits[0]:] if hits else passage) if a else 1.0
        return (question, answer) if answer >= need else None


def ordered_overlap(answer: list[str], passage: list[str]) -> float:
    """Share of the answer's words that the passage holds in order and close by (longest common subsequence).

    Close by: inside some stretch twice as long as the answer.
    """
    best, span = 0, 2 * len(answer)
    for at in range(0, max(1, len(passage) - len(answer) + 1), max(1, len(answer) // 2)):
        part = passage[at:at + span]
        row = [0] * (len(part) + 1)
        for w in answer:
            diag = 0
            for j, p in enumerate(part, 1):
                diag, row[j] = row[j], diag + 1 if w == p else max(row[j], row[j - 1])
        best = max(best, row[-1])
        if best == len(answer):
            break
    return best / len(answer)


def _frequencies(source: DataFrame, terms: frozenset[str]) -> dict[str, int]:
    """How many texts hold each of the index's terms, and under "" how many there are (all texts; as large as the index)."""
    arrow = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def count(batches):
        sums: Counter = Counter()
        for batch in batches:
            sums[""] += batch.num_rows
            for t in batch.column(0).to_pylist():
                sums.update(terms.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())],
                                         schema=arrow)

    rows = source.select("text").mapInArrow(trimmed(count), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in rows.toLocalIterator()}


def shards(source: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None, threshold: float):
    """Index shards of the whole benchmark, and its longest item in words.

    Items without any word can't leak and are left out; items of the same id
    are separate items.
    """
    cols = [F.col(f"`{id_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("q"),
            (F.col(f"`{answer_col}`").cast("string") if answer_col else F.lit(None).cast("string")).alias("a")]
    items, terms, total = [], set(), 0
    for row in benchmark.select(*cols).orderBy("item_id", "q").toLocalIterator():
        q, a = words_of(row["q"]), words_of(row["a"] or "")
        if answer_col is None and len(q) > 1:
            cut = -(-2 * len(q) // 3)
            q, a = q[:cut], q[cut:]
        if q or a:
            items.append((row["item_id"], q, a))
            terms.update(q, a)
            total += len(q) + len(a)
    longest = max((len(q) + len(a) for _, q, a in items), default=0)
    out, part, n = [], [], 0
    for it in items:
        part.append(it)
        n += len(it[1]) + len(it[2])
        if len(part) >= SHARD_ITEMS or n >= SHARD_WORDS:
            out.append(part)
            part, n = [], 0
    if part:
        out.append(part)
    if not out:
        return [], longest
    df = _frequencies(source, frozenset(terms))
    n_texts = df.pop("", 0)
    return [Shard(p, df, n_texts, total / len(items), threshold) for p in out], longest


def scan_text(words: list[str], shard: Shard, stride: int, need: float) -> list[tuple[int, float, float, float, int]]:
    """(item, score, question, answer, first word of the passage): the best passage of each leaked item."""
    get = shard.term.get
    none = len(shard.postings)
    ids = np.array([get(w, none) for w in words], np.int64)
    hot = np.unique(np.flatnonzero(shard.essential[ids]) // stride)
    if not len(hot):
        return []
    best: dict[int, tuple] = {}
    for k in np.unique(np.concatenate([hot - 1, hot])).tolist():
        lo, hi = max(k, 0) * stride, (k + 2) * stride
        terms = np.unique(ids[lo:hi])
        terms = terms[terms < none]
        if not len(terms):
            continue
        for item, score in shard.search(terms):
            over = shard.verify(item, words[lo:hi], need)
            if over and (item not in best or (over, score) > (best[item][2:4], best[item][1])):
                best[item] = (item, float(score), *over, lo)
    return [best[i] for i in sorted(best)]


HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_word int"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
          threshold: float = 0.5, need: float = 0.8) -> DataFrame:
    """(doc_id, item_id, score, overlaps, passage_word): one row per text and item it leaks, from its best passage.

    Null and empty texts and an empty benchmark leak nothing; repeated rows
    give repeated rows.
    """
    source = documents(docs, id_col, text_col)
    parts, longest = shards(source, benchmark, item_id_col, item_text_col, answer_col, threshold)
    stride = max(64, longest)
    out = None
    for shard in parts:
        def run(batch: pa.RecordBatch, shard=shard) -> dict:
            rows = [(d, shard.items[h[0]][0], *h[1:]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for h in scan_text(words_of(t), shard, stride, need)]
            return {n: [r[i] for r in rows] for i, n in enumerate(("d", "i", "s", "q", "a", "w"))}

        hits = map_batches(source, HITS, run)
        out = hits if out is None else out.unionByName(hits)
    return docs.sparkSession.createDataFrame([], HITS) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", answer_col: str | None = None, threshold: float = 0.5,
                      need: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that leak no item, columns as given; the decision is made row by row, without a join."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    parts, longest = shards(texts, benchmark, item_id_col, item_text_col, answer_col, threshold)
    stride = max(64, longest)
    at = docs.columns.index(text_col)
    for shard in parts:
        def run(batches, shard=shard):
            for batch in (part for whole in batches for part in slices(whole, 1000)):
                clean = [not scan_text(words_of(t or ""), shard, stride, need) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs
