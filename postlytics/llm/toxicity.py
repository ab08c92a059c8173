"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words (runs of letters and digits, lower case).  Every term of the labelled rows counts; its weight is its IDF
times a factor that grows with how clearly it tells the classes of the labelled rows apart (z of two proportions)
and is never 0.  Examples with equal vectors are one entry with its numbers of toxic and clean rows.

Entries lie in blocks of BLOCK, like ones side by side, and the index holds for each term the blocks that have it and its
greatest weight there.  For a text these maxima add up to a bound on the cosine of any entry of a block.  Blocks
are scored in rounds from the highest bound down; the k-th best cosine so far is the bar, and a block whose bound
is below it is never opened, so the k nearest are exact.  Votes weigh by distance and are drawn towards the labelled
rows' overall share, which keeps the scores calibrated.  A text with no term of any labelled row gets the share among
labelled rows without any.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.llm.common import by_size, documents, map_batches, ship, word_hashes

BLOCK = 128
ROUNDS = (4,)  # blocks opened before the bar alone decides
EPS = 1e-9


def term_counts(texts: list[str], known: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) of each text, terms ascending: hashes of words, or places in the sorted hashes ``known``."""
    out = []
    for lo, hi in by_size(texts):
        words, per = word_hashes(texts[lo:hi])
        row = np.repeat(np.arange(hi - lo), per)
        if known is not None:
            at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
            has = known[at] == words if len(known) else np.zeros(len(words), bool)
            words, row = at[has].astype(np.uint64), row[has]
        order = np.lexsort((words, row))
        words, row = words[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])])) if len(words) else np.zeros(0, int)
        n = np.diff(np.append(first, len(words)))
        ends = np.searchsorted(row[first], np.arange(1, hi - lo))
        out += zip(np.split(words[first], ends), np.split(n, ends))
    return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the number of each range."""
    size = hi - lo
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


@dataclass
class Model:
    #: sorted term hashes, their weights
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: entries: weights of toxic and clean rows, one example id each
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    clean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    prior: float = 0.0
    empty: float = 0.0
    k: int = 15
    #: the index: a term's blocks are blocks[at[t]:at[t + 1]], with the greatest weight and the place of the first posting each
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    entry: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    opened: int = 0  # blocks opened so far, for tests

    @classmethod
    def build(cls, rows: list[tuple[int, int, np.ndarray, np.ndarray]], k: int) -> "Model":
        """Index of labelled rows (id, label 0 / 1, term hashes, counts)."""
        n1 = sum(y for _, y, _, _ in rows)
        n0 = len(rows) - n1
        if not n0 or not n1:
            return cls(prior=float(bool(n1)), empty=float(bool(n1)), k=k)
        per = np.array([len(t) for _, _, t, _ in rows])
        terms, number = np.unique(np.concatenate([t for _, _, t, _ in rows]), return_inverse=True)
        label = np.repeat([y for _, y, _, _ in rows], per)
        c1 = np.bincount(number[label == 1], minlength=len(terms))
        c0 = np.bincount(number[label == 0], minlength=len(terms))
        p = (c0 + c1) / len(rows)
        z2 = (c1 / n1 - c0 / n0) ** 2 / np.maximum(p * (1 - p) * (1 / n0 + 1 / n1), 1e-12)
        weight = np.log(1 + len(rows) / np.maximum(c0 + c1, 1)) * (1 + z2) / (36 + z2)
        # equal counts make equal vectors
        entries: dict[tuple, list] = {}
        empty = [1.0, 1.0]
        for (i, y, _, n), t in zip(rows, np.split(number, np.cumsum(per)[:-1])):
            if not len(t):
                empty[y] += 1
                continue
            e = entries.setdefault((t.tobytes(), n.tobytes()), [[0, 0], i, t, (1 + np.log(n)) * weight[t]])
            e[0][y] += 1
            e[1] = min(e[1], i)
        # entries of one class and one commonest word (mostly one language) share blocks, so that bounds are close
        common = c0 + c1
        found = sorted(entries.values(), key=lambda e: (e[0][1] >= e[0][0], int(e[2][common[e[2]].argmax()]), int(e[2][e[3].argmax()]), e[1]))
        model = cls(terms, weight, np.array([e[0][1] for e in found], float), np.array([e[0][0] for e in found], float),
                    np.array([e[1] for e in found], np.int64), n1 / len(rows), empty[1] / sum(empty), k)
        if found:
            size = np.array([len(e[2]) for e in found])
            entry = np.repeat(np.arange(len(found), dtype=np.int32), size)
            term = np.concatenate([e[2] for e in found])
            value = np.concatenate([e[3] / math.sqrt(float(e[3] @ e[3])) for e in found])
            order = np.lexsort((entry, term))
            term, entry, value = term[order], entry[order], value[order]
            block = entry // BLOCK
            cut = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
            model.entry, model.value = entry, value
            model.blocks, model.most, model.first = block[cut], np.maximum.reduceat(value, cut), np.append(cut, len(term))
            model.at = np.searchsorted(term[cut], np.arange(len(terms) + 1))
        return model

    def nearest(self, term: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, entries) of the k nearest (more if several share the k-th), best first; the query is a unit vector."""
        if not len(term) or not len(self.example):
            return np.zeros(0), np.zeros(0, int)
        place, size = _ranges(self.at[term], self.at[term + 1])
        block, by = self.blocks[place], np.repeat(query, size)
        n_blocks = -(-len(self.example) // BLOCK)
        bound = np.bincount(block, self.most[place] * by, minlength=n_blocks)
        order = np.argsort(-bound, kind="stable")
        sims, bar, done = np.zeros(len(self.example)), 0.0, 0
        for step in (*ROUNDS, n_blocks):
            # bounds fall along the order: those that may reach the bar come first
            todo = order[done:min(done + step, int(np.searchsorted(-bound[order], EPS - bar, side="right")))]
            todo = todo[bound[todo] > 0]
            if not len(todo):
                break
            open_ = np.zeros(n_blocks, bool)
            open_[todo] = True
            here = open_[block]
            at, n = _ranges(self.first[place[here]], self.first[place[here] + 1])
            sims += np.bincount(self.entry[at], self.value[at] * np.repeat(by[here], n), minlength=len(sims))
            done += len(todo)
            self.opened += len(todo)
            if len(sims) > self.k:
                bar = float(np.partition(sims, len(sims) - self.k)[len(sims) - self.k])
        keep = np.flatnonzero((sims > 0) & (sims >= bar - EPS))
        keep = keep[np.lexsort((self.example[keep], -sims[keep]))]
        return sims[keep], keep

    def scores(self, texts: list[str]) -> list[tuple[float, list[dict]]]:
        out = []
        for term, n in term_counts(texts, self.terms):
            term = term.astype(np.int64)
            query = (1 + np.log(n)) * self.weight[term]
            out.append(self._vote(*self.nearest(term, query / math.sqrt(float(query @ query)) if len(query) else query)))
        return out

    def _vote(self, sims: np.ndarray, at: np.ndarray) -> tuple[float, list[dict]]:
        if not len(at):
            return self.empty, []
        sims = np.minimum(1.0, sims)
        # entries weigh by the logarithm of their rows, so that copies of one text don't outvote the rest
        rows = self.toxic[at] + self.clean[at]
        weight = (1 + np.log(rows)) / (1.05 - sims)
        score = float(((weight * self.toxic[at] / rows).sum() + self.prior) / (weight.sum() + 1.0))
        evidence = [{"doc_id": int(self.example[i]), "similarity": float(s), "toxic": bool(self.toxic[i] >= self.clean[i])}
                    for s, i in zip(sims[:3], at[:3])]
        return min(1.0, max(0.0, score)), evidence


def labelled_sample(labels: DataFrame, label_col: str, id_col: str, limit: int) -> DataFrame:
    """(sample_id, label): at most ``limit`` labelled ids, the least by hash; one row an id, a null label teaches nothing."""
    rows = (labels.select(F.col(f"`{id_col}`").cast("long").alias("sample_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
            .where("sample_id is not null and label is not null").groupBy("sample_id").agg(F.max("label").alias("label")))
    return rows.orderBy(F.xxhash64("sample_id"), "sample_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
        label_col: str = "toxic", max_rows: int = 4_000, k: int = 15) -> Model:
    """Examples from at most ``max_rows`` labelled rows (the documented bound of the classifier's sample).

    The rows' words are counted in tasks; the index, bounded by these rows, is put together from their counts.  Of rows
    that share an id the one with the least text hash is the example.  Without labelled rows every score is 0.
    """
    ship(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, label_col, label_id_col, max_rows))
    rows = documents(docs, id_col, text_col).join(sample, F.col("doc_id") == F.col("sample_id"))
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))

    def count(batch: pa.RecordBatch) -> dict:
        found = term_counts(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"),
                "terms": [t.astype("<u8").tobytes() for t, _ in found], "counts": [n.astype("<i4").tobytes() for _, n in found]}

    counted = map_batches(rows, "doc_id long, label int, terms binary, counts binary", count).toLocalIterator()
    return Model.build(sorted(((r["doc_id"], int(r["label"] > 0), np.frombuffer(r["terms"], "<u8"), np.frombuffer(r["counts"], "<i4"))
                               for r in counted), key=lambda r: r[0]), k)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", evidence: bool = True) -> DataFrame:
    """(doc_id, score, evidence), one row per input row; evidence: the nearest examples.

    Null and empty texts have no term: they get the share among labelled rows
    without one; equal texts get equal scores.
    """
    fields = "doc_id long, score double" + ", evidence array<struct<doc_id:long,similarity:double,toxic:boolean>>" * evidence
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as the sample's distinct words

    def run(batch: pa.RecordBatch) -> dict:
        got = sent.value.scores(batch.column(1).to_pylist())
        out = {"doc_id": batch.column(0), "score": [s for s, _ in got]}
        return out | {"evidence": [e for _, e in got]} if evidence else out

    return map_batches(documents(docs, id_col, text_col), fields, run)
