"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms of the corpus within a band of inverse document
frequency.  Since a term of the band is in at least ``least_share`` of the
texts, the lexicon has at most (mean distinct terms of a text / least_share)
terms, whatever the size of the corpus; that is the bound of what each task is
sent, and it is checked.  Random subsets of the lexicon come in ``LEVELS``
densities (1/2, 1/4, ...), ``PER_LEVEL`` of each.  A text's sorted distinct
lexicon terms, cut down to each subset, are hashed; the fingerprint is the
list of hashes.  Sparse subsets agree between texts that share part of their
terms, dense ones only between nearly equal texts.

Likeness takes subsets from the sparsest on until ``ENOUGH`` of them hold a
term of either text, and is the share of those that agree.  A text without any
lexicon term has the hash of its whole text for a fingerprint.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.llm.common import documents, lower, spark_schema

WORD = re.compile(r"[^\W_]+")
LEVELS, PER_LEVEL, ENOUGH = 12, 16, 16
SUBSETS = LEVELS * PER_LEVEL
#: Terms one task's counter may hold before it is emptied into the shuffle.
MAX_COUNTED = 400_000


def terms(text: str) -> set[str]:
    return set(WORD.findall(lower(text)))


def frequencies(source: DataFrame) -> DataFrame:
    """(term, df) over all texts; a task counts its own texts first."""
    arrow = pa.schema([("term", pa.string()), ("df", pa.int64())])

    def flush(sums: Counter):
        out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())],
                                         schema=arrow)
        sums.clear()
        return out

    def count(batches):
        sums: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                sums.update(terms(t))
                if len(sums) > MAX_COUNTED:
                    yield flush(sums)
        yield flush(sums)

    return source.select("text").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(source: DataFrame, least_share: float = 0.001, most_share: float = 0.1, least_df: int = 2,
            most_terms: int = 2_000_000) -> list[str]:
    """The terms in the band, sorted.  ``most_terms`` guards the bound: beyond it a larger ``least_share`` is asked for."""
    n = source.count()
    band = frequencies(source).where(F.col("df").between(max(least_df, math.ceil(least_share * n)), max(least_df, int(most_share * n))))
    found = sorted(r["term"] for r in band.select("term").limit(most_terms + 1).toLocalIterator())
    if len(found) > most_terms:
        raise ValueError(f"over {most_terms} terms in the band; raise least_share")
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprinter:
    """Term numbers, term hashes and the subsets each term is in."""

    def __init__(self, words: list[str]):
        self.number = {t: i for i, t in enumerate(words)}
        self.hash = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 1) for t in words], np.uint64)
        self.member = np.zeros((len(words), SUBSETS), bool)
        with np.errstate(over="ignore"):
            for s in range(SUBSETS):
                level = np.uint64(64 - (s // PER_LEVEL + 1))
                self.member[:, s] = _mix(self.hash + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> level == 0

    def of(self, text: str) -> np.ndarray | str:
        """Hash of each subset (0: no term of it), or the text's own hash if no term is in the lexicon."""
        number = self.number
        ids = sorted(number[t] for t in terms(text) if t in number)
        if not ids:
            return "=" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]
        rows = self.member[ids]
        with np.errstate(over="ignore"):
            sums = (rows * self.hash[ids][:, None]).sum(axis=0, dtype=np.uint64)
            out = (_mix(sums) & np.uint64(0xFFFF)).astype(np.uint16)
        out[out == 0] = 1
        out[~rows.any(axis=0)] = 0
        return out


def as_text(print_: np.ndarray | str) -> str:
    return print_ if isinstance(print_, str) else print_.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | str, b: np.ndarray | str) -> float:
    if isinstance(a, str) or isinstance(b, str):
        return float(isinstance(a, str) and isinstance(b, str) and a == b)
    if np.array_equal(a, b):
        return 1.0
    some = ((a | b) > 0).reshape(LEVELS, PER_LEVEL)
    agree = ((a == b) & (a > 0)).reshape(LEVELS, PER_LEVEL)
    n = e = 0
    for level in range(LEVELS - 1, -1, -1):
        n += int(some[level].sum())
        e += int(agree[level].sum())
        if n >= ENOUGH:
            break
    return e / n if n else 0.0


_READY: dict[int, Fingerprinter] = {}


def _fingerprinter(words) -> Fingerprinter:
    """One for each worker and broadcast lexicon."""
    if words.id not in _READY:
        _READY.clear()
        _READY[words.id] = Fingerprinter(words.words)
    return _READY[words.id]


class _Words:
    """Lexicon as tasks receive it: one string, with a key for the worker's cache."""

    def __init__(self, words: list[str]):
        self.joined = "\n".join(words)
        self.id = xxhash.xxh64_intdigest(self.joined.encode("utf-8", "surrogatepass"))

    @property
    def words(self) -> list[str]:
        return self.joined.split("\n") if self.joined else []


def fingerprint(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), one row per input row; equal texts have equal fingerprints."""
    from postlytics.llm.common import map_batches

    sent = docs.sparkSession.sparkContext.broadcast(_Words(words))

    def run(batch: pa.RecordBatch) -> dict:
        f = _fingerprinter(sent.value)
        return {"doc_id": batch.column(0), "fingerprint": [as_text(f.of(t)) for t in batch.column(1).to_pylist()]}

    return map_batches(documents(docs, id_col, text_col), "doc_id long, fingerprint string", run)


NO_ID = -(1 << 63)


def in_order(source: DataFrame, buckets: int | None = None) -> DataFrame:
    """(dest, tail, doc_id, text): the rows in order of (doc_id, text) within each ``dest``, each followed by a tail row.

    Texts go to ranges of ids; the ranges' bounds are quantiles of the ids
    alone.  The first row of each range is also sent, as tail, to the range
    before it (that of the first range to the last), so that every row meets
    its successor without anything passing through one task.  Null ids come
    first.
    """
    spark = source.sparkSession
    buckets = buckets or max(2, 2 * source.rdd.getNumPartitions())
    keyed = source.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    ids = keyed.select("doc_id")
    shares = [i / buckets for i in range(1, buckets)]
    bounds = np.array(sorted({int(x) for x in (ids.approxQuantile("doc_id", shares, 0.1 / buckets) if shares else [])}), dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(x):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, x.to_numpy(), side="right").astype(np.int32))

    first = {r["b"]: r["m"] for r in ids.select(bucket("doc_id").alias("b"), "doc_id").groupBy("b").agg(F.min("doc_id").alias("m")).collect()}
    used = sorted(first)
    before = spark.createDataFrame([(first[b], used[i - 1]) for i, b in enumerate(used)], "first_id long, before int")
    home = keyed.select(bucket("doc_id").alias("dest"), F.lit(False).alias("tail"), "doc_id", "text")
    tails = (keyed.join(F.broadcast(before), F.col("doc_id") == F.col("first_id"))
             .select(F.col("before").alias("dest"), F.lit(True).alias("tail"), "doc_id", "text"))
    return (home.unionByName(tails).repartitionById(max(1, used[-1] + 1 if used else 1), "dest")
            .sortWithinPartitions("dest", "tail", "doc_id", "text"))


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_likeness(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next text, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first
    as many (or all) of the next text in order of (doc_id, text); the last row
    is followed by the first.  A single row follows itself.  Null texts are
    empty; repeated rows follow each other.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema(EDITED))
    sent = docs.sparkSession.sparkContext.broadcast(_Words(words))

    def run(batches):
        f = _fingerprinter(sent.value)
        now = None  # (dest, id, text, fingerprint)
        for batch in batches:
            rows = []
            for dest, tail, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and now[0] != dest:
                    now = None  # the range before ended with its tail
                if now is None and tail:
                    continue
                print_ = f.of(text)
                if now is not None:
                    _, was, old, mine = now
                    k = len(old) // 2
                    edited = old[:len(old) - k] + text[:k]
                    other = f.of(edited)
                    rows.append((None if was == NO_ID else was, len(old),
                                 hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(mine), as_text(other),
                                 likeness(mine, other), likeness(mine, print_)))
                now = None if tail else (dest, doc, text, print_)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(arrow)], schema=arrow)

    return in_order(documents(docs, id_col, text_col)).mapInArrow(run, EDITED)
