"""How text filters overlap: counts of removed, redundant and unique failures under every order of the filters.

Five filters judge a text: A (too few words), B (too few distinct words), C (too many capitals), D (holds a symbol)
and E (a row of smaller id has the same text).  A-D follow from the text alone.  E is decided behind a counting
Bloom prepass: tasks sketch the hashes of their texts, the sketches are added page by page, and a text one of whose
cells counts a single text is unique for sure.  Only the others shuffle, as whole texts aggregated in their task
first, for the least id of each text.  The flags then meet the labels and become counts per (part, mask of failed
filters); every figure of every order is a sum of those counts.

Rules: a null text is the empty text and a null part the empty string.  A row without an id never fails E and
makes no other row fail.  Equal rows (same id, same text) don't fail E through each other.  Labels of one id are
taken together (1 if any row has 1).  An empty table gives no row.  Only the named columns are read.
"""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.llm.common import cut_lineage, map_batches, ship

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"

PAGE = 1 << 15  # cells of a page of the sketch; all cells of a text lie in one page
HASHES = 4
CELLS_A_TEXT = 16


def mask(raw: bytes, points: int) -> int:
    """Failed filters A-D of a text given as UTF-8; words are split at the ASCII white space."""
    words = raw.split()
    n = len(words)
    failed = BIT["A"] * (n < 50) | BIT["B"] * (100 * len(set(words)) < 65 * n)
    failed |= BIT["C"] * (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 5 * points)
    return failed | BIT["D"] * (len(raw.translate(None, SYMBOLS)) < len(raw))


def _rows(docs: DataFrame, id_col: str, text_col: str, part_col: str, hash_bits: int) -> DataFrame:
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"),
                       F.shiftrightunsigned(F.xxhash64(text), 64 - hash_bits).alias("h"))


def _flagged(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, part, h, mask) of each row, with its text if asked."""
    def fn(batch: pa.RecordBatch) -> dict:
        text = batch.column("text")
        masks = [mask(raw, n) for raw, n in zip(text.cast(pa.binary()).to_pylist(), pc.utf8_length(text).to_pylist())]
        out = {"doc_id": batch.column("doc_id"), "part": batch.column("part"), "h": batch.column("h"), "mask": masks}
        return out | ({"text": text} if with_text else {})

    return map_batches(rows, "doc_id long, part string, h long, mask int" + ", text string" * with_text, fn)


def _cells(h: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Page of each hash and its cells there, (rows, HASHES)."""
    with np.errstate(over="ignore"):
        u = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        u ^= u >> np.uint64(29)
        page = ((u >> np.uint64(32)) * np.uint64(pages)) >> np.uint64(32)
        u = (u + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        u ^= u >> np.uint64(32)
    shift = np.arange(HASHES, dtype=np.uint64) * np.uint64(15)
    return page.astype(np.int64), ((u[:, None] >> shift) & np.uint64(PAGE - 1)).astype(np.int64)


def sketch(hashes: DataFrame, n: int, max_cells: int) -> bytes:
    """Bitmap of the cells that count two texts or more, from the added sketches of all tasks.

    ``CELLS_A_TEXT`` cells a text, ``max_cells`` at most (an eighth of it in bytes is the most the driver and a
    worker hold).  Past that the bitmap clears fewer texts; what it says of a cleared text always holds.
    """
    pages = max(1, min(max_cells, CELLS_A_TEXT * n) // PAGE)

    def partial(batches):
        held: list[np.ndarray] = []

        def flush():
            if not held:
                return
            page, cells = _cells(np.concatenate(held), pages)
            held.clear()
            codes = np.sort((page[:, None] * PAGE + cells).ravel())
            codes = codes[np.concatenate([[True, True], codes[2:] != codes[:-2]])]  # a counter stops at two
            at = np.flatnonzero(np.diff(codes // PAGE, prepend=-1))
            cells = (codes % PAGE).astype("<u2")
            yield from _sliced({"page": codes[at] // PAGE, "cells": [c.tobytes() for c in np.split(cells, at[1:])]})

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) > 1_000_000:
                yield from flush()
        yield from flush()

    def _sliced(columns: dict):
        for lo in range(0, len(columns["page"]), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(columns["page"][lo:lo + 4096], pa.int64()),
                                              pa.array(columns["cells"][lo:lo + 4096], pa.binary())], ["page", "cells"])

    def add(key, table):
        counts = np.zeros(PAGE, np.int64)
        for cells in table.column("cells"):
            counts += np.bincount(np.frombuffer(cells.as_py(), "<u2"), minlength=PAGE)
        return pa.table({"page": pa.array([key[0].as_py()], pa.int64()),
                         "cells": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())})

    merged = hashes.mapInArrow(partial, "page long, cells binary").groupBy("page").applyInArrow(add, "page long, cells binary")
    bits = np.zeros((pages, PAGE // 8), np.uint8)
    for row in merged.toLocalIterator():
        bits[row["page"]] = np.frombuffer(row["cells"], np.uint8)
    return bits.tobytes()


def _maybe(bitmap: bytes, h: np.ndarray) -> np.ndarray:
    """Which hashes may belong to two texts or more."""
    bits = np.frombuffer(bitmap, np.uint8)
    page, cells = _cells(h, len(bits) * 8 // PAGE)
    cells += page[:, None] * PAGE
    return ((bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=1)


def _least_ids(rows: DataFrame, bitmap) -> DataFrame:
    """(h, text, lo, n): least id and number of rows of every text that the bitmap doesn't clear."""
    def run(batches):
        seen: dict[tuple, list] = {}

        def flush():
            keys, vals = list(seen), list(seen.values())
            for lo in range(0, len(keys), 500):
                k, v = keys[lo:lo + 500], vals[lo:lo + 500]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.binary()),
                                                  pa.array([x[0] for x in v], pa.int64()), pa.array([x[1] for x in v], pa.int64())],
                                                 ["h", "text", "lo", "n"])
            seen.clear()

        size = 0
        for batch in batches:
            keep = _maybe(bitmap.value, batch.column("h").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(keep))
            for i, h, raw in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(),
                                 batch.column("text").cast(pa.binary()).to_pylist()):
                if (h, raw) in seen:
                    had = seen[h, raw]
                    had[0], had[1] = min(had[0], i), had[1] + 1
                else:
                    seen[h, raw] = [i, 1]
                    size += len(raw)
            if size > 32_000_000:
                yield from flush()
                size = 0
        yield from flush()

    return (rows.where("doc_id is not null").select("doc_id", "h", "text").mapInArrow(run, "h long, text binary, lo long, n long")
            .groupBy("h", "text").agg(F.min("lo").alias("lo"), F.sum("n").alias("n")))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    with_id = rows.where("doc_id is not null").join(of, "doc_id", "left")
    none = rows.where("doc_id is null").withColumn("good", F.lit(None).cast("boolean")).withColumn("bad", F.lit(None).cast("boolean"))
    return with_id.unionByName(none).withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "bad")})


KEYS = ("part", "mask", "good", "bad")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                max_cells: int = 1 << 29, hash_bits: int = 64) -> DataFrame:
    """(part, mask, good, bad, n): rows of each part by the set of filters they fail, quality and toxicity.

    ``max_cells`` bounds the sketch.  ``hash_bits`` below 64 only makes different texts of one hash likely (tests).
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col, part_col, hash_bits)
    facts = cut_lineage(_flagged(rows))
    bitmap = spark.sparkContext.broadcast(sketch(facts.where("doc_id is not null").select("h"), facts.count(), max_cells))

    classes = cut_lineage(_least_ids(rows, bitmap))
    by_hash = classes.groupBy("h").agg(F.min("lo").alias("first"), F.sum("n").alias("rows"), F.count("*").alias("texts"))
    repeated = cut_lineage(by_hash.where("rows > 1"))
    mixed = repeated.where("texts > 1").select("h")

    def probe(batches):
        for batch in batches:
            yield batch.append_column("maybe", pa.array(_maybe(bitmap.value, batch.column("h").to_numpy(zero_copy_only=False))))

    known = facts.mapInArrow(probe, "doc_id long, part string, h long, mask int, maybe boolean")
    # from here on a row is a few numbers; equal ids are counted first, so that the least id of a group has its rows
    known = _labelled(known.withColumn("maybe", F.expr("maybe and doc_id is not null")), labels)
    known = known.groupBy("maybe", F.when(F.col("maybe"), F.col("doc_id")).alias("id"), F.when(F.col("maybe"), F.col("h")).alias("h"),
                          *KEYS).agg(F.count("*").alias("n"))
    unique = known.where("not maybe").select(*KEYS, "n")
    groups = known.where("maybe").groupBy("h", *KEYS).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    groups = groups.join(repeated, "h", "left")
    at_first = F.when(F.col("least.id") == F.coalesce("first", "least.id"), F.col("least.n")).otherwise(F.lit(0))
    split = groups.where("coalesce(texts, 1) = 1").select(*KEYS, "n", at_first.alias("kept"))
    parts = [unique, split.select(*KEYS, F.col("kept").alias("n")),
             split.select("part", F.col("mask").bitwiseOR(F.lit(BIT["E"])).alias("mask"), "good", "bad", (F.col("n") - F.col("kept")).alias("n"))]
    if not mixed.isEmpty():  # different texts of one hash: their rows are judged by the text itself
        same = _flagged(rows.where("doc_id is not null").join(mixed, "h", "left_semi"), with_text=True)
        same = same.withColumn("text", F.col("text").cast("binary")).join(classes.select("h", "text", "lo"), ["h", "text"])
        same = same.withColumn("mask", F.col("mask").bitwiseOR(F.when(F.col("doc_id") > F.col("lo"), BIT["E"]).otherwise(0)))
        parts.append(_labelled(same.drop("text", "h", "lo"), labels).groupBy(*KEYS).agg(F.count("*").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n > 0")


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bit of its filter, bits of the filters before) of every order and step."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            out.append(("".join(order), step, BIT[name], before))
            before |= BIT[name]
    return out


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from ``mask_counts``.

    A step depends on its filter and the set before it only, so the 80 such pairs are summed per part and then
    laid out as the 600 steps of all orders; both tables are of fixed size.
    """
    spark = counts.sparkSession
    plan = orders()
    pairs = spark.createDataFrame(sorted({(b, s) for _, _, b, s in plan}), "bit int, before int")
    steps = spark.createDataFrame(plan, "filter_order string, step int, bit int, before int")
    n, m = F.col("n"), F.col("mask")
    fails, gone = m.bitwiseAND(F.col("bit")) != 0, m.bitwiseAND(F.col("before")) != 0
    here = fails & ~gone
    total = lambda when, what=n: F.sum(F.when(when, what).otherwise(F.lit(0))).cast("long")
    tally = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("n_good"),
                                              F.sum(F.when(F.col("bad"), n).otherwise(0)).alias("n_bad"))
    share = F.lit(math.factorial(len(FILTERS))) / F.greatest(F.bit_count(m), F.lit(1))  # orders in which a failed filter comes first
    per_pair = tally.join(F.broadcast(pairs)).groupBy("part", "bit", "before").agg(
        total(~gone & ~fails).alias("kept"), total(here).alias("removed"), total(fails & gone).alias("redundant"),
        total(m == F.col("bit")).alias("unique_fails"), total(here, F.col("n_good")).alias("good_lost"),
        total(here, F.col("n_bad")).alias("toxic_lost"), total(fails, (n * share).cast("long")).alias("shapley"))
    return per_pair.join(F.broadcast(steps), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
