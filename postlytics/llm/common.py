"""Helpers shared by the operators: input shaping, Arrow tasks, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlytics.session import cut_lineage, ship

__all__ = ["documents", "ship", "map_batches", "slices", "cut_lineage", "connected_components", "fresh", "spark_schema",
           "crc_mod", "kept", "trimmed"]


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read, under fixed names; a null text is the empty text.

    Every other column, whatever its name, stays out, so it cannot clash.
    """
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def crc_mod(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod`` (held-out rule of the contracts)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def spark_schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


#: What workers keep from task to task (tables, automata), by operator.
_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """A dict that a worker keeps until a task of another operator runs in it."""
    return _KEPT.setdefault(name, {})


def trimmed(task, keep: str = ""):
    """A ``mapInArrow`` function that starts without other operators' tables and leaves no freed memory behind.

    Workers serve one stage after another; without this each holds the most that any stage ever took.
    """
    def run(batches):
        drop_tables(keep)
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def drop_tables(keep: str) -> None:
    """Of this worker's tables those of ``keep`` stay."""
    for name, tables in _KEPT.items():
        if name != keep:
            tables.clear()


def give_back() -> None:
    """Freed memory goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict], rows: int = 1000, keep: str = "") -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows; ``fn`` gives a dict of columns.

    Small slices bound a worker's memory whatever the batch size is; ``keep``
    names the operator whose tables stay in the worker.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema(schema))

    def run(batches):
        for whole in batches:
            for part in slices(whole, rows):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(fn(part).values(), arrow)],
                                                 schema=arrow)

    return df.mapInArrow(trimmed(run, keep), schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _forest(batches):
    """Spanning forest of a task's edges: at most one edge per vertex goes on to the shuffle."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    limit = 500_000
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def flush():
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=schema)

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                parent.setdefault(min(ra, rb), min(ra, rb))
        if len(parent) > limit:
            yield flush()
    yield flush()


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (node, root) for each node that has an edge.

    Random contraction: in each round every vertex goes to the neighbour (or
    itself) whose hash of that round is least, and the edges are renamed and
    deduplicated, so a constant share of vertices goes in each round and the
    number of rounds is logarithmic, also for long chains.  Edge tasks first
    shrink to a spanning forest.  All state lives in checkpointed tables in
    the shared folder; nothing but the edge count reaches the driver.  ``root``
    is some vertex of the component, the same for all its vertices.
    """
    spark = edges.sparkSession
    ship(spark)
    current = cut_lineage(edges.select(F.col(edges.columns[0]).cast("long").alias("a"),
                                       F.col(edges.columns[1]).cast("long").alias("b"))
                          .mapInArrow(trimmed(_forest), "a long, b long").where("a <> b").distinct())
    members = None
    rnd = 0
    while current.limit(1).count():
        rnd += 1
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        h = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(rnd)).alias("h"), F.col(c).alias("v"))
        up = both.groupBy("a").agg(F.min(h("b")).alias("m")).select("a", F.least(F.col("m"), h("a"))["v"].alias("up"))
        up = cut_lineage(up)
        if members is None:
            members = up.select(F.col("a").alias("node"), F.col("up").alias("root"))
        else:
            members = cut_lineage(members.join(up.withColumnRenamed("a", "root"), "root", "left")
                                  .select("node", F.coalesce("up", "root").alias("root")))
        left = up.select("a", F.col("up").alias("ua"))
        right = up.select(F.col("a").alias("b"), F.col("up").alias("ub"))
        current = cut_lineage(current.join(left, "a").join(right, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b"))
                              .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                              .distinct())
    if members is None:
        return spark.createDataFrame([], "node long, root long")
    return members


def by_size(texts: list[str], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` characters in all (one longer text is a range of its own)."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if i > lo and n + len(t) > limit:
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def lower(text: str) -> str:
    """Lower case of the same length, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


_ALNUM: np.ndarray | None = None


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (run of letters and digits, lower case) of all texts in order, and words per text."""
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    codes = code_points("\n".join(lower(t) for t in texts) + "\n")
    solid = _ALNUM[codes]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    per = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(texts))
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        power = np.full(len(codes) + 1, base, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        del power
        back = np.full(len(codes) + 1, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        back = np.cumprod(back)
        return mix64((run[stops] - run[starts]) * back[starts]), per


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
