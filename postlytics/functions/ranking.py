"""Exact within-group ranks and quantiles without putting a group into one task.

``Window.partitionBy(g).orderBy(x)`` sends every row of a group to a single
task; with one group holding a third of all rows that task is the job.  Here
the rows are range-partitioned on (group, value) instead - the range bounds
come from a sample, so a hot group is cut into many partitions - and sorted
inside each partition.  A tiny table of per-(partition, group) counts gives
each partition's starting offset inside its group; a row's rank is that
offset plus its position inside the partition.

Quantiles need no rank of every row: three rounds of counts narrow the range
of values around each wanted rank until one value is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlytics.functions.columns import broadcast_groups
from postlytics.session import cut_lineage


def range_ordered(df: DataFrame, group: str, value: str, num_partitions: int | None = None) -> DataFrame:
    """Range-partition on (group, value), sort inside partitions, and tag each row
    with its partition (``__pid``) and an increasing position (``__pos``)."""
    p = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a hash tie-breaker lets the range bounds cut a long run of one repeated
    # value (a hot group with a third of all rows at 0.0) over many tasks
    tb = F.xxhash64(F.monotonically_increasing_id(), F.spark_partition_id())
    return (df.withColumn("__tb", tb)
            .repartitionByRange(p, F.col(group), F.col(value), F.col("__tb"))
            .sortWithinPartitions(group, value, "__tb")
            .withColumn("__pid", F.spark_partition_id())
            .withColumn("__pos", F.monotonically_increasing_id())
            .drop("__tb"))


def ranks_within_groups(df: DataFrame, group: str, value: str, num_partitions: int | None = None) -> DataFrame:
    """Add ``rank`` (1..n, ties in arbitrary order) and ``n`` per group.

    ``df`` must carry non-null ``group`` and ``value`` columns.
    """
    # one lineage cut so both uses below see the same physical order
    ordered = cut_lineage(range_ordered(df, group, value, num_partitions))
    blocks = ordered.groupBy("__pid", group).agg(
        F.count(F.lit(1)).alias("__cnt"), F.min("__pos").alias("__first"))
    w = Window.partitionBy(group).orderBy("__pid")
    blocks = blocks.withColumn(
        "__offset", F.coalesce(F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("n", F.sum("__cnt").over(Window.partitionBy(group)))
    # (partitions x groups) rows: small by construction; Spark checks the size before broadcasting
    ranked = ordered.join(blocks.select("__pid", group, "__offset", "__first", "n"), ["__pid", group])
    return ranked.withColumn("rank", F.col("__offset") + (F.col("__pos") - F.col("__first")) + 1) \
        .drop("__pid", "__pos", "__offset", "__first")


# Above this many distinct values the value->count map of ``percentile`` is no longer a safe single-task state.
MAP_QUANTILE_MAX_DISTINCT = 1_000_000


def _interpolated(lo: Column, hi: Column, h: Column) -> Column:
    """The interpolation of Spark's ``percentile``, term by term, so all ways give the same bits."""
    return F.when((hi == lo) | (F.floor(h) == F.ceil(h)), lo).otherwise((F.ceil(h) - h) * lo + (h - F.floor(h)) * hi)


def _rank_quantiles(df: DataFrame, group: str, value: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles from distributed ranks (no group in one task)."""
    r = ranks_within_groups(df, group, value)
    pos = [(F.col("n") - 1).cast("double") * F.lit(float(p)) for p in probs]
    want = F.lit(False)
    for h in pos:
        want = want | (F.col("rank") == F.floor(h) + 1) | (F.col("rank") == F.ceil(h) + 1)
    picked = r.where(want)  # at most 2 rows per quantile and group
    aggs = [F.first("n").alias("n")]
    for i, h in enumerate(pos):
        aggs.append(F.max(F.when(F.col("rank") == F.floor(h) + 1, F.col(value))).alias(f"__lo{i}"))
        aggs.append(F.max(F.when(F.col("rank") == F.ceil(h) + 1, F.col(value))).alias(f"__hi{i}"))
    g = picked.groupBy(group).agg(*aggs)
    out = [_interpolated(F.col(f"__lo{i}"), F.col(f"__hi{i}"), h).alias(f"q{i}") for i, h in enumerate(pos)]
    return g.select(group, F.array(*out).alias("q"))


# Range refinement: pieces of an octave in the first round, pieces of a range in the two that follow.  Octave pieces are 10
# bits of a double's 53; two rounds of 22 bits leave less than the distance of two neighbours.
OCTAVE_PIECES = 1024
RANGE_PIECES = 2.0 ** 22


def _octave_piece(v: Column) -> Column:
    """Order-preserving coarse code of a double: sign and logarithm; zero, infinities and NaN have codes of their own."""
    size = F.abs(v)
    code = F.when(size == float("inf"), F.lit(4_000_000)) \
        .otherwise(F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size)) * OCTAVE_PIECES) + 2_000_000)
    piece = F.when(F.isnan(v), F.lit(5_000_000)).when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * code)
    # never null: or the joins on it would repeat the whole expression in a filter of their own
    return F.coalesce(piece.cast("long"), F.lit(0).cast("long"))


def _range_piece(v: Column, lo: Column, hi: Column) -> Column:
    """Which of the equal pieces of a range a value is in (never decreasing in the value)."""
    piece = F.when(lo == hi, F.lit(0)).otherwise(F.floor((v - lo) / (hi - lo) * F.lit(RANGE_PIECES))).cast("long")
    return F.coalesce(piece, F.lit(0).cast("long"))


def _narrowed(pieces: DataFrame, key: list[str], piece: str, wanted: Column) -> DataFrame:
    """Of counted pieces those that hold a wanted rank, with the ranks counted from the piece's first value.

    ``pieces``: key, piece, n, lo, hi and what ``wanted`` needs, an array of (i, at) with 0-based ranks within the key.
    """
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy(piece).rowsBetween(Window.unboundedPreceding, 0))
    p = pieces.withColumn("upto", upto).withColumn("wanted", wanted)
    inside = F.filter("wanted", lambda w: (w["at"] >= F.col("upto") - F.col("n")) & (w["at"] < F.col("upto")))
    shifted = F.transform(inside, lambda w: F.struct(w["i"].alias("i"), (w["at"] - (F.col("upto") - F.col("n"))).alias("at")))
    return p.withColumn("wanted", shifted).where(F.size("wanted") > 0).drop("upto")


def _refined_quantiles(d: DataFrame, group: str, value: str, probs: list[float], small) -> DataFrame:
    """Exact linear-interpolated quantiles by range refinement: three aggregates over the rows, no row is shuffled.

    First every group's values are counted by pieces of an octave.  The piece
    that holds a wanted rank is cut into equal ranges between its least and
    its greatest value, which are counted, and so once more: then a range
    holds one value.  ``small`` makes a table of pieces (groups x 2 x probs
    rows at most) ready to be joined to the rows.
    """
    v = F.col("v")
    rows = d.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).withColumn("b0", _octave_piece(v))
    span = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    first = rows.groupBy("g", "b0").agg(*span).withColumn("total", F.sum("n").over(Window.partitionBy("g")))
    place = [(F.col("total") - 1).cast("double") * F.lit(float(p)) for p in probs]
    ranks = F.array(*[F.struct(F.lit(2 * i + side).alias("i"), cut(h).cast("long").alias("at"))
                      for i, h in enumerate(place) for side, cut in enumerate((F.floor, F.ceil))])
    one = small(_narrowed(first, ["g"], "b0", ranks).select("g", "b0", "total", "wanted", F.col("lo").alias("lo1"), F.col("hi").alias("hi1")))
    rows = rows.join(one.select("g", "b0", "lo1", "hi1"), ["g", "b0"]).withColumn("b1", _range_piece(v, F.col("lo1"), F.col("hi1")))
    second = rows.groupBy("g", "b0", "b1").agg(*span).join(one.select("g", "b0", F.col("wanted").alias("ranks")), ["g", "b0"])
    two = small(_narrowed(second, ["g", "b0"], "b1", F.col("ranks")).select(
        "g", "b0", "b1", "wanted", F.col("lo").alias("lo2"), F.col("hi").alias("hi2")))
    rows = rows.join(two.select("g", "b0", "b1", "lo2", "hi2"), ["g", "b0", "b1"]).withColumn("b2", _range_piece(v, F.col("lo2"), F.col("hi2")))
    third = rows.groupBy("g", "b0", "b1", "b2").agg(*span).join(two.select("g", "b0", "b1", F.col("wanted").alias("ranks")), ["g", "b0", "b1"])
    found = _narrowed(third, ["g", "b0", "b1"], "b2", F.col("ranks")).select("g", "lo", F.explode("wanted.i").alias("i"))
    values = found.groupBy("g").agg(*[F.max(F.when(F.col("i") == k, F.col("lo"))).alias(f"x{k}") for k in range(2 * len(probs))])
    totals = one.groupBy("g").agg(F.first("total").alias("total"))
    return values.join(totals, "g").select(F.col("g").alias(group), F.array(*[
        _interpolated(F.col(f"x{2 * i}"), F.col(f"x{2 * i + 1}"), h) for i, h in enumerate(place)]).alias("q"))


def group_quantiles(df: DataFrame, group: str | None, value: str, probs: list[float],
                    method: str | None = None, few_groups: bool = False) -> DataFrame:
    """Exact quantiles (linear interpolation, as pandas / DuckDB ``quantile_cont``) per group.

    Returns (group, q array) - or a one-row (q array) frame when ``group`` is None.
    ``method``: ``refine`` (default) = counts over narrowing ranges, whatever
    the number of distinct values; ``map`` = Spark ``percentile`` (a
    value->count state, for few distinct values); ``rank`` = distributed ranks.
    Without a group, or with ``few_groups`` (a fixed set of labels), ``refine``
    starts no job of its own; else its tables of pieces are counted before they
    are broadcast.
    """
    method = method or "refine"
    g = group or "__all"
    d = df.select((F.col(group) if group else F.lit(0)).alias(g), F.col(value).alias("__v")) \
        .where(F.col(g).isNotNull() & F.col("__v").isNotNull())
    if method == "map":
        res = d.groupBy(g).agg(F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    elif method == "rank":
        res = _rank_quantiles(d, g, "__v", probs)
    else:
        res = _refined_quantiles(d, g, "__v", probs, broadcast_groups if group and not few_groups else F.broadcast)
    if group is None:
        return res.agg(F.first("q").alias("q"))  # always one row (null q when empty)
    return res.withColumnRenamed(g, group)
