"""Exploratory aggregates (A*), top-k (T*) and benchmark operators (B*).

Every operator takes a ``Prepared`` table and returns a lazy DataFrame.
Group-bys are single-key hash aggregates with map-side partial aggregation,
so a hot group (a third of all posts on one weekday or one type) is reduced
to one partial row per task before the shuffle.  Exact quantiles come from
counts over narrowing ranges (``functions.ranking``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlytics.functions.columns import broadcast_groups, ntz_text, rint_round
from postlytics.functions.ranking import MAP_QUANTILE_MAX_DISTINCT, group_quantiles
from postlytics.operators.features import ER, TOTAL, Prepared
from postlytics.session import ship

# Calendar order used by the reports.
WEEKDAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
DEFAULT_BENCHMARK = 5.0
SQRT_2PI = 2.5066282746310002


def _er() -> Column:
    return F.col(ER)


QUARTILES = [0.25, 0.5, 0.75]


def er_quartiles(pre: Prepared) -> DataFrame:
    """One row: exact quartiles of the engagement rate."""
    return group_quantiles(pre.df, None, ER, QUARTILES)


def numeric_columns(pre: Prepared) -> list[str]:
    """Numeric columns as pandas' ``select_dtypes('number')`` sees them (no booleans).

    Id columns are left out: the reference always keeps ids as text.
    """
    from postlytics.sources.csv_export import is_id_column

    return [f.name for f in pre.df.schema.fields
            if isinstance(f.dataType, T.NumericType) and not is_id_column(f.name) and f.name != "_row_id"]


# --------------------------------------------------------------------- A2-A5
def describe_numeric(pre: Prepared, k: float = 1.5, digits: int = 2) -> DataFrame:
    """A2: per numeric column count, mean, std, min, quartiles, max, IQR, bounds, outliers.

    One wide aggregate for the moments and quartiles of all columns, a second
    one against its single row for the outlier counts; only that row is turned
    into one row a column.  Columns of too many distinct values for a value
    map get their quartiles by range refinement.
    """
    cols = numeric_columns(pre)
    wide = pre.df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    names = wide.columns
    small = names  # no column has more distinct values than there are rows
    if wide.count() > MAP_QUANTILE_MAX_DISTINCT:
        distinct = wide.agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in names]).first()
        small = [c for c, n in zip(names, distinct) if n <= MAP_QUANTILE_MAX_DISTINCT]
    probs = F.array(*[F.lit(p) for p in QUARTILES])
    row = wide.agg(*[F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
                              F.max(c).alias("max")).alias(c) for c in names],
                   *[F.percentile(c, probs).alias(f"{c}_q") for c in small])
    for c in names:
        if c not in small:
            row = row.crossJoin(F.broadcast(group_quantiles(wide, None, c, QUARTILES).withColumnRenamed("q", f"{c}_q")))
    bounds = []
    for c in names:
        q = F.col(f"{c}_q")
        bounds += [(q[0] - F.lit(k) * (q[2] - q[0])).alias(f"{c}_lo"), (q[2] + F.lit(k) * (q[2] - q[0])).alias(f"{c}_hi")]
    row = row.select("*", *bounds)
    out = wide.crossJoin(F.broadcast(row.select(*[f"{c}_{e}" for c in names for e in ("lo", "hi")]))).agg(
        *[F.count_if((F.col(c) < F.col(f"{c}_lo")) | (F.col(c) > F.col(f"{c}_hi"))).alias(f"{c}_out") for c in names])
    one = lambda i, c: F.struct(
        F.lit(cols[i]).alias("column_name"), F.col(c)["count"].cast("double").alias("count"),
        *[rint_round(v, digits).alias(n) for n, v in (
            ("mean", F.col(c)["mean"]), ("std", F.col(c)["std"]), ("min", F.col(c)["min"]), ("p25", F.col(f"{c}_q")[0]),
            ("p50", F.col(f"{c}_q")[1]), ("p75", F.col(f"{c}_q")[2]), ("max", F.col(c)["max"]),
            ("iqr", F.col(f"{c}_q")[2] - F.col(f"{c}_q")[0]), ("lower_bound", F.col(f"{c}_lo")), ("upper_bound", F.col(f"{c}_hi")))],
        F.coalesce(F.col(f"{c}_out"), F.lit(0)).cast("bigint").alias("outliers_count"))
    return row.crossJoin(F.broadcast(out)).select(F.inline(F.array(*[one(i, c) for i, c in enumerate(names)])))


def er_stats(pre: Prepared, digits: int = 2) -> DataFrame:
    """A3: mean, median, std, min, max, q25, q75 of the engagement rate."""
    er = _er()
    return pre.df.agg(
        F.avg(er).alias("mean"), F.stddev_samp(er).alias("std"),
        F.min(er).alias("min"), F.max(er).alias("max"),
    ).crossJoin(er_quartiles(pre)).select(
        rint_round(F.col("mean"), digits).alias("mean"),
        rint_round(F.col("q")[1], digits).alias("median"),
        rint_round(F.col("std"), digits).alias("std"),
        rint_round(F.col("min"), digits).alias("min"),
        rint_round(F.col("max"), digits).alias("max"),
        rint_round(F.col("q")[0], digits).alias("q25"),
        rint_round(F.col("q")[2], digits).alias("q75"),
    )


def er_bounds(pre: Prepared, k: float = 1.5) -> DataFrame:
    """One-row quartiles and IQR fences of the engagement rate."""
    return er_quartiles(pre).select(
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
    ).withColumn("iqr", F.col("q3") - F.col("q1")) \
     .withColumn("lower_bound", F.col("q1") - F.lit(k) * F.col("iqr")) \
     .withColumn("upper_bound", F.col("q3") + F.lit(k) * F.col("iqr"))


def outlier_rows(pre: Prepared, k: float = 1.5) -> DataFrame:
    """Posts whose rate lies outside the IQR fences (one-row broadcast)."""
    b = F.broadcast(er_bounds(pre, k).select("lower_bound", "upper_bound"))
    return pre.df.crossJoin(b).where(
        (_er() < F.col("lower_bound")) | (_er() > F.col("upper_bound"))
    ).drop("lower_bound", "upper_bound")


def er_outlier_summary(pre: Prepared, k: float = 1.5) -> DataFrame:
    """A4: quartiles, IQR, fences, outlier count and % of all rows."""
    b = F.broadcast(er_bounds(pre, k))
    joined = pre.df.select(ER).crossJoin(b)
    is_out = (_er() < F.col("lower_bound")) | (_er() > F.col("upper_bound"))
    agg = joined.agg(*[F.first(c).alias(c) for c in ["q1", "median", "q3", "iqr", "lower_bound", "upper_bound"]],
                     F.count_if(is_out).alias("outliers"), F.count(F.lit(1)).alias("rows"))
    return agg.select(
        *[rint_round(F.col(c), 4).alias(c) for c in ["q1", "median", "q3", "iqr", "lower_bound", "upper_bound"]],
        F.col("outliers").cast("bigint").alias("outliers"),
        rint_round(F.col("outliers") / F.col("rows") * 100.0, 1).alias("outlier_pct"),
    )


def missing_values(pre: Prepared) -> DataFrame:
    """A5: null count per column, only columns with nulls, most first."""
    cols = pre.df.columns
    row = pre.df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = row.unpivot([], cols, "column_name", "missing")
    return long.where(F.col("missing") > 0).orderBy(F.desc("missing"), "column_name")


def column_types(pre: Prepared) -> DataFrame:
    """Data type per column."""
    spark = pre.df.sparkSession
    return spark.createDataFrame([(n, t) for n, t in pre.df.dtypes], "column_name string, dtype string")


# --------------------------------------------------------------------- A7-A12
def _weekday_rows(pre: Prepared) -> DataFrame:
    return pre.df.where(F.col("weekday").isNotNull())


def er_by_weekday(pre: Prepared, digits: int = 2) -> DataFrame:
    """Mean rate per weekday in calendar order (only days that occur)."""
    if not pre.has_calendar:
        raise ValueError("no valid date column: weekday features are missing")
    d = F.col(pre.roles.date)
    return _weekday_rows(pre).groupBy("weekday").agg(
        (F.min(F.weekday(d)) + 1).alias("day_order"),
        rint_round(F.avg(_er()), digits).alias("avg_er"),
        F.count(_er()).alias("posts"),
    ).orderBy("day_order")


def _argmax(df: DataFrame, key: str, value: Column, digits: int, name: str) -> DataFrame:
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("__m"))
    return g.where(F.col("__m").isNotNull()).orderBy(F.desc("__m"), F.asc(key)).limit(1).select(
        F.col(key).alias(name), rint_round(F.col("__m"), digits).alias("avg_er"))


def best_weekday(pre: Prepared, digits: int = 2) -> DataFrame:
    """Weekday with the highest mean rate; alphabetical first on ties."""
    return _argmax(pre.df, "weekday", _er(), digits, "best_weekday")


def er_by_hour(pre: Prepared, digits: int = 2) -> DataFrame:
    """Mean rate per hour of day, in hour order."""
    return pre.df.where(F.col("hour").isNotNull()).groupBy("hour").agg(
        rint_round(F.avg(_er()), digits).alias("avg_er"), F.count(_er()).alias("posts"),
    ).orderBy("hour")


def top_hours(pre: Prepared, n: int = 3, digits: int = 2) -> DataFrame:
    """A10: the n best hours by mean rate (smaller hour first on ties)."""
    g = pre.df.where(F.col("hour").isNotNull()).groupBy("hour").agg(F.avg(_er()).alias("__m"))
    w = Window.orderBy(F.desc("__m"), F.asc("hour"))  # ranks the n rows left after the limit
    top = g.where(F.col("__m").isNotNull()).orderBy(F.desc("__m"), F.asc("hour")).limit(n)
    return top.select(F.row_number().over(w).alias("rank"), "hour",
                      rint_round(F.col("__m"), digits).alias("avg_er"))


def er_by_type(pre: Prepared, digits: int = 2) -> DataFrame:
    """Mean, median, count and std of the rate per content type."""
    t = pre.roles.type
    if not t:
        raise ValueError("no content type column")
    er = _er()
    base = pre.df.where(F.col(t).isNotNull())
    med = group_quantiles(base, t, ER, [0.5])
    return base.groupBy(t).agg(
        rint_round(F.avg(er), digits).alias("avg_er"),
        F.count(er).alias("posts"),
        rint_round(F.stddev_samp(er), digits).alias("std_er"),
    ).join(med, t, "left").select(
        t, "avg_er", rint_round(F.col("q")[0], digits).alias("median_er"), "posts", "std_er",
    ).orderBy(F.desc("avg_er"), t)


def best_type(pre: Prepared, digits: int = 2) -> DataFrame:
    """Content type with the highest mean rate."""
    if not pre.roles.type:
        raise ValueError("no content type column")
    return _argmax(pre.df, pre.roles.type, _er(), digits, "best_type")


# --------------------------------------------------------------------- A13-A18
def interaction_breakdown(pre: Prepared, digits: int = 2) -> DataFrame:
    """Sums of likes, comments, saves, shares and each one's share in %."""
    r = pre.roles
    parts = [(lbl, getattr(r, lbl)) for lbl in ("likes", "comments", "saves", "shares") if getattr(r, lbl)]
    sums = pre.df.agg(*[F.sum(F.col(c)).cast("bigint").alias(lbl) for lbl, c in parts])
    long = sums.unpivot([], [lbl for lbl, _ in parts], "interaction", "total")
    total = sums.select(sum((F.col(lbl) for lbl, _ in parts), F.lit(0)).alias("__all"))
    return long.crossJoin(F.broadcast(total)).select(
        "interaction", "total",
        rint_round(F.col("total") / F.col("__all") * 100.0, digits).alias("share_pct"),
    )


def monthly_trend(pre: Prepared, digits: int = 2) -> DataFrame:
    """Mean rate per calendar month, labelled by month end; empty months dropped."""
    d = F.col(pre.roles.date)
    return pre.df.where(d.isNotNull()).groupBy(F.last_day(d).alias("month_end")).agg(
        F.avg(_er()).alias("__m")
    ).where(F.col("__m").isNotNull()).select(
        "month_end", rint_round(F.col("__m"), digits).alias("avg_er")).orderBy("month_end")


def weekend_vs_weekday(pre: Prepared, digits: int = 2) -> DataFrame:
    """Mean rate and posts per period, and the absolute difference (one pass)."""
    er = _er()
    wk = F.col("is_weekend")
    return pre.df.agg(
        F.avg(F.when(wk, er)).alias("we"), F.avg(F.when(~wk, er)).alias("wd"),
        F.count(F.when(wk, er)).alias("weekend_posts"), F.count(F.when(~wk, er)).alias("weekday_posts"),
    ).select(
        rint_round(F.col("we"), digits).alias("weekend_avg"),
        rint_round(F.col("wd"), digits).alias("weekday_avg"),
        "weekend_posts", "weekday_posts",
        rint_round(F.abs(F.col("we") - F.col("wd")), digits).alias("abs_difference"),
    )


def scatter_x(pre: Prepared) -> str:
    r = pre.roles
    x = r.reach or r.impressions or r.views
    if not x:
        raise ValueError("no reach / impressions / views column")
    return x


def reach_er_correlation(pre: Prepared, x: str | None = None) -> DataFrame:
    """Pearson correlation of reach (else impressions, views) and rate."""
    x = x or scatter_x(pre)
    both = pre.df.where(F.col(x).isNotNull() & _er().isNotNull())
    return both.agg(
        F.lit(x).alias("x_column"),
        rint_round(F.corr(F.col(x).cast("double"), _er()), 6).alias("pearson_r"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def trend_line(pre: Prepared, x: str | None = None) -> DataFrame:
    """OLS line of rate on reach: slope, intercept, R^2."""
    x = x or scatter_x(pre)
    xc = F.col(x).cast("double")
    return pre.df.agg(
        F.lit(x).alias("x_column"),
        rint_round(F.regr_slope(_er(), xc), 10).alias("slope"),
        rint_round(F.regr_intercept(_er(), xc), 6).alias("intercept"),
        rint_round(F.regr_r2(_er(), xc), 6).alias("r2"),
        F.regr_count(_er(), xc).alias("n_pairs"),
    )


def er_histogram(pre: Prepared, bins: int = 30) -> DataFrame:
    """Equal-width bins from min to max, last bin closed; empty bins kept."""
    er = _er()
    spark = pre.df.sparkSession
    rng = pre.df.agg(F.min(er).alias("lo"), F.max(er).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    idx = F.least(F.floor((er - F.col("lo")) / width), F.lit(bins - 1))
    idx = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(idx).cast("int")
    counts = pre.df.select(ER).where(er.isNotNull()).crossJoin(F.broadcast(rng)) \
        .groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("posts"))
    spine = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(rng))
    return spine.join(counts, "bin", "left").select(
        "bin",
        rint_round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(float(bins)), 6).alias("bin_start"),
        rint_round(F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / F.lit(float(bins)), 6).alias("bin_end"),
        F.coalesce(F.col("posts"), F.lit(0)).cast("bigint").alias("posts"),
    ).orderBy("bin")


# Cells a bandwidth is cut into, and bandwidths a kernel reaches, in the density estimate.
CELLS_PER_BANDWIDTH = 32
KERNEL_REACH = 8.0


def er_density(pre: Prepared, gridsize: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE (Scott bandwidth) of the rate on an evenly spaced grid, from binned values.

    A value between two nodes, 1/32 of a bandwidth apart, counts for both, the
    nearer one more (linear binning); a node then adds its kernel to the grid
    points within 8 bandwidths.  The rows need one aggregate to cells, whose
    number follows from the range in bandwidths, not from the values.  The
    density differs from the exact sum of kernels by at most
    ``density_error(bandwidth)``.  Without rows there is no grid; where all
    values are equal there is no bandwidth and the density is null.
    """
    er = _er()
    st = pre.df.agg(F.count(er).alias("n"), F.stddev_samp(er).alias("sd"),
                    F.min(er).alias("lo"), F.max(er).alias("hi")).where("n > 0") \
        .withColumn("bw", F.nullif(F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.lit(0.0))) \
        .withColumn("g_lo", F.col("lo") - F.lit(cut) * F.coalesce("bw", F.lit(0.0))) \
        .withColumn("g_hi", F.col("hi") + F.lit(cut) * F.coalesce("bw", F.lit(0.0))) \
        .withColumn("cell", F.col("bw") / CELLS_PER_BANDWIDTH) \
        .withColumn("step", (F.col("g_hi") - F.col("g_lo")) / F.lit(float(gridsize - 1)))
    stats = ["n", "bw", "lo", "g_lo", "cell", "step"]  # one row: they stay beside what is counted
    place = (er - F.col("lo")) / F.col("cell")
    cells = pre.df.select(ER).where(er.isNotNull()).crossJoin(F.broadcast(st.select(*stats))) \
        .select(*stats, F.floor(place).alias("node"), (place - F.floor(place)).alias("part")) \
        .groupBy(*stats, "node").agg(F.count(F.lit(1)).alias("c"), F.sum("part").alias("right"))
    nodes = cells.select(*stats, F.explode(F.array(F.struct("node", (F.col("c") - F.col("right")).alias("w")),
                                                   F.struct((F.col("node") + 1).alias("node"), F.col("right").alias("w")))).alias("s")) \
        .groupBy(*stats, F.col("s.node").alias("node")).agg(F.sum("s.w").alias("w"))
    reach = F.lit(KERNEL_REACH) * F.col("bw")
    first = F.greatest(F.ceil((F.col("v") - reach - F.col("g_lo")) / F.col("step")).cast("int"), F.lit(0))
    last = F.least(F.floor((F.col("v") + reach - F.col("g_lo")) / F.col("step")).cast("int"), F.lit(gridsize - 1))
    near = nodes.withColumn("v", F.col("lo") + F.col("node") * F.col("cell")) \
        .withColumn("points", F.when((last >= first) & F.col("bw").isNotNull(), F.sequence(first, last))) \
        .select("n", "bw", "g_lo", "step", "w", "v", F.explode_outer("points").alias("point"))
    x = F.col("g_lo") + F.col("point") * F.col("step")
    z = (x - F.col("v")) / F.col("bw")
    sums = near.groupBy("n", "bw", "g_lo", "step", "point").agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * (z * z))).alias("s"))
    # the grid's points (gridsize at most) are put in one row and laid out again, with those no kernel reaches
    found = sums.groupBy("n", "bw", "g_lo", "step").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("point").isNotNull(), F.struct("point", "s")))).alias("found"))
    grid = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("point"))
    return grid.select(
        "point", rint_round(x, 8).alias("x"),
        rint_round(F.coalesce(F.try_element_at("found", F.col("point")), F.lit(0.0)) / (F.col("n") * F.col("bw") * F.lit(SQRT_2PI)), 10)
        .alias("density"),
    ).orderBy("point")


def density_error(bandwidth: float) -> float:
    """Greatest difference of ``er_density`` from the exact estimate: curvature between two nodes, and the cut tails."""
    return (1 / CELLS_PER_BANDWIDTH ** 2 / 8 + math.exp(-KERNEL_REACH ** 2 / 2)) / (bandwidth * SQRT_2PI)


def box_stats(pre: Prepared, group: str | None = None, k: float = 1.5, value: str = ER) -> DataFrame:
    """Quartiles, whiskers (last point inside 1.5 IQR) and outlier count per group."""
    df = pre.df
    v = F.col(value)
    if group is None:
        df = df.withColumn("__g", F.lit("all"))
    else:
        df = df.withColumn("__g", F.col(group).cast("string"))
    df = df.where(v.isNotNull() & F.col("__g").isNotNull())
    q = group_quantiles(df, "__g", value, QUARTILES).select(
        "__g", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    q = q.withColumn("lo_f", F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_f", F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1")))
    inside = (v >= F.col("lo_f")) & (v <= F.col("hi_f"))
    agg = df.select("__g", value).join(broadcast_groups(q), "__g").groupBy("__g", "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
        F.count(F.lit(1)).alias("n"),
    )
    return agg.select(
        F.col("__g").alias("grp"),
        *[rint_round(F.col(c), 4).alias(c) for c in ["q1", "median", "q3"]],
        rint_round(F.col("q3") - F.col("q1"), 4).alias("iqr"),
        rint_round(F.col("whisker_low"), 4).alias("whisker_low"),
        rint_round(F.col("whisker_high"), 4).alias("whisker_high"),
        F.col("outliers").cast("bigint").alias("outliers"), "n",
    )


# Poisson(1) by inverse cdf of a 16-bit draw: the weight is how many of these bounds the draw reaches.
# From the rule floor(65536 * P(X <= k)), k = 0, 1, ...
POISSON_BOUNDS = [int(65536 * sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1))) for k in range(8)]
DRAWS = 8  # 16-bit draws in an md5


def poisson_weight(draw: Column) -> Column:
    """Poisson(1) weight of a uniform draw given as four hex digits, whose order as text is that of the numbers."""
    out = F.lit(float(len(POISSON_BOUNDS)))
    for k, bound in reversed(list(enumerate(POISSON_BOUNDS))):
        out = F.when(draw < f"{bound:04x}", F.lit(float(k))).otherwise(out)
    return out


def replicate_weights(key: Column, n_boot: int, seed: int) -> Column:
    """One post's weights in all replicates; eight replicates' draws come from one md5 of (seed, post, block)."""
    blocks = F.sequence(F.lit(0), F.lit(-(-n_boot // DRAWS) - 1))
    digests = F.transform(blocks, lambda b: F.md5(F.concat_ws("|", F.lit(str(seed)), key, b.cast("string")).cast("binary")))
    places = F.array(*[F.lit(4 * j + 1) for j in range(DRAWS)])
    draws = F.flatten(F.transform(digests, lambda h: F.transform(places, lambda at: h.substr(at, F.lit(4)))))
    return F.slice(F.transform(draws, poisson_weight), 1, n_boot)


def _replicate_sums(n_boot: int, seed: int):
    """Rows (grp, v, key) -> a row a group and task: posts, their sum, and each replicate's sum of weights, then of weighted values.

    The weights are those of ``replicate_weights``, whose draws are the bytes of its md5s.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("v", pa.float64()), ("s", pa.list_(pa.float64()))])
    weight = np.searchsorted(POISSON_BOUNDS, np.arange(65536), side="right").astype(np.uint8)
    ends = [b"|%d" % b for b in range(-(-n_boot // DRAWS))]

    def draw(keys: list) -> np.ndarray:
        begins = [str(seed).encode() if k is None else f"{seed}|{k}".encode() for k in keys]
        raw = b"".join([hashlib.md5(b + e).digest() for b in begins for e in ends])
        return weight[np.frombuffer(raw, ">u2").reshape(len(keys), -1)[:, :n_boot]].astype(float)

    def run(batches):
        held: dict = {}

        def out():
            got = pa.RecordBatch.from_pydict({"grp": list(held), "n": [h[0] for h in held.values()], "v": [h[1] for h in held.values()],
                                              "s": [h[2] for h in held.values()]}, schema=schema)
            held.clear()
            return got

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                code, v, w = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), draw(batch.column(2).to_pylist())
                of = code.indices.to_numpy()
                for i, grp in enumerate(code.dictionary.to_pylist()):
                    mine = np.flatnonzero(of == i)
                    h = held.setdefault(grp, [0, 0.0, np.zeros(2 * n_boot)])
                    h[0] += len(mine)
                    h[1] += v[mine].sum()
                    h[2][:n_boot] += w[mine].sum(0)
                    h[2][n_boot:] += v[mine] @ w[mine]
                if len(held) > 1000:  # of any number of groups a task holds so many
                    yield out()
        if held:
            yield out()

    return run


def mean_ci(pre: Prepared, group: str = "weekday", n_boot: int = 1000, level: float = 0.95,
            seed: int = 42) -> DataFrame:
    """Bootstrap interval of each group's mean (Poisson bootstrap).

    Every post gets a Poisson(1) weight in every replicate, whatever the number
    of posts: repeatable under any partitioning or retry, and in any engine.
    A group's accumulator is a vector of the replicates' weighted sums and
    weights; a post is added to it in its task and accumulators are merged, so
    posts are neither multiplied nor shuffled.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from postlytics.operators.ml import row_key

    ship(pre.df.sparkSession)
    rows = pre.df.where(F.col(group).isNotNull() & _er().isNotNull()) \
        .select(F.col(group).cast("string").alias("grp"), _er().cast("double").alias("v"), row_key(pre).alias("key"))
    parts = rows.mapInArrow(_replicate_sums(n_boot, seed), "grp string, n long, v double, s array<double>")
    sums = parts.groupBy("grp").agg((F.sum("v") / F.sum("n")).alias("mean"), F.sum("n").alias("n"),
                                    vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    means = sums.select("grp", "mean", "n", F.explode(F.arrays_zip(
        F.slice("s", 1, n_boot).alias("w"), F.slice("s", n_boot + 1, n_boot).alias("wv"))).alias("r"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    # n_boot replicate means per group: a bounded percentile state (a replicate without posts has no mean)
    m = F.when(F.col("r.w") > 0, F.col("r.wv") / F.col("r.w"))
    ci = means.groupBy("grp", "mean", "n").agg(F.percentile(m, F.array(F.lit(lo), F.lit(hi))).alias("p")).where("p is not null")
    return ci.select(
        "grp", "n", rint_round(F.col("mean"), 6).alias("mean"),
        rint_round(F.col("p")[0], 6).alias("ci_low"), rint_round(F.col("p")[1], 6).alias("ci_high"))


def trend_line_ci(pre: Prepared, x: str | None = None, points: int = 100, level: float = 0.95) -> DataFrame:
    """Confidence band of the fitted mean along x (closed form)."""
    from postlytics.functions.distributions import t_ppf

    x = x or scatter_x(pre)
    xc, y = F.col(x).cast("double"), _er()
    both = pre.df.where(xc.isNotNull() & y.isNotNull())
    st = both.agg(
        F.count(F.lit(1)).alias("n"), F.avg(xc).alias("mx"), F.avg(y).alias("my"),
        F.var_pop(xc).alias("vx"), F.regr_slope(y, xc).alias("b"), F.regr_intercept(y, xc).alias("a"),
        F.min(xc).alias("x_lo"), F.max(xc).alias("x_hi"),
        F.regr_syy(y, xc).alias("syy"), F.regr_sxy(y, xc).alias("sxy"),
    )
    sse = F.col("syy") - F.col("b") * F.col("sxy")  # centred sums: nothing cancels at large n
    st = st.withColumn("s2", F.greatest(sse, F.lit(0.0)) / (F.col("n") - 2)) \
        .withColumn("sxx", F.col("vx") * F.col("n")) \
        .withColumn("tq", t_ppf(F.lit(1 - (1 - level) / 2), F.col("n") - 2))
    spark = pre.df.sparkSession
    g = spark.range(points).crossJoin(F.broadcast(st))
    gx = F.col("x_lo") + F.col("id") * (F.col("x_hi") - F.col("x_lo")) / F.lit(float(points - 1))
    g = g.withColumn("gx", gx)
    fit = F.col("a") + F.col("b") * F.col("gx")
    se = F.sqrt(F.col("s2") * (F.lit(1.0) / F.col("n") + F.pow(F.col("gx") - F.col("mx"), 2) / F.col("sxx")))
    return g.select(F.col("id").cast("int").alias("point"), rint_round(F.col("gx"), 6).alias("x"),
                    rint_round(fit, 6).alias("fit"), rint_round(fit - F.col("tq") * se, 6).alias("ci_low"),
                    rint_round(fit + F.col("tq") * se, 6).alias("ci_high"))


# --------------------------------------------------------------------- A23-A26
def column_defaults(pre: Prepared, numeric: list[str] | None = None, categorical: list[str] | None = None) -> DataFrame:
    """Median of each numeric feature, mode (smallest on ties) of each category."""
    r = pre.roles
    numeric = numeric if numeric is not None else [c for c in (r.reach, r.views, r.likes, r.comments,
                                                                 r.saves, r.shares, r.follows) if c]
    categorical = categorical if categorical is not None else [c for c in (r.type, "weekday", "hour")
                                                               if c and c in pre.df.columns]
    spark = pre.df.sparkSession
    parts = []
    if numeric:
        long = pre.df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
            [], numeric, "feature", "value")
        med = group_quantiles(long, "feature", "value", [0.5])
        names = spark.createDataFrame([(c,) for c in numeric], "feature string")
        parts.append(names.join(med, "feature", "left")
                     .select("feature", F.col("q")[0].alias("median"), F.lit(None).cast("string").alias("mode")))
    for c in categorical:
        dtype = pre.df.schema[c].dataType
        counts = pre.df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
        top = counts.orderBy(F.desc("__n"), F.asc(c)).limit(1)
        parts.append(top.select(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("median"),
                                F.col(c).cast("string").alias("mode")))
    if not parts:
        return spark.createDataFrame([], "feature string, median double, mode string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_types(pre: Prepared) -> DataFrame:
    """Sorted distinct non-null content types."""
    t = pre.roles.type
    return pre.df.where(F.col(t).isNotNull()).select(F.col(t).alias("content_type")).distinct().orderBy("content_type")


def _row_key(pre: Prepared) -> Column:
    """Stable row identity for ties: the loader's ``_row_id`` else ``post_id``."""
    cols = pre.df.columns
    if "_row_id" in cols:
        return F.col("_row_id")
    for c in cols:
        if c == "post_id" or c.endswith("_id"):
            return F.col(c)
    return F.monotonically_increasing_id()


def top_posts(pre: Prepared, n: int = 10, columns: list[str] | None = None) -> DataFrame:
    """The n posts with the highest rate (file order on ties)."""
    r = pre.roles
    if columns is None:
        columns = [c for c in (r.date, ER, r.type, r.likes, r.saves) if c]
    key = _row_key(pre)
    ranked = pre.df.select(*columns, key.alias("__k")).orderBy(_er().desc_nulls_last(), F.col("__k")).limit(n)
    w = Window.orderBy(F.col(ER).desc_nulls_last(), F.col("__k"))  # over the n kept rows only
    return ranked.select(F.row_number().over(w).alias("rank"), *columns)


def top_posts_library(pre: Prepared, n: int = 10) -> DataFrame:
    """T1, library variant: date, rate, total engagements and the denominator column."""
    r = pre.roles
    den = r.reach or r.views or r.impressions
    return top_posts(pre, n, [c for c in (r.date, ER, TOTAL, den) if c])


def top5_posts(pre: Prepared) -> DataFrame:
    """The five best posts with date (or N/A), type and interactions."""
    r = pre.roles
    d = F.coalesce(ntz_text(r.date, "date"), F.lit("N/A")) if r.date else F.lit("N/A")
    t = F.coalesce(F.col(r.type).cast("string"), F.lit("")) if r.type else F.lit("")
    key = _row_key(pre)
    ranked = pre.df.select(d.alias("date"), t.alias("content_type"),
                           F.col(TOTAL).cast("bigint").alias("interactions"), ER, key.alias("__k")) \
        .orderBy(_er().desc_nulls_last(), F.col("__k")).limit(5)
    w = Window.orderBy(F.col(ER).desc_nulls_last(), F.col("__k"))
    return ranked.select(F.row_number().over(w).alias("rank"), "date", "content_type", "interactions",
                         rint_round(F.col(ER), 1).alias("er_1dp"))


# --------------------------------------------------------------------- B1-B3
def benchmark_check(pre: Prepared, benchmark: float = DEFAULT_BENCHMARK) -> DataFrame:
    """B1: is the mean rate strictly above the benchmark?"""
    return pre.df.agg(F.avg(_er()).alias("m")).select(
        rint_round(F.col("m"), 2).alias("avg_er"), F.lit(float(benchmark)).alias("benchmark"),
        (F.col("m") > F.lit(float(benchmark))).alias("beats_benchmark"))


def benchmark_status(pre: Prepared, benchmark: float = DEFAULT_BENCHMARK) -> DataFrame:
    """Outstanding / above / below, the multiple and the signed delta."""
    b = F.lit(float(benchmark))
    avg = F.col("avg_er")
    base = pre.df.agg(rint_round(F.avg(_er()), 2).alias("avg_er"))
    delta = rint_round(avg - b, 1)
    return base.select(
        "avg_er", b.alias("benchmark"),
        F.when(avg >= b * 1.5, "outstanding").when(avg >= b, "above").otherwise("below").alias("status"),
        F.when(avg >= b * 1.5, rint_round(avg / b, 1)).alias("multiple"),
        delta.alias("delta"),
        F.when(delta >= 0, "up").otherwise("down").alias("direction"),
    )
