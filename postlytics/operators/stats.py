"""Hypothesis tests (H*): ANOVA, t-tests, Levene, terciles, Shapiro-Wilk.

Every test reduces the rows to per-group moments (n, mean, variance) with one
partial+final aggregate, then finishes on one row with Column maths.  No
group's values are ever gathered in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.functions.columns import broadcast_groups, rint_round
from postlytics.functions.distributions import f_sf, norm_cdf, norm_ppf, t_two_sided_p
from postlytics.functions.ranking import group_quantiles, ranks_within_groups
from postlytics.operators.features import ER, Prepared
from postlytics.session import cut_lineage

ALPHA = 0.05

# Effect-size cut points and tercile labels.
EFFECT_CUTS = [(0.01, "negligible"), (0.06, "small"), (0.14, "medium")]
TERCILE_LABELS = ["Short", "Medium", "Long"]


def effect_label(eta2: Column) -> Column:
    """Negligible / small / medium / large."""
    out = F.lit("large")
    for cut, label in reversed(EFFECT_CUTS):
        out = F.when(eta2 < cut, label).otherwise(out)
    return out


def group_moments(df: DataFrame, group: Column | str, value: str = ER, min_n: int = 1) -> DataFrame:
    """(grp, n, mean, var) per group over non-null values; groups below min_n dropped."""
    g = F.col(group) if isinstance(group, str) else group
    v = F.col(value)
    m = df.where(g.isNotNull() & v.isNotNull()).groupBy(g.cast("string").alias("grp")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))
    return m.where(F.col("n") >= min_n)


def anova_from_moments(m: DataFrame) -> DataFrame:
    """One-way ANOVA from group moments: one row with k, N, SSB, SSW, F, p, eta2."""
    tot = m.agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("k"),
                (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand_mean"))
    j = m.crossJoin(F.broadcast(tot))
    # global aggregate: always one row, also when no group qualifies
    row = j.agg(
        F.first("n_total").alias("n_total"), F.coalesce(F.first("k"), F.lit(0)).alias("k"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand_mean"), 2)).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ssw"),
    )
    d1 = (F.col("k") - 1).cast("double")
    d2 = (F.col("n_total") - F.col("k")).cast("double")
    f = (F.col("ssb") / d1) / (F.col("ssw") / d2)
    sst = F.col("ssb") + F.col("ssw")
    return row.select(
        "k", "n_total", "ssb", "ssw", d1.alias("df_between"), d2.alias("df_within"), f.alias("F"),
        F.when(sst > 0, F.col("ssb") / sst).otherwise(F.lit(0.0)).alias("eta2"),
    ).withColumn("p", f_sf(F.col("F"), F.col("df_between"), F.col("df_within")))


def best_group(m: DataFrame) -> DataFrame:
    """Group with the highest mean; first in name order on ties."""
    return m.agg(F.min_by(F.col("grp"), F.struct(-F.col("mean"), F.col("grp"))).alias("best"))


def anova_by(pre: Prepared, group: str | None = None, min_n: int = 5, alpha: float = ALPHA) -> DataFrame:
    """H1: does the group (content type by default) affect the rate?"""
    group = group or pre.roles.type
    if not group:
        raise ValueError("no grouping column")
    m = group_moments(pre.df, group, ER, min_n)
    a = anova_from_moments(m)
    b = best_group(m)
    e2 = rint_round(F.col("eta2"), 4)
    return a.crossJoin(b).where(F.col("k") >= 2).select(
        F.lit("One-Way ANOVA").alias("test"),
        rint_round(F.col("F"), 4).alias("statistic"),
        rint_round(F.col("p"), 4).alias("p_value"),
        F.col("df_between"), F.col("df_within"),
        (F.col("p") < alpha).alias("reject_h0"),
        e2.alias("effect_size"), effect_label(e2).alias("effect_label"),
        F.col("best").alias("best_group"), F.col("k").alias("groups"), "n_total",
    )


def anova_group_means(pre: Prepared, group: str | None = None, min_n: int = 5) -> DataFrame:
    """H1 detail: the per-group means (2 digits) and counts that entered the test."""
    group = group or pre.roles.type
    m = group_moments(pre.df, group, ER, min_n)
    return m.select("grp", "n", rint_round(F.col("mean"), 2).alias("mean_er"))


def _two_groups(a: list[Column], b: list[Column], equal_var: Column) -> tuple[Column, Column, Column]:
    """(t, df, eta2) of two groups from their (n, mean, var)."""
    n1, n2 = a[0].cast("double"), b[0].cast("double")
    (m1, v1), (m2, v2) = a[1:], b[1:]
    se_w = F.sqrt(v1 / n1 + v2 / n2)
    none = lambda c: F.nullif(c, F.lit(0.0))  # noqa: E731 - no spread or one value: no statistic rather than an error
    df_w = F.pow(v1 / n1 + v2 / n2, 2) / none(F.pow(v1 / n1, 2) / none(n1 - 1) + F.pow(v2 / n2, 2) / none(n2 - 1))
    sp2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / none(n1 + n2 - 2)
    se_p = F.sqrt(sp2 * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    t = (m1 - m2) / none(F.when(equal_var, se_p).otherwise(se_w))
    dfree = F.when(equal_var, n1 + n2 - 2).otherwise(df_w)
    mm = (n1 * m1 + n2 * m2) / (n1 + n2)
    ssb = n1 * F.pow(m1 - mm, 2) + n2 * F.pow(m2 - mm, 2)
    ssw = (n1 - 1) * F.coalesce(v1, F.lit(0.0)) + (n2 - 1) * F.coalesce(v2, F.lit(0.0))
    return t, dfree, F.when(ssb + ssw > 0, ssb / (ssb + ssw)).otherwise(F.lit(0.0))


def two_group_test(m1: DataFrame, m2: DataFrame, equal_var: bool | Column = False) -> DataFrame:
    """H5/H6: t statistic, df and two-sided p from two one-row moment frames.

    ``m1``/``m2`` carry n, mean, var; ``equal_var`` may be a Column (per-row choice).
    """
    a = m1.select(F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("var").alias("v1"))
    b = m2.select(F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("var").alias("v2"))
    ev = equal_var if isinstance(equal_var, Column) else F.lit(bool(equal_var))
    t, dfree, eta2 = _two_groups([F.col(c) for c in ("n1", "m1", "v1")], [F.col(c) for c in ("n2", "m2", "v2")], ev)
    return a.crossJoin(b).select("*", t.alias("t"), dfree.alias("df"), eta2.alias("eta2")) \
        .withColumn("p", t_two_sided_p(F.col("t"), F.col("df")))


def _period_moments(pre: Prepared, weekend: bool) -> DataFrame:
    wk = F.col("is_weekend") if weekend else ~F.col("is_weekend")
    d = pre.df.where(wk & F.col(ER).isNotNull())
    return d.agg(F.count(ER).alias("n"), F.avg(ER).alias("mean"), F.var_samp(ER).alias("var"))


def weekend_test(pre: Prepared, equal_var: bool = False, min_n: int = 5, alpha: float = ALPHA,
                 require_date: bool = False) -> DataFrame:
    """H5 (Welch, default) / H6 (pooled): weekend versus weekday posts."""
    src = pre
    if require_date and pre.roles.date:
        src = Prepared(pre.df.where(F.col(pre.roles.date).isNotNull()), pre.roles, pre.denominator)
    res = two_group_test(_period_moments(src, True), _period_moments(src, False), equal_var)
    e2 = rint_round(F.col("eta2"), 4)
    return res.where((F.col("n1") >= min_n) & (F.col("n2") >= min_n)).select(
        F.lit("Student t-test" if equal_var else "Welch t-test").alias("test"),
        rint_round(F.col("t"), 4).alias("statistic"),
        rint_round(F.col("p"), 4).alias("p_value"),
        rint_round(F.col("df"), 4).alias("df"),
        (F.col("p") < alpha).alias("reject_h0"),
        e2.alias("effect_size"), effect_label(e2).alias("effect_label"),
        F.when(F.col("m1") > F.col("m2"), "Weekend").otherwise("Weekday").alias("better_period"),
        rint_round(F.col("m2"), 2).alias("weekday_avg"),
        rint_round(F.col("m1"), 2).alias("weekend_avg"),
        F.col("n1").alias("weekend_n"), F.col("n2").alias("weekday_n"),
    )


def levene(df: DataFrame, group: str, value: str = ER, min_n: int = 1, few_groups: bool = False) -> DataFrame:
    """H7: Brown-Forsythe/Levene (median-centred) = ANOVA on |x - group median|.

    ``few_groups``: the group is one of a fixed set of labels, its table needs no count before it is broadcast.
    """
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()) \
        .select(F.col(group).cast("string").alias("grp"), F.col(value).alias("v"))
    counts = d.groupBy("grp").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_n)
    med = group_quantiles(d, "grp", "v", [0.5], few_groups=few_groups).select("grp", F.col("q")[0].alias("med"))
    keep = (F.broadcast if few_groups else broadcast_groups)(counts.join(med, "grp").select("grp", "med"))
    z = d.join(keep, "grp").select("grp", F.abs(F.col("v") - F.col("med")).alias("z"))
    a = anova_from_moments(group_moments(z, "grp", "z"))
    return a.select(F.col("F").alias("W"), F.col("p"), "df_between", "df_within", "k", "n_total")


def levene_by(pre: Prepared, group: str | None = None, min_n: int = 5) -> DataFrame:
    group = group or pre.roles.type
    return levene(pre.df, group, ER, min_n).select(
        rint_round(F.col("W"), 4).alias("statistic"), rint_round(F.col("p"), 4).alias("p_value"),
        "df_between", "df_within", F.col("k").alias("groups"), "n_total")


# ------------------------------------------------------------------ reels and durations
def reel_rows(pre: Prepared, type_col: str | None = None) -> DataFrame:
    """Rows whose type mentions reel or video (any case)."""
    t = type_col or pre.roles.type
    if not t:
        raise ValueError("No content type column found (media_type/post_type/type).")
    return pre.df.where(F.coalesce(F.col(t).cast("string").rlike("(?i)reel|video"), F.lit(False)))


# Duration column names the tests fall back to, in order.
DURATION_CANDIDATES = ["duration", "duration_(sec)", "duration_sec", "video_duration", "length"]


def duration_column(pre: Prepared) -> str | None:
    """The resolved duration role, else the first known duration name present."""
    return pre.roles.duration or next((c for c in DURATION_CANDIDATES if c in pre.df.columns), None)


def duration_rows(pre: Prepared, lo: float = 3.0, hi: float = 90.0, lo_inclusive: bool = False) -> DataFrame:
    """P21 + P22: reels with a duration in (lo, hi] (or [lo, hi]) and a rate."""
    d = duration_column(pre)
    if not d:
        raise ValueError("Duration column not found.")
    dc = F.col(d).cast("double")
    lower = dc >= lo if lo_inclusive else dc > lo
    return reel_rows(pre).where(lower & (dc <= hi) & dc.isNotNull() & F.col(ER).isNotNull()) \
        .withColumn(d, dc)


def with_terciles(reels: DataFrame, duration: str) -> DataFrame:
    """H2: Short / Medium / Long by linear terciles, right-closed, lowest included.

    Tied edges leave no three bins: every row then gets a null group and the
    caller reports the error.
    """
    q = reels.agg(F.min(duration).alias("dmin"), F.max(duration).alias("dmax")).crossJoin(
        group_quantiles(reels, None, duration, [1.0 / 3.0, 2.0 / 3.0]))
    q = q.select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), "dmin", "dmax")
    dc = F.col(duration)
    distinct_edges = (F.col("dmin") < F.col("q1")) & (F.col("q1") < F.col("q2")) & (F.col("q2") < F.col("dmax"))
    grp = F.when(~distinct_edges, F.lit(None)) \
        .when(dc <= F.col("q1"), F.lit(TERCILE_LABELS[0])) \
        .when(dc <= F.col("q2"), F.lit(TERCILE_LABELS[1])).otherwise(F.lit(TERCILE_LABELS[2]))
    return reels.crossJoin(F.broadcast(q)).withColumn("duration_group", grp) \
        .withColumn("group_order", F.when(grp == "Short", 1).when(grp == "Medium", 2).when(grp == "Long", 3))


def duration_terciles(pre: Prepared, lo: float = 3.0, hi: float = 90.0, lo_inclusive: bool = False) -> DataFrame:
    """H2 report: count, mean rate and duration range per tercile group."""
    d = duration_column(pre)
    t = with_terciles(duration_rows(pre, lo, hi, lo_inclusive), d)
    return t.where(F.col("duration_group").isNotNull()).groupBy("duration_group", "group_order").agg(
        F.count(F.lit(1)).alias("reels"),
        rint_round(F.avg(ER), 2).alias("mean_er"),
        F.min(d).alias("min_duration"), F.max(d).alias("max_duration"),
    ).orderBy("group_order")


def shapiro_wilk(df: DataFrame, group: str, value: str = ER, alpha: float = ALPHA) -> DataFrame:
    """H8: Shapiro-Wilk W and p per group (Royston 1995 approximation, AS R94).

    The weights depend only on a value's rank and the group size, so after an
    exact distributed rank the statistic is one more aggregate.  Valid for
    3 <= n; the p approximation is Royston's for 4 <= n (n = 3 exact).
    """
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()) \
        .select(F.col(group).cast("string").alias("grp"), F.col(value).cast("double").alias("x"))
    r = ranks_within_groups(d, "grp", "x")
    n = F.col("n").cast("double")
    m = norm_ppf((F.col("rank") - 0.375) / (n + 0.25))
    r = r.withColumn("m", m)
    j = F.least(F.col("rank"), F.col("n") - F.col("rank") + 1)  # distance from the nearer end
    sign = F.when(F.col("rank") * 2 < F.col("n") + 1, -1.0).when(F.col("rank") * 2 > F.col("n") + 1, 1.0).otherwise(0.0)
    agg = r.groupBy("grp").agg(
        F.first("n").alias("n"),
        F.sum(F.col("m") * F.col("m")).alias("summ2"),
        F.sum(F.when(j > 2, F.col("m") * F.col("x")).otherwise(0.0)).alias("mx_mid"),
        F.sum(F.when(j == 2, F.col("m") * F.col("x")).otherwise(0.0)).alias("mx_2"),
        F.sum(F.when(j == 1, sign * F.col("x")).otherwise(0.0)).alias("sx_1"),
        F.sum(F.when(j == 2, sign * F.col("x")).otherwise(0.0)).alias("sx_2"),
        F.max(F.when(F.col("rank") == 1, F.col("m"))).alias("m1"),
        F.max(F.when(F.col("rank") == 2, F.col("m"))).alias("m2"),
        F.avg("x").alias("mean"), F.var_samp("x").alias("var"),
    )
    nn = F.col("n").cast("double")
    c1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
    c2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]

    def poly(cs, x):
        acc = F.lit(cs[-1])
        for c in reversed(cs[:-1]):
            acc = acc * x + F.lit(c)
        return acc

    # staged projections: every intermediate is computed once, never inlined twice
    st = agg.where(F.col("n") >= 3).withColumn("u", F.lit(1.0) / F.sqrt(nn)) \
        .withColumn("ss", F.sqrt(F.col("summ2")))
    st = st.withColumn("a1", poly(c1, F.col("u")) - F.col("m1") / F.col("ss")) \
        .withColumn("a2", poly(c2, F.col("u")) - F.col("m2") / F.col("ss"))
    big = nn > 5
    st = st.withColumn("fac", F.when(big, F.sqrt((F.col("summ2") - 2 * F.col("m1") ** 2 - 2 * F.col("m2") ** 2)
                                                 / (1 - 2 * F.col("a1") ** 2 - 2 * F.col("a2") ** 2)))
                       .otherwise(F.sqrt((F.col("summ2") - 2 * F.col("m1") ** 2) / (1 - 2 * F.col("a1") ** 2))))
    # middle ranks: coefficient m_r / fac; ends: the corrected a1 (and a2 when n > 5)
    st = st.withColumn("lin", F.when(nn == 3, F.lit(math.sqrt(0.5)) * F.col("sx_1")).otherwise(
        F.col("mx_mid") / F.col("fac") + F.col("a1") * F.col("sx_1")
        + F.when(big, F.col("a2") * F.col("sx_2")).otherwise(F.col("mx_2") / F.col("fac"))))
    st = st.withColumn("W", F.least(F.pow(F.col("lin"), 2) / (F.col("var") * (nn - 1)), F.lit(1.0)))
    # p-value (Royston 1995)
    st = st.withColumn("wy", F.log(F.lit(1.0) - F.col("W"))) \
        .withColumn("gamma", poly([-2.273, 0.459], nn))
    ln_n = F.log(nn)
    z_small = (-F.log(F.col("gamma") - F.col("wy")) - poly([0.5440, -0.39978, 0.025054, -6.714e-4], nn)) \
        / F.exp(poly([1.3822, -0.77857, 0.062767, -0.0020322], nn))
    z_big = (F.col("wy") - poly([-1.5861, -0.31082, -0.083751, 0.0038915], ln_n)) \
        / F.exp(poly([-0.4803, -0.082676, 0.0030302], ln_n))
    st = st.withColumn("z", F.when(nn <= 11, z_small).otherwise(z_big))
    st = st.withColumn("upper", F.lit(1.0) - norm_cdf(F.col("z")))
    p3 = F.greatest(F.lit(0.0), F.lit(6.0 / math.pi) * (F.asin(F.sqrt(F.col("W")))
                                                       - F.lit(math.asin(math.sqrt(0.75)))))
    p = F.when(nn == 3, p3) \
        .when(nn <= 11, F.when(F.col("wy") >= F.col("gamma"), F.lit(1e-99)).otherwise(F.col("upper"))) \
        .otherwise(F.col("upper"))
    out = st.select("grp", "n", "W", p.alias("p"))
    return out.withColumn("normal", F.col("p") > alpha)


def shapiro_by(pre: Prepared, group: str | None = None, alpha: float = ALPHA) -> DataFrame:
    group = group or pre.roles.type
    return shapiro_wilk(pre.df, group, ER, alpha).select(
        "grp", "n", rint_round(F.col("W"), 4).alias("W"), rint_round(F.col("p"), 4).alias("p_value"), "normal")


def _not_run(spark: SparkSession, why: str, alpha: float) -> DataFrame:
    """The row of ``duration_test`` where its columns are missing."""
    schema = ("error string, test_used string, total_reels_analyzed bigint, group_counts string, group_means string, best_duration_group string, "
              "normality_passed boolean, equal_variance_p double, statistic double, p_value double, alpha double, reject_h0 boolean, "
              "effect_size_eta2 double, conclusion string, agency_recommendation string")
    return spark.createDataFrame([(why, None, 0, *[None] * 7, float(alpha), *[None] * 4)], schema)


def _tercile_moments(t: DataFrame, min_group: int) -> DataFrame:
    """One row from one grouped aggregate over the labelled reels: counts, the groups large enough, ANOVA, both t-tests."""
    m = t.groupBy("duration_group", "group_order").agg(
        F.count(F.lit(1)).alias("n"), F.avg(ER).alias("mean"), F.var_samp(ER).alias("var"))
    named = F.col("duration_group").isNotNull()
    one = m.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("valid_reels"),
        F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("total_reels"),
        # at most 3 labels
        F.array_sort(F.collect_list(F.when(named & (F.col("n") >= min_group), F.struct(
            F.col("group_order").alias("ord"), F.col("duration_group").alias("grp"), "n", "mean", "var")))).alias("g"))

    def total(f):
        return F.aggregate("g", F.lit(0.0), lambda acc, x: acc + f(x))

    one = one.withColumn("k", F.size("g").cast("bigint")).withColumn("n_total", total(lambda x: x["n"])) \
        .withColumn("grand", total(lambda x: x["n"] * x["mean"]) / F.nullif(F.col("n_total"), F.lit(0.0)))
    one = one.withColumn("ssb", total(lambda x: x["n"] * F.pow(x["mean"] - F.col("grand"), 2))) \
        .withColumn("ssw", total(lambda x: (x["n"] - 1) * F.coalesce(x["var"], F.lit(0.0))))
    d1, d2, sst = F.col("k") - F.lit(1.0), F.col("n_total") - F.col("k"), F.col("ssb") + F.col("ssw")
    first, second = ([F.col("g")[at][c] for c in ("n", "mean", "var")] for at in (F.lit(0), F.size("g") - 1))
    first, second = ([F.when(F.col("k") >= 2, c) for c in cols] for cols in (first, second))
    one = one.withColumn("F", F.when((d1 > 0) & (d2 > 0) & (F.col("ssw") > 0), (F.col("ssb") / d1) / (F.col("ssw") / d2))) \
        .withColumn("eta2", F.when(sst > 0, F.col("ssb") / sst).otherwise(F.lit(0.0)))
    for name, equal in (("pooled", True), ("welch", False)):
        tt, df, _ = _two_groups(first, second, F.lit(equal))
        one = one.withColumn(f"t_{name}", tt).withColumn(f"df_{name}", df)
    pairs = lambda f: F.to_json(F.map_from_entries(F.array_sort(F.transform("g", lambda x: F.struct(x["grp"], f(x))))))
    return one.select(
        "valid_reels", "total_reels", "g", "k", "F", "eta2", "t_pooled", "t_welch",
        f_sf(F.col("F"), d1, d2).alias("p"),
        *[t_two_sided_p(F.col(f"t_{n}"), F.col(f"df_{n}")).alias(f"p_{n}") for n in ("pooled", "welch")],
        pairs(lambda x: x["n"]).alias("group_counts"),
        pairs(lambda x: F.format_string("%.2f%%", x["mean"])).alias("group_means"),
        F.array_min(F.transform("g", lambda x: F.struct((-x["mean"]).alias("m"), x["grp"].alias("grp"))))["grp"].alias("best"))


def duration_test(pre: Prepared, alpha: float = ALPHA, lo: float = 3.0, hi: float = 90.0,
                  lo_inclusive: bool = False, min_reels: int = 15, min_group: int = 3,
                  t_test: str = "levene") -> DataFrame:
    """H4: does reel duration affect the rate?  ANOVA over terciles, t-test if 2 remain.

    ``t_test``: ``levene`` (library: pooled when Levene does not reject, else
    Welch), ``pooled`` (notebook) or ``welch``.  One result row; when a
    requirement is not met the row carries ``error``.
    """
    d = duration_column(pre)
    missing = [what for what, col in (("duration", d), ("content type", pre.roles.type), ("engagement rate", ER if ER in pre.df.columns else None))
               if not col]
    if missing:
        return _not_run(pre.df.sparkSession, f"No {' and no '.join(missing)} column: the test can't be run.", alpha)
    # read by the moments, by Levene's and by Shapiro-Wilk's test: cut the lineage once
    reels = cut_lineage(duration_rows(pre, lo, hi, lo_inclusive).select(d, ER))
    t = cut_lineage(with_terciles(reels, d).select("duration_group", "group_order", ER))
    st = cut_lineage(_tercile_moments(t, min_group))
    kept = F.broadcast(st.select(F.explode("g.grp").alias("duration_group")))  # at most 3 labels
    tested = t.join(kept, "duration_group")
    lev = levene(tested, "duration_group", few_groups=True).select(F.col("p").alias("levene_p"))
    sw = shapiro_wilk(tested, "duration_group", ER, alpha).agg(F.bool_and("normal").alias("normality_passed"))
    row = st.crossJoin(lev).crossJoin(sw)
    two = F.col("k") == 2
    pooled = {"levene": F.col("levene_p") > alpha, "pooled": F.lit(True), "welch": F.lit(False)}[t_test]
    stat = F.when(two, F.when(pooled, F.col("t_pooled")).otherwise(F.col("t_welch"))).otherwise(F.col("F"))
    pval = F.when(two, F.when(pooled, F.col("p_pooled")).otherwise(F.col("p_welch"))).otherwise(F.col("p"))
    reject = pval < alpha
    error = (F.when(F.col("valid_reels") < min_reels,
                    F.format_string("%d reels with a duration and a rate; the test needs %d.",
                                    F.col("valid_reels"), F.lit(min_reels)))
             .when(F.col("total_reels") == 0, F.lit("The durations' terciles coincide: no three groups."))
             .when(F.col("k") < 2, F.lit("Fewer than two duration groups have enough reels.")))
    sig = F.when(reject, "significant").otherwise("not significant")
    pstr = F.format_string("%.4f", pval)
    out = row.select(
        error.alias("error"),
        F.when(two, "Two-Sample t-Test").otherwise("One-Way ANOVA").alias("test_used"),
        F.col("valid_reels").alias("total_reels_analyzed"),
        "group_counts", "group_means",
        F.col("best").alias("best_duration_group"),
        "normality_passed",
        rint_round(F.col("levene_p"), 4).alias("equal_variance_p"),
        rint_round(stat, 3).alias("statistic"),
        rint_round(pval, 4).alias("p_value"),
        F.lit(float(alpha)).alias("alpha"),
        reject.alias("reject_h0"),
        rint_round(F.col("eta2"), 3).alias("effect_size_eta2"),
        F.concat(F.lit("Engagement by duration: "), sig, F.lit(" difference, p "), pstr, F.lit("; null hypothesis "),
                 F.when(reject, "rejected").otherwise("kept"), F.lit(".")).alias("conclusion"),
        F.when(F.col("best") == "Short",
               F.lit("Short reels have the best mean rate: make more of them."))
        .otherwise(F.lit("Short reels aren't ahead: vary the content before the length."))
        .alias("agency_recommendation"),
    )
    return out


def p_values(pre: Prepared) -> DataFrame:
    """Every test statistic with its degrees of freedom and p-value."""
    a = anova_by(pre).select(F.lit("content_type_anova").alias("test_name"), "statistic",
                             F.col("df_between").alias("df1"), F.col("df_within").alias("df2"), "p_value")
    w = weekend_test(pre).select(F.lit("weekend_welch").alias("test_name"), "statistic",
                                 F.lit(1.0).alias("df1"), F.col("df").alias("df2"), "p_value")
    s = weekend_test(pre, equal_var=True).select(F.lit("weekend_student").alias("test_name"), "statistic",
                                                 F.lit(1.0).alias("df1"), F.col("df").alias("df2"), "p_value")
    lv = levene_by(pre).select(F.lit("content_type_levene").alias("test_name"), "statistic",
                               F.col("df_between").alias("df1"), F.col("df_within").alias("df2"), "p_value")
    return a.unionByName(w).unionByName(s).unionByName(lv)


def _pstr(p: Column) -> Column:
    """p rounded to 4 digits as plain text (no exponent)."""
    return F.regexp_replace(F.format_string("%.4f", p), "(\\.[0-9]*?)0+$", "$1")


def test_summary(pre: Prepared, alpha: float = ALPHA) -> DataFrame:
    """H12 + H10: every test as one row with its own decision (D7) and a sentence.

    H3: a test whose requirements aren't met has its row as well, with the reason as its sentence and no decision.
    """
    a = None if not pre.roles.type else anova_by(pre, alpha=alpha).select(
        F.lit("content_type").alias("test_name"), "test", "statistic", "p_value", "reject_h0",
        "effect_size", "effect_label",
        F.concat(F.lit("Rates by content type "), F.when(F.col("reject_h0"), "differ").otherwise("don't differ clearly"),
                 F.lit(": p "), _pstr(F.col("p_value")), F.lit(", effect "),
                 F.col("effect_label"), F.lit(", highest mean "), F.col("best_group"), F.lit(".")).alias("interpretation"))
    w = None if not pre.has_calendar else weekend_test(pre, alpha=alpha).select(
        F.lit("weekend").alias("test_name"), "test", "statistic", "p_value", "reject_h0",
        "effect_size", "effect_label",
        F.concat(F.col("better_period"), F.lit(" has the higher mean rate, "),
                 F.when(F.col("reject_h0"), "clearly").otherwise("not clearly"),
                 F.lit(": p "), _pstr(F.col("p_value")), F.lit(", effect "), F.col("effect_label"),
                 F.lit(", weekday "), F.format_string("%.2f", F.col("weekday_avg")),
                 F.lit(", weekend "), F.format_string("%.2f", F.col("weekend_avg")), F.lit(".")
                 ).alias("interpretation"))
    ran = F.col("error").isNull()
    shown = lambda c: F.when(ran, c)
    d = duration_test(pre, alpha=alpha).select(
        F.lit("reel_duration").alias("test_name"), shown(F.col("test_used")).alias("test"),
        *[shown(F.col(c)).alias(c) for c in ("statistic", "p_value", "reject_h0")],
        shown(rint_round(F.col("effect_size_eta2"), 4)).alias("effect_size"),
        shown(effect_label(F.col("effect_size_eta2"))).alias("effect_label"),
        F.coalesce("error", "conclusion").alias("interpretation"))
    tests = [("content_type", a, "No two content types with enough rated posts: the test can't be run."),
             ("weekend", w, "Weekend or weekday has too few rated posts: the test can't be run."), ("reel_duration", d, "")]
    rows = None
    for name, found, why in tests:
        slot = pre.df.sparkSession.createDataFrame([(name, why)], "test_name string, why string")
        found = d.where("false") if found is None else found
        one = slot.join(found.withColumn("found", F.lit(True)), "test_name", "left").withColumn(
            "interpretation", F.when(F.col("found"), F.col("interpretation")).otherwise(F.col("why"))).drop("found", "why")
        rows = one if rows is None else rows.unionByName(one)
    none = F.col("reject_h0").isNull()
    return rows.withColumn("decision", F.when(none, "not run").when(F.col("reject_h0"), "reject H0").otherwise("do not reject H0")) \
        .withColumn("action", F.when(none, F.concat(F.lit("No answer on "), F.col("test_name"), F.lit(": more data is needed.")))
                    .when(F.col("reject_h0"),
                                     F.concat(F.lit("Act on "), F.col("test_name"), F.lit(": the difference is real.")))
                    .otherwise(F.concat(F.lit("No action on "), F.col("test_name"),
                                        F.lit(": the difference may be chance."))))
