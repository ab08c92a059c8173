import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postlytics.functions.ranking import ranks_within_groups
from postlytics.operators import stats
from postlytics.operators.features import Prepared, preprocess
from postlytics.operators.roles import Roles


def _ppf(p):
    # numpy-free inverse normal via bisection on erf (test helper only)
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def shapiro_twin(x):
    """Plain-loop Royston (AS R94) on one sample: the distributed version must agree."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = np.array([_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    summ2 = (m ** 2).sum()
    ss = math.sqrt(summ2)
    u = 1 / math.sqrt(n)
    c1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
    c2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
    poly = lambda cs, v: sum(c * v ** k for k, c in enumerate(cs))
    a = m / 1.0
    a1 = poly(c1, u) - m[0] / ss
    if n > 5:
        a2 = poly(c2, u) - m[1] / ss
        fac = math.sqrt((summ2 - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2))
        a = m / fac
        a[0], a[1], a[-1], a[-2] = -a1, -a2, a1, a2
    else:
        fac = math.sqrt((summ2 - 2 * m[0] ** 2) / (1 - 2 * a1 ** 2))
        a = m / fac
        a[0], a[-1] = -a1, a1
    w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
    return min(w, 1.0)


@pytest.mark.parametrize("n", [4, 7, 11, 12, 50, 300])
def test_shapiro_w_matches_twin(spark, n):
    rng = np.random.default_rng(n)
    xs = {"a": rng.normal(size=n), "b": rng.exponential(size=n)}
    data = [(g, float(v)) for g, arr in xs.items() for v in arr]
    df = spark.createDataFrame(data, "g string, x double")
    out = {r["grp"]: r for r in stats.shapiro_wilk(df, "g", "x").collect()}
    for g, arr in xs.items():
        assert out[g]["W"] == pytest.approx(shapiro_twin(arr), abs=1e-9)
        assert 0.0 <= out[g]["p"] <= 1.0
    if n >= 50:
        assert out["b"]["p"] < 0.05  # exponential sample is not normal


def test_distributed_ranks_equal_window(spark):
    rng = np.random.default_rng(1)
    data = [("hot" if i % 3 else f"g{i % 7}", float(rng.integers(0, 50))) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, x double")
    got = ranks_within_groups(df, "g", "x", num_partitions=6)
    w = Window.partitionBy("g").orderBy("x")
    exp = df.withColumn("r", F.row_number().over(w))
    # ties may be ordered differently: compare the multiset of (group, value, rank) per group+value
    a = got.groupBy("g", "x").agg(F.sum("rank").alias("s"), F.count("*").alias("c")).collect()
    b = exp.groupBy("g", "x").agg(F.sum("r").alias("s"), F.count("*").alias("c")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert got.agg(F.max(F.col("rank") - F.col("n"))).first()[0] == 0


def test_anova_matches_closed_form(spark):
    rng = np.random.default_rng(3)
    groups = {"x": rng.normal(0, 1, 30), "y": rng.normal(0.5, 1, 40), "z": rng.normal(1, 2, 25)}
    data = [(g, float(v)) for g, arr in groups.items() for v in arr]
    df = spark.createDataFrame(data, "g string, engagement_rate_pct double")
    res = stats.anova_from_moments(stats.group_moments(df, "g")).first()
    allv = np.concatenate(list(groups.values()))
    ssb = sum(len(a) * (a.mean() - allv.mean()) ** 2 for a in groups.values())
    ssw = sum(((a - a.mean()) ** 2).sum() for a in groups.values())
    f = (ssb / 2) / (ssw / (len(allv) - 3))
    assert res["F"] == pytest.approx(f, rel=1e-10)
    assert res["eta2"] == pytest.approx(ssb / (ssb + ssw), rel=1e-10)
    assert 0 <= res["p"] <= 1


def test_tied_terciles_give_error_row(spark):
    rows = [(i, "Reel", 5.0 if i < 10 else 6.0 + (i - 10), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "post_id long, post_type string, duration_sec double, engagement_rate_pct double")
    pre = Prepared(df, Roles(type="post_type", duration="duration_sec"), "reach")
    out = stats.duration_test(pre).first()
    assert out["error"] is not None


def test_welch_equals_formula(spark, pre_small):
    r = stats.weekend_test(pre_small).first()
    pdf = pre_small.df.select("is_weekend", "engagement_rate_pct").toPandas().dropna()
    a = pdf[pdf.is_weekend].engagement_rate_pct.to_numpy()
    b = pdf[~pdf.is_weekend].engagement_rate_pct.to_numpy()
    t = (a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b))
    assert r["statistic"] == pytest.approx(round(t, 4), abs=1e-4)
    assert 0 <= r["p_value"] <= 1


def test_null_date_is_weekday(spark):
    import datetime as dt
    df = spark.createDataFrame([(1, dt.datetime(2024, 7, 6, 10), 10.0, 1.0), (2, None, 10.0, 2.0)],
                               "post_id long, publish_time timestamp_ntz, reach double, likes double")
    pre = preprocess(df)
    got = {r["post_id"]: r["is_weekend"] for r in pre.df.collect()}
    assert got == {1: True, 2: False}


def test_all_null_parts_total_zero(spark):
    df = spark.createDataFrame([(1, 10.0, None, None)], "post_id long, reach double, likes double, saves double")
    assert preprocess(df).df.first()["total_engagements"] == 0.0


def test_rank_quantiles_equal_map_quantiles(spark):
    from postlytics.functions.ranking import group_quantiles

    rng = np.random.default_rng(7)
    data = [("hot" if i % 3 else f"g{i % 5}", float(rng.integers(0, 1000)) / 7) for i in range(4000)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = [0.25, 0.5, 0.75, 1 / 3]
    a = {r["g"]: r["q"] for r in group_quantiles(df, "g", "v", probs, method="map").collect()}
    b = {r["g"]: r["q"] for r in group_quantiles(df, "g", "v", probs, method="rank").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k], b[k], rtol=0, atol=1e-9)
    one = group_quantiles(df, None, "v", [0.5], method="rank").first()["q"][0]
    assert one == pytest.approx(float(np.quantile([v for _, v in data], 0.5)), abs=1e-9)


def test_refined_quantiles_equal_map_quantiles(spark):
    from postlytics.functions.ranking import group_quantiles

    rng = random.Random(3)
    data = [("edges", x) for x in (float("inf"), 1.0, -float("inf"))] + [("tiny", x) for x in (5e-324, 1e-323, 0.0)] + [("one", 7.0)]
    for i in range(3000):
        data += [("zeros", rng.choice([0.0, -0.0, 1.5, round(rng.gauss(0, 50), 4)])), ("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)),
                 ("neighbours", 1.0 + i * 2.0 ** -52), ("few", float(i % 3)), (None, 1.0), ("nulls", None if i % 2 else -float(i))]
    df = spark.createDataFrame(data, "g string, v double").repartition(8)
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    a = {r["g"]: r["q"] for r in group_quantiles(df, "g", "v", probs, method="map").collect()}
    assert a == {r["g"]: r["q"] for r in group_quantiles(df, "g", "v", probs).collect()}
    assert group_quantiles(df.where("g = 'wide'"), None, "v", probs).first()["q"] == a["wide"]
    assert group_quantiles(df.where("false"), None, "v", probs).first()["q"] is None
    assert group_quantiles(df.where("false"), "g", "v", probs).count() == 0


def test_refined_quantiles_shuffle_no_row(spark):
    from postlytics.functions.ranking import group_quantiles

    df = spark.range(1000).select(F.rand(1).alias("v"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantiles", "quantiles")
    try:
        q = group_quantiles(df, None, "v", [0.5])
        assert not tracker.getJobIdsForGroup("quantiles")  # nothing runs before the result is asked for
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = q._jdf.queryExecution().executedPlan().toString()
    # the rows meet their pieces in broadcast joins and reach a shuffle only as partial counts
    assert "SortMergeJoin LeftOuter" not in plan and plan.count("partial_count(1)") >= 3


def test_ranks_split_a_run_of_ties(spark):
    # a third of all rows share one (group, value): the ranks must still be a permutation
    data = [("hot", 0.0)] * 3000 + [("hot", float(i)) for i in range(1, 3001)] + [("cold", float(i)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, x double")
    r = ranks_within_groups(df, "g", "x", num_partitions=8)
    per = r.groupBy("g").agg(F.count("*").alias("c"), F.countDistinct("rank").alias("d"),
                             F.min("rank").alias("lo"), F.max("rank").alias("hi")).collect()
    for row in per:
        assert row["c"] == row["d"] == row["hi"] and row["lo"] == 1
    from postlytics.functions.ranking import range_ordered

    o = range_ordered(df, "g", "x", 8)
    zero_parts = o.where((F.col("g") == "hot") & (F.col("x") == 0.0)).select("__pid").distinct().count()
    assert zero_parts >= 2  # the run of ties is cut over several tasks
    assert r.where((F.col("g") == "hot") & (F.col("x") == 0.0)).agg(F.max("rank")).first()[0] == 3000
