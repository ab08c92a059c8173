from pyspark.sql import functions as F

from postlytics.operators import eda, stats


def test_histogram_counts_add_up(pre_small):
    h = eda.er_histogram(pre_small).agg(F.sum("posts")).first()[0]
    n = pre_small.df.where(F.col("engagement_rate_pct").isNotNull()).count()
    assert h == n


def test_shares_add_to_100(pre_small):
    s = eda.interaction_breakdown(pre_small).agg(F.sum("share_pct")).first()[0]
    assert abs(s - 100.0) < 0.05


def test_rate_non_negative_with_positive_denominator(pre_small):
    bad = pre_small.df.where((F.col("reach") > 0) & (F.col("engagement_rate_pct") < 0)).count()
    assert bad == 0


def test_eta2_in_unit_interval(pre_small):
    e = stats.anova_by(pre_small).first()["effect_size"]
    assert 0.0 <= e <= 1.0


def test_same_result_under_any_partitioning(spark, pre_small):
    from postlytics.operators.features import Prepared

    a = sorted(map(tuple, eda.er_by_type(pre_small).collect()))
    re = Prepared(pre_small.df.repartition(7), pre_small.roles, pre_small.denominator)
    b = sorted(map(tuple, eda.er_by_type(re).collect()))
    assert a == b


def test_bootstrap_ci_close_to_normal_interval(spark, pre_small):
    import math

    out = {r["grp"]: r for r in eda.mean_ci(pre_small).collect()}
    pdf = pre_small.df.select("weekday", "engagement_rate_pct").toPandas().dropna()
    for day, g in pdf.groupby("weekday"):
        r = out[day]
        se = g.engagement_rate_pct.std(ddof=1) / math.sqrt(len(g))
        assert r["n"] == len(g)
        assert r["ci_low"] < r["mean"] < r["ci_high"]
        width = r["ci_high"] - r["ci_low"]
        assert 0.6 * 3.92 * se < width < 1.4 * 3.92 * se


def test_poisson_weights_have_the_right_moments(spark):
    from postlytics.operators.eda import poisson_weight

    m, v = spark.range(65536).select(poisson_weight(F.lpad(F.lower(F.hex("id")), 4, "0")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(m - 1) < 1e-3 and abs(v - 1) < 2e-3


def test_replicate_weights_by_plain_python(spark):
    import hashlib

    from postlytics.operators.eda import POISSON_BOUNDS, replicate_weights

    got = spark.createDataFrame([("p1",), ("p2",)], "key string").select("key", replicate_weights(F.col("key"), 19, 7).alias("w")).collect()
    for r in got:
        draws = [int(hashlib.md5(f"7|{r['key']}|{b}".encode()).hexdigest()[4 * j:4 * j + 4], 16) for b in range(3) for j in range(8)]
        assert r["w"] == [sum(u >= x for x in POISSON_BOUNDS) for u in draws[:19]]


def test_bootstrap_sums_come_from_tasks_and_equal_the_drawn_weights(spark, pre_small):
    """Weights are drawn from bytes in Arrow tasks, not by expressions on text; null keys and groups of one row count as well."""
    import numpy as np

    from postlytics.operators import eda
    from postlytics.operators.features import Prepared

    data = [("a" if i % 3 else "b", float(i % 7) + 0.5, None if i % 10 == 4 else str(i)) for i in range(1200)]
    data += [("c", 2.0, "x"), ("c", None, "y"), (None, 1.0, "z")]
    df = spark.createDataFrame(data, "weekday string, engagement_rate_pct double, post_id string").repartition(3)
    pre = Prepared(df, pre_small.roles, pre_small.denominator)
    got = eda.mean_ci(pre, n_boot=100, seed=7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "md5" not in plan
    drawn = df.dropna(subset=["weekday", "engagement_rate_pct"]).select("*", eda.replicate_weights(F.col("post_id"), 100, 7).alias("w")).toPandas()
    out = {r["grp"]: r for r in got.collect()}
    assert set(out) == {"a", "b", "c"}
    for grp, g in drawn.groupby("weekday"):
        w, v = np.stack(g["w"].to_list()), g["engagement_rate_pct"].to_numpy()
        ok = w.sum(0) > 0
        lo, hi = np.quantile((v @ w)[ok] / w.sum(0)[ok], [0.025, 0.975])
        r = out[grp]
        assert r["n"] == len(g) and abs(r["mean"] - v.mean()) < 1e-6
        assert abs(r["ci_low"] - lo) < 2e-6 and abs(r["ci_high"] - hi) < 2e-6


def _rates(spark, pre, values):
    from postlytics.operators.features import Prepared

    return Prepared(spark.createDataFrame([(v,) for v in values], "engagement_rate_pct double"), pre.roles, pre.denominator)


def test_density_within_its_bound_of_the_exact_sum(spark, pre_small):
    """Binned values against all kernels, with far outliers between which the grid has empty stretches."""
    import numpy as np

    rng = np.random.default_rng(3)
    for v in (rng.normal(5, 2, 400), np.concatenate([rng.gamma(2, 1, 300), [90.0, 400.0]]), np.array([1.0, 2.0])):
        out = eda.er_density(_rates(spark, pre_small, v.tolist())).collect()
        bw = v.std(ddof=1) * len(v) ** -0.2
        x = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 200)
        want = np.exp(-0.5 * ((x[:, None] - v) / bw) ** 2).sum(axis=1) / (len(v) * bw * eda.SQRT_2PI)
        assert [r["point"] for r in out] == list(range(200))
        assert np.allclose([r["x"] for r in out], x, atol=1e-7)
        assert np.abs(np.array([r["density"] for r in out]) - want).max() <= eda.density_error(bw) + 1e-10


def test_density_without_spread_or_rows(spark, pre_small):
    for same in ([4.0], [4.0] * 5):
        out = eda.er_density(_rates(spark, pre_small, same)).collect()
        assert len(out) == 200 and all(r["x"] == 4.0 and r["density"] is None for r in out)
    assert eda.er_density(_rates(spark, pre_small, [])).count() == 0
    assert eda.er_density(_rates(spark, pre_small, [None])).count() == 0
