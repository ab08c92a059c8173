"""Operators that no other test reaches: reports of roles and types, text metrics, tests that can't be run."""

from dataclasses import replace

from pyspark.sql import functions as F

from postlytics.operators import eda, stats
from postlytics.operators.features import preprocess
from postlytics.operators.roles import Roles, clean_name, role_report


def test_role_report(spark, pre_small):
    rows = {r["role"]: r["column"] for r in role_report(spark, pre_small.roles).collect()}
    assert rows["reach"] == pre_small.roles.reach and rows["type"] == "post_type"
    assert {r["column"] for r in role_report(spark, Roles()).collect()} == {None}


def test_column_types(spark, pre_small):
    rows = [tuple(r) for r in eda.column_types(pre_small).collect()]
    assert rows == pre_small.df.dtypes and ("engagement_rate_pct", "double") in rows


def test_text_metrics_become_numbers(spark):
    """Metric columns of a frame that the loader didn't make: separators and signs go, k and m aren't units here."""
    rows = [("1", "1,200", " 10 ", "5", "$3"), ("2", "", "1k", None, "2%"), ("3", "900", "abc", "-4", "1.5")]
    df = spark.createDataFrame(rows, "post_id string, reach string, likes string, comments string, saves string")
    pre = preprocess(df)
    got = {r["post_id"]: (r["reach"], r["likes"], r["comments"], r["saves"], r["total_engagements"]) for r in pre.df.collect()}
    assert got == {"1": (1200.0, 10.0, 5.0, 3.0, 18.0), "2": (None, None, None, 2.0, 2.0), "3": (900.0, None, -4.0, 1.5, 1.5)}


def test_clean_name():
    assert [clean_name(x) for x in (" Post  ID ", "__Reach (total)__", "Duración_s", "%", "a--b__c")] == [
        "post_id", "reach_total", "duración_s", "", "a_b_c"]


def test_summary_shows_tests_that_cannot_be_run(spark, pre_small):
    few = replace(pre_small, df=pre_small.df.where("post_type = 'Image'").limit(4))
    rows = {r["test_name"]: r for r in stats.test_summary(few).collect()}
    assert set(rows) == {"content_type", "weekend", "reel_duration"}
    for name in ("content_type", "reel_duration"):
        assert rows[name]["decision"] == "not run" and rows[name]["statistic"] is None and rows[name]["interpretation"]


def test_duration_test_without_its_columns_gives_its_error_row(spark, pre_small):
    bare = replace(pre_small, df=pre_small.df.drop("duration_sec"), roles=replace(pre_small.roles, duration=None))
    row = stats.duration_test(bare).first()
    assert "duration" in row["error"] and row["p_value"] is None and row["total_reels_analyzed"] == 0
    assert stats.duration_test(bare).columns == stats.duration_test(pre_small).columns
    whole = {r["test_name"]: r["decision"] for r in stats.test_summary(bare).collect()}
    assert whole["reel_duration"] == "not run" and whole["content_type"] != "not run"


def test_describe_scans_without_exploding(spark, pre_small):
    plan = eda.describe_numeric(pre_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("Generate") <= 1


def test_band_of_a_far_away_line(spark, pre_small):
    """Values far from 0: the residual sum must not cancel."""
    df = spark.range(2000).select((F.col("id") * 1.0).alias("reach"), (F.lit(1e8) + F.col("id") * 2 + (F.col("id") % 2)).alias("engagement_rate_pct"))
    r = eda.trend_line_ci(replace(pre_small, df=df), "reach").where("point = 50").first()
    assert 0.01 < r["ci_high"] - r["fit"] < 0.05
