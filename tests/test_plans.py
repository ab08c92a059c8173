"""Physical-plan guards: the properties the scale design relies on."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from postlytics.functions.ranking import range_ordered
from postlytics.operators import eda, stats
from postlytics.sources.fixtures import posts_from_events


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_scan_is_pruned(spark):
    p = plan(posts_from_events(spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p
    assert "props" not in p.split("ReadSchema")[1].split(">")[0]
    assert "partial_sum" in p and "partial_count" in p  # map-side pre-aggregation before the shuffle


def test_group_bys_aggregate_map_side(pre_small):
    for df in (eda.er_by_weekday(pre_small), eda.er_by_type(pre_small), stats.anova_group_means(pre_small)):
        assert "partial_avg" in plan(df)


def test_one_row_sides_are_broadcast_not_cartesian(pre_small):
    for df in (eda.outlier_rows(pre_small), eda.er_histogram(pre_small), eda.er_outlier_summary(pre_small)):
        p = plan(df)
        assert "CartesianProduct" not in p
        assert "BroadcastNestedLoopJoin" in p or "BroadcastExchange" in p


def test_ranks_use_range_partitioning(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").cast("double").alias("x"))
    p = plan(range_ordered(df, "g", "x", 4))
    assert "rangepartitioning" in p
    assert "Window" not in p


def test_raw_rows_are_not_shuffled_on_a_group(spark, pre_small):
    """With Spark's own broadcast out of reach, per-group tables still go to the rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (eda.box_stats(pre_small, "post_type"), eda.box_stats(pre_small), stats.levene_by(pre_small)):
            p = plan(df)
            assert ("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p) and "SortMergeJoin" not in p
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bootstrap_adds_posts_to_accumulators(pre_small):
    """No row per post and replicate: the only Generate lies above the merged accumulators."""
    p = plan(eda.mean_ci(pre_small))
    assert p.count("Generate explode") == 1
    assert p.index("Generate explode") < p.index("ObjectHashAggregate") or p.index("Generate explode") < p.rindex("Exchange")
    assert "Generate" not in p[p.rindex("Exchange hashpartitioning"):]


def test_density_is_taken_from_cells(pre_small):
    """Rows meet one statistics row and an aggregate, never the grid."""
    p = plan(eda.er_density(pre_small))
    assert "CartesianProduct" not in p
    assert "Range (0, 200" not in p
