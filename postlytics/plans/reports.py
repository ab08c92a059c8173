"""Report tables composed from operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.functions.columns import ntz_text
from postlytics.operators import eda
from postlytics.operators.features import ER, Prepared, meta_summary
from postlytics.session import cut_lineage


def overview(pre: Prepared) -> DataFrame:
    """Posts, date range, mean rate, best day (+ its mean), best hour, best type, max rate.

    One-row aggregates joined by cross join; each side is a single row.
    """
    m = meta_summary(pre).select("total_rows", "date_range_start", "date_range_end",
                                 F.col("avg_engagement_rate").alias("avg_er"),
                                 F.col("max_engagement_rate").alias("max_er"))
    day = eda.best_weekday(pre, digits=1).select(F.col("best_weekday").alias("best_day"),
                                                 F.col("avg_er").alias("best_day_er"))
    hour = eda.top_hours(pre, 1).select(F.col("hour").alias("best_hour"))
    typ = eda.best_type(pre).select("best_type")
    # each side is one row (or none): keep the overview row regardless
    day = day.agg(F.first("best_day").alias("best_day"), F.first("best_day_er").alias("best_day_er"))
    hour = hour.agg(F.first("best_hour").alias("best_hour"))
    typ = typ.agg(F.first("best_type").alias("best_type"))
    return m.crossJoin(day).crossJoin(hour).crossJoin(typ)


def eda_report(pre: Prepared) -> DataFrame:
    """The API's EDA answer as one long table (section, key, value, text)."""
    def rows(df: DataFrame, section: str, key: str, value: str | None, text: str | None) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"),
            (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
            (F.col(value).cast("double") if value else F.lit(None).cast("double")).alias("value"),
            (F.col(text).cast("string") if text else F.lit(None).cast("string")).alias("text"),
        )

    r = pre.roles
    st = eda.er_stats(pre)
    types = eda.er_by_type(pre).withColumn("k", F.col(r.type))
    top = cut_lineage(eda.top_posts(pre))  # ten rows, read five times
    st_long = st.unpivot([], st.columns, "k", "v")
    parts = [
        rows(meta_summary(pre).select(F.col("total_rows").alias("v"), F.lit("total_posts").alias("k")),
             "summary", "k", "v", None),
        rows(meta_summary(pre).select(F.lit("start").alias("k"), F.col("date_range_start").alias("t")),
             "date_range", "k", None, "t"),
        rows(meta_summary(pre).select(F.lit("end").alias("k"), F.col("date_range_end").alias("t")),
             "date_range", "k", None, "t"),
        rows(st_long, "engagement_rate", "k", "v", None),
        rows(eda.er_by_weekday(pre), "day_averages", "weekday", "avg_er", None),
        rows(eda.best_weekday(pre).withColumn("k", F.lit("best_day")), "best_day", "k", "avg_er", "best_weekday"),
        rows(eda.top_hours(pre), "top3_hours", "rank", "hour", None),
        rows(types, "content_type_avg", "k", "avg_er", None),
        rows(types, "content_type_median", "k", "median_er", None),
        rows(types, "content_type_posts", "k", "posts", None),
        rows(eda.best_type(pre).withColumn("k", F.lit("best_type")), "best_content_type", "k", "avg_er", "best_type"),
        rows(eda.interaction_breakdown(pre), "engagement_breakdown", "interaction", "total", None),
        rows(eda.monthly_trend(pre), "monthly_trend", "month_end", "avg_er", None),
        rows(top, "top10_posts", "rank", ER, None),
        rows(top.withColumn("d", ntz_text(r.date, "date")), "top10_dates", "rank", None, "d"),
        rows(top, "top10_types", "rank", None, r.type),
        rows(top, "top10_likes", "rank", r.likes, None),
        rows(top, "top10_saves", "rank", r.saves, None),
        rows(eda.benchmark_check(pre).withColumn("k", F.lit("beats_benchmark")), "benchmark", "k",
             "benchmark", "beats_benchmark"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
