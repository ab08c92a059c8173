"""Registered queries: each callable takes (spark, sf_dir) and returns a DataFrame.

Every query starts from the posts table Spark derives from ``events`` and runs
over all of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.functions.columns import broadcast_groups, ntz_text
from postlytics.functions.ranking import group_quantiles
from postlytics.operators import eda, filters, linear, ml, stats
from postlytics.plans import reports
from postlytics.sources import csv_export, sinks
from postlytics.sources.exports import export_from_tables, materialized_posts, mixed_exports_from_tables, table_version
from postlytics.operators.features import (
    ER, TOTAL, Prepared, denominator_choice, hour_label, meta_summary, preprocess,
)

Query = Callable[[SparkSession, str], DataFrame]


def prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    """Preprocessed posts; the derivation from ``events`` is materialised once per session."""
    return preprocess(materialized_posts(spark, sf_dir))


def _on_pre(fn: Callable[[Prepared], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepared(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def _pick_denominator(pre: Prepared) -> DataFrame:
    return denominator_choice(pre.df, pre.roles)


def _quantiles(pre: Prepared, method: str) -> DataFrame:
    """Deciles of the rate per type, by one way of finding exact quantiles."""
    q = group_quantiles(pre.df, pre.roles.type, ER, [0.1, 0.5, 0.9], method=method)
    return q.select(pre.roles.type, *[F.round(F.col("q")[i], 9).alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


EDA_QUERIES: dict[str, Query] = {
    "er_by_weekday": _on_pre(eda.er_by_weekday),
    "meta_summary": _on_pre(meta_summary),
    "preprocess": _on_pre(lambda p: p.df),
    "engagement_rate": _on_pre(lambda p: p.df.select("post_id", TOTAL, ER)),
    "kpi_rates": _on_pre(lambda p: p.df.select(
        "post_id", "save_rate_pct", "share_rate_pct", "comments_per_like",
        "like_rate_on_views_pct", "profile_to_follow_conversion_pct")),
    "total_engagements": _on_pre(lambda p: p.df.select("post_id", TOTAL)),
    "calendar_features": _on_pre(lambda p: p.df.select("post_id", "weekday", "hour", "month", "is_weekend")),
    "hour_label": _on_pre(lambda p: p.df.select("post_id", hour_label(F.col("hour")).alias("hour_label"))),
    "pick_denominator": _on_pre(_pick_denominator),
    "describe_numeric": _on_pre(eda.describe_numeric),
    "er_stats": _on_pre(eda.er_stats),
    "er_outlier_summary": _on_pre(eda.er_outlier_summary),
    "outlier_rows": _on_pre(eda.outlier_rows),
    "missing_values": _on_pre(eda.missing_values),
    "best_weekday": _on_pre(eda.best_weekday),
    "er_by_hour": _on_pre(eda.er_by_hour),
    "top_hours": _on_pre(eda.top_hours),
    "er_by_type": _on_pre(eda.er_by_type),
    "best_type": _on_pre(eda.best_type),
    "interaction_breakdown": _on_pre(eda.interaction_breakdown),
    "monthly_trend": _on_pre(eda.monthly_trend),
    "weekend_vs_weekday": _on_pre(eda.weekend_vs_weekday),
    "reach_er_correlation": _on_pre(eda.reach_er_correlation),
    "trend_line": _on_pre(eda.trend_line),
    "er_histogram": _on_pre(eda.er_histogram),
    "box_stats": _on_pre(eda.box_stats),
    "box_stats_by_type": _on_pre(lambda p: eda.box_stats(p, p.roles.type)),
    "box_stats_by_period": _on_pre(lambda p: eda.box_stats(replace(p, df=p.df.withColumn("period", filters.period())), "period")),
    "box_stats_by_duration": _on_pre(lambda p: eda.box_stats(
        replace(p, df=stats.with_terciles(stats.duration_rows(p), p.roles.duration)), "duration_group")),
    "quantiles_by_map": _on_pre(lambda p: _quantiles(p, "map")),
    "quantiles_by_rank": _on_pre(lambda p: _quantiles(p, "rank")),
    "quantiles_by_refining": _on_pre(lambda p: _quantiles(p, "refine")),
    "column_defaults": _on_pre(eda.column_defaults),
    "distinct_types": _on_pre(eda.distinct_types),
    "top_posts": _on_pre(eda.top_posts),
    "top5_posts": _on_pre(eda.top5_posts),
    "top_posts_library": _on_pre(eda.top_posts_library),
    "er_histogram_25": _on_pre(lambda p: eda.er_histogram(p, 25)),
    "benchmark_check": _on_pre(eda.benchmark_check),
    "benchmark_status": _on_pre(eda.benchmark_status),
    "benchmark_check_notebook": _on_pre(lambda p: eda.benchmark_check(p, 3.5)),
    "er_density": _on_pre(eda.er_density),
    "mean_ci": _on_pre(eda.mean_ci),
    "trend_line_ci": _on_pre(eda.trend_line_ci),
}


STATS_QUERIES: dict[str, Query] = {
    "anova_content_type": _on_pre(stats.anova_by),
    "anova_group_means": _on_pre(stats.anova_group_means),
    "welch_weekend": _on_pre(stats.weekend_test),
    "student_t": _on_pre(lambda p: stats.weekend_test(p, equal_var=True)),
    "levene": _on_pre(stats.levene_by),
    "p_values": _on_pre(stats.p_values),
    "duration_terciles": _on_pre(stats.duration_terciles),
    "duration_terciles_notebook": _on_pre(lambda p: stats.duration_terciles(p, 3.0, 180.0, lo_inclusive=True)),
    "shapiro_wilk": _on_pre(stats.shapiro_by),
    "duration_test": _on_pre(stats.duration_test),
    "duration_test_notebook": _on_pre(lambda p: stats.duration_test(p, lo=3.0, hi=180.0, lo_inclusive=True, t_test="pooled")),
    "test_summary": _on_pre(stats.test_summary),
}


MISC_QUERIES: dict[str, Query] = {
    "reel_filter": _on_pre(lambda p: filters.reel_filter(p).select("post_id", "post_type", "duration_sec", ER)),
    "duration_filter": _on_pre(lambda p: filters.duration_filter(p).select("post_id", "post_type",
                                                                           "duration_sec", ER)),
    "complete_cases": _on_pre(filters.complete_cases),
    "period_label": _on_pre(lambda p: p.df.select("post_id", filters.period().alias("period"))),
    "json_safe": _on_pre(lambda p: sinks.json_safe(p.df)),
    "preview": _on_pre(lambda p: sinks.preview(p.df, 5)),
    "overview": _on_pre(reports.overview),
    "eda_report": _on_pre(reports.eda_report),
}


EXPORT_COLUMNS = ["post_id", "publish_time", "post_type", "duration_sec", "reach", "impressions", "views",
                  "likes", "comments", "saves", "shares", "follows", "profile_visits"]


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_export.read_export(spark, export_from_tables(spark, sf_dir))


def _loaded_pre(spark: SparkSession, sf_dir: str) -> Prepared:
    return preprocess(csv_export.kept(_loaded(spark, sf_dir)))


def _text_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as text cells: missing-value words, dates in five layouts, numbers with units."""
    p = materialized_posts(spark, sf_dir)
    k = F.pmod("post_id", F.lit(5))
    iso = ntz_text("publish_time", "iso")
    date = (F.when(k == 0, F.concat(F.replace(iso, F.lit(" "), F.lit("T")), F.lit("Z"))).when(k == 1, F.concat(iso, F.lit(".000")))
            .when(k == 2, F.concat(F.lit("\t"), iso)).when(k == 3, F.concat(iso, F.lit("+00:00"))).otherwise(ntz_text("publish_time", "dmy")))
    views = F.when(k == 0, F.format_number("views", 0)).when(k == 1, F.concat(F.lit("$"), F.col("views").cast("string"))) \
        .when((k == 2) & (F.col("views") % 100 == 0), F.concat(F.format_string("%.1f", F.col("views") / F.lit(1000.0)), F.lit("k"))) \
        .otherwise(F.concat(F.lit(" "), F.col("views").cast("string"), F.lit("\u00a0")))
    words = F.element_at(F.array(*[F.lit(w) for w in csv_export.NA_TOKENS]),
                         (F.pmod("post_id", F.lit(len(csv_export.NA_TOKENS))) + 1).cast("int"))
    gap = F.pmod("post_id", F.lit(7)) == 0
    return p.select("post_id", date.alias("publish_time"), views.alias("views"),
                    F.when(gap, words).otherwise(F.col("post_type")).alias("post_type"),
                    F.when(~gap, F.col("likes").cast("string")).alias("likes"))


LOADER_QUERIES: dict[str, Query] = {
    "read_export_messy": lambda s, d: csv_export.read_export(s, mixed_exports_from_tables(s, d), glob="part-*").select(*EXPORT_COLUMNS, "caption"),
    "smart_numeric": lambda s, d: csv_export.smart_numeric(_text_posts(s, d).select("post_id", "views")),
    "parse_dates": lambda s, d: csv_export.parse_dates(_text_posts(s, d).select("post_id", "publish_time")),
    "null_tokens": lambda s, d: csv_export.null_tokens(_text_posts(s, d), ["post_type"]).select("post_id", "post_type"),
    "drop_empty_rows": lambda s, d: csv_export.drop_empty_rows(_text_posts(s, d).select(F.col("post_id").alias("_row_id"), "likes")),
    "read_export": lambda s, d: _loaded(s, d).select(*EXPORT_COLUMNS),
    "read_export_er_by_type": lambda s, d: eda.er_by_type(_loaded_pre(s, d)),
    "read_export_monthly_trend": lambda s, d: eda.monthly_trend(_loaded_pre(s, d)),
}


#: Fits of this session, by version of the table they come from: later queries reuse them.
_MODELS: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: tuple, make: Callable[[], object]):
    key = (*table_version(spark, sf_dir), *what)
    if key not in _MODELS:
        while len(_MODELS) >= 24:  # the oldest go: a long session over many tables keeps a bounded number
            _MODELS.pop(next(iter(_MODELS)))
        _MODELS[key] = make()
    return _MODELS[key]


def trained(spark: SparkSession, sf_dir: str, name: str, variant: str = "api") -> ml.Trained:
    return _once(spark, sf_dir, (name, variant), lambda: ml.train_model(prepared(spark, sf_dir), name, variant))


def _metrics(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = trained(spark, sf_dir, name)
        return ml.evaluate(t.model.transform(t.test)).select(F.lit(name).alias("model"), "*")
    return run


def _zoo(spark: SparkSession, sf_dir: str) -> ml.Zoo:
    """All four models on the test split and on the five folds."""
    return _once(spark, sf_dir, ("zoo",), lambda: ml.fit_zoo(prepared(spark, sf_dir), ml.MODEL_ORDER))


def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13 as the API reports it: test metrics and 5-fold CV for each model."""
    return ml.compare_models(prepared(spark, sf_dir), zoo=_zoo(spark, sf_dir))


def _best(spark: SparkSession, sf_dir: str) -> ml.Trained:
    """The model of the highest test R^2 (each fitted on the training split only)."""
    def make() -> ml.Trained:
        zoo = ml.fit_zoo(prepared(spark, sf_dir), ml.MODEL_ORDER, k=0)
        return zoo.trained[ml.best_model(zoo, ml.MODEL_ORDER)]

    return _once(spark, sf_dir, ("best",), make)


def _planned(pre: Prepared) -> DataFrame:
    """Planned posts derived from the whole table: some fields left blank."""
    fs = ml.select_features(pre, "api")
    rows = ml.model_rows(pre, fs)
    k = F.col("row_key").cast("long")
    blanks = {c: F.when(k % 3 == 0, F.lit(None)).otherwise(F.col(c)) for c in fs.numeric[:2]}
    blanks[pre.roles.type] = F.when(k % 4 == 0, F.lit(None)).otherwise(F.col(pre.roles.type))
    blanks["weekday"] = F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("weekday"))
    blanks["hour"] = F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("hour").cast("int"))
    return rows.select("row_key", *fs.all).withColumns(blanks)


def _predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    pre = prepared(spark, sf_dir)
    scored = _once(spark, sf_dir, ("predict",), lambda: ml.predict_posts(pre, _planned(pre)))
    return scored.select("row_key", "predicted_er")


def _labelled(spark: SparkSession, sf_dir: str, style: str) -> DataFrame:
    """M17 / M18 on a fixed prediction column: a tenth of the views in hundreds, so every label occurs."""
    pre = prepared(spark, sf_dir)
    fs = ml.select_features(pre, "api")
    scored = ml.model_rows(pre, fs).select("row_key", (F.col("views") % 400 / F.lit(10.0)).alias("predicted_er"))
    return ml.prediction_label(pre, scored, style=style)


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[ml.FeatureSet, DataFrame]:
    """All model rows through the feature stages fitted on the training split."""
    def make():
        fs, rows, train, _test = ml.prepare_model_data(prepared(spark, sf_dir))
        return fs, ml.fit_encoder(fs, train, train.count()).transform(rows)

    return _once(spark, sf_dir, ("encoded",), make)


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: the scaled numbers of every model row."""
    from pyspark.ml.functions import vector_to_array

    fs, rows = _encoded(spark, sf_dir)
    v = vector_to_array("__num")
    return rows.select("row_key", *[F.round(v[i], 6).alias(f"scaled_{c}") for i, c in enumerate(fs.numeric)])


def _one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the one-hot digits of every model row, one string a category."""
    from pyspark.ml.functions import vector_to_array

    fs, rows = _encoded(spark, sf_dir)
    return rows.select("row_key", *[F.array_join(F.transform(vector_to_array(f"__ohe_{c}"), lambda x: x.cast("int").cast("string")), "")
                                    .alias(f"one_hot_{c}") for c in fs.categorical])


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best model of the comparison (with its 5-fold CV) and the top driver."""
    zoo = _zoo(spark, sf_dir)
    return ml.ml_summary(_compare(spark, sf_dir), ml.feature_importance(zoo.trained["Gradient Boosting"]), zoo.rows)


def _type_mean_predictor(pre: Prepared) -> DataFrame:
    t = pre.roles.type
    means = broadcast_groups(pre.df.groupBy(t).agg(F.avg(ER).alias("prediction")))
    return pre.df.where(F.col(ER).isNotNull()).join(means, t).select(F.col(ER).alias("label"), "prediction")


ML_QUERIES: dict[str, Query] = {
    "model_rows": _on_pre(lambda p: ml.model_rows(p, ml.select_features(p, "api"))
                          .select(F.col("row_key"), "bucket", "fold")),
    "split": _on_pre(lambda p: ml.model_rows(p, ml.select_features(p, "api"))
                     .groupBy(F.when(F.col("bucket") < 20, "test").otherwise("train").alias("part"))
                     .agg(F.count(F.lit(1)).alias("rows"))),
    "evaluate": _on_pre(lambda p: ml.evaluate(_type_mean_predictor(p))),
    "linear_model": _on_pre(lambda p: linear.metrics(p, "Linear Regression")),
    "ridge_model": _on_pre(lambda p: linear.metrics(p, "Ridge Regression")),
    "forest_model": _metrics("Random Forest"),
    "boosted_model": _metrics("Gradient Boosting"),
    "cross_validate": _on_pre(lambda p: linear.cross_validate(p, "Linear Regression")),
    "cross_validate_ridge": _on_pre(lambda p: linear.cross_validate(p, "Ridge Regression")),
    "compare_models": _compare,
    "feature_importance": lambda s, d: ml.feature_importance(trained(s, d, "Gradient Boosting")),
    "feature_importance_forest": lambda s, d: ml.top_features(ml.feature_importance(trained(s, d, "Random Forest")), 10),
    "compare_models_library": _on_pre(lambda p: ml.compare_models(p, "library", with_cv=False)),
    "residual_summary": lambda s, d: ml.residual_summary(_best(s, d)),
    "actual_vs_predicted": lambda s, d: ml.actual_vs_predicted(_best(s, d)),
    "predict_posts": _predict,
    "prediction_label": lambda s, d: _labelled(s, d, "api"),
    "prediction_label_dashboard": lambda s, d: _labelled(s, d, "dashboard"),
    "scaled_features": _scaled,
    "one_hot": _one_hot,
    "ml_summary": lambda s, d: _summary(s, d),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(ML_QUERIES)
    out.update(LOADER_QUERIES)
    out.update(MISC_QUERIES)
    out.update(EDA_QUERIES)
    out.update(STATS_QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    from postlytics.plans.oracle import eda_sql, loader_sql, misc_sql, ml_sql, report_sql, shapiro_sql, stats_sql

    out = {}
    out.update(shapiro_sql())
    out.update(report_sql())
    out.update(ml_sql())
    out.update(loader_sql())
    out.update(misc_sql())
    out.update(eda_sql())
    out.update(stats_sql())
    return out
