"""Engagement-rate models (M*) on Spark ML.

Feature pipeline = ``StringIndexer`` + ``OneHotEncoder`` for categories
(first level dropped, unknown levels -> all zeros, as the reference's
``OneHotEncoder(drop="first", handle_unknown="ignore")``) and
``StandardScaler`` for numbers with the population standard deviation.  The
train/test split and the CV folds come from an md5 hash of (seed, row key), so
they repeat under any partitioning and DuckDB can recompute them.

Caution (kept from the reference): the rate is a formula of several of the
features, so a high R^2 is target leakage, not insight.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    ElementwiseProduct,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.functions.columns import rint_round
from postlytics.operators.features import ER, Prepared
from postlytics.operators.trees import Binned, TreeRegressor

SEED = 42
LABEL = "label"

# Model names and defaults of the reference's model zoo.
MODEL_ORDER = ["Linear Regression", "Ridge Regression", "Random Forest", "Gradient Boosting"]
MIN_ROWS = {"library": 50, "api": 30, "notebook": 30, "predict": 20}
TEST_SIZE = {"library": 0.25, "api": 0.2, "notebook": 0.2}


@dataclass(frozen=True)
class FeatureSet:
    numeric: list[str]
    categorical: list[str]

    @property
    def all(self) -> list[str]:
        return self.numeric + self.categorical


def select_features(pre: Prepared, variant: str = "api") -> FeatureSet:
    """M1: API/dashboard 7 numbers without impressions; library/notebook with it.

    Categories: type, weekday, hour; the notebook adds month.
    """
    r = pre.roles
    keys = ["reach", "views", "likes", "comments", "saves", "shares", "follows"]
    if variant in ("library", "notebook"):
        keys = ["reach", "impressions", "views", "likes", "comments", "saves", "shares", "follows"]
    numeric = []
    for k in keys:
        c = getattr(r, k)
        if c and c in pre.df.columns and c not in numeric:
            numeric.append(c)
    cats = [c for c in (r.type, "weekday", "hour") if c and c in pre.df.columns]
    if variant == "notebook" and "month" in pre.df.columns:
        cats.append("month")
    return FeatureSet(numeric, cats)


def row_key(pre: Prepared) -> Column:
    cols = pre.df.columns
    if "_row_id" in cols:
        return F.col("_row_id").cast("string")
    if "post_id" in cols:
        return F.col("post_id").cast("string")
    return F.monotonically_increasing_id().cast("string")


def hash_bucket(key: Column, seed: int = SEED, buckets: int = 100) -> Column:
    """Deterministic bucket 0..buckets-1 from md5(seed|key)."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), key))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.lit(buckets)).cast("int")


def model_rows(pre: Prepared, fs: FeatureSet, seed: int = SEED) -> DataFrame:
    """M2: complete cases of features + label, with the split bucket and fold."""
    cols = fs.all + [ER]
    base = pre.df.select(*[F.col(c) for c in cols], row_key(pre).alias("row_key"))
    base = base.dropna(how="any", subset=cols)
    conv = {c: F.col(c).cast("double") for c in fs.numeric}
    conv.update({c: F.lpad(F.col(c).cast("string"), 2, "0") if c == "hour" else F.col(c).cast("string")
                 for c in fs.categorical})
    # a row without a key goes by its values, so that it is in a part as well
    key = F.coalesce(F.col("row_key"), F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols])))
    b = hash_bucket(key, seed)
    return base.withColumns(conv).withColumn(LABEL, F.col(ER)).withColumn("bucket", b) \
        .withColumn("fold", F.col("bucket") % 5)


def check_rows(rows: DataFrame, minimum: int) -> int:
    n = rows.count()
    if n < minimum:
        raise ValueError(f"Only {n} complete rows: need >= {minimum}.")
    return n


def split(rows: DataFrame, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """M3: bucket < 100 * test_size -> test."""
    cut = int(round(test_size * 100))
    return rows.where(F.col("bucket") >= cut), rows.where(F.col("bucket") < cut)


def fit_encoder(fs: FeatureSet, train: DataFrame, n_train: int) -> PipelineModel:
    """M4-M6: scaler with population std, one-hot without the first level.

    ``StringIndexer(alphabetDesc, keep)`` puts the alphabetically first level
    last (index n-1) and unknown levels at n; clamping to n-1 and
    ``OneHotEncoder(dropLast=True)`` then drops the first level and maps
    unknown levels to all zeros.
    """
    stages = []
    if fs.numeric:
        fac = math.sqrt(n_train / (n_train - 1)) if n_train > 1 else 1.0
        stages += [
            VectorAssembler(inputCols=fs.numeric, outputCol="__num_raw"),
            StandardScaler(inputCol="__num_raw", outputCol="__num_s", withMean=True, withStd=True),
            ElementwiseProduct(inputCol="__num_s", outputCol="__num",
                               scalingVec=Vectors.dense([fac] * len(fs.numeric))),
        ]
    cats = fs.categorical
    if cats:
        indexer = StringIndexer(inputCols=cats, outputCols=[f"__idx_{c}" for c in cats],
                                stringOrderType="alphabetDesc", handleInvalid="keep").fit(train)
        clamp = ", ".join(f"least(`__idx_{c}`, {len(lv) - 1}D) AS `__cidx_{c}`"
                          for c, lv in zip(cats, indexer.labelsArray))
        stages += [
            indexer,
            SQLTransformer(statement=f"SELECT *, {clamp} FROM __THIS__"),
            OneHotEncoder(inputCols=[f"__cidx_{c}" for c in cats], outputCols=[f"__ohe_{c}" for c in cats],
                          dropLast=True),
        ]
    parts = (["__num"] if fs.numeric else []) + [f"__ohe_{c}" for c in cats]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages).fit(train)


#: Rows of encoded training data a partition holds.  Tree models sample by
#: partition, so the layout is part of the model: it follows from the rows
#: alone (hash of the row key, sorted), never from the number of cores.
ROWS_PER_PARTITION = 5_000
#: Beyond this many partitions they grow instead, so that a round of a boosted model stays a bounded number of tasks.
MOST_PARTITIONS = 1_024


@dataclass
class Encoded:
    """One training split, encoded once: only features and label, cached until ``release``, and binned once for its tree models."""

    encoder: PipelineModel
    train: DataFrame
    n: int
    label_std: float
    binned: Binned | None = None

    def bins(self) -> Binned:
        self.binned = self.binned or Binned(self.train, LABEL, SEED)
        return self.binned

    def release(self) -> None:
        self.train.unpersist()
        if self.binned:
            self.binned.release()


def encode_split(fs: FeatureSet, train: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> Encoded:
    st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(LABEL).alias("sy")).first()
    enc = fit_encoder(fs, train, st["n"])
    data = (enc.transform(train).select("features", LABEL, "row_key")
            .repartition(min(MOST_PARTITIONS, max(1, math.ceil(st["n"] / rows_per_partition))), "row_key").sortWithinPartitions("row_key")
            .select("features", LABEL).persist(StorageLevel.MEMORY_AND_DISK))
    return Encoded(enc, data, st["n"], st["sy"] or 0.0)


def tree_memory_mb(spark: SparkSession, share: float = 0.25, least: int = 64, most: int = 1024) -> int:
    """Memory a task may use for the histograms of the tree nodes it grows in one pass over the data.

    A quarter of the heap by the tasks that run in it side by side; the rest is for cached rows and shuffles.
    """
    conf = spark.sparkContext.getConf()
    master = spark.sparkContext.master
    if re.fullmatch(r"local(\[[^]]*\])?", master):
        heap = spark._jvm.java.lang.Runtime.getRuntime().maxMemory() / 2**20
        slots = spark.sparkContext.defaultParallelism
    else:
        heap = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsMb(conf.get("spark.executor.memory", "1g"))
        cluster = re.fullmatch(r"local-cluster\[\d+,(\d+),\d+\]", master.replace(" ", ""))
        cores = int(cluster[1]) if cluster else int(conf.get("spark.executor.cores", "0")) or 8  # standalone gives all cores of a machine
        slots = cores // int(conf.get("spark.task.cpus", "1"))
    return int(max(least, min(most, heap * share / max(1, slots))))


def make_model(name: str, variant: str = "api", gbt_subsample: float = 0.8, memory_mb: int = 256):
    """M7-M10 with the reference's hyper-parameters."""
    if name == "Linear Regression":
        return LinearRegression(featuresCol="features", labelCol=LABEL, regParam=0.0, solver="normal")
    if name == "Ridge Regression":
        return LinearRegression(featuresCol="features", labelCol=LABEL, elasticNetParam=0.0,
                                standardization=False, solver="normal")  # regParam set per fit (M8)
    if name == "Random Forest":
        trees, depth, leaf = (500, 12, 2) if variant == "library" else (400, 10, 3)
        return TreeRegressor(LABEL, trees=trees, depth=depth, least=leaf, seed=SEED)
    if name == "Gradient Boosting":
        return TreeRegressor(LABEL, rounds=300, depth=5, step=0.05, share=gbt_subsample, seed=SEED)
    raise ValueError(name)


def fit_model(name: str, data: Encoded, variant: str = "api", alpha: float = 1.0,
              gbt_subsample: float = 0.8) -> PipelineModel:
    """The bare estimator on an encoded split; the result takes raw rows."""
    spark = data.train.sparkSession
    model = make_model(name, variant, gbt_subsample, tree_memory_mb(spark))
    if name == "Ridge Regression":
        # sklearn's alpha on the unscaled squared loss == Spark's regParam * n / std(y)
        model.setRegParam(alpha * data.label_std / data.n if data.n else 0.0)
    fitted = model.fit_all([data.bins()])[0] if isinstance(model, TreeRegressor) else model.fit(data.train)
    return PipelineModel(data.encoder.stages + [fitted])


def fit_together(name: str, data: list[Encoded], variant: str = "api", gbt_subsample: float = 0.8) -> list[PipelineModel]:
    """A tree model on each of several encoded splits, in shared jobs."""
    models = make_model(name, variant, gbt_subsample).fit_all([d.bins() for d in data])
    return [PipelineModel(d.encoder.stages + [m]) for d, m in zip(data, models)]


def _fit(name: str, fs: FeatureSet, train: DataFrame, variant: str, gbt_subsample: float = 0.8) -> PipelineModel:
    data = encode_split(fs, train)
    try:
        return fit_model(name, data, variant, gbt_subsample=gbt_subsample)
    finally:
        data.release()


def evaluate(pred: DataFrame, digits: int = 4, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """R^2, MAE, RMSE in one aggregate."""
    y, p = F.col(label), F.col(prediction)
    agg = pred.agg(F.sum(F.pow(y - p, 2)).alias("sse"), F.avg(F.abs(y - p)).alias("mae"),
                   F.avg(F.pow(y - p, 2)).alias("mse"), F.var_pop(y).alias("vy"), F.count(y).alias("n"))
    r2 = F.lit(1.0) - F.col("sse") / (F.col("vy") * F.col("n"))
    return agg.select(rint_round(r2, digits).alias("r2"), rint_round(F.col("mae"), digits).alias("mae"),
                      rint_round(F.sqrt(F.col("mse")), digits).alias("rmse"))


@dataclass
class Trained:
    name: str
    model: PipelineModel
    fs: FeatureSet
    test: DataFrame


def prepare_model_data(pre: Prepared, variant: str = "api", test_size: float | None = None, seed: int = SEED):
    test_size = test_size if test_size is not None else TEST_SIZE.get(variant, 0.2)
    fs = select_features(pre, variant)
    rows = model_rows(pre, fs, seed)
    check_rows(rows, MIN_ROWS.get(variant, 30))
    train, test = split(rows, test_size)
    return fs, rows, train, test


def train_model(pre: Prepared, name: str, variant: str = "api", test_size: float | None = None) -> Trained:
    fs, _rows, train, test = prepare_model_data(pre, variant, test_size)
    return Trained(name, _fit(name, fs, train, variant), fs, test)


#: Splits of a comparison whose encoded rows are cached side by side.
SPLITS_CACHED = 3


@dataclass
class Zoo:
    """Metrics of every fit, (model, fold or None for the test split) -> (r2, mae, rmse), and the test-split models."""

    scores: dict[tuple[str, int | None], tuple[float, float, float]]
    trained: dict[str, Trained]
    rows: int


def fit_zoo(pre: Prepared, names: list[str], variant: str = "api", k: int = 5, with_test: bool = True,
            parallelism: int = 6) -> Zoo:
    """Fits every model on the training split and (``k`` > 0) on every fold's complement.

    Each split is encoded once; its linear models come first, then it is binned for its tree models and its encoded rows
    are given up, so only a few splits are cached at a time.  Boosted models of all splits share their jobs, which
    run beside those of the forests.  Only metrics and trees come to the driver.
    """
    from concurrent.futures import ThreadPoolExecutor

    fs, rows, train, test = prepare_model_data(pre, variant)
    splits = ([(None, train, test)] if with_test else []) + [(f, rows.where(F.col("fold") != f), rows.where(F.col("fold") == f))
                                                            for f in range(k)]
    grown = {n: m for n in names if isinstance(m := make_model(n, variant), TreeRegressor)}
    kept: list[tuple[Encoded, DataFrame]] = []

    def prepare(split):
        fold, own, rest = split
        data = encode_split(fs, own)
        held = data.encoder.transform(rest).select("features", LABEL).persist(StorageLevel.MEMORY_AND_DISK)
        kept.append((data, held))
        scored = [score((n, fold, held, fit_model(n, data, variant))) for n in names if n not in grown]
        if grown:
            data.bins().load(list(grown.values()))
            data.train.unpersist()
        return fold, data, held, scored

    def score(fit):
        name, fold, held, model = fit
        r = evaluate(model.stages[-1].transform(held), digits=12).first()
        return name, fold, (r["r2"], r["mae"], r["rmse"]), model

    rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(splits), SPLITS_CACHED))) as few:
            ready = list(few.map(prepare, splits))
        done = [s for *_, scored in ready for s in scored]
        n_rows = rows.count()
        rows.unpersist()
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(splits))) + 1) as pool:
            fits = []
            for name in sorted(grown, key=lambda n: not grown[n].rounds):  # a boosted model is one long task a split: it begins first
                if grown[name].rounds:
                    fits.append((name, [pool.submit(fit_together, name, [data for _, data, _, _ in ready], variant)]))
                else:
                    fits.append((name, [pool.submit(fit_model, name, data, variant) for _, data, _, _ in ready]))
            for name, jobs in fits:
                models = jobs[0].result() if grown[name].rounds else [j.result() for j in jobs]
                done += pool.map(score, [(name, fold, held, m) for (fold, _, held, _), m in zip(ready, models)])
    finally:
        rows.unpersist()
        for data, held in kept:
            held.unpersist()
            data.release()
    trained = {n: Trained(n, m, fs, test) for n, fold, _, m in done if fold is None}
    return Zoo({(n, fold): s for n, fold, s, _ in done}, trained, n_rows)


def _cv_row(zoo: Zoo, name: str, k: int) -> tuple[float, float]:
    r2 = [zoo.scores[name, f][0] for f in range(k)]
    mean = sum(r2) / k
    return mean, math.sqrt(sum((x - mean) ** 2 for x in r2) / k)


def cross_validate(pre: Prepared, name: str, variant: str = "api", k: int = 5) -> DataFrame:
    """K-fold R^2 over all complete rows: mean and population std."""
    zoo = fit_zoo(pre, [name], variant, k, with_test=False)
    df = pre.df.sparkSession.createDataFrame([(name, *_cv_row(zoo, name, k))], "model string, m double, s double")
    return df.select("model", rint_round(F.col("m"), 4).alias("cv_r2_mean"), rint_round(F.col("s"), 4).alias("cv_r2_std"))


def compare_models(pre: Prepared, variant: str = "api", names: list[str] | None = None,
                   with_cv: bool = True, zoo: Zoo | None = None, k: int = 5) -> DataFrame:
    """One row per model with test metrics (and CV); ``is_best`` = highest R^2."""
    names = names or (["Linear Regression", "Random Forest"] if variant == "library" else MODEL_ORDER)
    zoo = zoo or fit_zoo(pre, names, variant, k if with_cv else 0)
    digits = 3 if variant == "library" else 4
    best = best_model(zoo, names, digits)
    rows = [(n, *(float(x) for x in zoo.scores[n, None]), i, *(_cv_row(zoo, n, k) if with_cv else (None, None)), n == best)
            for i, n in enumerate(names)]
    df = pre.df.sparkSession.createDataFrame(rows, "model string, r2 double, mae double, rmse double, model_order int, "
                                                   "cv_r2_mean double, cv_r2_std double, is_best boolean")
    rounded = [rint_round(F.col(c), digits).alias(c) for c in ("r2", "mae", "rmse")]
    cv = [rint_round(F.col(c), 4).alias(c) for c in ("cv_r2_mean", "cv_r2_std")] if with_cv else []
    return df.select("model", *rounded, "model_order", *cv, "is_best")


def best_model(zoo: Zoo, names: list[str], digits: int = 4) -> str:
    """Highest test R^2 as reported (rounded); the earlier model wins a tie."""
    return min(names, key=lambda n: (-round(zoo.scores[n, None][0], digits), names.index(n)))


def feature_importance(t: Trained, digits: int = 4) -> DataFrame:
    """Importances named by feature and category level, largest first."""
    spark = t.test.sparkSession
    names = list(t.fs.numeric)
    for stage in t.model.stages:
        if hasattr(stage, "labelsArray"):
            # alphabetDesc: vector slot i <-> labels[i]; the last (first alphabetical) level is dropped
            for c, labels in zip(t.fs.categorical, stage.labelsArray):
                for lv in list(labels)[:-1]:
                    shown = str(int(lv)) if c == "hour" else lv
                    names.append(f"{c}_{shown}")
    imp = t.model.stages[-1].featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.select("feature", rint_round(F.col("importance"), digits).alias("importance")) \
        .orderBy(F.desc("importance"), "feature")


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    """T4: the n most important features (10 / 12 / 5 / 3 in the reference's views)."""
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def actual_vs_predicted(t: Trained) -> DataFrame:
    """One row per held-out post: actual, predicted and the residual."""
    return t.model.transform(t.test).select("row_key", F.col(LABEL).alias("actual"), F.col("prediction").alias("predicted"),
                                            (F.col(LABEL) - F.col("prediction")).alias("residual"))


def residual_summary(t: Trained, pad: float = 0.5) -> DataFrame:
    """Residual mean / population std, largest over- and under-estimate, axis limits with a margin."""
    p = actual_vs_predicted(t)
    return p.agg(
        rint_round(F.avg("residual"), 4).alias("residual_mean"),
        rint_round(F.stddev_pop("residual"), 4).alias("residual_std"),
        rint_round(-F.min("residual"), 4).alias("max_overestimate"),
        rint_round(F.max("residual"), 4).alias("max_underestimate"),
        rint_round(F.least(F.min("actual"), F.min("predicted")) - pad, 4).alias("axis_min"),
        rint_round(F.greatest(F.max("actual"), F.max("predicted")) + pad, 4).alias("axis_max"),
        F.count(F.lit(1)).alias("n_test"),
    )


def fill_planned(pre: Prepared, planned: DataFrame, fs: FeatureSet,
                 default_weekday: str = "Tuesday", default_hour: int = 9) -> DataFrame:
    """M16 inputs: missing numbers -> column median, type -> mode, weekday/hour -> defaults."""
    from postlytics.operators.eda import column_defaults

    defaults = column_defaults(pre, fs.numeric, [c for c in fs.categorical if c not in ("weekday", "hour")])
    wide = defaults.agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"__d_{c}")
                          for c in fs.numeric],
                        *[F.max(F.when(F.col("feature") == c, F.col("mode"))).alias(f"__d_{c}")
                          for c in fs.categorical if c not in ("weekday", "hour")])
    j = planned.crossJoin(F.broadcast(wide))
    out = {}
    for c in fs.numeric:
        out[c] = F.coalesce(F.col(c).cast("double"), F.col(f"__d_{c}"))
    for c in fs.categorical:
        if c == "weekday":
            out[c] = F.coalesce(F.col(c), F.lit(default_weekday))
        elif c == "hour":
            out[c] = F.lpad(F.coalesce(F.col(c), F.lit(default_hour)).cast("string"), 2, "0")
        else:
            out[c] = F.coalesce(F.col(c).cast("string"), F.col(f"__d_{c}"))
    return j.withColumns(out).drop(*[c for c in j.columns if c.startswith("__d_")])


def predict_posts(pre: Prepared, planned: DataFrame, clip: bool = True, variant: str = "predict") -> DataFrame:
    """Train gradient boosting on all complete rows, score a table of planned posts."""
    fs = select_features(pre, "api")
    rows = model_rows(pre, fs)
    check_rows(rows, MIN_ROWS[variant])
    model = _fit("Gradient Boosting", fs, rows, "api", gbt_subsample=1.0)
    scored = model.transform(fill_planned(pre, planned, fs))
    p = F.greatest(F.col("prediction"), F.lit(0.0)) if clip else F.col("prediction")
    return scored.withColumn("predicted_er", p)


def prediction_label(pre: Prepared, scored: DataFrame, benchmark: float = 5.0, style: str = "api",
                     prediction: str = "predicted_er") -> DataFrame:
    """Labels and deltas of predictions against the account mean and the benchmark."""
    avg = pre.df.agg(F.avg(ER).alias("__avg"), F.max(ER).alias("__best"))
    j = scored.crossJoin(F.broadcast(avg))
    p = F.col(prediction)
    b = F.lit(float(benchmark))
    if style == "api":
        label = F.when(p >= F.col("__avg"), "Above the account's mean: worth promoting.") \
            .otherwise("Below the account's mean: try another type or time.")
    else:
        # The dashboard's three states.
        label = F.when(p >= F.col("__avg") * 1.1, "ABOVE YOUR AVERAGE") \
            .when(p >= b, "ABOVE BENCHMARK").otherwise("BELOW BENCHMARK")
    return j.select(
        *[c for c in scored.columns],
        rint_round(p, 2).alias("predicted_er_2dp"),
        rint_round(F.col("__avg"), 2).alias("your_avg_er"),
        (p >= F.col("__avg")).alias("above_avg"),
        (p >= b).alias("above_benchmark"),
        label.alias("recommendation"),
        rint_round(p - F.col("__avg"), 1).alias("delta_vs_avg"),
        rint_round(p - b, 1).alias("delta_vs_benchmark"),
        rint_round(F.col("__best"), 1).alias("best_post_er"),
    )


def ml_summary(compare: DataFrame, importance: DataFrame, rows_used: int) -> DataFrame:
    """Best-model sentence and top driver."""
    best = compare.where(F.col("is_best")).limit(1)
    top = importance.orderBy(F.desc("importance"), "feature").limit(1).select(F.col("feature").alias("top"))
    top = top.agg(F.coalesce(F.first("top"), F.lit("N/A")).alias("top"))
    cv = F.col("cv_r2_mean") if "cv_r2_mean" in compare.columns else F.lit(None).cast("double")
    cvs = F.col("cv_r2_std") if "cv_r2_std" in compare.columns else F.lit(None).cast("double")
    return best.crossJoin(top).select(
        F.col("model").alias("best_model"), "r2", "mae", F.col("top").alias("top_driver"),
        F.lit(rows_used).alias("total_posts_used"),
        F.format_string("%s explains most (R2 %s, mean error %s points, cross-validated R2 %s, spread %s); strongest feature: %s.",
                        F.col("model"), F.col("r2").cast("string"), F.col("mae").cast("string"),
                        cv.cast("string"), cvs.cast("string"), F.col("top")).alias("summary"),
    )
