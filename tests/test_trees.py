import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from postlytics.operators import trees


@pytest.fixture(scope="module")
def data(spark):
    """Two numbers without ties in their gains, one-hot digits of four levels, a constant."""
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 4, 600)
    x = np.column_stack([rng.gamma(2, 10, 600), rng.normal(0, 1, 600), *[(kind == k).astype(float) for k in (1, 2, 3)], np.full(600, 3.0)])
    y = x[:, 0] + 4 * np.sin(3 * x[:, 1]) + np.array([0, 5, -3, 9])[kind] + rng.normal(0, .1, 600)
    df = spark.createDataFrame([([float(v) for v in r], float(t)) for r, t in zip(x, y)], "x array<double>, label double")
    return df.select(array_to_vector("x").alias("features"), "label").coalesce(1).cache()


def test_boosting_equals_spark_ml(spark, data):
    own = trees.TreeRegressor("label", rounds=8, depth=4, step=0.1).fit(data)
    other = GBTRegressor(labelCol="label", maxIter=8, maxDepth=4, stepSize=0.1, subsamplingRate=1.0).fit(data)
    got = [[r[0] for r in m.transform(data).select("prediction").collect()] for m in (own, other)]
    assert np.allclose(*got, rtol=1e-9)
    assert np.allclose(own.featureImportances.toArray(), other.featureImportances.toArray(), atol=1e-9)


def test_models_of_several_splits_equal_those_of_each(spark, data):
    parts = [data.where(F.col("label") > 10), data]
    est = trees.TreeRegressor("label", rounds=30, depth=3, share=0.8)
    for both, part in zip(est.fit_all(parts), parts):
        one = est.fit(part)
        assert all(np.array_equal(a.split, b.split) and np.allclose(a.value, b.value) for a, b in zip(one.trees, both.trees))


def test_forest_does_not_depend_on_tasks_and_keeps_leaves(spark, data, monkeypatch):
    est = trees.TreeRegressor("label", trees=6, depth=5, least=3)
    one = est.fit(data.repartition(3, "label").sortWithinPartitions("label"))
    monkeypatch.setattr(trees, "FOREST_ROWS", 150)
    monkeypatch.setattr(trees, "TASK_WORK", 600)
    other = est.fit(data.repartition(3, "label").sortWithinPartitions("label"))
    for a, b in zip(one.trees, other.trees):
        assert np.array_equal(a.split, b.split) and np.allclose(a.value, b.value) and len(a.split) > 10
    p = np.array([tuple(r) for r in one.transform(data).select("label", "prediction").collect()])
    assert np.corrcoef(p.T)[0, 1] > 0.9


def test_a_row_takes_a_byte_a_column_whatever_the_number_of_trees(spark, data):
    frame = data.select(trees.vector_to_array("features").alias("x"), F.col("label").alias("y"))
    layout = trees.layout_of(frame, 600, 1)
    assert [slots for slots, _ in layout.columns] == [[0], [1], [2, 3, 4]]
    pieces, bins, y = trees.blocks(frame, layout, 600, 1_000).first()
    assert bins.dtype == np.uint8 and bins.shape == (3, 600) and len(y) == 600


def test_columns_that_meet_in_one_row_stay_apart(spark):
    rows = [(float(i % 2), float(i % 3 == 0), float(i % 2 + 2 * (i % 3 == 0))) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, label double").select(array_to_vector(F.array("a", "b")).alias("features"), "label")
    m = trees.TreeRegressor("label", rounds=1, depth=2).fit(df)
    assert len(m.layout.columns) == 2 and all(r[0] == pytest.approx(r[1]) for r in m.transform(df).select("label", "prediction").collect())


def test_nothing_to_split_on_gives_the_mean(spark, data):
    df = data.select(array_to_vector(F.array(F.lit(1.0))).alias("features"), "label")
    m = trees.TreeRegressor("label", trees=3).fit(df)
    mean = df.agg(F.avg("label")).first()[0]
    assert m.transform(df).agg(F.max(F.abs(F.col("prediction") - mean))).first()[0] < 1e-9 and m.numFeatures == 1


def test_small_splits_are_boosted_in_one_job(spark, monkeypatch):
    """A split of one block takes no job a level, and its trees are those of the jobs by level, with one block or several."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    data = [(Vectors.dense(r), float(r[0] * 3 + (r[1] > 0) * 2 + r[2])) for r in x]
    dfs = [spark.createDataFrame(data[:n], ["features", "label"]).repartition(3).cache() for n in (600, 450)]
    model = trees.TreeRegressor("label", rounds=30, depth=4, step=0.1, share=0.8, seed=5)
    for df in dfs:
        df.count()
    spark.sparkContext.setJobGroup("boost", "boost")
    try:
        got = model.fit_all(dfs)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boost")) < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    by_level = lambda bases, layouts, rounds, *rest: trees._boost(bases, layouts, 1050, rounds, *rest)
    monkeypatch.setattr(trees, "_boost_blocks", by_level)
    one = model.fit_all(dfs)
    monkeypatch.setattr(trees, "BOOST_ROWS", 200)
    several = model.fit_all(dfs)
    for a, b, c in zip(got, one, several):
        for s, t, u in zip(a.trees, b.trees, c.trees):
            assert (s.split == t.split).all() and (s.value == t.value).all()
            assert (s.split == u.split).all() and np.allclose(s.value, u.value)


def test_a_forest_of_one_block_takes_no_job_a_level(spark, data, monkeypatch):
    """Deep trees of one block cost as many jobs as shallow ones, and are those of the jobs by level."""
    def grown(depth):
        group = f"forest-{depth}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            model = trees.TreeRegressor("label", trees=9, depth=depth, least=2).fit(data)
            return model, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    (_, few), (deep, many) = grown(2), grown(9)
    assert few == many
    monkeypatch.setattr(trees, "_forest_block", trees._forest)
    for a, b in zip(deep.trees, grown(9)[0].trees):
        assert (a.split == b.split).all() and (a.left == b.left).all() and (a.value == b.value).all() and (a.gain == b.gain).all()


def _mixed(rows: int, seed: int = 11):
    rng = np.random.default_rng(seed)
    kind = rng.integers(0, 5, rows)
    x = np.column_stack([rng.normal(size=rows), rng.gamma(2, 10, rows), rng.integers(0, 9, rows), *[(kind == k).astype(float) for k in (1, 2, 3, 4)]])
    y = x[:, 0] * 3 + np.sqrt(x[:, 1]) + (x[:, 2] > 4) * x[:, 0] + kind + rng.normal(0, .1, rows)
    return x, y


def test_a_large_block_is_summed_packed_into_the_same_trees(spark, monkeypatch):
    """Several columns in one pass and siblings by difference give the trees of plain sums, weighted or not, with every leaf."""
    x, y = _mixed(5_000)
    layout = trees.Layout.of([trees.thresholds(c) for c in x.T], (x > 0.5).T.astype(float) @ (x > 0.5))
    bins = layout.encode(x)
    monkeypatch.setattr(trees, "CHUNK", 700)
    packed = trees.Packed(layout, bins)
    assert sum(len(columns) for _, columns, _ in packed.groups) == len(layout.columns) > len(packed.groups)
    w = np.random.default_rng(1).poisson(1.0, len(y))
    used = np.flatnonzero(w)
    for rows, weight, depth, least in ((used, w[used].astype(float), 9, 3), (np.arange(len(y)), None, 5, 1), (used, None, 12, 1)):
        plain = trees._grown(layout, bins[:, rows], np.ones(len(rows)) if weight is None else weight, y[rows], depth, least)
        got, leaf = packed.grown(rows, weight, trees._on_grid(y[rows], weight), depth, least, track=True)
        routed = trees.route(got.binned(layout), bins[:, rows])
        assert (leaf == routed).all() and (packed.leaves(got, rows) == routed).all() and got.depth == plain.depth
        assert np.allclose(got.value[routed], plain.value[trees.route(plain.binned(layout), bins[:, rows])], atol=1e-9)
        assert np.allclose(got.gain.sum(), plain.gain.sum(), rtol=1e-9)


def test_splits_of_a_comparison_are_boosted_in_one_job_beyond_a_round_s_block(spark, monkeypatch):
    """Splits of more rows than a block of the jobs by level take no job a level (before: 5 jobs a round) and give their trees."""
    x, y = _mixed(900)
    dfs = [spark.createDataFrame([(Vectors.dense(r), float(t)) for r, t in zip(x[:n], y)], ["features", "label"]).repartition(3).cache() for n in (900, 700)]
    for df in dfs:
        df.count()
    monkeypatch.setattr(trees, "BOOST_ROWS", 200)
    monkeypatch.setattr(trees, "PACKED_ROWS", 100)
    model = trees.TreeRegressor("label", rounds=30, depth=4, step=0.1, seed=5)  # all rows: splits that part them alike count as one
    spark.sparkContext.setJobGroup("beyond", "beyond")
    try:
        got = model.fit_all(dfs)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("beyond")) < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(trees, "FOREST_ROWS", 300)
    for a, b, df in zip(got, model.fit_all(dfs), dfs):
        p, q = ([r[0] for r in m.transform(df).select("prediction").collect()] for m in (a, b))
        assert np.allclose(p, q, atol=1e-7) and np.std(p) > 1


def test_a_piece_is_drawn_as_a_whole_however_tasks_read_it(spark, data, monkeypatch):
    frame = data.repartition(7, "label").select(trees.vector_to_array("features").alias("x"), F.col("label").alias("y")).cache()
    layout = trees.layout_of(frame, 600, 1)
    monkeypatch.setattr(trees, "PIECE_ROWS", 40)
    size = {r["p"]: r["count"] for r in frame.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    whole = sorted((p, i, min(40, n - 40 * i)) for p, n in size.items() for i in range(-(-n // 40)))
    one = trees.blocks(frame, layout, 600, 1_000).first()
    monkeypatch.setattr(trees, "_few", lambda d: d.coalesce(2))
    two = trees.blocks(frame, layout, 600, 1_000).first()
    assert one[0] == two[0] == whole and np.array_equal(one[1], two[1]) and np.array_equal(one[2], two[2])
