"""Linear and ridge regression (M7, M8, M12) from sums.

One grouped aggregate over the model rows gives, for every part of the data and every combination of category levels,
the count, sums and products of the numbers (shifted by their means, so that nothing cancels).  These cells add
up to a Gram matrix per part; a training set is the sum of parts, a fold's complement the total less the fold, and
each fit is one small symmetric solve.  All folds come from one scan, and a fold's R^2 follows from its sums alone.

The design is that of ``ml.fit_encoder``: numbers scaled by the population standard deviation of the training part,
one column per level that the training part has but its first; an unknown level has no column.  A constant number
has no column either.  Where columns depend on each other, the solution of least norm is taken.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlytics.functions.columns import rint_round
from postlytics.operators.ml import LABEL, MIN_ROWS, FeatureSet, check_rows, evaluate, model_rows, select_features, split
from postlytics.operators.features import Prepared

ALPHA = {"Linear Regression": 0.0, "Ridge Regression": 1.0}


@dataclass
class Sums:
    """Gram matrices over [1, numbers, levels, label] by part of the data."""

    fs: FeatureSet
    shift: np.ndarray  # of the numbers and the label
    levels: list[tuple[str, str]]  # (category, level) of the level columns, in order
    gram: dict[int, np.ndarray]

    @property
    def total(self) -> np.ndarray:
        return sum(self.gram.values(), np.zeros((2 + len(self.fs.numeric) + len(self.levels),) * 2))


@dataclass
class Fit:
    """``intercept + sum of number x coefficient + coefficients of the row's levels``."""

    numbers: dict[str, float]
    levels: dict[tuple[str, str], float]
    intercept: float
    vector: np.ndarray  # of the residual, over the columns of ``Sums``

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for c, w in self.numbers.items():
            out = out + F.col(c) * F.lit(w)
        for c in dict.fromkeys(c for c, _ in self.levels):
            pairs = [F.lit(x) for (name, level), w in self.levels.items() if name == c for x in (level, w)]
            out = out + F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(c)), F.lit(0.0))
        return out


def gram_sums(rows: DataFrame, fs: FeatureSet, part: Column) -> Sums:
    """Sums of each value of ``part`` (an int) over rows as ``ml.model_rows`` gives them.

    The cells that come to the driver are bounded by the combinations of category levels that occur, not by the rows.
    """
    names = [*fs.numeric, LABEL]
    shift = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).first()
    shift = np.array([x or 0.0 for x in shift], float)
    z = [F.col(c) - F.lit(float(m)) for c, m in zip(names, shift)]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    cells = rows.groupBy(part.alias("__part"), *fs.categorical).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(z)],
        *[F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()

    levels = sorted({(c, r[c]) for r in cells for c in fs.categorical}, key=lambda x: (fs.categorical.index(x[0]), x[1]))
    k, m = len(fs.numeric), 1 + len(fs.numeric)
    at = {lv: m + i for i, lv in enumerate(levels)}
    size = m + len(levels) + 1
    number = [*range(1, m), size - 1]  # columns of the numbers and the label
    gram: dict[int, np.ndarray] = {}
    for r in cells:
        g = gram.setdefault(r["__part"], np.zeros((size, size)))
        sums = np.array([r[f"s{i}"] for i in range(k + 1)])
        on = [0, *(at[c, r[c]] for c in fs.categorical)]
        for a in on:
            for b in on:
                g[a, b] += r["n"]
            g[a, number] += sums
            g[number, a] += sums
        for i, j in pairs:
            g[number[i], number[j]] += r[f"p{i}_{j}"]
            if i != j:
                g[number[j], number[i]] += r[f"p{i}_{j}"]
    return Sums(fs, shift, levels, gram)


def solve(sums: Sums, gram: np.ndarray, alpha: float = 0.0) -> Fit:
    """Least squares, or ridge with ``alpha`` on the scaled columns, on the rows that ``gram`` sums up."""
    k = len(sums.fs.numeric)
    n, y = gram[0, 0], len(gram) - 1
    centred = gram - np.outer(gram[:, 0], gram[0]) / n
    keep, seen = [], set()
    for i in range(1, y):
        if i > k:
            c, _ = sums.levels[i - k - 1]
            if gram[i, i] <= 0:
                continue
            if c not in seen:  # the first level of the training part
                seen.add(c)
                continue
        elif centred[i, i] <= 1e-12 * max(gram[i, i], 1.0):
            continue
        keep.append(i)
    keep = np.array(keep, int)
    scale = np.array([math.sqrt(centred[i, i] / n) if i <= k else 1.0 for i in keep])
    a = centred[np.ix_(keep, keep)] / np.outer(scale, scale) + alpha * np.eye(len(keep))
    b = centred[keep, y] / scale
    try:
        root = np.linalg.cholesky(a)
        if (np.diag(root) < 1e-6 * np.sqrt(np.diag(a))).any():
            raise np.linalg.LinAlgError
        w = np.linalg.solve(root.T, np.linalg.solve(root, b))
    except np.linalg.LinAlgError:
        w = np.linalg.lstsq(a, b, rcond=1e-10)[0]
    w = w / scale
    vector = np.zeros(len(gram))
    vector[y], vector[keep] = 1.0, -w
    vector[0] = -(gram[0, y] - gram[0, keep] @ w) / n
    numbers = {sums.fs.numeric[i - 1]: float(x) for i, x in zip(keep, w) if i <= k}
    levels = {sums.levels[i - k - 1]: float(x) for i, x in zip(keep, w) if i > k}
    shifted = sum(x * sums.shift[sums.fs.numeric.index(c)] for c, x in numbers.items())
    return Fit(numbers, levels, float(sums.shift[-1] - vector[0] - shifted), vector)


def r_squared(fit: Fit, gram: np.ndarray) -> float:
    """R^2 of a fit on the rows that ``gram`` sums up."""
    sse = max(0.0, float(fit.vector @ gram @ fit.vector))
    return 1.0 - sse / float(gram[-1, -1] - gram[0, -1] ** 2 / gram[0, 0])


def _rows(pre: Prepared, variant: str) -> tuple[FeatureSet, DataFrame]:
    fs = select_features(pre, variant)
    rows = model_rows(pre, fs)
    check_rows(rows, MIN_ROWS.get(variant, 30))
    return fs, rows


def fit(pre: Prepared, name: str, variant: str = "api", test_size: float = 0.2) -> tuple[Fit, DataFrame]:
    """The model of the training split, and the test rows."""
    fs, rows = _rows(pre, variant)
    train, test = split(rows, test_size)
    sums = gram_sums(train, fs, F.lit(0))
    return solve(sums, sums.total, ALPHA[name]), test


def metrics(pre: Prepared, name: str, variant: str = "api", test_size: float = 0.2) -> DataFrame:
    """M7 / M8: (model, r2, mae, rmse) on the test split."""
    model, test = fit(pre, name, variant, test_size)
    scored = test.select(LABEL, model.predict().alias("prediction"))
    return evaluate(scored, 3 if variant == "library" else 4).select(F.lit(name).alias("model"), "*")


def cross_validate(pre: Prepared, name: str, variant: str = "api", k: int = 5) -> DataFrame:
    """Mean and population standard deviation of the folds' R^2, every fold from one scan."""
    fs, rows = _rows(pre, variant)
    sums = gram_sums(rows, fs, F.col("bucket") % k)
    scores = [r_squared(solve(sums, sums.total - g, ALPHA[name]), g) for g in sums.gram.values()]
    df = pre.df.sparkSession.createDataFrame([(name, float(np.mean(scores)), float(np.std(scores)))], "model string, m double, s double")
    return df.select("model", rint_round(F.col("m"), 4).alias("cv_r2_mean"), rint_round(F.col("s"), 4).alias("cv_r2_std"))
