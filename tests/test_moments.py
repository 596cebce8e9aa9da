"""Regressions from moments against Spark's own fits, closed forms and plain scores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.config import ForecastConfig
from tallyspark.operators import forecast as FC
from tallyspark.operators.moments import Moments, Range
from tallyspark.operators.monthly import TARGET

FEATURES = ["a", "b", "c", "d"]
RANGES = [Range("one", 8, 12), Range("two", 12, 16), Range("three", 16, 20)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 240
    x = rng.normal([5, 200, 0, 1e6], [2, 40, 1, 3e4], (n, 4))
    y = x @ np.array([3000.0, -20.0, 500.0, 0.01]) + 20000 + rng.standard_t(2, n) * 900
    position = np.arange(n) * 20 // n
    rows = [(int(p), *map(float, r), float(t)) for p, r, t in zip(position, x, y, strict=True)]
    df = spark.createDataFrame(rows, f"position int, a double, b double, c double, d double, {TARGET} double")
    return x, y, position, df.repartition(3).persist()


def spark_fit(df, r, name):
    """Predictions for all rows by Spark's estimator, fitted on the range."""
    training = FC._prepare(df.filter(F.col("position") < r.fit_end), FEATURES)
    fitted = training.fit(FC.candidates()[name])
    return fitted, FC._predict(FC._vectors(df, training.preprocess), fitted)


def test_ranges_equal_sparks_fits(table):
    """Coefficients, preparation, predictions and scores of every range, from one set of moments."""
    x, y, position, df = table
    moments = Moments(df, FEATURES, TARGET, RANGES)
    for name, close in (("baseline_linear", 1e-8), ("ridge", 1e-8), ("elasticnet", 1e-6)):
        weights = moments.fit(name)
        scores = moments.scores({name: weights})
        for r, w in zip(RANGES, weights, strict=True):
            fitted, predicted = spark_fit(df, r, name)
            mine = moments.linear(w)
            assert mine.coefficients == pytest.approx(list(fitted.model.coefficients), rel=close, abs=close * 1e3)
            assert mine.intercept == pytest.approx(fitted.model.intercept, rel=close)
            train = position < r.fit_end
            prepared = moments.prepared(r.name)
            assert prepared.medians == pytest.approx(np.median(x[train], axis=0))
            assert prepared.mean == pytest.approx(x[train].mean(0)) and prepared.scale == pytest.approx(x[train].std(0))
            held = predicted.filter((F.col("position") >= r.fit_end) & (F.col("position") < r.score_end))
            assert scores[name, r.name] == pytest.approx(FC._scores(held), rel=1e-6)


def huber_parts(z, y, w, b, sigma, alpha, epsilon=1.35):
    u = (y - z @ w - b) / sigma
    inside = np.abs(u) < epsilon
    psi = np.where(inside, 2 * u, 2 * epsilon * np.sign(u))
    loss = (sigma + np.where(inside, u * u, 2 * epsilon * np.abs(u) - epsilon**2) * sigma).sum() + alpha * w @ w
    return loss, -(z.T @ psi) + 2 * alpha * w, psi.sum()


def test_huber_reaches_sparks_loss_and_a_zero_gradient(table):
    x, y, position, df = table
    moments = Moments(df, FEATURES, TARGET, RANGES)
    for r, w in zip(RANGES, moments.fit("huber"), strict=True):
        train = position < r.fit_end
        z = (x[train] - x[train].mean(0)) / x[train].std(0)
        mine = moments.linear(w)
        weights, t = np.array(mine.coefficients), y[train]
        residual = np.abs(t - z @ weights - mine.intercept)
        sigmas = np.geomspace(residual.mean() / 20, residual.mean() * 20, 4000)
        losses = [huber_parts(z, t, weights, mine.intercept, s, 1e-4)[0] for s in sigmas]
        at = sigmas[int(np.argmin(losses))]
        fine = np.linspace(at * 0.99, at * 1.01, 4001)
        sigma = fine[int(np.argmin([huber_parts(z, t, weights, mine.intercept, s, 1e-4)[0] for s in fine]))]
        loss, by_weight, by_intercept = huber_parts(z, t, weights, mine.intercept, sigma, 1e-4)
        assert np.abs(by_weight).max() / len(t) < 1e-4 and abs(by_intercept) / len(t) < 1e-4
        fitted, _ = spark_fit(df, r, "huber")
        theirs = huber_parts(
            z, t, fitted.model.coefficients.toArray() * fitted.scale, fitted.model.intercept * fitted.scale + fitted.shift,
            fitted.model.scale * fitted.scale, 1e-4,
        )[0]
        assert loss <= theirs * (1 + 1e-6)


def test_gaps_take_each_ranges_own_median(spark, table):
    x, y, position, df = table
    holes = np.zeros(x.shape, bool)
    holes[::7, 1], holes[3::11, 3] = True, True
    rows = [
        (int(p), *[None if h else float(v) for v, h in zip(r, hole, strict=True)], float(t))
        for p, r, hole, t in zip(position, x, holes, y, strict=True)
    ]
    gappy = spark.createDataFrame(rows, df.schema).repartition(2)
    moments = Moments(gappy, FEATURES, TARGET, RANGES)
    for r, w in zip(RANGES, moments.fit("ridge"), strict=True):
        train = position < r.fit_end
        medians = np.nanmedian(np.where(holes, np.nan, x)[train], axis=0)
        full = np.where(holes, medians, x)
        mean, scale = full[train].mean(0), full[train].std(0)
        z, t = (full[train] - mean) / scale, y[train]
        want = np.linalg.solve(z.T @ z + 3 * np.eye(4), z.T @ (t - t.mean()))
        assert moments.linear(w).coefficients == pytest.approx(want, rel=1e-7)
        assert moments.prepared(r.name).medians == pytest.approx(medians)
        held = (position >= r.fit_end) & (position < r.score_end)
        error = ((full[held] - mean) / scale) @ want + t.mean() - y[held]
        got = moments.scores({"ridge": moments.fit("ridge")})["ridge", r.name]
        assert got[0] == pytest.approx(np.sqrt((error**2).mean())) and got[1] == pytest.approx(np.abs(error).mean())
    empty = gappy.withColumn("b", F.when(F.col("position") >= 12, F.col("b")))
    with pytest.raises(ValueError, match="'b' has no value"):
        Moments(empty, FEATURES, TARGET, RANGES)
    with pytest.raises(ValueError, match="no rows"):
        Moments(gappy.where("false"), FEATURES, TARGET, RANGES)


def test_columns_that_hang_together_or_stand_still(spark, table):
    """Dependent and constant columns: the least-norm solution, as least squares by singular values."""
    x, y, position, df = table
    wide = df.withColumn("sum", F.col("a") + F.col("b")).withColumn("same", F.lit(15.0))
    moments = Moments(wide, [*FEATURES, "sum", "same"], TARGET, RANGES)
    (w, *_), train = moments.fit("baseline_linear"), position < 8
    full = np.column_stack([x, x[:, 0] + x[:, 1]])[train]
    z = (full - full.mean(0)) / full.std(0)
    want = np.linalg.lstsq(z, y[train] - y[train].mean(), rcond=None)[0]
    assert moments.linear(w).coefficients == pytest.approx([*want, 0.0], rel=1e-6, abs=1e-6)
    huber = moments.fit("huber")
    assert all(np.isfinite(h).all() for h in huber)


def test_the_forecaster_chooses_from_moments(table):
    _, _, _, df = table
    data = df.withColumn("MonthStartDate", F.expr("add_months(DATE'2020-01-01', position)")).drop("position")
    model, metrics, cv = FC.fit_forecaster(data, (), ForecastConfig(forest_trees=3))
    valid = {r["model"]: r["rmse"] for r in metrics.filter("split = 'valid' AND model <> 'baseline_mean'").collect()}
    assert model.name == min(valid, key=valid.get) and cv.count() == len(valid) == 5
    split = FC.time_split(data)
    test = FC._scores(FC.forecast(split.filter("split = 'test'"), model))
    row = metrics.filter(f"split = 'test' AND model = '{model.name}'").first()
    assert (row["rmse"], row["mae"], row["r2"]) == pytest.approx(test, rel=1e-9)
    cv_alone = FC.time_series_cv(split.filter("split = 'train'"), FEATURES, ForecastConfig(), ["ridge"]).first()
    assert cv_alone["cv_rmse_mean"] == pytest.approx(cv.filter("model = 'ridge'").first()["cv_rmse_mean"])
