"""Model parts against closed forms and brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.config import AnomalyConfig, ForecastConfig, ProfilerConfig
from tallyspark.functions.quantiles import exact_quantiles
from tallyspark.operators import anomaly as A
from tallyspark.operators import clustering as K
from tallyspark.operators import forecast as FC
from tallyspark.operators import prep as P
from tallyspark.operators.monthly import MONTH, TARGET
from tallyspark.operators.profiler import fit_profiler, predict_profile
from tallyspark.sources.models import (
    load_artifact, load_model, save_model, versions, write_metrics,
)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    values = np.round(rng.gamma(2.0, 3.0, 40000), 3)
    values[:13000] = 4.0  # one value holds a third
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(values)], "v double, g int")
    probs = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = exact_quantiles(df, ["v"], probs, accuracy=1000).first()["v"]
    assert got == pytest.approx(list(np.quantile(values, probs)))
    by = {r["g"]: r["v"] for r in exact_quantiles(df, ["v"], probs, ["g"], 1000).collect()}
    for g in range(3):
        assert by[g] == pytest.approx(list(np.quantile(values[np.arange(40000) % 3 == g], probs)))


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_quantiles_of_odd_groups(spark, accuracy):
    """Null keys, groups without a value, ties, NaN: as the built-in aggregate, at either bracket width."""
    rng = np.random.default_rng(1)
    rows = [(None, float(v)) for v in rng.normal(size=300)] + [("tie", 2.0)] * 90 + [("tie", 3.0)]
    rows += [("none", None), ("none", float("nan")), ("one", 7.5), ("two", float("nan")), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame([(g, v, None if v is None else -v) for g, v in rows], "g string, v double, w double")
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {r["g"]: (r["v"], r["w"]) for r in exact_quantiles(df, ["v", "w"], probs, ["g"], accuracy).collect()}
    plain = df.selectExpr("g", "nullif(v, double('NaN')) v", "nullif(w, double('NaN')) w").groupBy("g")
    lits = "array(" + ", ".join(f"{p}D" for p in probs) + ")"
    want = {
        r["g"]: (r["v"], r["w"])
        for r in plain.agg(F.expr(f"percentile(v, {lits})").alias("v"), F.expr(f"percentile(w, {lits})").alias("w")).collect()
    }
    assert set(got) == set(want) == {None, "tie", "none", "one", "two"}
    for g, pair in want.items():
        for a, b in zip(got[g], pair, strict=True):
            assert a is None or a == [None] * 5 if b is None else a == pytest.approx(b), g
    assert exact_quantiles(df.where("false"), ["v"], probs).first()["v"] == [None] * 5


def test_population_variance_selects(spark):
    # population variance .0089 is below the limit, the sample variance .0133 is not
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 5.0), (0.2, 9.0)], "a double, b double")
    prep = P.fit_prep(df, ["a", "b"], 0.01)
    assert prep.columns == ("b",)
    assert prep.scale[0] == pytest.approx(np.std([1, 5, 9]))
    with pytest.raises(ValueError):
        P.fit_prep(df, ["a"], 0.01)
    wide = P.apply_prep(df.select("a"), prep).first()["features"]
    assert wide == pytest.approx([(0 - prep.mean[0]) / prep.scale[0]])
    assert P.fit_prep(df.withColumn("c", F.lit(0.1)), ["c"]).scale == (1.0,)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(c, 0.4, (50, 3)) for c in ((0, 0, 0), (4, 0, 1), (0, 5, 2))])
    rows = [(f"w{i:03d}", [float(v) for v in p]) for i, p in enumerate(pts)]
    return pts, spark.createDataFrame(rows, "YearWeek string, features array<double>").persist()


def brute_silhouette(x, labels, squared=False):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    d = d if squared else np.sqrt(d)
    out = []
    for i, g in enumerate(labels):
        own = (labels == g).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = d[i][labels == g].sum() / (own - 1)
        b = min(d[i][labels == h].mean() for h in set(labels) - {g})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def brute_davies_bouldin(x, labels):
    ids = sorted(set(labels))
    c = {g: x[labels == g].mean(0) for g in ids}
    s = {g: np.linalg.norm(x[labels == g] - c[g], axis=1).mean() for g in ids}
    return np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in ids if j != i) for i in ids])


def test_kmeans_and_quality(blobs):
    x, df = blobs
    model = K.fit_kmeans(df, ["a", "b", "c"], 3, n_init=3, max_iter=50)
    assert list(model.centers) == sorted(model.centers)
    labelled = K.assign(df, model).persist()
    rows = labelled.orderBy("YearWeek").collect()
    labels = np.array([r["cluster_label"] for r in rows])
    nearest = np.linalg.norm(x[:, None] - np.array(model.centers)[None], axis=2)
    assert (labels == nearest.argmin(1)).all()
    assert [r["nearest_distance"] for r in rows] == pytest.approx(list(nearest.min(1)))
    q = K.cluster_quality(labelled, ["YearWeek"], 3).first()
    assert q["silhouette"] == pytest.approx(brute_silhouette(x, labels))
    assert q["davies_bouldin"] == pytest.approx(brute_davies_bouldin(x, labels))
    assert (q["balance_score"], q["min_cluster_fraction"], q["silhouette_rows"]) == (1.0, pytest.approx(1 / 3), 150)
    blocks = K.silhouette(labelled, ["YearWeek"], block_rows=40).first()  # the same, whatever the blocks
    assert blocks["silhouette_rows"] == 150 and blocks["silhouette"] == pytest.approx(q["silhouette"])
    squared = K.silhouette(labelled, ["YearWeek"], "squared").first()
    assert squared["silhouette"] == pytest.approx(brute_silhouette(x, labels, squared=True))


def test_single_member_cluster_counts_zero(spark):
    df = spark.createDataFrame(
        [("a", [0.0], 0), ("b", [1.0], 0), ("c", [9.0], 1)], "YearWeek string, features array<double>, cluster_label int"
    )
    x, g = np.array([[0.0], [1.0], [9.0]]), np.array([0, 0, 1])
    assert K.silhouette(df, ["YearWeek"]).first()[0] == pytest.approx(brute_silhouette(x, g))
    assert K.silhouette(df, ["YearWeek"], "squared").first()[0] == pytest.approx(brute_silhouette(x, g, squared=True))


def test_small_share_is_penalised(spark):
    row = "CAST({} AS DOUBLE) AS min_cluster_fraction, 0.5D AS silhouette, 0.8D AS balance_score, 1.0D AS davies_bouldin"
    score = lambda f: spark.range(1).selectExpr(*row.format(f).split(", ")).select(K.composite_score(0.05)).first()[0]
    assert score(0.05) == pytest.approx(0.2 + 0.24 + 0.01 - 0.1)
    assert score(0.04) == pytest.approx(0.2 + 0.24 + 0.008 - 0.1 - 0.25)


def test_ties_go_to_the_lowest_cluster(spark):
    df = spark.createDataFrame([([0.0],)], "features array<double>")
    assert K.assign(df, K.Centroids(("a",), ((1.0,), (-1.0,)))).first()["cluster_label"] == 0


def test_profile_rules(spark):
    base = {f"{c}_mean": 0.0 for c in K.SUMMARY_COLUMNS} | {"cluster_size": 50}
    low = {"expense_to_income_ratio_mean": 0.4, "expense_volatility_ratio_mean": 0.4}
    high = {"expense_to_income_ratio_mean": 0.95, "expense_volatility_ratio_mean": 0.8}
    cases = [
        ({"cluster_size": 4}, "uc_davranis_grubu"),
        (low | {"expense_vs_rolling_mean_ratio_mean": 1.05}, "tasarruf_odakli"),
        (high | {"dominant_category_ratio_mean": 0.56}, "kategori_yogun_harcama"),
        (high | {"top2_category_ratio_sum_mean": 0.8, "category_entropy_mean": 1.0}, "kategori_yogun_harcama"),
        (high | {"weekend_expense_ratio_mean": 0.43}, "hafta_sonu_agirlikli"),
        (high | {"expense_vs_rolling_mean_ratio_mean": 1.2}, "dengesiz_yuksek_harcama"),
        (high | {"zero_income_week_mean": 0.31}, "gelirsiz_harcama_donemi"),
        ({"expense_to_income_ratio_mean": 0.75, "total_income_mean": 1.0, "active_days_ratio_mean": 0.35}, "dengeli_harcama"),
        (high, "genel_davranis_profili"),
    ]
    rows = [tuple((base | c).values()) for c, _ in cases]
    df = spark.createDataFrame(rows, list(base))
    got = [r[0] for r in df.select(K.profile_label(F.lit(100), 0.05)).collect()]
    assert got == [want for _, want in cases]


def test_contributions_are_largest_first_then_by_name(spark):
    df = spark.createDataFrame([([1.0, -3.0, 1.0], 0)], "features array<double>, cluster_label int")
    top = A.top_contributions(df, K.Centroids(("z", "b", "a"), ((0.0, 0.0, 0.0),)), 2).first()[-1]
    assert [(c["feature"], c["absolute_deviation"]) for c in top] == [("b", 3.0), ("a", 1.0)]


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, (60, 4))
    y = x @ np.array([3.0, -2.0, 0.5, 0.0]) * 1000 + 20000 + rng.normal(0, 500, 60)
    rows = [(int(i), *[float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, f"position int, a double, b double, c double, d double, {TARGET} double")
    return x, y, df.persist()


def predictions(df, name):
    training = FC._prepare(df, ["a", "b", "c", "d"])
    fitted = training.fit(FC.candidates()[name])
    rows = FC._predict(FC._vectors(df, training.preprocess), fitted).orderBy("position").collect()
    return np.array([r[FC.PREDICTION] for r in rows])


def scaled_x(x):
    return (x - x.mean(0)) / x.std(0)


def test_linear_and_ridge_equal_the_closed_form(regression):
    x, y, df = regression
    z = scaled_x(x)
    for name, alpha in (("baseline_linear", 0.0), ("ridge", 3.0)):
        w = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (y - y.mean()))
        assert predictions(df, name) == pytest.approx(z @ w + y.mean(), rel=1e-6)


def test_elastic_net_equals_coordinate_descent(regression):
    x, y, df = regression
    z, r, n = scaled_x(x), y - y.mean(), len(y)
    w, l1, l2 = np.zeros(4), 0.05 * 0.3, 0.05 * 0.7
    for _ in range(3000):
        for j in range(4):
            rho = z[:, j] @ (r - z @ w + z[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - l1, 0) / (z[:, j] @ z[:, j] / n + l2)
    assert predictions(df, "elasticnet") == pytest.approx(z @ w + y.mean(), rel=1e-5)


def test_huber_reaches_the_optimum_at_any_scale(regression):
    """The gradient of sum(sigma + H(r / sigma) sigma) + alpha |w|^2 vanishes."""
    x, y, df = regression
    training = FC._prepare(df, ["a", "b", "c", "d"])
    fit = training.fit(FC.candidates()["huber"])
    z, n = scaled_x(x), len(y)
    w = fit.model.coefficients.toArray() * fit.scale
    b = fit.model.intercept * fit.scale + fit.shift
    sigma = fit.model.scale * fit.scale
    u = (y - z @ w - b) / sigma
    psi = np.where(np.abs(u) <= 1.35, 2 * u, 2 * 1.35 * np.sign(u))
    grad = -(z.T @ psi) + 2 * 1e-4 * w
    assert np.abs(grad).max() / n < 1e-3 and abs(psi.sum()) / n < 1e-3


def test_metrics_of_a_constant_target(spark):
    df = spark.createDataFrame([(2.0, 2.0, 3.0), (2.0, 2.0, 2.0)], f"{TARGET} double, good double, bad double")
    assert tuple(FC.regression_metrics(df, prediction="good").first()) == (0.0, 0.0, 1.0)
    assert FC.regression_metrics(df, prediction="bad").first()["r2"] == 0.0


def test_imputation_and_text_features(spark):
    df = spark.createDataFrame(
        [(1.0, "x"), (3.0, "y"), (None, "y"), (9.0, None)], "num double, word string"
    )
    pre = FC.fit_preprocess(df, ["num", "word"], 4)
    assert pre.medians == (3.0,) and pre.modes == (("word", "y"),) and pre.categories == (("x", "y"),)
    vals = np.array([1, 3, 3, 9.0])
    got = [r["features"] for r in FC.apply_preprocess(df, pre).collect()]
    assert [g[0] for g in got] == pytest.approx(list((vals - vals.mean()) / vals.std()))
    assert [g[1:] for g in got] == [[1, 0], [0, 1], [0, 1], [0, 1]]
    new = spark.createDataFrame([("zzz",)], "word string")
    assert FC.apply_preprocess(new, pre).first()["features"][1:] == [0.0, 0.0]


def test_folds():
    assert FC.cv_folds(58) == [(1, 16, 30), (2, 30, 44), (3, 44, 58)]
    assert FC.cv_folds(4, 5) == [(1, 1, 2), (2, 2, 3), (3, 3, 4)]


def test_too_few_months(spark):
    df = spark.sql(f"SELECT explode(sequence(DATE'2024-01-01', DATE'2024-09-01', INTERVAL 1 MONTH)) AS {MONTH}")
    with pytest.raises(Exception, match="fewer than 10 months"):
        FC.time_split(df).collect()


@pytest.fixture(scope="module")
def models(spark):
    from tallyspark.operators import monthly as M
    from tallyspark.operators import weekly as W
    from tallyspark.plans.queries import orders

    clean = orders(spark, "/root/testdata/sf0.001").persist()
    weeks = W.weekly_features(clean, ["entity"]).persist()
    keys = ["entity", "YearWeek"]
    profiler, labelled, _ = fit_profiler(weeks, ["entity"], ProfilerConfig(n_init=1))
    assert predict_profile(weeks, profiler).select(*keys, "cluster_label").intersect(labelled.select(*keys, "cluster_label")).count() == labelled.count()
    detector, scored, stats = A.fit_anomaly(weeks.select(*keys, *W.weekly_columns("anomaly")), keys, AnomalyConfig(n_init=1))
    row = stats.first()
    assert row["anomaly_count"] == scored.filter("is_anomaly").count() > row["severe_anomaly_count"] > 0
    data = M.forecast_dataset(clean, 15, 5, ["entity"]).persist()
    forecaster, metrics, cv = FC.fit_forecaster(data, ["entity"], ForecastConfig(forest_trees=5))
    valid = {r["model"]: r["rmse"] for r in metrics.filter("split = 'valid' AND model <> 'baseline_mean'").collect()}
    assert forecaster.name == min(valid, key=valid.get) and cv.count() == 5
    return profiler, detector, forecaster, weeks, data, metrics


def test_models_survive_storage(spark, models, tmp_path):
    profiler, detector, forecaster, weeks, data, metrics = models
    for i, m in enumerate((profiler, detector, forecaster)):
        save_model(spark, m, f"{tmp_path}/{i}")
    p, a, f = [load_model(spark, f"{tmp_path}/{i}") for i in range(3)]
    assert (p.prep, p.centroids, a) == (profiler.prep, profiler.centroids, detector)
    assert sorted(p.summary.collect()) == sorted(profiler.summary.collect())
    assert sorted(FC.forecast(data, f).select(FC.PREDICTION).collect()) == sorted(
        FC.forecast(data, forecaster).select(FC.PREDICTION).collect()
    )
    with pytest.raises(FileNotFoundError):
        load_model(spark, f"{tmp_path}/none")
    write_metrics(metrics, f"{tmp_path}/metrics")
    assert spark.read.json(f"{tmp_path}/metrics").count() == metrics.count()


def test_artifacts_keep_the_whole_training(spark, models, tmp_path):
    profiler, detector, forecaster, weeks, data, metrics = models
    path = f"{tmp_path}/forecaster"
    removed = weeks.select("entity", "YearWeek").limit(7)
    config = ForecastConfig(forest_trees=5)
    assert save_model(spark, forecaster, path, config, metrics=metrics, removed_weeks=removed) == 1
    assert save_model(spark, forecaster, path) == 2 and versions(spark, path) == [1, 2]
    first = load_artifact(spark, path, 1)
    assert first.config == config and set(first.tables) == {"metrics", "removed_weeks"} and first.version == 1
    assert sorted(first.tables["metrics"].collect()) == sorted(metrics.collect())
    assert first.tables["removed_weeks"].count() == 7
    newest = load_artifact(spark, path)
    assert newest.version == 2 and newest.config is None and not newest.tables
    other = f"{tmp_path}/profiler"
    save_model(spark, profiler, other, ProfilerConfig(candidate_ks=(2, 5)))
    assert load_artifact(spark, other).config.candidate_ks == (2, 5)
    assert load_artifact(spark, other).model.scope.first() == profiler.scope.first()


def test_a_version_that_was_not_finished_is_never_read(spark, models, tmp_path, monkeypatch):
    from tallyspark.sources import models as storage

    _, detector, *_ = models
    path = f"{tmp_path}/detector"
    write = storage._write

    def stops(spark, rows, schema, where):
        if where.endswith("/thresholds"):
            raise RuntimeError("lost")
        write(spark, rows, schema, where)

    monkeypatch.setattr(storage, "_write", stops)
    with pytest.raises(RuntimeError):
        save_model(spark, detector, path)
    with pytest.raises(FileNotFoundError):
        load_model(spark, path)
    monkeypatch.setattr(storage, "_write", write)
    assert save_model(spark, detector, path) == 1 and load_model(spark, path) == detector
    monkeypatch.setattr(storage, "_write", stops)
    with pytest.raises(RuntimeError):
        save_model(spark, detector, path)
    assert versions(spark, path) == [1] and load_model(spark, path) == detector
    with pytest.raises(FileNotFoundError, match="version 9"):
        load_model(spark, path, 9)


def test_risk_report(spark, models):
    from tallyspark.operators.risk import RiskModels, risk_report
    from tallyspark.plans.ledgers import order_ledger

    bundle = RiskModels(*models[:3])
    raw = order_ledger(spark, "/root/testdata/sf0.001", "o_custkey")
    raw = raw.withColumn("entity", F.nullif(F.col("entity"), F.lit(7)))  # one entity without a key
    report = risk_report(raw, bundle, ["entity"], 1e6).persist()
    assert report.count() == raw.select("entity").distinct().count()
    assert report.filter("status = 'ok' AND NOT risk_score BETWEEN 0 AND 100").count() == 0
    assert report.filter("(status = 'ok') <> (risk_score IS NOT NULL)").count() == 0
    key = report.filter("status = 'ok' AND entity IS NOT NULL").first()["entity"]
    alone = risk_report(raw.filter(F.col("entity") == key).drop("entity"), bundle, budgets=1e6).first()
    same = report.filter(F.col("entity") == key).first()
    assert alone["risk_score"] == same["risk_score"]
    assert alone["explanation"] == same["explanation"]
    assert alone["components"]["profile"]["cluster_risk_map"] == same["components"]["profile"]["cluster_risk_map"]
    assert len(alone["components"]["anomaly"]["top_feature_contributions"]) == 5


@pytest.mark.parametrize("months", [3, 4, 5, 8, 17])
def test_fold_roles_follow_the_bounds(spark, months):
    train = spark.createDataFrame([(m, "e") for m in range(months)], "position int, entity string")
    got = {(r["fold"], r["position"], r["role"]) for r in FC.fold_roles(train).collect()}
    want = {(i, m, "fit" if m < s else "score") for i, s, e in FC.cv_folds(months) for m in range(min(e, months))}
    assert got == want
