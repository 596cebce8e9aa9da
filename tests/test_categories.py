"""Category features as sparse parts of rows, against the same features as columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.config import AnomalyConfig, ForecastConfig, ProfilerConfig
from tallyspark.operators import anomaly as A
from tallyspark.operators import categories as CAT
from tallyspark.operators import clustering as K
from tallyspark.operators import forecast as FC
from tallyspark.operators import kmeans as KM
from tallyspark.operators import monthly as M
from tallyspark.operators import weekly as W
from tallyspark.operators.profiler import fit_profiler, predict_profile
from tallyspark.operators.risk import RiskModels, risk_report
from tallyspark.plans.ledgers import order_ledger
from tallyspark.plans.queries import orders
from tallyspark.sources.models import load_model, save_model

SF = "/root/testdata/sf0.001"
E, KEY = ["entity"], ["entity", "YearWeek"]


@pytest.fixture(scope="module")
def ledger(spark):
    return orders(spark, SF).persist()


@pytest.fixture(scope="module")
def frames(ledger):
    categories = W.list_categories(ledger)
    wide = W.weekly_features(ledger, E, "profile", categories).persist()
    plain = W.weekly_features(ledger, E).persist()
    return wide, plain, W.weekly_category_long(ledger, E).persist(), categories


def sparse_rows(spark, n, d, width, seed=0):
    rng = np.random.default_rng(seed)
    x, wide = rng.normal(size=(n, d)), np.zeros((n, width))
    rows = []
    for i in range(n):
        idx = np.sort(rng.choice(width, rng.integers(0, 5), replace=False))
        wide[i, idx] = rng.gamma(2.0, 1.0, len(idx))
        rows.append((f"w{i}", x[i].tolist(), idx.tolist(), wide[i, idx].tolist()))
    df = spark.createDataFrame(rows, "w string, features array<double>, idx array<int>, val array<double>")
    return np.concatenate([x, wide], axis=1), df.repartition(3)


def test_rows_with_a_wide_part_behave_as_columns(spark):
    full, df = sparse_rows(spark, 90, 2, 40)
    rng = np.random.default_rng(3)
    width, batch = 40, df.orderBy(F.substring("w", 2, 9).cast("int")).toArrow().combine_chunks().to_batches()[0]
    rows = KM.Rows.of(batch, width)
    centers = rng.normal(size=(5, 42))
    assert np.allclose(rows.square_distances(centers), ((full[:, None] - centers) ** 2).sum(2))
    label = rng.integers(0, 4, 90)
    assert np.allclose(rows.sums(label, 4), [full[label == c].sum(0) for c in range(4)])
    for a, z in ((0, 1), (1, 7), (0, 42), (3, 20), (30, 99)):
        assert np.allclose(rows.dense(a, z), full[:, a:z])
    part = rows[10:30]
    assert np.allclose(part.dense(0, 42), full[10:30]) and len(rows[5:5]) == 0
    x, idx, val = rows.row(7)
    assert np.allclose(x, full[7, :2]) and np.allclose(full[7, 2:][idx], val)


def test_wide_fit_and_quality_equal_those_of_columns(spark, monkeypatch):
    full, df = sparse_rows(spark, 150, 3, 25, seed=4)
    flat = df.select("w", F.udf(lambda x, i, v: x + [dict(zip(i, v, strict=True)).get(p, 0.0) for p in range(25)], "array<double>")("features", "idx", "val").alias("features"))
    names = [f"c{i}" for i in range(28)]
    dense = KM.fit_restarts(flat, names, [2, 3], 4, 50, 1, ["w"])
    sparse = KM.fit_restarts(df, names[:3], [2, 3], 4, 50, 1, ["w"], width=25)
    monkeypatch.setattr(KM, "PASS_NUMBERS", 100)  # a run or two a pass
    split = KM.fit_restarts(df, names[:3], [2, 3], 4, 50, 1, ["w"], width=25)
    for k in (2, 3):
        assert np.allclose(dense[k].centers, sparse[k].centers) and np.allclose(dense[k].centers, split[k].centers)
        a, b = K.assign(flat, dense[k]).persist(), K.assign(df, sparse[k], width=25).persist()
        assert sorted(a.select("w", K.LABEL).collect()) == sorted(b.select("w", K.LABEL).collect())
        want = K.cluster_quality(a, ["w"], 28).first().asDict()
        got = K.cluster_quality(b, ["w"], 3, width=25).first().asDict()
        assert got == pytest.approx(want)


def test_places_are_dense_and_in_order(spark):
    rows = spark.range(1000).select(F.concat(F.lit("c"), F.lpad("id", 4, "0")).alias("category"), F.lit("amount").alias("kind"))
    placed = CAT.with_places(rows.repartition(7), ["kind", "category"]).collect()
    assert sorted((r["category"], r["place"]) for r in placed) == [(f"c{i:04d}", i) for i in range(1000)]


def test_statistics_with_zeros(frames):
    wide, _, long, categories = frames
    n = wide.count()
    names = [f"cat_{c}_{k}" for c in categories for k in CAT.KINDS]
    want = {c: (wide.agg(F.avg(f"`{c}`"), F.var_pop(f"`{c}`")).first()) for c in names[:6]}
    got = {r["feature"]: (r["mean"], r["variance"]) for r in CAT.category_stats(long, n).collect()}
    assert set(got) == set(names)
    for c, row in want.items():
        assert got[c] == pytest.approx(tuple(row))


@pytest.fixture(scope="module")
def fitted(frames):
    wide, plain, long, _ = frames
    config = AnomalyConfig(n_init=4)
    anomaly = [c for c in W.weekly_columns("anomaly")]
    columns = [F.col(f"`{c}`") for c in wide.columns if c in {*KEY, *W.weekly_columns("anomaly", frames[3])}]
    dense = A.fit_anomaly(wide.select(*columns), KEY, config)
    sparse = A.fit_anomaly(plain.select(*KEY, *anomaly), KEY, config, long)
    profile = ProfilerConfig(n_init=3)
    return dense, sparse, fit_profiler(wide, E, profile), fit_profiler(plain, E, profile, categories=long)


def by_key(df, *columns):
    return {(r["entity"], r["YearWeek"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_anomaly_model_equals_that_of_columns(frames, fitted):
    wide, plain, long, _ = frames
    dense, sparse, *_ = fitted
    assert sparse[0].anomaly_threshold == pytest.approx(dense[0].anomaly_threshold)
    assert sparse[0].severe_threshold == pytest.approx(dense[0].severe_threshold)
    want, got = by_key(dense[1], A.SCORE), by_key(sparse[1], A.SCORE)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    a = by_key(A.score_weeks(wide, dense[0], 4), "is_anomaly", "top_feature_contributions")
    b = by_key(A.score_weeks(plain, sparse[0], 4, KEY, long), "is_anomaly", "top_feature_contributions")
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0]
        assert [t["feature"] for t in a[k][1]] == [t["feature"] for t in b[k][1]]
        for t, u in zip(a[k][1], b[k][1], strict=True):
            assert tuple(t)[1:] == pytest.approx(tuple(u)[1:], abs=1e-9)


def test_profiler_equals_that_of_columns(frames, fitted):
    *_, (dense, labelled, _), (sparse, other, _) = fitted
    assert by_key(labelled, K.LABEL) == by_key(other, K.LABEL)
    drop = lambda e: {r["k"]: r["composite_score"] for r in e.collect()}
    assert drop(sparse.evaluation) == pytest.approx(drop(dense.evaluation))
    _, plain, long, _ = frames
    predicted = predict_profile(plain, sparse, E, long)
    assert by_key(predicted.join(other.select(*KEY), KEY), K.LABEL) == by_key(other, K.LABEL)
    with pytest.raises(ValueError, match="long table"):
        predict_profile(plain, sparse, E)


def test_report_and_storage(spark, ledger, fitted, tmp_path):
    dense, sparse, (profiler, *_), (slim, *_) = fitted
    for i, m in enumerate((slim, sparse[0])):
        save_model(spark, m, f"{tmp_path}/{i}")
    slim, detector = load_model(spark, f"{tmp_path}/0"), load_model(spark, f"{tmp_path}/1")
    forecaster, _, _ = FC.fit_forecaster(M.forecast_dataset(ledger, 15, 5, E), E, ForecastConfig(), ["ridge"], False)
    raw = order_ledger(spark, SF)
    rows = []
    for bundle in (RiskModels(profiler, dense[0], forecaster), RiskModels(slim, detector, forecaster)):
        report = risk_report(raw, bundle, E, 1e6)
        rows.append({r["entity"]: (r["risk_score"], r["explanation"], r["components"]["profile"]["cluster_id"]) for r in report.collect()})
    assert rows[0] == rows[1] and len(rows[0]) == 5


def test_unknown_and_absent_categories(spark, frames):
    _, plain, long, _ = frames
    prep = CAT.fit_categories(long.where("category <> 'brand#1'"), plain.count(), 0.01)
    found = CAT.apply_categories(plain, long, prep, KEY).select(*KEY, F.size("idx").alias("n")).collect()
    assert len(found) == plain.count()
    none = CAT.apply_categories(plain, long.where("false"), prep, KEY)
    assert none.where("size(idx) > 0 OR size(val) > 0").count() == 0 and none.count() == plain.count()
