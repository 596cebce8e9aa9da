from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import risk as R
from tallyspark.operators.clustering import LABEL


def norm(spark, score, t, s):
    df = spark.createDataFrame([(float(score), float(t), float(s))], "a double, t double, s double")
    return df.select(R.anomaly_norm(F.col("a"), F.col("t"), F.col("s"))).first()[0]


def test_anomaly_norm(spark):
    assert norm(spark, 0, 2, 4) == 0.0
    assert norm(spark, 1, 2, 4) == pytest.approx(0.345)
    assert norm(spark, 2, 2, 4) == pytest.approx(0.70)  # the upper band starts at the threshold
    assert norm(spark, 3, 2, 4) == pytest.approx(0.85)
    assert norm(spark, 4, 2, 4) == 1.0
    assert norm(spark, 0.5, 0, 0) == 1.0
    assert norm(spark, 2, 2, 1) == pytest.approx(0.70)  # a severe cut below is lifted


def summary(spark, raws):
    rows = [(i, float(r) / 0.28, "label") for i, r in enumerate(raws)]
    return spark.createDataFrame(rows, f"{LABEL} int, expense_to_income_ratio_mean double, profile_label string")


def test_cluster_risk(spark):
    got = lambda raws: [r["cluster_risk"] for r in R.cluster_risk_map(summary(spark, raws)).orderBy(LABEL).collect()]
    assert got([1, 2, 3]) == pytest.approx([0.15, 0.575, 1.0])
    assert got([5]) == [0.5]
    assert got([2, 2, 2 + 1e-10]) == pytest.approx([0.575] * 3)
    df = spark.createDataFrame([(0,), (9,)], f"{LABEL} int")
    rows = R.with_cluster_risk(df, R.cluster_risk_map(summary(spark, [1, 2]))).orderBy(LABEL).collect()
    assert (rows[0]["cluster_risk"], rows[1]["cluster_risk"], rows[1]["profile_label"]) == (
        pytest.approx(0.15), 0.5, "genel_davranis_profili",
    )


def money(spark, budget, predicted=1200.0, spent=500.0, pace=1000.0):
    df = spark.createDataFrame(
        [(budget, predicted, spent, pace)],
        "budget double, predicted_month_end_expense double, total_expense_so_far double, rolling_3m_expense_mean double",
    )
    return R.budget_risk(df).first()


def test_budget_risk(spark):
    r = money(spark, 1000.0)
    assert (r["budget_usage_ratio"], r["budget_remaining"], r["expected_overrun_amount"]) == (1.2, 500.0, 200.0)
    assert r["budget_overrun_probability"] == pytest.approx(1 / (1 + math.exp(-1.2)))
    assert r["forecast_risk"] == r["budget_overrun_probability"]
    for none in (None, -5.0, 0.0, 0.99):
        r = money(spark, none)
        assert (r["budget_usage_ratio"], r["budget_overrun_probability"], r["forecast_risk"]) == (0.0, 0.0, 1.0)
        assert r["budget"] == max(none or 0.0, 0.0)
    assert money(spark, None, predicted=300.0)["forecast_risk"] == pytest.approx(0.3)
    assert money(spark, None, pace=0.0)["forecast_risk"] == 0.5
    assert money(spark, None, predicted=-10.0)["forecast_risk"] == 0.0


def test_driver_ties_and_score(spark):
    def driver(p, a, f):
        df = spark.createDataFrame([(p, a, f)], "p double, a double, f double")
        return df.select(R.dominant_driver(F.col("p"), F.col("a"), F.col("f")), R.risk_score(F.col("p"), F.col("a"), F.col("f"))).first()

    assert driver(0.5, 0.5, 0.5)[0] == "profile"
    assert driver(0.1, 0.5, 0.5)[0] == "anomaly"
    assert driver(0.1, 0.2, 0.5)[0] == "forecast"
    assert driver(1.0, 1.0, 1.0)[1] == 100.0
    assert driver(0.1234, 0.5678, 0.9)[1] == pytest.approx(54.51)


@pytest.mark.parametrize(
    ("x", "text"),
    [
        (0.0, "0.0"), (0.5, "0.5"), (12345678.9, "12345678.9"), (0.0001, "0.0001"), (0.00005, "5e-05"),
        (0.000012, "1.2e-05"), (0.000003, "3e-06"), (-2.25, "-2.25"), (100.0, "100.0"),
    ],
)
def test_numbers_in_sentences(spark, x, text):
    assert text == repr(x)
    assert spark.range(1).select(R.number_text(F.lit(x))).first()[0] == text


def test_latest(spark):
    df = spark.createDataFrame([("a", "2024-W01", 1), ("a", "2024-W10", 2), (None, "2023-W52", 3)], "e string, YearWeek string, v int")
    assert sorted(r["v"] for r in R.latest(df, "YearWeek", ["e"]).collect()) == [2, 3]
    assert [r["v"] for r in R.latest(df).collect()] == [2]
