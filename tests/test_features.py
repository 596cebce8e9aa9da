"""Weekly and monthly features on hand-computed rows."""

from __future__ import annotations

import math
import statistics

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import monthly as M
from tallyspark.operators import outliers as O
from tallyspark.operators import weekly as W
from tallyspark.operators.cleaning import clean_ledger

ROWS = [
    ("2021-01-03", "a", "10", "debit", "food", "m"),  # Sunday, still 2020-W53
    ("2021-01-04", "b", "30", "debit", "Food", "m"),
    ("2021-01-04", "c", "50", "debit", "rent x", "m"),
    ("2021-01-09", "d", "20", "debit", "rent_x", "m"),
    ("2021-01-09", "e", "200", "credit", "pay", "m"),
    ("2021-01-12", "f", "70", "credit", "pay", "m"),  # a week of credits only
    ("2021-03-16", "g", "5", "debit", "food", "m"),  # gap weeks before
    ("2021-03-16 08:00:00", "g", "5", "debit", "food", "m"),
]


@pytest.fixture(scope="module")
def weeks(spark):
    cols = ["Date", "Description", "Amount", "Transaction Type", "Category", "Account Name"]
    raw = spark.createDataFrame(ROWS, ", ".join(f"`{c}` string" for c in cols))
    frame = W.weekly_features(clean_ledger(raw), categories=["food", "rent x", "pay"])
    return {r["YearWeek"]: r for r in frame.collect()}


def test_week_keys(weeks):
    assert sorted(weeks) == ["2020-W53", "2021-W01", "2021-W02", "2021-W11"]


def test_base(weeks):
    w = weeks["2021-W01"]
    assert (w["total_transactions"], w["total_expense"], w["total_income"]) == (4, 100.0, 200.0)
    assert w["avg_expense"] == pytest.approx(100 / 3)
    assert (w["max_expense"], w["min_expense"]) == (50.0, 20.0)
    assert w["std_expense"] == pytest.approx(statistics.stdev([30, 50, 20]))
    assert (w["expense_transaction_count"], w["income_transaction_count"]) == (3, 1)
    assert (w["active_days"], w["unique_categories"]) == (2, 4)  # "rent x" and "rent_x" are two names in one column
    assert (w["weekend_expense"], w["weekday_expense"]) == (20.0, 80.0)
    assert weeks["2020-W53"]["std_expense"] == 0.0
    assert weeks["2020-W53"]["weekend_expense"] == 10.0


def test_week_without_expense(weeks):
    w = weeks["2021-W02"]
    for c in ("avg_expense", "max_expense", "min_expense", "std_expense", "category_entropy", "dominant_category_ratio"):
        assert w[c] == 0.0
    assert w["expense_to_income_ratio"] == 0.0
    assert weeks["2021-W11"]["zero_income_week"] == 1 and w["zero_income_week"] == 0


def test_categories(weeks):
    w = weeks["2021-W01"]
    assert w["cat_food_amount"] == 30.0
    assert w["cat_rent_x_amount"] == 70.0  # names that collide are added
    assert (w["cat_pay_amount"], w["cat_pay_ratio"]) == (0.0, 0.0)
    assert w["dominant_category_ratio"] == pytest.approx(0.7)
    assert w["top2_category_ratio_sum"] == pytest.approx(1.0)
    assert w["category_entropy"] == pytest.approx(-(0.3 * math.log(0.3) + 0.7 * math.log(0.7)))


def test_rolling_runs_over_existing_weeks(weeks):
    w = weeks["2021-W11"]
    assert w["rolling_4w_expense_mean"] == pytest.approx((10 + 100 + 0 + 10) / 4)
    assert w["expense_vs_rolling_mean_ratio"] == pytest.approx(10 / 30)
    assert w["active_days"] == 1


def test_variant_columns():
    profile, anomaly = W.weekly_columns("profile", ["a"]), W.weekly_columns("anomaly", ["a"])
    assert set(profile) - set(anomaly) == set(W.PROFILE_ONLY)
    assert "cat_a_amount" in anomaly
    with pytest.raises(ValueError):
        W.weekly_columns("other")


def test_equal_amounts_have_no_deviation(ledger):
    rows = [("2024-01-0%d" % d, str(d), "33.1", "debit", f"c{d}", "m") for d in range(1, 8)]
    assert W.weekly_features(clean_ledger(ledger(rows))).first()["std_expense"] == pytest.approx(0, abs=1e-9)


def test_one_entity_equals_its_own_ledger(spark):
    from tallyspark.plans.ledgers import order_ledger

    raw = order_ledger(spark, "/root/testdata/sf0.001")
    many = W.weekly_features(clean_ledger(raw, ["entity"]), ["entity"]).filter("entity = 'BUILDING'").drop("entity")
    alone = W.weekly_features(clean_ledger(raw.filter("entity = 'BUILDING'").drop("entity")))

    def key(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())

    assert key(many) == key(alone)
    bad = many.filter(
        (F.abs(F.col("weekend_expense") + F.col("weekday_expense") - F.col("total_expense")) > 1e-6)
        | (F.col("dominant_category_ratio") > 1 + 1e-9)
    )
    assert bad.count() == 0


def test_list_categories_refuses_instead_of_cutting(ledger):
    rows = [("2024-01-05", "x", "1", "debit", f"c{i}", "m") for i in range(5)]
    clean = clean_ledger(ledger(rows))
    assert W.list_categories(clean) == [f"c{i}" for i in range(5)]
    with pytest.raises(ValueError):
        W.list_categories(clean, 4)


MONTHS = [
    *[("2024-01-%02d" % d, "x", str(d), "debit", "a" if d < 5 else "b", "m") for d in (1, 3, 7, 8, 20)],
    ("2024-01-10", "salary", "100", "credit", "pay", "m"),
    ("2024-01-11", "x", "100", "credit", "transfer", "m"),
    ("2024-03-02", "x", "40", "debit", "a", "m"),  # February is missing
    ("2024-03-20", "x", "60", "debit", "a", "m"),
    ("2024-04-20", "x", "50", "debit", "a", "m"),  # nothing before the snapshot
    ("2024-05-03", "x", "9", "credit", "pay", "m"),  # no debit
    ("2024-06-04", "x", "10", "debit", "a", "m"),
    ("2024-06-06", "x", "30", "debit", "b", "m"),
]


@pytest.fixture(scope="module")
def clean_months(spark):
    cols = ["Date", "Description", "Amount", "Transaction Type", "Category", "Account Name"]
    return clean_ledger(spark.createDataFrame(MONTHS, ", ".join(f"`{c}` string" for c in cols)))


def test_month_history_skips_missing_months(clean_months):
    m = {r["YearMonth"]: r for r in M.monthly_base(clean_months).collect()}
    assert m["2024-01"]["month_total_income"] == 100.0  # the transfer is no income
    assert m["2024-03"]["prev_month_total_expense"] == 39.0
    assert m["2024-03"]["expense_momentum"] == 0.0
    assert m["2024-04"]["expense_momentum"] == 61.0
    assert m["2024-03"]["rolling_3m_expense_std"] == 0.0
    assert m["2024-06"]["rolling_3m_expense_mean"] == pytest.approx((100 + 50 + 0) / 3)
    assert m["2024-06"]["rolling_3m_expense_std"] == pytest.approx(statistics.stdev([100, 50, 0]))
    assert m["2024-06"]["expense_vs_prev_month_ratio"] == 0.0


def test_snapshot(clean_months):
    s = {r["YearMonth"]: r for r in M.month_snapshot(clean_months, 15).collect()}
    assert sorted(s) == ["2024-01", "2024-03", "2024-06"]
    r = s["2024-01"]
    assert (r["total_expense_so_far"], r["expense_tx_count_so_far"], r["total_tx_so_far"]) == (19.0, 4, 6)
    assert r["std_expense_so_far"] == pytest.approx(statistics.pstdev([1, 3, 7, 8]))
    assert (r["avg_daily_expense_so_far"], r["active_days_ratio_so_far"]) == (pytest.approx(19 / 15), pytest.approx(6 / 15))
    assert r["dominant_category_ratio_so_far"] == pytest.approx(15 / 19)
    assert (r["expense_trend_delta_so_far"], r["expense_trend_ratio_so_far"]) == (-3.0, pytest.approx(8 / 11))
    assert (r["unique_categories_so_far"], r["month_total_expense_target"]) == (2, 39.0)
    assert s["2024-03"]["std_expense_so_far"] == 0.0


def test_training_rows_need_enough_transactions(clean_months):
    assert [r["YearMonth"] for r in M.forecast_dataset(clean_months, 15, 5).collect()] == ["2024-01"]


def test_latest_month_uses_the_last_day_seen(clean_months):
    r = M.latest_month_snapshot(clean_months, 15).first()
    assert (r["YearMonth"], r["snapshot_day"], r["has_snapshot"]) == ("2024-06", 6, True)
    assert r["avg_daily_expense_so_far"] == pytest.approx(40 / 6)
    assert r["expense_trend_delta_so_far"] == 40.0  # half-way day is 3
    cut = clean_months.filter("Date < '2024-06-01'")
    late = M.latest_month_snapshot(cut, 15).first()
    assert late["has_snapshot"] is False and late["total_expense_so_far"] is None


def test_outliers(spark):
    rows = [(f"2024-W{i:02d}", float(100 + i % 5), float(50 + i % 3), 0.3) for i in range(1, 30)]
    rows.append(("2024-W30", 9000.0, 9000.0, 0.3))
    df = spark.createDataFrame(rows, "YearWeek string, total_expense double, total_income double, category_entropy double")
    kept, removed = O.outlier_weeks(df, min_features=2)
    assert [r["YearWeek"] for r in removed.collect()] == ["2024-W30"]
    assert kept.count() == 29 and kept.columns == df.columns
    assert O.outlier_weeks(df)[1].count() == 0  # a zero spread never votes
    assert O.outlier_weeks(df.select("YearWeek"))[0].count() == 30
    assert [r["YearWeek"] for r in O.outlier_weeks(df, min_features=2, pooled=True)[1].collect()] == ["2024-W30"]
