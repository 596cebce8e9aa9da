"""The registered queries: every operator over the whole test tables.

Averages of cents often end exactly between two rounded values, so results are nudged
before rounding here (and in the SQL), never in the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.config import AnomalyConfig, ForecastConfig, ProfilerConfig, RiskConfig
from tallyspark.functions.calendar import is_weekend, iso_year_week, with_calendar
from tallyspark.functions.numeric import numeric_columns
from tallyspark.operators import anomaly as A
from tallyspark.operators import categories as CAT
from tallyspark.operators import clustering as K
from tallyspark.operators import contracts as C
from tallyspark.operators import forecast as FC
from tallyspark.operators import kmeans as KM
from tallyspark.operators import monthly as M
from tallyspark.operators import outliers as O
from tallyspark.operators import prep as P
from tallyspark.operators import risk as R
from tallyspark.operators import weekly as W
from tallyspark.operators.cleaning import clean_ledger, split_flows
from tallyspark.operators.moments import Linear
from tallyspark.operators.profiler import ProfilerModel, fit_profiler
from tallyspark.plans.ledgers import dirty_ledger, event_ledger, order_ledger, order_ledgers, table
from tallyspark.session import durable, fresh_path
from tallyspark.sources.models import write_metrics
from tallyspark.sources.registry import model_registry, registry_violations, write_metadata

E = ["entity"]
KEY = ["entity", "YearWeek"]
NUDGE = {2: 0.0, 4: 1e-7, 6: 1e-9}

# Digits kept in results: money sums 2, averages of money 4, ratios 6.
MONEY = (
    "total_expense", "total_income", "max_expense", "min_expense", "weekend_expense", "weekday_expense",
    "net_cash_flow", "month_total_expense", "month_total_income", "prev_month_total_expense",
    "prev_2_month_total_expense", "expense_momentum", "total_expense_so_far", "max_expense_so_far",
    "total_income_so_far", "expense_trend_delta_so_far", "month_total_expense_target", "amount",
)
AVERAGES = (
    "avg_expense", "std_expense", "avg_transaction_value", "rolling_4w_expense_mean",
    "rolling_4w_income_mean", "rolling_3m_expense_mean", "rolling_3m_expense_std",
    "rolling_3m_income_mean", "avg_daily_expense_so_far", "avg_expense_so_far", "std_expense_so_far",
)

# Parameters of the fixed-model queries: five features, their scaling, three centres.
FIXED_PREP = P.Prep(
    ("total_expense", "total_income", "weekend_expense_ratio", "avg_transaction_value", "category_entropy"),
    (1200000.0, 600000.0, 0.28, 53000.0, 2.45),
    (300000.0, 250000.0, 0.1, 5000.0, 0.2),
)
FIXED_CENTROIDS = K.Centroids(
    FIXED_PREP.columns,
    ((-0.8, 0.6, 0.4, 0.2, -0.7), (0.1, -0.2, -0.5, -0.6, 0.3), (0.9, -0.1, 0.5, 0.7, 0.4)),
)
FIXED_THRESHOLD, FIXED_SEVERE = 2.5, 3.25
#: Scaling for the weeks of nations, which are smaller than those of segments.
NATION_PREP = P.Prep(FIXED_PREP.columns, (240000.0, 120000.0, 0.28, 53000.0, 2.1), (110000.0, 90000.0, 0.2, 8000.0, 0.5))
GIVEN_MOVES, GIVEN_LIMIT = 300, 1e-18
#: A forecaster of two features and scaling for customers' weeks, for the report with fixed models.
CUSTOMER_PREP = P.Prep(FIXED_PREP.columns, (35000.0, 12000.0, 0.28, 38000.0, 0.1), (25000.0, 25000.0, 0.45, 22000.0, 0.3))
SMALL_FEATURES = ("total_expense_so_far", "rolling_3m_expense_mean")
SMALL_CANDIDATES = ("baseline_linear", "ridge", "elasticnet")
FIXED_FORECAST = FC.ForecastModel(
    "ridge", 15, SMALL_FEATURES, FC.Preprocess(P.Prep(SMALL_FEATURES, (50000.0, 60000.0), (40000.0, 30000.0)), (45000.0, 55000.0)),
    Linear((36123.71, 10517.37), 70000.123),  # far from ties of cents
)
#: Three sets of starting centres for k-means: the fixed ones, drawn in, and mirrored.
GIVEN_STARTS = [[[v * f for v in c] for c in FIXED_CENTROIDS.centers] for f in (1.0, 0.5, -1.0)]
FORECAST_WEIGHT_SO_FAR, FORECAST_WEIGHT_HISTORY = 1.15, 0.45
LABELS = {"0": "saver", "2": "spender"}
DESCRIPTIONS = {"0": "spends little", "1": "spends as usual"}


def digits(name: str) -> int | None:
    if name in MONEY or name.endswith("_amount"):
        return 2
    return 4 if name in AVERAGES else 6


def rnd(c: Column, d: int = 6) -> Column:
    return F.round(c + F.lit(NUDGE[d]), d)


def rounded(df: DataFrame, overrides: Mapping[str, int] | None = None) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "double":
            c = rnd(c, (overrides or {}).get(f.name) or digits(f.name)).alias(f.name)
        out.append(c)
    return df.select(*out)


def orders(spark: SparkSession, d: str) -> DataFrame:
    return clean_ledger(order_ledger(spark, d), E)


def dirty(spark: SparkSession, d: str) -> DataFrame:
    return clean_ledger(dirty_ledger(spark, d), E, read_nulls=True)


def weeks(spark: SparkSession, d: str, variant: str = "profile") -> DataFrame:
    return W.weekly_features(orders(spark, d), E, variant)


def fixed_scores(spark: SparkSession, d: str) -> DataFrame:
    return A.anomaly_score(P.apply_prep(weeks(spark, d), FIXED_PREP), FIXED_CENTROIDS)


# cleaning -------------------------------------------------------------------------------


def q_clean_ledger(spark: SparkSession, d: str) -> DataFrame:
    return dirty(spark, d)


def q_true_income_split(spark: SparkSession, d: str) -> DataFrame:
    rows = split_flows(dirty(spark, d), "true").withColumn("AllCredit", F.when(F.col("Transaction Type") == "credit", F.col("Amount")).otherwise(F.lit(0.0)))
    return rounded(
        rows.groupBy("entity", "Category").agg(
            F.sum("Expense").alias("total_expense"),
            F.sum("Income").alias("true_income_amount"),
            F.sum("AllCredit").alias("credit_amount"),
            F.count_if(F.col("Income") > 0).alias("income_rows"),
        )
    )


def q_calendar_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("Date"))
    return with_calendar(rows)


def q_iso_week_key(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    rows = table(spark, d, "events").groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return rows.select("day", iso_year_week(F.col("day")).alias("YearWeek"), is_weekend(F.col("day")).alias("weekend"), "n")


# weekly ---------------------------------------------------------------------------------


def q_weekly_base(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weeks(spark, d).select(*KEY, *W.BASE_COLUMNS))


def q_weekly_ratios(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weeks(spark, d).select(*KEY, *W.RATIO_COLUMNS))


def q_weekly_single_ledger(spark: SparkSession, d: str) -> DataFrame:
    return rounded(W.weekly_features(clean_ledger(order_ledger(spark, d).drop("entity"))))


def q_weekly_events_by_user(spark: SparkSession, d: str) -> DataFrame:
    return rounded(W.weekly_features(clean_ledger(event_ledger(spark, d), E), E))


def q_weekly_anomaly_variant(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weeks(spark, d, "anomaly"))


def q_weekly_category_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(W.weekly_category_long(orders(spark, d), E))


def q_weekly_category_pivot(spark: SparkSession, d: str) -> DataFrame:
    names = [f"brand#{i}" for i in range(1, 26)]
    wide = W.weekly_features(orders(spark, d), E, "anomaly", names)
    cols = [*W.category_columns(names, "amount"), *W.category_columns(names, "ratio")]
    return rounded(wide.select(*KEY, *[F.col(f"`{c}`").alias(c.replace("#", "")) for c in cols]))


def q_weekly_concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weeks(spark, d).select(*KEY, *W.CONCENTRATION_COLUMNS))


def q_weekly_rolling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weeks(spark, d).select(*KEY, *W.ROLLING_COLUMNS))


# outliers, preparation ------------------------------------------------------------------


def q_outlier_weeks_kept(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = O.outlier_weeks(weeks(spark, d), entity_cols=E)
    return rounded(kept.select(*KEY, "total_expense", "total_income"))


def q_outlier_weeks_removed(spark: SparkSession, d: str) -> DataFrame:
    _, removed = O.outlier_weeks(weeks(spark, d), z=2.5, min_features=2, entity_cols=E)
    return removed.select(*KEY, F.col("outlier_feature_count").cast("long").alias("outlier_feature_count"))


def q_outlier_weeks_pooled(spark: SparkSession, d: str) -> DataFrame:
    frame = durable(weeks(spark, d))
    _, removed = O.outlier_weeks(frame, z=2.5, min_features=2, entity_cols=E, pooled=True)
    return removed.select(*KEY, F.col("outlier_feature_count").cast("long").alias("outlier_feature_count"))


def q_robust_stats(spark: SparkSession, d: str) -> DataFrame:
    cols = list(O.OUTLIER_COLUMNS)
    stats = O.with_robust_stats(weeks(spark, d), cols, E).select(
        "entity", *[f"_{k}_{c}" for c in cols for k in ("med", "mad")]
    )
    one = stats.groupBy("entity").agg(*[F.first(c).alias(c) for c in stats.columns if c != "entity"])
    return one.select(
        "entity",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        rnd(F.col(f"_med_{c}"), 4).alias("med"),
                        rnd(F.col(f"_mad_{c}"), 4).alias("mad"),
                    )
                    for c in cols
                ]
            )
        ),
    )


STAT_COLUMNS = (
    "total_transactions", "weekend_expense_ratio", "expense_frequency_ratio", "active_days",
    "dominant_category_ratio", "category_entropy", "expense_vs_rolling_mean_ratio",
)


def q_feature_variance(spark: SparkSession, d: str) -> DataFrame:
    stats = P.feature_stats(weeks(spark, d), STAT_COLUMNS)
    return rounded(stats.withColumn("selected", F.col("variance") > 0.01))


def q_numeric_feature_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every numeric column that the schema of the weeks shows."""
    frame = weeks(spark, d)
    stats = P.feature_stats(frame, numeric_columns(frame, KEY))
    return rounded(stats.select("feature", "n", "mean", F.sqrt("variance").alias("deviation")), {"mean": 4, "deviation": 4})


def q_category_feature_stats(spark: SparkSession, d: str) -> DataFrame:
    """Every category feature's statistics over all weeks, and its place among the selected ones."""
    clean = orders(spark, d)
    long = durable(W.weekly_category_long(clean, E))
    n = long.select(*KEY).distinct().count()
    prep = CAT.fit_categories(long, n, 0.01)
    places = prep.table.select("feature", F.col("place").cast("long").alias("place"))
    spread = F.sqrt("variance").alias("deviation")
    stats = CAT.category_stats(long, n).select("feature", "kind", "category", "n", "mean", spread)
    return rounded(stats.join(places, "feature", "left"), {"mean": 4, "deviation": 4})


def q_scaled_features(spark: SparkSession, d: str) -> DataFrame:
    frame = durable(weeks(spark, d))
    prep = P.fit_prep(frame, STAT_COLUMNS, 0.01)
    wide = P.scaled_columns(frame, prep, KEY)
    return rounded(wide.unpivot(KEY, list(prep.columns), "feature", "value"))


# scoring with a fixed model -------------------------------------------------------------


def q_assign_fixed_centroids(spark: SparkSession, d: str) -> DataFrame:
    return fixed_scores(spark, d).select(*KEY, K.LABEL)


def q_anomaly_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fixed_scores(spark, d).select(*KEY, A.SCORE))


def q_anomaly_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.fit_thresholds(durable(fixed_scores(spark, d).select(A.SCORE))))


def q_anomaly_flags(spark: SparkSession, d: str) -> DataFrame:
    return A.with_flags(fixed_scores(spark, d), FIXED_THRESHOLD, FIXED_SEVERE).select(
        *KEY, "is_anomaly", "is_severe_anomaly"
    )


def q_anomaly_score_stats(spark: SparkSession, d: str) -> DataFrame:
    flagged = A.with_flags(fixed_scores(spark, d), FIXED_THRESHOLD, FIXED_SEVERE)
    return rounded(A.score_stats(durable(flagged.select(A.SCORE, "is_anomaly", "is_severe_anomaly"))))


def q_top_contributions(spark: SparkSession, d: str) -> DataFrame:
    top = A.top_contributions(fixed_scores(spark, d), FIXED_CENTROIDS, 3)
    rows = top.select(*KEY, F.posexplode("top_feature_contributions").alias("pos", "c"))
    return rounded(rows.select(*KEY, "pos", "c.*"))


def q_top_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.top_anomalies(fixed_scores(spark, d).select(*KEY, A.SCORE), 10, KEY))


# clusters under a fixed labelling -------------------------------------------------------


def q_cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return K.cluster_sizes(fixed_scores(spark, d))


def q_cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    frame = durable(fixed_scores(spark, d).drop("features"))
    summary = K.cluster_summary(frame, 0.05)
    return rounded(summary, {c: 4 for c in summary.columns})


def q_cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    frame = durable(fixed_scores(spark, d).select(*KEY, K.LABEL, "features"))
    return rounded(K.cluster_quality(frame, KEY, len(FIXED_PREP.columns)))


def q_silhouette_nations(spark: SparkSession, d: str) -> DataFrame:
    """Both measures over a ledger of several thousand weeks: one entity a nation."""
    ledger = clean_ledger(order_ledger(spark, d, "c_nationkey"), E)
    frame = P.apply_prep(W.weekly_features(ledger, E), NATION_PREP)
    frame = durable(K.assign(frame, FIXED_CENTROIDS).select(*KEY, K.LABEL, "features"))
    both = [K.silhouette(frame, KEY, m).withColumn("measure", F.lit(m)) for m in ("euclidean", "squared")]
    return rounded(both[0].unionByName(both[1]))


def q_kmeans_restarts(spark: SparkSession, d: str) -> DataFrame:
    """k-means from given starts, to the end of each run."""
    frame = durable(P.apply_prep(weeks(spark, d), FIXED_PREP).select("features"))
    runs = KM.lloyd(frame, [np.array(s) for s in GIVEN_STARTS], GIVEN_MOVES, GIVEN_LIMIT)
    rows = [
        (r, c, i + 1, float(v), run.iterations, run.cost)
        for r, run in enumerate(runs) for c, center in enumerate(run.centers) for i, v in enumerate(center)
    ]
    found = spark.createDataFrame(rows, "run int, cluster int, feature long, value double, iterations int, cost double")
    return rounded(found, {"cost": 4})


def q_profile_labels(spark: SparkSession, d: str) -> DataFrame:
    """The rules over every user of the event ledger: many small groups stand in for clusters."""
    groups = (
        W.weekly_features(clean_ledger(event_ledger(spark, d), E), E)
        .groupBy("entity")
        .agg(F.count("*").alias("cluster_size"), *[F.avg(c).alias(f"{c}_mean") for c in K.SUMMARY_COLUMNS])
    )
    return groups.select("entity", K.profile_label(F.lit(40), 0.05).alias("profile_label"))


# monthly --------------------------------------------------------------------------------


def q_monthly_base(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.monthly_base(orders(spark, d), E))


def q_monthly_base_dirty(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.monthly_base(dirty(spark, d), E))


def q_month_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.month_snapshot(orders(spark, d), 15, E))


def q_forecast_dataset(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.forecast_dataset(dirty(spark, d), 10, 60, E))


def q_latest_month_snapshot(spark: SparkSession, d: str) -> DataFrame:
    by_customer = clean_ledger(order_ledger(spark, d, "o_custkey"), E)
    return rounded(M.latest_month_snapshot(by_customer, 15, E))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return FC.time_split(M.forecast_dataset(orders(spark, d), 15, 5, E))


def q_time_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("entity", "YearMonth", "position", "split")


def q_cv_folds(spark: SparkSession, d: str) -> DataFrame:
    train = _split(spark, d).filter("split = 'train'")
    return FC.fold_roles(train).select("entity", "YearMonth", "fold", "role")


def q_baseline_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FC.baseline_metrics(_split(spark, d)), {"rmse": 2, "mae": 2})


def q_metrics_sink(spark: SparkSession, d: str) -> DataFrame:
    """Metrics written as JSON lines and read back."""
    path = fresh_path(spark, "metrics")
    write_metrics(FC.baseline_metrics(_split(spark, d)), path)
    back = spark.read.schema("model string, split string, rmse double, mae double, r2 double").json(path)
    return rounded(back, {"rmse": 2, "mae": 2})


def naive_forecast() -> Column:
    """A forecast with fixed coefficients, for queries that must not depend on a fit."""
    return (
        FORECAST_WEIGHT_SO_FAR * F.col("total_expense_so_far")
        + FORECAST_WEIGHT_HISTORY * F.col("rolling_3m_expense_mean")
    )


def q_regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = M.forecast_dataset(orders(spark, d), 15, 5, E).withColumn(FC.PREDICTION, naive_forecast())
    return rounded(FC.regression_metrics(rows), {"rmse": 2, "mae": 2})


# risk -----------------------------------------------------------------------------------


def _risk_map(spark: SparkSession, d: str) -> DataFrame:
    scored = fixed_scores(spark, d)
    means = [*R.CLUSTER_RISK_WEIGHTS, R.TREND_COLUMN]
    summary = scored.groupBy(K.LABEL).agg(*[F.avg(m.removesuffix("_mean")).alias(m) for m in means])
    return R.cluster_risk_map(summary)


def q_cluster_risk_map(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_risk_map(spark, d))


def q_anomaly_norm(spark: SparkSession, d: str) -> DataFrame:
    norm = R.anomaly_norm(F.col(A.SCORE), F.lit(FIXED_THRESHOLD), F.lit(FIXED_SEVERE))
    return rounded(fixed_scores(spark, d).select(*KEY, norm.alias("anomaly_risk_norm")))


def _money(spark: SparkSession, d: str) -> DataFrame:
    """Latest month per customer, fixed-coefficient forecast, budget from the account balance."""
    by_customer = clean_ledger(order_ledger(spark, d, "o_custkey"), E)
    months = M.latest_month_snapshot(by_customer, 15, E).withColumn(FC.PREDICTION, naive_forecast())
    budgets = table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity"), (F.col("c_acctbal") * 10).alias("budget")
    )
    return R.budget_risk(R.join_same(months, budgets, E, "left"))


def q_budget_risk(spark: SparkSession, d: str) -> DataFrame:
    cols = [
        "budget", "budget_usage_ratio", "budget_remaining", "expected_overrun_amount",
        "budget_overrun_probability", "forecast_risk",
    ]
    status = F.when(F.col("has_snapshot"), "ok").otherwise("no snapshot in the latest month").alias("status")
    kept = [F.when(F.col("has_snapshot"), F.col(c)).alias(c) for c in cols]
    rows = _money(spark, d).select("entity", "YearMonth", *kept, status)
    return rounded(rows, {"budget": 2, "budget_remaining": 2, "budget_usage_ratio": 4, "expected_overrun_amount": 4})


def q_latest_week(spark: SparkSession, d: str) -> DataFrame:
    frame = W.weekly_features(clean_ledger(event_ledger(spark, d), E), E)
    return rounded(R.latest(frame, "YearWeek", E).select(*KEY, "total_expense", "rolling_4w_expense_mean"))


def q_risk_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Score, level, driver and sentences for every order, its amounts taken as signals."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    rows = o.select(
        "o_orderkey",
        F.lit("genel_davranis_profili").alias("profile_label"),
        (key % 3).alias("cluster_id"),
        ((key * 7 % 101) / F.lit(100.0)).alias("profile_risk_norm"),
        ((key * 11 % 101) / F.lit(100.0)).alias("anomaly_risk_norm"),
        F.when(key % 97 != 0, (key * 13 % 101) / F.lit(100.0)).alias("forecast_risk_norm"),
        F.round(F.col("o_totalprice") / 1000, 6).alias(A.SCORE),
        F.lit(200.5).alias("anomaly_threshold"),
        F.lit(350.25).alias("severe_anomaly_threshold"),
        (F.col("o_totalprice") / 1000 > 200.5).alias("is_anomaly"),
        (F.col("o_totalprice") / 1000 > 350.25).alias("is_severe_anomaly"),
        F.col("o_totalprice").alias(FC.PREDICTION),
        ((key % 4) * 1000).cast("double").alias("budget"),
        F.round((key % 50) / F.lit(40.0), 4).alias("budget_usage_ratio"),
        ((key * 17 % 101) / F.lit(100.0)).alias("budget_overrun_probability"),
    )
    fused = R.fuse(rows)
    lines = [F.col("explanation")[i].alias(f"line_{i + 1}") for i in range(4)]
    return fused.select("o_orderkey", "risk_score", "risk_level", "dominant_driver", "status", *lines)


def q_risk_report_fixed(spark: SparkSession, d: str) -> DataFrame:
    """The whole report for customers, by models whose parameters are given."""
    by_segment, by_customer = order_ledgers(spark, d, "c_mktsegment", "o_custkey")
    segment_weeks = W.weekly_features(clean_ledger(by_segment, E), E)
    scores = A.anomaly_score(P.apply_prep(segment_weeks, FIXED_PREP), FIXED_CENTROIDS)
    summary = K.cluster_summary(durable(scores.drop("features")), 0.05)
    profiler = ProfilerModel(CUSTOMER_PREP, FIXED_CENTROIDS, durable(summary), None, None)
    detector = A.AnomalyModel(CUSTOMER_PREP, FIXED_CENTROIDS, FIXED_THRESHOLD, FIXED_SEVERE)
    budgets = table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity"), (F.col("c_acctbal") * 10).alias("budget")
    )
    report = R.risk_report(by_customer, R.RiskModels(profiler, detector, FIXED_FORECAST), E, budgets)
    part = "components"
    return report.select(
        "entity", "risk_score", "risk_level", "dominant_driver", "status",
        *[F.col(f"{part}.profile.{c}") for c in ("year_week", "cluster_id", "profile_label", "profile_risk_norm")],
        *[F.col(f"{part}.anomaly.{c}") for c in (A.SCORE, "is_anomaly", "is_severe_anomaly", "anomaly_risk_norm")],
        *[
            F.col(f"{part}.forecast.{c}")
            for c in (
                "year_month", "effective_snapshot_day", "spent_so_far", FC.PREDICTION, "budget", "budget_remaining",
                "budget_usage_ratio", "expected_overrun_amount", "budget_overrun_probability", "forecast_risk_norm",
            )
        ],
    )


# contracts ------------------------------------------------------------------------------


def q_severity_labels(spark: SparkSession, d: str) -> DataFrame:
    return fixed_scores(spark, d).select(
        *KEY,
        C.anomaly_severity(F.col(A.SCORE), FIXED_THRESHOLD, FIXED_SEVERE).alias("severity"),
        C.anomaly_severity(F.col(A.SCORE), FIXED_THRESHOLD).alias("severity_without_severe"),
        C.anomaly_severity(F.col(A.SCORE)).alias("severity_default"),
    )


def q_risk_levels(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("o_orderkey") % 101
    return table(spark, d, "orders").select(
        "o_orderkey",
        C.risk_level(score).alias("risk_level"),
        C.risk_level(score, 25.0, 75.0).alias("risk_level_custom"),
    )


def q_label_lookup(spark: SparkSession, d: str) -> DataFrame:
    return fixed_scores(spark, d).select(
        *KEY,
        C.map_label(F.col(K.LABEL), LABELS).alias("label"),
        C.map_description(F.col(K.LABEL), DESCRIPTIONS).alias("description"),
    )


def q_registry_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Per-row thresholds from a joined model table: one model per order priority."""
    o = table(spark, d, "orders")
    models = o.groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.avg("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")
    )
    rows = o.select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("name"))
    joined = C.with_registry(rows, models)
    return joined.select(
        "o_orderkey",
        C.anomaly_severity(F.col("o_totalprice"), F.col("low"), F.col("high") * 0.9).alias("severity"),
        C.risk_level(F.col("o_totalprice"), F.col("low"), F.col("high") * 0.9).alias("risk_level"),
    )


def q_registry_scores(spark: SparkSession, d: str) -> DataFrame:
    """Model metadata as JSON files, thresholds from the scores, read as a table that judges the weeks."""
    scores = durable(fixed_scores(spark, d).select(*KEY, A.SCORE))
    low, high = scores.agg(F.round(F.avg(A.SCORE), 6), F.round(F.max(A.SCORE) * 0.8, 6)).first()
    folder = fresh_path(spark, "registry")
    write_metadata(spark, "anomaly", {"thresholds": {"anomaly_score_threshold": low, "severe_anomaly_score_threshold": high}}, folder)
    write_metadata(spark, "risk", {"risk_thresholds": {"low_threshold": 40, "medium_threshold": 70}}, folder)
    registry = model_registry(spark, folder)
    lacking = registry_violations(registry, ["thresholds"]).select("name", F.array_join("missing_keys", ",").alias("missing"))
    week = F.substring("YearWeek", 7, 2).cast("int")
    rows = scores.withColumn("name", F.when(week % 2 == 0, "anomaly").otherwise("risk"))
    judged = C.with_registry(rows, registry.select("name", "thresholds")).join(lacking, "name", "left")
    limits = F.col("thresholds")
    severity = C.anomaly_severity(F.col(A.SCORE), limits["anomaly_score_threshold"], limits["severe_anomaly_score_threshold"])
    return judged.select(*KEY, "name", severity.alias("severity"), "missing")


def q_feature_frame(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumn("c_acctbal", F.nullif(F.col("c_acctbal"), F.lit(0.0)))
    return C.feature_frame(rows, ["c_acctbal", "absent", "c_nationkey"], -1.0, ["c_custkey"])


def q_payload_violations(spark: SparkSession, d: str) -> DataFrame:
    """Each user's payload has one key per event type seen on a day."""
    daily = table(spark, d, "events").groupBy(
        "user_id", F.to_date("ts").alias("day"), "event_type"
    ).agg(F.sum("value").alias("v"))
    payload = daily.groupBy("user_id", "day").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("payload")
    )
    checked = C.payload_violations(payload, "payload", ["click", "view"], True, ["error"])
    return checked.select(
        "user_id", "day",
        F.array_join(F.sort_array("missing_features"), ",").alias("missing_features"),
        F.array_join(F.sort_array("extra_fields"), ",").alias("extra_fields"),
        "is_valid",
    )


# fits -----------------------------------------------------------------------------------

FIT_PROFILER = ProfilerConfig()
FIT_ANOMALY = AnomalyConfig()
FIT_FORECAST = ForecastConfig()


def _profiler(spark: SparkSession, d: str) -> ProfilerModel:
    """Fitted on weeks with all category features."""
    clean = orders(spark, d)
    return fit_profiler(W.weekly_features(clean, E), E, FIT_PROFILER, categories=W.weekly_category_long(clean, E))[0]


def q_kmeans_profiler(spark: SparkSession, d: str) -> DataFrame:
    """The chosen clusters' summary, beside the scope of the training."""
    model = _profiler(spark, d)
    scope = [F.lit(v).alias(c) for c, v in model.scope.first().asDict().items()]
    shown = rounded(model.summary, {c: 4 for c in model.summary.columns})
    return shown.select("*", *scope)


def q_profiler_evaluation(spark: SparkSession, d: str) -> DataFrame:
    model = _profiler(spark, d)
    measured = model.evaluation.drop("cluster_counts").withColumn("chosen", F.col("k") == model.centroids.k)
    return rounded(measured)


def q_kmeans_anomaly(spark: SparkSession, d: str) -> DataFrame:
    clean = orders(spark, d)
    long = W.weekly_category_long(clean, E)
    model, scored, _ = A.fit_anomaly(W.weekly_features(clean, E, "anomaly"), KEY, FIT_ANOMALY, long)
    return rounded(scored.select(*KEY, A.SCORE, K.LABEL, "is_anomaly", "is_severe_anomaly"))


def q_forecast_candidates(spark: SparkSession, d: str) -> DataFrame:
    data = durable(M.forecast_dataset(orders(spark, d), 15, 5, E))
    _, metrics, cv = FC.fit_forecaster(data, E, FIT_FORECAST)
    return metrics.join(cv, "model", "left")


def q_forecast_small(spark: SparkSession, d: str) -> DataFrame:
    """The three squared-loss candidates on two features: cross-validation, selection, refit and test."""
    data = M.forecast_dataset(orders(spark, d), 15, 5, E).select("entity", "YearMonth", M.MONTH, *SMALL_FEATURES, M.TARGET)
    model, metrics, cv = FC.fit_forecaster(data, E, FIT_FORECAST, SMALL_CANDIDATES)
    found = metrics.join(cv, "model", "left").withColumn("chosen", F.col("model") == model.name)
    return rounded(found, {c: 2 for c in ("rmse", "mae", "cv_rmse_mean", "cv_mae_mean")})


def q_risk_report(spark: SparkSession, d: str) -> DataFrame:
    """Models fitted on segments, customers scored against a budget of their own."""
    by_segment, by_customer = order_ledgers(spark, d, "c_mktsegment", "o_custkey")
    clean = durable(clean_ledger(by_segment, E))
    frame, long = durable(W.weekly_features(clean, E)), durable(W.weekly_category_long(clean, E))
    profiler, _, _ = fit_profiler(frame, E, FIT_PROFILER, categories=long)
    detector, _, _ = A.fit_anomaly(frame.select(*KEY, *W.weekly_columns("anomaly")), KEY, FIT_ANOMALY, long)
    data = durable(M.forecast_dataset(clean, 15, 5, E))
    forecaster, _, _ = FC.fit_forecaster(data, E, FIT_FORECAST)
    models = R.RiskModels(profiler, detector, forecaster)
    budgets = table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity"), (F.col("c_acctbal") * 10).alias("budget")
    )
    report = R.risk_report(by_customer, models, E, budgets)
    return report.select(
        "entity", "risk_score", "risk_level", "dominant_driver", "status",
        F.array_join("explanation", " ").alias("explanation"),
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}
