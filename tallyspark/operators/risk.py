"""One explainable 0-100 risk score per entity from profile, anomaly and forecast."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.config import RiskConfig
from tallyspark.operators.anomaly import SCORE, AnomalyModel, score_weeks
from tallyspark.operators.cleaning import normalise_ledger, without_duplicates
from tallyspark.operators.clustering import LABEL
from tallyspark.operators.contracts import risk_level
from tallyspark.operators.forecast import PREDICTION, ForecastModel, forecast
from tallyspark.operators.monthly import latest_month_snapshot
from tallyspark.operators.prep import join_same
from tallyspark.operators.profiler import ProfilerModel, predict_profile
from tallyspark.operators.recent import recent_rows
from tallyspark.operators.weekly import weekly_category_long, weekly_features
from tallyspark.session import durable

DEFAULT_PROFILE = "genel_davranis_profili"
DEFAULT_CLUSTER_RISK = 0.50

# Weights of the cluster means in a cluster's raw risk.
CLUSTER_RISK_WEIGHTS = {
    "expense_to_income_ratio_mean": 0.28,
    "expense_volatility_ratio_mean": 0.20,
    "dominant_category_ratio_mean": 0.14,
    "weekend_expense_ratio_mean": 0.10,
    "zero_income_week_mean": 0.18,
}
TREND_COLUMN, TREND_WEIGHT = "expense_vs_rolling_mean_ratio_mean", 0.10

# The sentences of an explanation.
MESSAGES = {
    "profile": "Profil sinyali: %s (cluster=%s, norm=%s).",
    "severe": "Son hafta ciddi anomali içeriyor (score=%s, severe_threshold=%s).",
    "anomaly": "Son hafta anomali tespit edildi (score=%s, threshold=%s).",
    "calm": "Son hafta anomali baskısı düşük (norm=%s).",
    "budget": "Ay sonu tahmini harcama=%s, bütçe kullanım oranı=%s, budget overrun probability=%s.",
    "no_budget": "Bütçe verilmediği için forecast riski harcama temposuna göre yorumlandı (predicted_month_end_expense=%s).",
    "level": "Nihai risk seviyesi: %s.",
}


@dataclass(frozen=True)
class RiskModels:
    profiler: ProfilerModel
    anomaly: AnomalyModel
    forecaster: ForecastModel


def latest(df: DataFrame, key: str = "YearWeek", entity_cols: Sequence[str] = ()) -> DataFrame:
    """The last row of each entity; Spark keeps one row per task before the shuffle."""
    last = Window.partitionBy(*entity_cols).orderBy(F.desc(key))
    return df.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def cluster_risk_map(summary: DataFrame) -> DataFrame:
    """``cluster_label, profile_label, cluster_risk`` for k clusters, squeezed to 0.15-1."""

    def mean(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in summary.columns else F.lit(0.0)

    raw = TREND_WEIGHT * F.greatest(F.lit(0.0), mean(TREND_COLUMN) - 1.0)
    for name, weight in CLUSTER_RISK_WEIGHTS.items():
        raw = raw + weight * mean(name)
    every = Window.partitionBy()  # k rows
    low, high = F.min("raw").over(every), F.max("raw").over(every)
    same = (high - low) <= 1e-9 * F.greatest(F.abs(low), F.abs(high))
    place = F.when(same, F.lit(0.50)).otherwise((F.col("raw") - low) / F.nullif(high - low, F.lit(0.0)))
    squeezed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.15 + 0.85 * place))
    risk = F.when(F.count(F.lit(1)).over(every) == 1, F.lit(DEFAULT_CLUSTER_RISK)).otherwise(squeezed)
    label = F.col("profile_label") if "profile_label" in summary.columns else F.lit(DEFAULT_PROFILE)
    return summary.select(LABEL, label.alias("profile_label"), raw.alias("raw")).select(
        LABEL, "profile_label", risk.alias("cluster_risk")
    )


def with_cluster_risk(df: DataFrame, risk_map: DataFrame) -> DataFrame:
    """Label and risk of each row's cluster, with defaults. The map has k rows."""
    out = df.join(F.broadcast(risk_map), LABEL, "left")
    return out.withColumns(
        {
            "profile_label": F.coalesce("profile_label", F.lit(DEFAULT_PROFILE)),
            "cluster_risk": F.coalesce("cluster_risk", F.lit(DEFAULT_CLUSTER_RISK)),
        }
    )


def anomaly_norm(score: Column, threshold: Column, severe: Column) -> Column:
    """Piecewise 0-1 scale: up to .69 below the threshold, from .70 at it, 1 when severe."""
    t = F.greatest(threshold, F.lit(1e-9))
    s = F.greatest(severe, t + 1e-9)
    return (
        F.when(score <= 0, F.lit(0.0))
        .when(score < t, F.least(F.lit(0.69), score / t * 0.69))
        .when(score >= s, F.lit(1.0))
        .otherwise(F.least(F.lit(1.0), 0.70 + 0.30 * (score - t) / (s - t)))
    )


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def budget_risk(
    df: DataFrame,
    config: RiskConfig = RiskConfig(),
    budget: str = "budget",
    predicted: str = PREDICTION,
    spent: str = "total_expense_so_far",
    pace: str = "rolling_3m_expense_mean",
) -> DataFrame:
    """Budget columns and the forecast risk. A missing or negative budget counts as 0.

    Below the minimum budget the risk is the predicted pace against recent months.
    """
    b = F.greatest(F.coalesce(F.col(budget).cast("double"), F.lit(0.0)), F.lit(0.0))
    df = df.withColumn(budget, b)
    b, p = F.col(budget), F.col(predicted)
    funded = b >= config.min_budget
    usage = F.when(funded, p / F.nullif(b, F.lit(0.0))).otherwise(F.lit(0.0))
    df = df.withColumn("budget_usage_ratio", usage)
    chance = sigmoid((F.col("budget_usage_ratio") - 1.0) * config.sigmoid_sharpness)
    by_pace = F.when(F.col(pace) > 0, _unit(p / F.nullif(F.col(pace), F.lit(0.0)))).otherwise(F.lit(0.5))
    return df.withColumns(
        {
            "budget_remaining": F.when(funded, b - F.col(spent)).otherwise(F.lit(0.0)),
            "expected_overrun_amount": F.when(funded, F.greatest(F.lit(0.0), p - b)).otherwise(F.lit(0.0)),
            "budget_overrun_probability": F.when(funded, chance).otherwise(F.lit(0.0)),
            "forecast_risk": F.when(funded, _unit(chance)).otherwise(by_pace),
        }
    )


def risk_score(profile: Column, anomaly: Column, forecast_: Column, config: RiskConfig = RiskConfig()) -> Column:
    """Weighted sum of the three signals, each already rounded to four digits."""
    total = (
        config.profile_weight * profile
        + config.anomaly_weight * anomaly
        + config.forecast_weight * forecast_
    )
    return F.round(total * 100.0, 2)


def dominant_driver(profile: Column, anomaly: Column, forecast_: Column) -> Column:
    """The largest signal; equal signals rank profile, anomaly, forecast."""
    return (
        F.when((profile >= anomaly) & (profile >= forecast_), F.lit("profile"))
        .when(anomaly >= forecast_, F.lit("anomaly"))
        .otherwise(F.lit("forecast"))
    )


def number_text(c: Column) -> Column:
    """A rounded number as the sentences show it: plain digits, at least one decimal."""
    plain = F.regexp_replace(F.abs(c).cast("decimal(38,6)").cast("string"), r"(\.\d+?)0*$", "$1")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    millionths = F.round(F.abs(c) * 1e6).cast("long")
    tiny = F.when(millionths < 10, F.concat(millionths.cast("string"), F.lit("e-06"))).otherwise(
        F.concat(
            F.regexp_replace((millionths / 10).cast("decimal(5,1)").cast("string"), r"\.0$", ""), F.lit("e-05")
        )
    )
    return F.concat(sign, F.when((millionths > 0) & (millionths < 100), tiny).otherwise(plain))


def explanation(level: Column) -> Column:
    """Four sentences from the rounded component columns of ``risk_report``."""

    def say(key: str, *args: Column) -> Column:
        return F.format_string(MESSAGES[key], *args)

    week = (
        F.when(
            F.col("is_severe_anomaly"),
            say("severe", number_text(F.col(SCORE)), number_text(F.col("severe_anomaly_threshold"))),
        )
        .when(
            F.col("is_anomaly"),
            say("anomaly", number_text(F.col(SCORE)), number_text(F.col("anomaly_threshold"))),
        )
        .otherwise(say("calm", number_text(F.col("anomaly_risk_norm"))))
    )
    money = F.when(
        F.col("budget") > 0,
        say(
            "budget",
            number_text(F.col(PREDICTION)),
            number_text(F.col("budget_usage_ratio")),
            number_text(F.col("budget_overrun_probability")),
        ),
    ).otherwise(say("no_budget", number_text(F.col(PREDICTION))))
    return F.array(
        say(
            "profile",
            F.col("profile_label"),
            F.col("cluster_id").cast("string"),
            number_text(F.col("profile_risk_norm")),
        ),
        week,
        money,
        say("level", level),
    )


def fuse(df: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Add score, level, driver and explanation to the rounded component columns.

    An entity without a forecast keeps its row: score and level are null, ``status`` says why.
    """
    p, a, f = F.col("profile_risk_norm"), F.col("anomaly_risk_norm"), F.col("forecast_risk_norm")
    known = f.isNotNull()
    df = df.withColumn("risk_score", risk_score(p, a, f, config))
    level = risk_level(F.col("risk_score"), config.low_threshold, config.medium_threshold)
    return df.withColumns(
        {
            "risk_level": F.when(known, level),
            "dominant_driver": F.when(known, dominant_driver(p, a, f)),
            "explanation": F.when(known, explanation(level)),
            "status": F.when(known, F.lit("ok")).otherwise(F.lit("no snapshot in the latest month")),
        }
    )


def model_categories(models: RiskModels) -> list[str]:
    """Categories the models were fitted with, from their column names."""
    names = [*models.profiler.prep.columns, *models.anomaly.prep.columns]
    out = {n[4:-7] for n in names if n.startswith("cat_") and n.endswith("_amount")}
    return sorted(out | {n[4:-6] for n in names if n.startswith("cat_") and n.endswith("_ratio")})


def risk_components(
    clean: DataFrame,
    models: RiskModels,
    entity_cols: Sequence[str] = (),
    budgets: DataFrame | float | None = None,
    config: RiskConfig = RiskConfig(),
) -> DataFrame:
    """One row per entity with the flat, rounded columns of the three components.

    Weekly and monthly branches read the same duplicate-free shuffle output, which Spark
    plans once, and meet at one row per entity.
    """
    weeks = latest(
        weekly_features(clean, entity_cols, "profile", model_categories(models)), "YearWeek", entity_cols
    )
    categories = None
    if models.profiler.categories or models.anomaly.categories:
        # several passes follow: one row per entity and its categories are written once
        keys, weeks = [*entity_cols, "YearWeek"], durable(weeks)
        categories = durable(join_same(weekly_category_long(clean, entity_cols), weeks.select(*keys), keys))
    risks = cluster_risk_map(models.profiler.summary)
    per_cluster = risks.agg(
        F.map_from_entries(
            F.sort_array(
                F.collect_list(F.struct(F.col(LABEL).cast("string"), F.round("cluster_risk", 4)))
            )
        )
    )  # k rows
    profile = with_cluster_risk(predict_profile(weeks, models.profiler, entity_cols, categories), risks).select(
        *weeks.columns,
        F.col(LABEL).alias("cluster_id"),
        "profile_label",
        F.round("cluster_risk", 4).alias("profile_risk_norm"),
        per_cluster.scalar().alias("cluster_risk_map"),
    )
    am = models.anomaly
    signals = score_weeks(profile, am, 5, [*entity_cols, "YearWeek"], categories).select(
        *entity_cols,
        F.col("YearWeek").alias("year_week"),
        "cluster_id", "profile_label", "profile_risk_norm", "cluster_risk_map",
        F.round(SCORE, 6).alias(SCORE),
        F.round(F.lit(am.anomaly_threshold), 6).alias("anomaly_threshold"),
        F.round(F.lit(am.severe_threshold), 6).alias("severe_anomaly_threshold"),
        "is_anomaly", "is_severe_anomaly",
        F.round(
            anomaly_norm(F.col(SCORE), F.lit(am.anomaly_threshold), F.lit(am.severe_threshold)), 4
        ).alias("anomaly_risk_norm"),
        "top_feature_contributions",
    )
    fm = models.forecaster
    months = forecast(latest_month_snapshot(clean, fm.snapshot_day, entity_cols), fm)
    if isinstance(budgets, DataFrame):
        months = (
            join_same(months, budgets.select(*entity_cols, "budget"), entity_cols, "left")
            if entity_cols
            else months.withColumn("budget", budgets.select("budget").scalar())
        )
    else:
        months = months.withColumn("budget", F.lit(float(budgets or 0.0)))
    months = budget_risk(months, config)
    ok = F.col("has_snapshot")

    def rounded(c: str, digits: int, name: str | None = None) -> Column:
        return F.when(ok, F.round(c, digits)).alias(name or c)

    months = months.select(
        *entity_cols,
        F.col("YearMonth").alias("year_month"),
        F.lit(fm.snapshot_day).alias("model_snapshot_day"),
        F.col("snapshot_day").alias("effective_snapshot_day"),
        rounded("total_expense_so_far", 2, "spent_so_far"),
        rounded(PREDICTION, 2),
        F.round("budget", 2).alias("budget"),
        rounded("budget_remaining", 2),
        rounded("budget_usage_ratio", 4),
        rounded("expected_overrun_amount", 2),
        rounded("budget_overrun_probability", 4),
        rounded("forecast_risk", 4, "forecast_risk_norm"),
    )
    if entity_cols:
        return join_same(signals, months, entity_cols)
    # a single ledger: both sides are one row
    one = months.select(F.struct("*")).scalar()
    return signals.withColumn("_m", one).select(
        *signals.columns, *[F.col("_m")[c].alias(c) for c in months.columns]
    )


def risk_report(
    raw: DataFrame,
    models: RiskModels,
    entity_cols: Sequence[str] = (),
    budgets: DataFrame | float | None = None,
    config: RiskConfig = RiskConfig(),
    is_clean: bool = False,
) -> DataFrame:
    """Score raw ledgers: one row per entity with nested components.

    ``budgets`` is one amount for all or a frame of the entity columns and ``budget``. ``raw`` is read
    twice. A report is about the last week and month, whose columns look three weeks and three months
    back: older rows are left out before duplicates are removed, and the rest is written once.
    """
    rows = raw if is_clean else normalise_ledger(raw, entity_cols)
    rows = recent_rows(rows, entity_cols, months=4, weeks=4)
    clean = durable(rows if is_clean else without_duplicates(rows))
    fused = fuse(risk_components(clean, models, entity_cols, budgets, config), config)
    weights = F.struct(
        F.lit(config.profile_weight).alias("profile_weight"),
        F.lit(config.anomaly_weight).alias("anomaly_weight"),
        F.lit(config.forecast_weight).alias("forecast_weight"),
    )
    profile = F.struct("year_week", "cluster_id", "profile_label", "profile_risk_norm", "cluster_risk_map")
    anomaly = F.struct(
        "year_week", SCORE, "anomaly_threshold", "severe_anomaly_threshold", "is_anomaly",
        "is_severe_anomaly", "anomaly_risk_norm", "top_feature_contributions",
    )
    money = F.struct(
        "year_month", "model_snapshot_day", "effective_snapshot_day", "spent_so_far", PREDICTION, "budget",
        "budget_remaining", "budget_usage_ratio", "expected_overrun_amount", "budget_overrun_probability",
        "forecast_risk_norm",
    )
    return fused.select(
        *entity_cols, "risk_score", "risk_level", "dominant_driver", "status",
        weights.alias("weights"),
        F.struct(profile.alias("profile"), anomaly.alias("anomaly"), money.alias("forecast")).alias("components"),
        "explanation",
    )
