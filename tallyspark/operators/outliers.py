"""Weeks that lie far off their entity's own habit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.quantiles import exact_medians

# The features that vote.
OUTLIER_COLUMNS = (
    "total_expense", "total_income", "expense_to_income_ratio", "weekend_expense_ratio",
    "avg_transaction_value", "expense_frequency_ratio", "expense_volatility_ratio",
    "dominant_category_ratio", "category_entropy", "top2_category_ratio_sum",
    "expense_vs_rolling_mean_ratio",
)
MAD_SCALE = 0.6745


def with_robust_stats(
    weeks: DataFrame, columns: Sequence[str], entity_cols: Sequence[str] = (), pooled: bool = False
) -> DataFrame:
    """Add ``_med_<c>`` and ``_mad_<c>``.

    Per entity the statistics are window medians: the weekly frame is already partitioned
    by entity, so they add no shuffle. ``pooled`` takes them over all entities at once.
    """
    med = {c: f"_med_{c}" for c in columns}
    if not pooled:
        own = Window.partitionBy(*entity_cols)
        out = weeks.withColumns({med[c]: F.median(c).over(own) for c in columns})
        return out.withColumns(
            {f"_mad_{c}": F.median(F.abs(F.col(c) - F.col(med[c]))).over(own) for c in columns}
        )
    centre = exact_medians(weeks, columns).select(F.struct("*")).scalar()
    out = weeks.withColumn("_c", centre).withColumns({med[c]: F.col("_c")[c] for c in columns}).drop("_c")
    spread = exact_medians(
        out.select(*[F.abs(F.col(c) - F.col(med[c])).alias(c) for c in columns]), columns
    )
    return (
        out.withColumn("_c", spread.select(F.struct("*")).scalar())
        .withColumns({f"_mad_{c}": F.col("_c")[c] for c in columns})
        .drop("_c")
    )


def robust_z(c: str) -> Column:
    mad = F.col(f"_mad_{c}")
    return F.when(mad != 0, MAD_SCALE * (F.col(c) - F.col(f"_med_{c}")) / mad).otherwise(F.lit(0.0))


def with_outlier_count(
    weeks: DataFrame, z: float = 3.5, entity_cols: Sequence[str] = (), pooled: bool = False
) -> DataFrame:
    columns = [c for c in OUTLIER_COLUMNS if c in weeks.columns]
    if not columns:
        return weeks.withColumn("outlier_feature_count", F.lit(0))
    stats = with_robust_stats(weeks, columns, entity_cols, pooled)
    votes = reduce(add, [(F.abs(robust_z(c)) > z).cast("int") for c in columns])
    return stats.select(*weeks.columns, votes.alias("outlier_feature_count"))


def outlier_weeks(
    weeks: DataFrame,
    z: float = 3.5,
    min_features: int = 3,
    entity_cols: Sequence[str] = (),
    pooled: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(kept weeks, removed weeks). Removed weeks keep their vote count."""
    voted = with_outlier_count(weeks, z, entity_cols, pooled)
    out = F.col("outlier_feature_count") >= min_features
    return voted.filter(~out).drop("outlier_feature_count"), voted.filter(out)
