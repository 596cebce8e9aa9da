"""Spending profiles: outlier weeks out, prepare, choose k, describe the clusters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.config import ProfilerConfig
from tallyspark.functions.numeric import numeric_columns
from tallyspark.operators.categories import CategoryPrep, apply_categories, fit_categories, with_wide
from tallyspark.operators.clustering import Centroids, assign, cluster_summary, evaluate_ks
from tallyspark.operators.outliers import outlier_weeks
from tallyspark.operators.prep import Prep, apply_prep, fit_prep, join_same
from tallyspark.session import durable


@dataclass(frozen=True)
class ProfilerModel:
    """``summary`` and ``evaluation`` hold one row per cluster and per candidate k."""

    prep: Prep
    centroids: Centroids
    summary: DataFrame
    evaluation: DataFrame
    scope: DataFrame
    categories: CategoryPrep | None = None


def fit_profiler(
    weeks: DataFrame,
    entity_cols: Sequence[str] = (),
    config: ProfilerConfig = ProfilerConfig(),
    pooled_outliers: bool = False,
    categories: DataFrame | None = None,
) -> tuple[ProfilerModel, DataFrame, DataFrame]:
    """(model, labelled training weeks, removed weeks).

    ``categories`` is the long table of the same ledger (``weekly_category_long``): its amounts and
    shares join the features, however many categories there are.
    """
    keys = [*entity_cols, "YearWeek"]
    weeks = durable(weeks)
    if config.drop_outliers:
        kept, removed = outlier_weeks(
            weeks, config.outlier_z, config.outlier_min_features, entity_cols, pooled_outliers
        )
        kept, removed = durable(kept), removed.select(*keys)
    else:
        kept, removed = weeks, weeks.select(*keys).limit(0)
    before, after = weeks.count(), kept.count()
    prep = fit_prep(kept, numeric_columns(kept, keys), config.variance_threshold)
    prepared, wide, width = apply_prep(kept, prep), None, 0
    if categories is not None:
        mine = durable(join_same(categories, kept.select(*keys), keys, "left_semi"))
        wide = fit_categories(mine, after, config.variance_threshold)
        width = wide.width
        prepared = durable(apply_categories(prepared, mine, wide, keys))
    evaluation, centroids = evaluate_ks(prepared, keys, prep.columns, config, width)
    labelled = assign(prepared, centroids, width=width).drop("features", "idx", "val", "nearest_distance")
    summary = cluster_summary(labelled, config.min_cluster_ratio)
    summary = weeks.sparkSession.createDataFrame(summary.collect(), summary.schema)  # k rows
    scope = weeks.sparkSession.range(1).select(
        F.lit(before).alias("original_weekly_count"),
        F.lit(before - after).alias("removed_outlier_week_count"),
        F.lit(after).alias("final_training_weekly_count"),
    )
    return ProfilerModel(prep, centroids, summary, evaluation, scope, wide), labelled, removed


def predict_profile(
    weeks: DataFrame, model: ProfilerModel, entity_cols: Sequence[str] = (), categories: DataFrame | None = None
) -> DataFrame:
    """Add the cluster of each week. A model with category features takes the weeks' long table."""
    prepared, width = with_wide(apply_prep(weeks, model.prep), model.categories, [*entity_cols, "YearWeek"], categories)
    return assign(prepared, model.centroids, width=width).drop("features", "idx", "val", "nearest_distance")
