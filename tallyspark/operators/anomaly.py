"""Weekly anomaly scores: distance to the nearest cluster centre in scaled space."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tallyspark.config import AnomalyConfig
from tallyspark.functions.numeric import numeric_columns
from tallyspark.functions.quantiles import exact_quantiles
from tallyspark.operators.categories import CategoryPrep, apply_categories, fit_categories, with_wide
from tallyspark.operators.clustering import LABEL, assign, center, cluster_sizes
from tallyspark.operators.kmeans import Centroids, Rows, fit_restarts
from tallyspark.operators.prep import Prep, apply_prep, fit_prep, join_same
from tallyspark.session import durable

SCORE = "anomaly_score"


@dataclass(frozen=True)
class AnomalyModel:
    prep: Prep
    centroids: Centroids
    anomaly_threshold: float
    severe_threshold: float
    categories: CategoryPrep | None = None


def anomaly_score(df: DataFrame, centroids: Centroids, features: str = "features", width: int = 0) -> DataFrame:
    return assign(df, centroids, features, width).withColumnRenamed("nearest_distance", SCORE)


def fit_thresholds(
    scored: DataFrame, anomaly_percentile: float = 95, severe_percentile: float = 99
) -> DataFrame:
    """One row with both cut-offs, linearly interpolated between neighbouring scores."""
    q = exact_quantiles(scored, [SCORE], [anomaly_percentile / 100.0, severe_percentile / 100.0])
    return q.select(
        F.col(SCORE)[0].alias("anomaly_score_threshold"),
        F.col(SCORE)[1].alias("severe_anomaly_score_threshold"),
    )


def with_flags(scored: DataFrame, anomaly: Column | float, severe: Column | float) -> DataFrame:
    """Strictly above a cut-off counts."""
    return scored.withColumns(
        {"is_anomaly": F.col(SCORE) > anomaly, "is_severe_anomaly": F.col(SCORE) > severe}
    )


def score_stats(flagged: DataFrame) -> DataFrame:
    median = exact_quantiles(flagged, [SCORE], [0.5]).select(F.col(SCORE)[0]).scalar()
    return flagged.agg(
        F.min(SCORE).alias("score_min"),
        F.avg(SCORE).alias("score_mean"),
        F.max(SCORE).alias("score_max"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.count_if("is_severe_anomaly").alias("severe_anomaly_count"),
    ).withColumn("score_median", median)


def top_contributions(
    df: DataFrame, centroids: Centroids, n: int = 5, features: str = "features"
) -> DataFrame:
    """Add the ``n`` features farthest from the row's centre; equal distances by name."""
    names = F.array(*[F.lit(c) for c in centroids.columns])
    centers = F.array(*[center(c) for c in centroids.centers])
    triples = F.arrays_zip(
        names.alias("f"), F.col(features).alias("x"), F.element_at(centers, F.col(LABEL) + 1).alias("c")
    )
    # natural struct order: largest deviation first, then name
    keyed = F.transform(
        triples,
        lambda t: F.struct(
            (-F.abs(t["x"] - t["c"])).alias("o"), t["f"].alias("f"), t["x"].alias("x"), t["c"].alias("c")
        ),
    )
    best = F.transform(
        F.slice(F.sort_array(keyed), 1, n),
        lambda t: F.struct(
            t["f"].alias("feature"),
            (-t["o"]).alias("absolute_deviation"),
            t["x"].alias("sample_value_scaled"),
            t["c"].alias("centroid_value_scaled"),
        ),
    )
    return df.withColumn("top_feature_contributions", best)


def _wide_contributions(
    df: DataFrame, centroids: Centroids, prep: CategoryPrep, keys: Sequence[str], n: int, places: int = 2048
) -> DataFrame:
    """As ``top_contributions`` for rows with a wide part.

    Each row's largest deviations are picked in numpy, so many places at a time; the names, means
    and scales of their places come from a join.
    """
    centers, base, width = np.array(centroids.centers), len(centroids.columns), prep.width
    numbers = [StructField("place", IntegerType()), StructField("x", DoubleType()), StructField("c", DoubleType())]
    schema = StructType([*df.schema.fields, StructField("_top", ArrayType(StructType(numbers)))])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("place", pa.int32()), ("x", pa.float64()), ("c", pa.float64())]))
        for batch in batches:
            labels, top = batch.column(LABEL).to_numpy(zero_copy_only=False), []
            rows = Rows.of(batch, width)
            for at in range(0, len(rows), 256):
                block, mine = rows[at : at + 256], centers[labels[at : at + 256]]
                best = np.zeros((len(block), 0), int)
                dev, x = np.zeros((len(block), 0)), np.zeros((len(block), 0))
                for a in range(0, base + width, places):
                    part = block.dense(a, a + places)
                    spots = np.broadcast_to(np.arange(a, a + part.shape[1]), part.shape)
                    best, x = np.concatenate([best, spots], axis=1), np.concatenate([x, part], axis=1)
                    dev = np.concatenate([dev, np.abs(part - mine[:, a : a + places])], axis=1)
                    order = np.argsort(-dev, axis=1, kind="stable")[:, :n]  # equal ones by place
                    best, x, dev = (np.take_along_axis(v, order, 1) for v in (best, x, dev))
                for i in range(len(block)):
                    top.append([
                        {"place": int(p), "x": float(v), "c": float(mine[i, p])} for p, v in zip(best[i], x[i], strict=True)
                    ])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top, kind)], schema.names)

    spark = df.sparkSession
    own = spark.createDataFrame(list(enumerate(centroids.columns)), "place int, feature string")
    own = own.withColumns({"mean": F.lit(0.0), "scale": F.lit(1.0)})
    wide = prep.table.select((F.col("place") + base).alias("place"), "feature", "mean", "scale")
    named = own.unionByName(wide)
    picked = durable(df.mapInArrow(pick, schema))
    spots = picked.select(*keys, F.posexplode("_top").alias("rank", "t")).select(*keys, "rank", "t.*").join(named, "place")
    centred = F.col("mean") / F.col("scale")
    deviation = F.abs(F.col("x") - F.col("c")).alias("absolute_deviation")
    entry = F.struct(
        "feature", deviation, (F.col("x") - centred).alias("sample_value_scaled"), (F.col("c") - centred).alias("centroid_value_scaled")
    )
    ranked = spots.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", entry.alias("e")))).alias("_e"))
    joined = join_same(picked.drop("_top"), ranked, keys, "left")
    return joined.withColumn("top_feature_contributions", F.transform("_e", lambda t: t["e"])).drop("_e")


def score_weeks(
    weeks: DataFrame, model: AnomalyModel, top_n: int = 5, key_cols: Sequence[str] = ("YearWeek",),
    categories: DataFrame | None = None,
) -> DataFrame:
    """Weekly columns plus label, score, flags and contributions. A narrow plan, unless the model has
    category features; it then takes the weeks' long table and their key columns."""
    prepared, width = with_wide(apply_prep(weeks, model.prep), model.categories, key_cols, categories)
    scored = anomaly_score(prepared, model.centroids, width=width)
    flagged = with_flags(scored, model.anomaly_threshold, model.severe_threshold)
    if width:
        return _wide_contributions(flagged, model.centroids, model.categories, key_cols, top_n).drop("features", "idx", "val")
    return top_contributions(flagged, model.centroids, top_n).drop("features")


def top_anomalies(scored: DataFrame, n: int = 10, tie_break: Sequence[str] = ("YearWeek",)) -> DataFrame:
    return scored.orderBy(F.desc(SCORE), *tie_break).limit(n)


def fit_anomaly(
    weeks: DataFrame, key_cols: Sequence[str] = ("YearWeek",), config: AnomalyConfig = AnomalyConfig(),
    categories: DataFrame | None = None,
) -> tuple[AnomalyModel, DataFrame, DataFrame]:
    """(model, scored training weeks, one-row training metrics).

    ``categories`` is the long table of the same ledger: its amounts and shares join the features.
    """
    weeks = durable(weeks)
    n = weeks.count()
    if n < config.n_clusters:
        raise ValueError(f"{n} rows cannot form {config.n_clusters} clusters")
    prep = fit_prep(weeks, numeric_columns(weeks, key_cols), config.variance_threshold)
    prepared, wide, width = apply_prep(weeks, prep), None, 0
    if categories is not None:
        categories = durable(categories)
        wide = fit_categories(categories, n, config.variance_threshold)
        width = wide.width
        prepared = durable(apply_categories(prepared, categories, wide, key_cols))
    centroids = fit_restarts(
        prepared, prep.columns, [config.n_clusters], config.n_init, config.max_iter, config.seed, key_cols, width=width
    )[config.n_clusters]
    scored = anomaly_score(prepared, centroids, width=width)
    if width:
        scored = durable(scored)
    cut = fit_thresholds(scored, config.anomaly_percentile, config.severe_percentile).first()
    model = AnomalyModel(prep, centroids, cut[0], cut[1], wide)
    flagged = with_flags(scored, *cut)
    metrics = score_stats(flagged).withColumns(
        {
            "training_rows": F.lit(n),
            "anomaly_score_threshold": F.lit(cut[0]),
            "severe_anomaly_score_threshold": F.lit(cut[1]),
            "cluster_counts": cluster_sizes(scored)
            .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(LABEL, "cluster_size")))))
            .scalar(),
        }
    )
    return model, flagged.drop("features", "idx", "val"), metrics
