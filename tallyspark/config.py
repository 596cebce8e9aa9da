"""Tunable parameters. The defaults are fixed values of the service."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ProfilerConfig:
    variance_threshold: float = 0.01
    candidate_ks: tuple[int, ...] = (3, 4)
    min_cluster_ratio: float = 0.05
    drop_outliers: bool = True
    outlier_min_features: int = 3
    outlier_z: float = 3.5
    n_init: int = 40
    max_iter: int = 800
    seed: int = 42
    silhouette_measure: str = "euclidean"  # or "squared": one pass, for many rows


@dataclass(frozen=True)
class AnomalyConfig:
    n_clusters: int = 2
    variance_threshold: float = 0.01
    anomaly_percentile: float = 95
    severe_percentile: float = 99
    n_init: int = 20
    max_iter: int = 500
    seed: int = 42


@dataclass(frozen=True)
class ForecastConfig:
    snapshot_day: int = 15
    min_month_transactions: int = 5
    train_ratio: float = 0.70
    valid_ratio: float = 0.15
    n_splits: int = 3
    seed: int = 42
    ridge_alpha: float = 3.0
    elastic_alpha: float = 0.05
    elastic_l1_ratio: float = 0.3
    huber_epsilon: float = 1.35
    huber_alpha: float = 0.0001
    forest_trees: int = 150
    forest_depth: int = 4
    forest_min_leaf: int = 2


@dataclass(frozen=True)
class RiskConfig:
    profile_weight: float = 0.35
    anomaly_weight: float = 0.25
    forecast_weight: float = 0.40
    low_threshold: float = 40.0
    medium_threshold: float = 70.0
    sigmoid_sharpness: float = 6.0
    min_budget: float = 1.0
