"""Feature selection and scaling with population statistics."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Prep:
    """Selected columns in order with their centre and scale."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a missing key matches a missing key, so that no row is lost."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"_{k}" for k in keys])


def unpivoted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, value`` rows. Grouped aggregates over them keep their code small however
    wide the model is, and shuffle one row per column and task."""
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(
        [], [F.col(f"`{c}`") for c in columns], "feature", "value"
    )


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, mean, population variance."""
    return unpivoted(df, columns).groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance")
    )


def deviation(n: int, mean: float, variance: float) -> float:
    """Standard deviation, or 1 when the column is constant up to rounding."""
    eps = sys.float_info.epsilon
    constant = variance <= n * eps * variance + (n * mean * eps) ** 2
    return 1.0 if constant else variance**0.5


def fit_prep(df: DataFrame, columns: Sequence[str], variance_threshold: float | None = None) -> Prep:
    """Columns whose population variance exceeds the threshold, with scaling parameters.

    Only one row per column reaches the driver.
    """
    stats = {r["feature"]: r for r in feature_stats(df, columns).collect()}
    if not stats or all(r["n"] == 0 for r in stats.values()):
        raise ValueError("no rows to fit on")
    keep = [c for c in columns if variance_threshold is None or stats[c]["variance"] > variance_threshold]
    if not keep:
        raise ValueError(f"no feature has a variance above {variance_threshold}")
    return Prep(
        tuple(keep),
        tuple(stats[c]["mean"] for c in keep),
        tuple(deviation(stats[c]["n"], stats[c]["mean"], stats[c]["variance"]) for c in keep),
    )


def number(x: float) -> str:
    """A double as SQL text, exactly."""
    return f"{float(x)!r}D"


def scaled(df: DataFrame, prep: Prep) -> list[str]:
    """SQL of the scaled columns, aligned by name: an absent column counts as 0, extras are
    ignored. One text per column, because a call per operator adds up in a wide model."""
    have = set(df.columns)
    out = []
    for name, mean, scale in zip(prep.columns, prep.mean, prep.scale, strict=True):
        x = f"coalesce(CAST(`{name}` AS DOUBLE), 0D)" if name in have else "0D"
        z = f"({x} - ({number(mean)})) / ({number(scale)})"
        out.append(f"CASE WHEN abs({z}) < double('infinity') THEN {z} ELSE 0D END")
    return out


def apply_prep(df: DataFrame, prep: Prep, output: str = "features") -> DataFrame:
    """Add the scaled features as one ``array<double>``."""
    return df.withColumn(output, F.expr(f"array({', '.join(scaled(df, prep))})"))


def scaled_columns(df: DataFrame, prep: Prep, keep: Sequence[str] = ()) -> DataFrame:
    """The scaled features as named columns next to ``keep``."""
    named = [F.expr(e).alias(c) for e, c in zip(scaled(df, prep), prep.columns, strict=True)]
    return df.select(*keep, *named)
