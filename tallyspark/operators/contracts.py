"""Feature and label contracts checked on schemas and on rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN_LABEL = "unknown_profile"
UNKNOWN_DESCRIPTION = "No description available."


def feature_frame(df: DataFrame, names: Sequence[str], fill: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``names`` in order. An absent column is filled; a present null stays null."""
    have = set(df.columns)
    cols = [F.col(f"`{n}`") if n in have else F.lit(fill).alias(n) for n in names]
    return df.select(*keep, *cols)


def validate_required(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing required features ({len(missing)}): {missing}")
    return df


def validate_no_extra(df: DataFrame, names: Sequence[str], ignore: Iterable[str] = ()) -> DataFrame:
    allowed = {*names, *ignore}
    extra = [c for c in df.columns if c not in allowed]
    if extra:
        raise ValueError(f"Unexpected extra fields ({len(extra)}): {extra}")
    return df


def validate(
    df: DataFrame, names: Sequence[str], reject_extras: bool = False, ignore: Iterable[str] = ()
) -> DataFrame:
    validate_required(df, names)
    return validate_no_extra(df, names, ignore) if reject_extras else df


def payload_violations(
    df: DataFrame,
    payload: str,
    names: Sequence[str],
    reject_extras: bool = False,
    ignore: Iterable[str] = (),
) -> DataFrame:
    """The same checks on a map column, row by row: the missing and the unexpected keys."""
    keys = F.map_keys(payload)
    wanted = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    allowed = F.array(*[F.lit(n) for n in dict.fromkeys([*names, *ignore])]).cast("array<string>")
    none = F.array().cast("array<string>")
    return df.withColumns(
        {
            "missing_features": F.array_except(wanted, keys),
            "extra_fields": F.array_except(keys, allowed) if reject_extras else none,
        }
    ).withColumn("is_valid", (F.size("missing_features") == 0) & (F.size("extra_fields") == 0))


def _lookup(key: Column, table: Mapping[str, str] | Column, default: str) -> Column:
    """``table`` is a fixed mapping or a map column, as a joined registry row has it."""
    if isinstance(table, Mapping):
        if not table:
            return F.lit(default)
        table = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key.cast("string")), F.lit(default))


def map_label(cluster: Column, table: Mapping[str, str] | Column, default: str = UNKNOWN_LABEL) -> Column:
    return _lookup(cluster, table, default)


def map_description(
    cluster: Column, table: Mapping[str, str] | Column, default: str = UNKNOWN_DESCRIPTION
) -> Column:
    return _lookup(cluster, table, default)


def _cut(value: float | Column | None, default: Column) -> Column:
    if value is None:
        return default
    return F.coalesce(value if isinstance(value, Column) else F.lit(float(value)), default)


def anomaly_severity(
    score: Column, anomaly: float | Column | None = None, severe: float | Column | None = None
) -> Column:
    """Strictly above a threshold. Missing: anomaly 0, severe the anomaly threshold."""
    low = _cut(anomaly, F.lit(0.0))
    high = _cut(severe, low)
    return (
        F.when(score > high, F.lit("severe_anomaly"))
        .when(score > low, F.lit("anomaly"))
        .otherwise(F.lit("normal"))
    )


def risk_level(
    score: Column, low: float | Column | None = None, medium: float | Column | None = None
) -> Column:
    """A score equal to a threshold belongs to the upper class. Missing: 40 and 70."""
    return (
        F.when(score < _cut(low, F.lit(40.0)), F.lit("LOW"))
        .when(score < _cut(medium, F.lit(70.0)), F.lit("MEDIUM"))
        .otherwise(F.lit("HIGH"))
    )


def with_registry(df: DataFrame, registry: DataFrame, on: str = "name") -> DataFrame:
    """Attach each row's model entry. No hint: Spark broadcasts the registry only while it is
    below its size limit, so one model per entity works as well as one for all."""
    return df.join(registry, on, "left")
