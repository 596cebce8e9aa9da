"""Guarded arithmetic."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` where ``den`` is positive, else 0 (also for a null ``den``)."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def finite_or_zero(c: Column) -> Column:
    """0 for null, NaN (which Spark orders above infinity) and both infinities."""
    return F.when(F.abs(c) < float("inf"), c).otherwise(F.lit(0.0))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the numeric columns in order; an error when there is none."""
    skip = set(exclude)
    names = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
    if not names:
        raise ValueError("no numeric feature column")
    return names


def clean_numeric(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Replace null, NaN and infinities by 0 in every numeric column."""
    skip = set(exclude)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in skip or not isinstance(f.dataType, T.NumericType):
            out.append(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(finite_or_zero(c).alias(f.name))
        else:
            out.append(F.coalesce(c, F.lit(0).cast(f.dataType)).alias(f.name))
    return df.select(*out)
