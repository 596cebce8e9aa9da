"""Exact interpolated quantiles of very large groups.

Spark's ``percentile`` keeps every distinct value of a group in one task. That is fine
for the weeks of one entity, not for all weeks of all entities. Here a mergeable sketch
brackets each quantile first. The values inside the bracket, a few in ten thousand, are
counted by buckets of equal width, and only those of the one or two buckets that hold the
rank are put in order. The rank is exact because everything below is counted. There is one
path for every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per group: ``by`` and, for each column, an ``array<double>`` of quantiles.

    ``by`` must have few distinct values (cluster ids); per-entity medians belong in a
    window instead. NaN counts as missing. A group without a value in a column keeps its row,
    with null quantiles, and a null key is a group like any other. ``df`` is read twice, so
    pass a persisted or written frame.
    """
    vals = df.select(
        *by, *[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(c) for c in columns]
    )
    margin = 5.0 / accuracy
    edges = [e for p in probs for e in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = vals.groupBy(*by).agg(
        *[
            F.struct(
                F.count(F.col(f"`{c}`")).alias("n"),
                F.percentile_approx(F.col(f"`{c}`"), edges, accuracy).alias("edges"),
            ).alias(f"_s{i}")
            for i, c in enumerate(columns)
        ]
    )
    if by:
        held = _same(vals, sketch, by)
        spec = {i: F.col(f"_s{i}") for i in range(len(columns))}
    else:
        row = sketch.select(F.struct("*")).scalar()
        held = vals.withColumn("_s", row)
        spec = {i: F.col(f"_s._s{i}") for i in range(len(columns))}

    marks = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        for j in range(len(probs)):
            # below ``accuracy`` values the bracket may be narrower than a rank: take them all
            few = spec[i]["n"] <= accuracy
            lo, hi = spec[i]["edges"][2 * j], spec[i]["edges"][2 * j + 1]
            part = F.when(few | (hi <= lo), 0).otherwise(
                F.least(F.lit(BUCKETS - 1), F.floor((x - lo) / (hi - lo) * BUCKETS))
            )
            marks.append(
                F.when(
                    few & x.isNotNull() | (x <= hi),
                    F.struct(
                        F.lit(i).alias("i"), F.lit(j).alias("j"), spec[i]["n"].alias("n"),
                        # what lies below the bracket is only counted
                        F.when(few | (x >= lo), part.cast("int")).otherwise(-1).alias("part"),
                        F.when(few | (x >= lo), x).alias("x"),
                    ),
                )
            )
    counted = (
        held.select(*by, F.inline(F.array_compact(F.array(*marks))))
        .groupBy(*by, "i", "j", "n", "part", "x")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    h = F.lit(0.0)
    for j, p in enumerate(probs):
        h = F.when(F.col("j") == j, (F.col("n") - 1) * F.lit(float(p))).otherwise(h)
    at = [*by, "i", "j"]
    upto = F.sum("m").over(Window.partitionBy(*at).orderBy("part"))
    # at most BUCKETS + 1 rows for a group, column and quantile
    parts = counted.groupBy(*at, "n", "part").agg(F.sum("m").alias("m")).withColumns({"h": h, "upto": upto})
    wanted = parts.where(
        (F.col("part") >= 0) & (F.col("upto") > F.floor("h")) & (F.col("upto") - F.col("m") <= F.ceil("h"))
    ).select(*at, "part", "h", (F.col("upto") - F.col("m")).alias("before"))
    inner = _same(counted.drop("n"), wanted, [*at, "part"])
    upto = F.col("before") + F.sum("m").over(Window.partitionBy(*at, "part").orderBy("x"))
    picked = inner.withColumn("upto", upto).groupBy(*at).agg(
        F.first("h").alias("h"),
        F.min(F.when(F.col("upto") > F.floor("h"), F.col("x"))).alias("v0"),
        F.min(F.when(F.col("upto") > F.ceil("h"), F.col("x"))).alias("v1"),
    )
    value = F.col("v0") + (F.col("h") - F.floor("h")) * (F.col("v1") - F.col("v0"))
    values = picked.select(*by, "i", "j", value.alias("v"))
    found = values.groupBy(*by).agg(
        *[
            F.array(
                *[
                    F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v")))
                    for j in range(len(probs))
                ]
            ).alias(c)
            for i, c in enumerate(columns)
        ]
    )
    # groups none of whose columns has a value
    return _same(sketch.select(*by), found, by, "left") if by else found


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which a null equals a null."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"_{k}" for k in keys])


def exact_medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """As ``exact_quantiles`` for the median, one double per column."""
    q = exact_quantiles(df, columns, [0.5], by)
    return q.select(*by, *[F.col(f"`{c}`")[0].alias(c) for c in columns])
