"""Category features of any number, as sparse parts of the weeks' rows.

Every category gives two features, its amount in a week and its share of the week's expense, zero
in weeks without it. They are never laid out as columns. Statistics come from a grouped pass over the
long table (week, category), the zeros added by count; selected features get dense places by a
range-partitioned sort; and a week's row holds the places and scaled values of the categories it
has. New weeks are matched by category name; unknown categories are left out, absent ones are zero.

Scaled values here are not centred: ``x / scale``. Distances between rows and centres are the same,
and zeros stay zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.prep import join_same
from tallyspark.session import durable

KINDS = ("amount", "ratio")


@dataclass(frozen=True)
class CategoryPrep:
    """``table`` has one row per selected feature: kind, category, feature, place, mean, scale.
    ``width`` is their number."""

    table: DataFrame
    width: int


def _values(long: DataFrame) -> DataFrame:
    """(.., category, kind, value) of the long table, missing and infinite values as 0."""
    pairs = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.when(F.abs(F.col(k)) < float("inf"), F.col(k)).otherwise(F.lit(0.0)).alias("value"))
        for k in KINDS
    ])
    keys = [F.col(f"`{c}`") for c in long.columns if c not in KINDS]
    return long.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.kind", "p.value")


def feature_name(kind: str = "kind", category: str = "category"):
    return F.concat(F.lit("cat_"), F.col(category), F.lit("_"), F.col(kind))


def category_stats(long: DataFrame, n_rows: int) -> DataFrame:
    """(kind, category, feature, n, mean, variance) over ``n_rows`` weeks, most of them without the category.

    The population variance with the zeros follows from count, mean and spread of the others. A
    category of many weeks folds on the map side.
    """
    seen = _values(long).groupBy("kind", "category").agg(
        F.count("value").alias("c"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    share = F.col("c") / F.lit(n_rows)
    return seen.select(
        "kind", "category", feature_name().alias("feature"), F.lit(n_rows).cast("long").alias("n"),
        (share * F.col("m")).alias("mean"),
        (share * F.col("v") + share * (1 - share) * F.col("m") * F.col("m")).alias("variance"),
    )


def with_places(rows: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """``rows`` with dense numbers from 0 in ``order``, without a single task that sees them all.

    Rows are sorted by ranges; each range is numbered alone, and its offset is the sum of the
    ranges before it, a table of one row per range.
    """
    ranged = durable(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", before.alias("_offset"))
    numbered = ranged.withColumn("_within", within).join(F.broadcast(offsets), "_range")  # as many rows as ranges
    return numbered.withColumn(name, (F.col("_offset") + F.col("_within")).cast("int")).drop("_range", "_within", "_offset")


def fit_categories(long: DataFrame, n_rows: int, threshold: float | None = None) -> CategoryPrep:
    """The category features whose population variance exceeds ``threshold``, with places and scales."""
    stats = category_stats(long, n_rows)
    kept = stats if threshold is None else stats.where(F.col("variance") > threshold)
    scale = F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(F.lit(1.0))
    kept = kept.select("kind", "category", "feature", "mean", scale.alias("scale"))
    table = durable(with_places(kept, ["kind", "category"]))
    return CategoryPrep(table, table.count())


def apply_categories(weeks: DataFrame, long: DataFrame, prep: CategoryPrep, keys: Sequence[str]) -> DataFrame:
    """``weeks`` with the arrays ``idx`` and ``val`` of their selected category features."""
    spots = _values(long).join(prep.table.select("kind", "category", "place", "scale"), ["kind", "category"])
    spot = F.struct("place", (F.col("value") / F.col("scale")).alias("value"))
    packed = spots.where("value <> 0").groupBy(*keys).agg(F.sort_array(F.collect_list(spot)).alias("_spots"))
    joined = join_same(weeks, packed, keys, "left")
    places, values = F.transform("_spots", lambda s: s["place"]), F.transform("_spots", lambda s: s["value"])
    return joined.withColumns(
        {
            "idx": F.coalesce(places, F.expr("CAST(array() AS ARRAY<INT>)")),
            "val": F.coalesce(values, F.expr("CAST(array() AS ARRAY<DOUBLE>)")),
        }
    ).drop("_spots")


def with_wide(
    prepared: DataFrame, prep: CategoryPrep | None, keys: Sequence[str], long: DataFrame | None
) -> tuple[DataFrame, int]:
    """Prepared weeks with the wide part that a model asks for, and its width."""
    if prep is None:
        return prepared, 0
    if long is None:
        raise ValueError("the model has category features: pass the long table of the weeks")
    return apply_categories(prepared, long, prep, keys), prep.width
