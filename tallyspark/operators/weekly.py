"""Weekly features per entity.

The ledger is read once. Rows fold into *cells*, one per (entity, week, category), with
map-side partial aggregates, so the shuffle carries cells and a hot entity or category
collapses before it moves. Everything after works on cells or weeks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.calendar import is_weekend, iso_year_week, week_start
from tallyspark.functions.numeric import clean_numeric, safe_ratio
from tallyspark.functions.text import slug, slug_text
from tallyspark.operators.cleaning import require_columns, split_flows

WEEK = "WeekStart"
INPUT_COLUMNS = ("Date", "Amount", "Signed Amount", "Transaction Type", "Category")

BASE_COLUMNS = (
    "total_transactions", "total_expense", "total_income", "avg_expense", "max_expense", "min_expense",
    "std_expense", "expense_transaction_count", "income_transaction_count", "active_days",
    "unique_categories", "weekend_expense", "weekday_expense", "net_cash_flow",
)
RATIO_COLUMNS = (
    "expense_to_income_ratio", "weekend_expense_ratio", "weekday_expense_ratio", "avg_transaction_value",
    "expense_frequency_ratio", "income_presence_ratio", "expense_volatility_ratio", "active_days_ratio",
    "zero_income_week",
)
CONCENTRATION_COLUMNS = ("dominant_category_ratio", "category_entropy", "top2_category_ratio_sum")
ROLLING_COLUMNS = (
    "rolling_4w_expense_mean", "rolling_4w_income_mean", "expense_vs_rolling_mean_ratio",
    "income_vs_rolling_mean_ratio",
)
PROFILE_ONLY = (
    "active_days", "unique_categories", "income_presence_ratio", "expense_volatility_ratio",
    "active_days_ratio", "zero_income_week", *CONCENTRATION_COLUMNS, *ROLLING_COLUMNS,
)


def category_columns(categories: Sequence[str], kind: str) -> list[str]:
    """Wide column names; categories that share a name share a column."""
    return [f"cat_{c}_{kind}" for c in dict.fromkeys(slug_text(c) for c in categories)]


def weekly_columns(variant: str, categories: Sequence[str] = ()) -> list[str]:
    names = [
        *BASE_COLUMNS, *RATIO_COLUMNS, *category_columns(categories, "amount"),
        *category_columns(categories, "ratio"), *CONCENTRATION_COLUMNS, *ROLLING_COLUMNS,
    ]
    if variant == "profile":
        return names
    if variant == "anomaly":
        return [n for n in names if n not in PROFILE_ONLY]
    raise ValueError(f"variant must be 'profile' or 'anomaly', not {variant!r}")


def list_categories(ledger: DataFrame, limit: int = 5000) -> list[str]:
    """The category names of a ledger, for the wide model input.

    A model this wide is refused rather than cut; the long table has no such bound.
    """
    rows = ledger.select(slug(F.col("Category")).alias("c")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories: use weekly_category_long")
    return sorted(r["c"] for r in rows)


def weekly_cells(ledger: DataFrame, entity_cols: Sequence[str] = ()) -> DataFrame:
    """Partial aggregates per (entity, week, category).

    Names that differ only in spelling (``a b``, ``a_b``) fall into one cell; ``names`` counts them.
    """
    rows = split_flows(require_columns(ledger, [*entity_cols, *INPUT_COLUMNS]), "all")
    spent, weekend = F.col("Expense") > 0, is_weekend(F.col("Date"))
    spend = F.when(spent, F.col("Expense"))
    cells = rows.groupBy(*entity_cols, week_start(F.col("Date")).alias(WEEK), F.col("Category").alias("name")).agg(
        F.count("Amount").alias("n"),
        F.sum("Expense").alias("expense"),
        F.sum("Income").alias("income"),
        F.count_if(spent).alias("n_expense"),
        F.count_if(F.col("Income") > 0).alias("n_income"),
        F.avg(spend).alias("mean_expense"),
        (F.var_pop(spend) * F.count(spend)).alias("m2_expense"),
        F.max("Expense").alias("max_expense"),
        F.min(spend).alias("min_expense"),
        F.sum(F.when(weekend, F.col("Expense")).otherwise(F.lit(0.0))).alias("weekend"),
        F.sum(F.when(~weekend, F.col("Expense")).otherwise(F.lit(0.0))).alias("weekday"),
        # seven bits, one per weekday: distinct days without a distinct aggregate
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.weekday("Date"))).alias("days"),
    )
    n, one = F.sum("n_expense"), F.count(F.lit(1)) == 1
    mean = F.sum(F.col("mean_expense") * F.col("n_expense")) / F.nullif(n, F.lit(0))
    around = F.sum(F.col("m2_expense") + F.col("n_expense") * F.col("mean_expense") * F.col("mean_expense")) - n * mean * mean
    # dealt by week already, as the windows over these cells need it
    return cells.repartition(*entity_cols, WEEK).groupBy(*entity_cols, WEEK, slug(F.col("name")).alias("category")).agg(
        F.sum("n").alias("n"),
        F.sum("expense").alias("expense"),
        F.sum("income").alias("income"),
        n.alias("n_expense"),
        F.sum("n_income").alias("n_income"),
        F.when(one, F.first("mean_expense")).otherwise(mean).alias("mean_expense"),
        F.when(one, F.first("m2_expense")).otherwise(F.greatest(around, F.lit(0.0))).alias("m2_expense"),
        F.max("max_expense").alias("max_expense"),
        F.min("min_expense").alias("min_expense"),
        F.sum("weekend").alias("weekend"),
        F.sum("weekday").alias("weekday"),
        F.bit_or("days").alias("days"),
        F.count("name").alias("names"),
    )


def _ranked_cells(cells: DataFrame, entity_cols: Sequence[str]) -> DataFrame:
    """Cells with their week's totals and the category's rank, from one sort per week."""
    week = Window.partitionBy(*entity_cols, WEEK)
    ranked = week.orderBy(F.desc("expense"), "category")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cells.withColumns(
        {
            "week_expense": F.sum("expense").over(whole),
            "week_mean": F.sum("expense").over(whole) / F.nullif(F.sum("n_expense").over(whole), F.lit(0)),
            "rank": F.row_number().over(ranked),
        }
    ).withColumn("ratio", safe_ratio(F.col("expense"), F.col("week_expense")))


def weekly_category_long(ledger: DataFrame, entity_cols: Sequence[str] = ()) -> DataFrame:
    """One row per (entity, week, category): amount and share of the week's expense."""
    return _ranked_cells(weekly_cells(ledger, entity_cols), entity_cols).select(
        *entity_cols,
        iso_year_week(F.col(WEEK)).alias("YearWeek"),
        "category",
        F.col("expense").alias("amount"),
        "ratio",
    )


def _weeks(cells: DataFrame, entity_cols: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Cells to weeks. The grouping keys are those of the window below, so no new shuffle."""
    off = F.col("mean_expense") - F.col("week_mean")
    m2 = F.sum(F.col("m2_expense") + F.col("n_expense") * off * off)
    n_expense, spent = F.sum("n_expense"), F.col("ratio") > 0
    entropy = F.sum(F.when(spent, -F.col("ratio") * F.log(F.col("ratio") + 1e-12)))
    wide = [
        F.sum(F.when(F.col("category") == name, F.col("expense"))).alias(f"cat_{name}_amount")
        for name in dict.fromkeys(slug_text(c) for c in categories)
    ]
    return _ranked_cells(cells, entity_cols).groupBy(*entity_cols, WEEK).agg(
        F.sum("n").alias("total_transactions"),
        F.sum("expense").alias("total_expense"),
        F.sum("income").alias("total_income"),
        F.coalesce(F.first("week_mean"), F.lit(0.0)).alias("avg_expense"),
        F.coalesce(F.max("max_expense"), F.lit(0.0)).alias("max_expense"),
        F.coalesce(F.min("min_expense"), F.lit(0.0)).alias("min_expense"),
        F.when(n_expense > 1, F.sqrt(m2 / (n_expense - 1))).otherwise(F.lit(0.0)).alias("std_expense"),
        n_expense.alias("expense_transaction_count"),
        F.sum("n_income").alias("income_transaction_count"),
        F.bit_count(F.bit_or("days")).cast("long").alias("active_days"),
        F.sum("names").alias("unique_categories"),
        F.sum("weekend").alias("weekend_expense"),
        F.sum("weekday").alias("weekday_expense"),
        F.max("ratio").alias("dominant_category_ratio"),
        F.coalesce(entropy, F.lit(0.0)).alias("category_entropy"),
        F.sum(F.when(F.col("rank") <= 2, F.col("ratio")).otherwise(F.lit(0.0))).alias(
            "top2_category_ratio_sum"
        ),
        *wide,
    )


def with_weekly_ratios(weeks: DataFrame, categories: Sequence[str] = ()) -> DataFrame:
    """Row-wise ratios of a week's own totals."""
    n, spend, earn = F.col("total_transactions"), F.col("total_expense"), F.col("total_income")
    amounts = category_columns(categories, "amount")
    ratios = category_columns(categories, "ratio")
    return weeks.withColumns(
        {
            "net_cash_flow": earn - spend,
            "expense_to_income_ratio": safe_ratio(spend, earn),
            "weekend_expense_ratio": safe_ratio(F.col("weekend_expense"), spend),
            "weekday_expense_ratio": safe_ratio(F.col("weekday_expense"), spend),
            "avg_transaction_value": safe_ratio(spend + earn, n),
            "expense_frequency_ratio": safe_ratio(F.col("expense_transaction_count"), n),
            "income_presence_ratio": safe_ratio(F.col("income_transaction_count"), n),
            "expense_volatility_ratio": safe_ratio(F.col("std_expense"), F.col("avg_expense")),
            "active_days_ratio": F.when(n > 0, F.col("active_days") / F.lit(7.0)).otherwise(F.lit(0.0)),
            "zero_income_week": (earn <= 0).cast("int"),
            **{r: safe_ratio(F.col(f"`{a}`"), spend) for a, r in zip(amounts, ratios, strict=True)},
        }
    )


def with_rolling(weeks: DataFrame, entity_cols: Sequence[str] = ()) -> DataFrame:
    """Trailing means over the last four existing weeks, and each week against them.

    Partitions hold one entity's weeks, a number set by the calendar and not by traffic.
    """
    last4 = Window.partitionBy(*entity_cols).orderBy(WEEK).rowsBetween(-3, 0)
    return weeks.withColumns(
        {
            "rolling_4w_expense_mean": F.avg("total_expense").over(last4),
            "rolling_4w_income_mean": F.avg("total_income").over(last4),
        }
    ).withColumns(
        {
            "expense_vs_rolling_mean_ratio": safe_ratio(
                F.col("total_expense"), F.col("rolling_4w_expense_mean")
            ),
            "income_vs_rolling_mean_ratio": safe_ratio(
                F.col("total_income"), F.col("rolling_4w_income_mean")
            ),
        }
    )


def weekly_features(
    ledger: DataFrame,
    entity_cols: Sequence[str] = (),
    variant: str = "profile",
    categories: Sequence[str] = (),
) -> DataFrame:
    """The weekly feature frame, keyed by entity and ``YearWeek``.

    ``categories`` adds ``cat_<name>_amount`` and ``cat_<name>_ratio`` for the named
    categories, as conditional sums in the same aggregation: no pivot job, no join.
    """
    keep = weekly_columns(variant, categories)
    weeks = with_weekly_ratios(_weeks(weekly_cells(ledger, entity_cols), entity_cols, categories), categories)
    if variant == "profile":
        weeks = with_rolling(weeks, entity_cols)
    return clean_numeric(
        weeks.select(
            *entity_cols, iso_year_week(F.col(WEEK)).alias("YearWeek"), *[F.col(f"`{c}`") for c in keep]
        ),
        exclude=entity_cols,
    )
