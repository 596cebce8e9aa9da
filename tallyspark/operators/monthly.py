"""Monthly totals and mid-month snapshots per entity, from one pass over the ledger.

As in the weekly features, rows fold into (entity, month, category) cells first. The
snapshot is a set of conditional aggregates in the same cells, so no month is revisited.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.calendar import is_weekend, month_start, year_month
from tallyspark.functions.numeric import clean_numeric, safe_ratio
from tallyspark.operators.cleaning import require_columns, split_flows
from tallyspark.operators.recent import recent_rows

MONTH = "MonthStartDate"
INPUT_COLUMNS = ("Date", "Description", "Amount", "Transaction Type", "Category")

BASE_COLUMNS = (
    MONTH, "Year", "Month", "month_total_expense", "month_total_income", "total_transactions",
    "expense_transaction_count", "income_transaction_count", "active_days", "prev_month_total_expense",
    "prev_2_month_total_expense", "rolling_3m_expense_mean", "rolling_3m_expense_std",
    "rolling_3m_income_mean", "expense_momentum", "expense_vs_prev_month_ratio",
)
CARRIED_COLUMNS = (
    "prev_month_total_expense", "prev_2_month_total_expense", "rolling_3m_expense_mean",
    "rolling_3m_expense_std", "rolling_3m_income_mean", "expense_momentum",
)
SNAPSHOT_COLUMNS = (
    "total_expense_so_far", "expense_tx_count_so_far", "avg_daily_expense_so_far", "avg_expense_so_far",
    "std_expense_so_far", "max_expense_so_far", "total_income_so_far", "income_tx_count_so_far",
    "expense_to_income_ratio_so_far", "total_tx_so_far", "expense_frequency_ratio_so_far",
    "active_days_ratio_so_far", "expense_active_days_ratio_so_far", "weekend_expense_ratio_so_far",
    "unique_categories_so_far", "dominant_category_ratio_so_far", "category_entropy_so_far",
    "expense_trend_delta_so_far", "expense_trend_ratio_so_far",
)
FEATURE_COLUMNS = ("Year", "Month", "snapshot_day", *SNAPSHOT_COLUMNS, *CARRIED_COLUMNS)
TARGET = "month_total_expense_target"


def _bits(cond: Column) -> Column:
    """Days of the month as bits: distinct days without a distinct aggregate."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.dayofmonth("Date"))
    return F.bit_or(F.when(cond, bit).otherwise(F.lit(0).cast("long")))


def _midpoints(day: int, per_month_day: bool) -> list[int]:
    """Half-way days a snapshot may need: one, or one per possible effective day."""
    top = max(1, day // 2)
    return list(range(1, top + 1)) if per_month_day else [top]


def monthly_cells(
    ledger: DataFrame, entity_cols: Sequence[str], day: int, midpoints: Sequence[int]
) -> DataFrame:
    rows = split_flows(require_columns(ledger, [*entity_cols, *INPUT_COLUMNS]), "true")
    debit = F.col("Transaction Type") == "debit"
    earned = F.col("Income") > 0
    today = F.dayofmonth("Date")
    soon = today <= day
    spend = F.when(debit & soon, F.col("Amount"))

    def total(cond: Column, c: str = "Amount") -> Column:
        return F.sum(F.when(cond, F.col(c)).otherwise(F.lit(0.0)))

    return rows.groupBy(*entity_cols, month_start(F.col("Date")).alias(MONTH), "Category").agg(
        F.count("Amount").alias("n"),
        F.sum("Expense").alias("expense"),
        F.sum("Income").alias("income"),
        F.count_if(F.col("Expense") > 0).alias("n_expense"),
        F.count_if(earned).alias("n_income"),
        F.count_if(debit).alias("n_debit"),
        _bits(F.lit(True)).alias("days"),
        F.max(today).alias("last_day"),
        F.count_if(soon).alias("s_n"),
        F.count_if(debit & soon).alias("s_n_expense"),
        F.count_if(earned & soon).alias("s_n_income"),
        total(debit & soon).alias("s_expense"),
        total(earned & soon).alias("s_income"),
        F.avg(spend).alias("s_mean"),
        (F.var_pop(spend) * F.count(spend)).alias("s_m2"),
        F.max(spend).alias("s_max"),
        total(debit & soon & is_weekend(F.col("Date"))).alias("s_weekend"),
        _bits(soon).alias("s_days"),
        _bits(debit & soon).alias("s_expense_days"),
        *[total(debit & (today <= m)).alias(f"s_half_{m}") for m in midpoints],
    )


def month_table(
    ledger: DataFrame,
    entity_cols: Sequence[str] = (),
    day: int = 15,
    effective_day: bool = False,
) -> DataFrame:
    """One row per (entity, month): month totals, lagged totals and the snapshot.

    ``effective_day`` lowers the snapshot day to the last day seen in the month. The rows
    up to that day are the same as up to ``day``; only divisors and the half-way day move.
    """
    mids = _midpoints(day, effective_day)
    cells = monthly_cells(ledger, entity_cols, day, mids)
    whole = Window.partitionBy(*entity_cols, MONTH)
    cells = cells.withColumns(
        {
            "t_expense": F.sum("s_expense").over(whole),
            "t_mean": F.sum("s_expense").over(whole) / F.nullif(F.sum("s_n_expense").over(whole), F.lit(0)),
        }
    ).withColumn("ratio", safe_ratio(F.col("s_expense"), F.col("t_expense")))
    off = F.col("s_mean") - F.col("t_mean")
    m2 = F.sum(F.col("s_m2") + F.col("s_n_expense") * off * off)
    ns = F.sum("s_n_expense")
    entropy = F.sum(F.when(F.col("ratio") > 0, -F.col("ratio") * F.log(F.col("ratio") + 1e-12)))
    months = cells.groupBy(*entity_cols, MONTH).agg(
        F.sum("expense").alias("month_total_expense"),
        F.sum("income").alias("month_total_income"),
        F.sum("n").alias("total_transactions"),
        F.sum("n_expense").alias("expense_transaction_count"),
        F.sum("n_income").alias("income_transaction_count"),
        F.sum("n_debit").alias("n_debit"),
        F.bit_count(F.bit_or("days")).cast("long").alias("active_days"),
        F.max("last_day").alias("last_day"),
        F.sum("s_n").alias("total_tx_so_far"),
        ns.alias("expense_tx_count_so_far"),
        F.sum("s_n_income").alias("income_tx_count_so_far"),
        F.sum("s_expense").alias("total_expense_so_far"),
        F.sum("s_income").alias("total_income_so_far"),
        F.coalesce(F.first("t_mean"), F.lit(0.0)).alias("avg_expense_so_far"),
        F.when(ns > 1, F.sqrt(m2 / ns)).otherwise(F.lit(0.0)).alias("std_expense_so_far"),
        F.coalesce(F.max("s_max"), F.lit(0.0)).alias("max_expense_so_far"),
        F.sum("s_weekend").alias("s_weekend"),
        F.bit_count(F.bit_or("s_days")).cast("long").alias("s_active"),
        F.bit_count(F.bit_or("s_expense_days")).cast("long").alias("s_expense_active"),
        F.count_if(F.col("s_n_expense") > 0).alias("unique_categories_so_far"),
        F.max("ratio").alias("dominant_category_ratio_so_far"),
        F.coalesce(entropy, F.lit(0.0)).alias("category_entropy_so_far"),
        *[F.sum(f"s_half_{m}").alias(f"s_half_{m}") for m in mids],
    )
    used_day = F.least(F.lit(day), F.col("last_day")) if effective_day else F.lit(day)
    months = _with_snapshot(months.withColumn("snapshot_day", used_day.cast("int")), mids)
    return _with_history(months, entity_cols)


def _with_snapshot(months: DataFrame, mids: Sequence[int]) -> DataFrame:
    d, spend = F.col("snapshot_day"), F.col("total_expense_so_far")
    if len(mids) == 1:
        early = F.col(f"s_half_{mids[0]}")
    else:
        half = F.greatest(F.lit(1), F.floor(d / 2).cast("int"))
        early = F.element_at(F.array(*[F.col(f"s_half_{m}") for m in mids]), half)
    late = spend - early
    return months.withColumns(
        {
            "avg_daily_expense_so_far": safe_ratio(spend, d),
            "expense_to_income_ratio_so_far": safe_ratio(spend, F.col("total_income_so_far")),
            "expense_frequency_ratio_so_far": safe_ratio(
                F.col("expense_tx_count_so_far"), F.col("total_tx_so_far")
            ),
            "active_days_ratio_so_far": safe_ratio(F.col("s_active"), d),
            "expense_active_days_ratio_so_far": safe_ratio(F.col("s_expense_active"), d),
            "weekend_expense_ratio_so_far": safe_ratio(F.col("s_weekend"), spend),
            "expense_trend_delta_so_far": late - early,
            "expense_trend_ratio_so_far": safe_ratio(late, early),
        }
    )


def _with_history(months: DataFrame, entity_cols: Sequence[str]) -> DataFrame:
    """Lags and trailing means by existing month: a missing month is skipped, not zero."""
    line = Window.partitionBy(*entity_cols).orderBy(MONTH)
    last3 = line.rowsBetween(-3, -1)
    spend = F.col("month_total_expense")
    prev, prev2 = F.lag(spend, 1).over(line), F.lag(spend, 2).over(line)
    months = months.withColumns(
        {
            "Year": F.year(MONTH),
            "Month": F.month(MONTH),
            "YearMonth": year_month(F.col(MONTH)),
            "prev_month_total_expense": prev,
            "prev_2_month_total_expense": prev2,
            "rolling_3m_expense_mean": F.avg(spend).over(last3),
            "rolling_3m_expense_std": F.stddev_samp(spend).over(last3),
            "rolling_3m_income_mean": F.avg("month_total_income").over(last3),
            "is_latest": F.lead(F.lit(1)).over(line).isNull(),
        }
    )
    months = months.withColumns(
        {
            "expense_momentum": F.col("prev_month_total_expense") - F.col("prev_2_month_total_expense"),
            "expense_vs_prev_month_ratio": safe_ratio(spend, F.col("prev_month_total_expense")),
        }
    )
    return clean_numeric(months, exclude=entity_cols)


def monthly_base(ledger: DataFrame, entity_cols: Sequence[str] = ()) -> DataFrame:
    return month_table(ledger, entity_cols).select(*entity_cols, "YearMonth", *BASE_COLUMNS)


def has_snapshot() -> Column:
    """A month can be forecast when it has rows up to the snapshot day and any debit."""
    return (F.col("total_tx_so_far") > 0) & (F.col("n_debit") > 0)


def month_snapshot(
    ledger: DataFrame, day: int = 15, entity_cols: Sequence[str] = (), effective_day: bool = False
) -> DataFrame:
    """Snapshot rows of every month that has one, with the month-end target."""
    return _snapshot_rows(month_table(ledger, entity_cols, day, effective_day), entity_cols)


def _snapshot_rows(months: DataFrame, entity_cols: Sequence[str]) -> DataFrame:
    return months.filter(has_snapshot()).select(
        *entity_cols, "YearMonth", MONTH, *FEATURE_COLUMNS, F.col("month_total_expense").alias(TARGET)
    )


def forecast_dataset(
    ledger: DataFrame, day: int = 15, min_transactions: int = 5, entity_cols: Sequence[str] = ()
) -> DataFrame:
    """Training rows. History columns see every month, also the ones left out here."""
    months = month_table(ledger, entity_cols, day)
    return _snapshot_rows(months.filter(F.col("total_transactions") >= min_transactions), entity_cols)


def latest_month_snapshot(
    ledger: DataFrame, day: int = 15, entity_cols: Sequence[str] = ()
) -> DataFrame:
    """Each entity's last month with its effective snapshot day.

    Entities whose last month has no snapshot stay, with null features and
    ``has_snapshot`` false. The last month's columns look three months back, so only the rows of
    each entity's last four existing months fold into cells.
    """
    recent = recent_rows(ledger, entity_cols, months=4)
    months = month_table(recent, entity_cols, day, effective_day=True).filter("is_latest")
    ok = has_snapshot()
    features = [F.when(ok, F.col(c)).alias(c) for c in FEATURE_COLUMNS if c != "snapshot_day"]
    return months.select(*entity_cols, "YearMonth", MONTH, "snapshot_day", ok.alias("has_snapshot"), *features)
