"""Raw ledger to clean ledger: one scan, narrow projections, one shuffle for duplicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import (
    DEFAULT_DATE_FORMATS, norm_text, not_nan, null_tokens, parse_amount, parse_date, strip_space,
)

LEDGER_COLUMNS = ("Date", "Description", "Amount", "Transaction Type", "Category", "Account Name")
TYPES = ("debit", "credit")

# Credits that only move money and are no income.
TRANSFER_CATEGORIES = (
    "credit card payment", "transfer", "balance adjustment", "internal transfer", "payment",
)
TRANSFER_DESCRIPTIONS = ("credit card payment", "transfer", "payment")


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def signed_amount() -> Column:
    return F.when(F.col("Transaction Type") == "debit", -F.col("Amount")).otherwise(F.col("Amount"))


def is_true_income() -> Column:
    """A credit that is no transfer. A missing description never excludes."""
    named = F.col("Category").isin(*TRANSFER_CATEGORIES)
    described = F.coalesce(F.col("Description").isin(*TRANSFER_DESCRIPTIONS), F.lit(False))
    return (F.col("Transaction Type") == "credit") & ~named & ~described


def split_flows(df: DataFrame, income: str = "all") -> DataFrame:
    """Add ``Expense`` and ``Income``. ``income`` is "all" credits or only "true" income."""
    if income not in ("all", "true"):
        raise ValueError(f"income must be 'all' or 'true', not {income!r}")
    earns = F.col("Transaction Type") == "credit" if income == "all" else is_true_income()
    return df.withColumns(
        {
            "Expense": F.when(F.col("Transaction Type") == "debit", F.col("Amount")).otherwise(F.lit(0.0)),
            "Income": F.when(earns, F.col("Amount")).otherwise(F.lit(0.0)),
        }
    )


def normalise_ledger(
    df: DataFrame,
    entity_cols: Sequence[str] = (),
    date_formats: Sequence[str] = DEFAULT_DATE_FORMATS,
    read_nulls: bool = False,
) -> DataFrame:
    """Typed, lower-cased, valid rows; duplicates still in. No shuffle."""
    df = require_columns(trim_headers(df), [*entity_cols, *LEDGER_COLUMNS])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    text = [c for c in LEDGER_COLUMNS if types[c] == "string" or c not in ("Date", "Amount")]

    def each(fn: Callable[[Column], Column], names: Sequence[str]) -> DataFrame:
        cols = [
            (fn(F.col(f"`{c}`").cast("string")).alias(c) if c in names else F.col(f"`{c}`"))
            for c in LEDGER_COLUMNS
        ]
        return df.select(*entity_cols, *cols)

    # a missing raw value stays missing, so the scan can drop it
    df = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in ("Date", "Amount", "Transaction Type", "Category")))
    # One projection per step: each step uses its input more than once, and Spark keeps
    # such projections apart instead of copying one expression into the next.
    df = each(null_tokens, text) if read_nulls else df
    df = each(strip_space, text)
    date, amount = F.col("Date"), F.col("Amount")
    row = {
        "Date": parse_date(date, date_formats) if "Date" in text else _as_ntz(date, types["Date"]),
        "Description": norm_text(F.col("Description")),
        "Amount": F.abs(parse_amount(amount) if "Amount" in text else not_nan(amount.cast("double"))),
        "Transaction Type": norm_text(F.col("Transaction Type")),
        "Category": norm_text(F.col("Category")),
        "Account Name": norm_text(F.col("Account Name")),
    }
    named = [value.alias(name) for name, value in row.items()]
    if {"Date", "Amount"} & set(text):
        # A filter moves below projections and would repeat every parse inside itself, in code
        # too long for the JIT compiler. It does not move below a generator of one row.
        rows = df.select(*entity_cols, F.inline(F.array(F.struct(*named))))
    else:
        # nothing to parse: filters, the caller's too, go on to the scan
        rows = df.select(*entity_cols, *named)
    return rows.filter(
        F.col("Date").isNotNull()
        & F.col("Category").isNotNull()
        & F.col("Transaction Type").isin(*TYPES)
        & (F.col("Amount") > 0)
    )


def _as_ntz(date: Column, kind: str) -> Column:
    """A cast that is none leaves the column bare, as a pushed filter needs it."""
    return date if kind == "timestamp_ntz" else date.cast("timestamp_ntz")


def clean_ledger(
    df: DataFrame,
    entity_cols: Sequence[str] = (),
    date_formats: Sequence[str] = DEFAULT_DATE_FORMATS,
    read_nulls: bool = False,
) -> DataFrame:
    """The clean ledger with ``Signed Amount``.

    All kept columns are duplicate keys, so ``distinct`` says the same as dropping
    duplicates by key and its hash spreads rows evenly whatever the entity sizes.
    The output carries no order.
    """
    return without_duplicates(normalise_ledger(df, entity_cols, date_formats, read_nulls))


def without_duplicates(rows: DataFrame) -> DataFrame:
    """Normalised rows once each, with ``Signed Amount``."""
    return rows.distinct().withColumn("Signed Amount", signed_amount())
