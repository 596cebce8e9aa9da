"""Reading raw ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.text import null_tokens
from tallyspark.operators.cleaning import trim_headers


_BROKEN = "_broken_row"


def read_ledger(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """A raw ledger from CSV, JSON, parquet, ORC or a table.

    CSV columns are matched by header name and stay text; missing-value tokens become null
    before anything is trimmed. Rows with fewer values than the header end in nulls. Files with
    line breaks inside quotes need ``multi_line=True``, and each of them is then read by one task;
    without it a row that is cut by such a line break, or that has more values than the header,
    is an error when it is read, whatever columns are asked for.
    """
    if fmt == "table":
        return trim_headers(spark.read.table(path))
    if fmt == "csv":
        return trim_headers(_read_csv(spark, path, multi_line))
    reader = spark.read.format(fmt)
    if fmt == "json":
        reader = reader.options(primitivesAsString=True)
    return trim_headers(reader.load(path))


def _read_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    # a doubled quote is a quote, as spreadsheets write it
    options = {"header": True, "escape": '"', "multiLine": multi_line, "inferSchema": False}
    plain = spark.read.options(**options).csv(path)
    names = plain.columns
    if multi_line:
        rows = plain
    else:
        # whole rows are parsed even where few columns are asked for, or broken ones would pass unseen
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, _BROKEN)])
        reader = spark.read.schema(schema).options(**options, mode="PERMISSIVE", columnPruning=False)
        rows = reader.option("columnNameOfCorruptRecord", _BROKEN).csv(path)
        # always true, but Spark refuses to read nothing besides the broken rows, as for a count
        fine = F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0
        rows = rows.where(F.when(_is_broken(len(names)), F.raise_error(_message(path))).otherwise(fine))
    return rows.select(*[null_tokens(F.col(f"`{c}`")).alias(c) for c in names])


def _is_broken(n_columns: int) -> Column:
    """A row of the wrong length that a line break has cut, or that holds too many values."""
    raw = F.col(_BROKEN)
    quotes = F.regexp_count(raw, F.lit('"'))
    commas = F.regexp_count(F.regexp_replace(raw, '"[^"]*"', ""), F.lit(","))
    return raw.isNotNull() & ((quotes % 2 == 1) | (commas >= n_columns))


def _message(path: str) -> Column:
    text = f"{path} has a row that does not fit its header (read with multi_line=True if values hold line breaks): "
    return F.concat(F.lit(text), F.col(_BROKEN))


def write_ledger(df: DataFrame, path: str, fmt: str = "csv", sort: bool = False) -> None:
    """Write a ledger; ``sort`` orders it by date, which only files need."""
    write_rows(df, path, fmt, ["Date"] if sort else [])


def write_weeks(df: DataFrame, path: str, fmt: str = "parquet", entity_cols: Sequence[str] = ()) -> None:
    """Write weekly features in the order of entity and week, over files as within them."""
    write_rows(df, path, fmt, [*entity_cols, "YearWeek"])


def write_rows(df: DataFrame, path: str, fmt: str, order_by: Sequence[str] = ()) -> None:
    """Write a frame; ordered by a range partitioning, so that no task holds more than its share."""
    out = df.orderBy(*[F.col(f"`{c}`") for c in order_by]) if order_by else df
    writer = out.write.format(fmt)
    (writer.options(header=True, escape='"') if fmt == "csv" else writer).save(path)
