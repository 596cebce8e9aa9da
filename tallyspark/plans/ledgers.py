"""Ledgers made from the test tables.

``order_ledger``: one transaction per order line, long history, few large entities.
``event_ledger``: one transaction per event, many small entities, one month.
``dirty_ledger``: the order ledger rendered to text with faults set by key arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import durable

#: Order lines a task joins at a time, on average.
ROWS_PER_TASK = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins carry no hint: Spark broadcasts a side only under its own size limit.

    Many order lines are dealt to tasks of a bounded number of rows; their number comes from the
    files' footers. Fewer are left to Spark.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tasks = -(-lines.count() // ROWS_PER_TASK)
    if tasks > spark.sparkContext.defaultParallelism:
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    return (
        lines
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )


def order_ledger(spark: SparkSession, sf_dir: str, entity: str = "c_mktsegment") -> DataFrame:
    """Raw ledger with an ``entity`` column (market segment or customer key)."""
    return _ledger(_order_lines(spark, sf_dir), F.col(entity).alias("entity"))


def order_ledgers(spark: SparkSession, sf_dir: str, *entities: str) -> list[DataFrame]:
    """Order ledgers by several entities, from order lines that are joined and written once."""
    lines = durable(_ledger(_order_lines(spark, sf_dir), *entities))
    rest = lines.columns[len(entities):]
    return [lines.select(F.col(e).alias("entity"), *rest) for e in entities]


def _ledger(lines: DataFrame, *entities: str | Column) -> DataFrame:
    return lines.select(
        *entities,
        F.col("l_shipdate").alias("Date"),
        F.col("p_type").alias("Description"),
        F.col("l_extendedprice").alias("Amount"),
        F.when(F.col("l_returnflag") == "R", "credit").otherwise("debit").alias("Transaction Type"),
        F.col("p_brand").alias("Category"),
        F.col("o_orderpriority").alias("Account Name"),
    )


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"),
        F.col("ts").alias("Date"),
        F.col("props").alias("Description"),
        F.col("value").alias("Amount"),
        F.when(F.col("event_type") == "signup", "credit").otherwise("debit").alias("Transaction Type"),
        F.col("event_type").alias("Category"),
        F.lit(None).cast("string").alias("Account Name"),
    )


def dirty_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text ledger with padded headers, padded and upper-cased text, missing-value
    tokens, bad dates and numbers, unknown types, flipped signs and repeated rows."""
    k = F.col("l_orderkey") + F.col("l_linenumber")

    def every(n: int, r: int):
        return k % n == r

    amount = F.format_string("%.2f", F.col("l_extendedprice"))
    kind = F.when(F.col("l_returnflag") == "R", "credit").otherwise("debit")
    rows = _order_lines(spark, sf_dir).select(
        F.col("c_mktsegment").alias("entity"),
        F.when(every(41, 1), "not a date")
        .when(every(41, 2), F.concat(F.lit(" "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" ")))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias(" Date "),
        F.when(every(37, 1), "nan")
        .when(every(37, 2), F.concat(F.lit("\t"), F.upper("p_type"), F.lit(" ")))
        .when(every(37, 3), "transfer")
        .when(every(37, 4), "None")
        .otherwise(F.col("p_type"))
        .alias("Description"),
        F.when(every(31, 1), "abc")
        .when(every(31, 2), F.concat(F.lit("-"), amount))
        .when(every(31, 3), "0")
        .when(every(31, 4), F.concat(F.lit(" "), amount, F.lit(" ")))
        .when(every(31, 5), "NaN")
        .when(every(31, 6), "1d")
        .otherwise(amount)
        .alias("Amount"),
        F.when(every(29, 1), "fee")
        .when(every(29, 2), F.concat(F.lit(" "), F.upper(kind)))
        .when(every(29, 3), F.lit(None))
        .otherwise(kind)
        .alias("Transaction Type"),
        F.when(every(23, 1), "")
        .when(every(23, 2), F.concat(F.lit("  "), F.upper("p_brand"), F.lit("\n")))
        .when(every(23, 3), "NA")
        .when(every(23, 4), " NA ")
        .when(every(23, 5), "Internal Transfer")
        .otherwise(F.col("p_brand"))
        .alias("Category"),
        F.when(every(19, 1), "None").otherwise(F.col("o_orderpriority")).alias("Account Name "),
    )
    # urgent rows stand twice; one pass over the tables, not a union of two
    times = F.when(F.col("Account Name ") == "1-URGENT", 2).otherwise(1)
    return rows.select("*", F.explode(F.sequence(F.lit(1), times)).alias("_copy")).drop("_copy")
