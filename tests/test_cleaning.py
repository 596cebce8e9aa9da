from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.text import SPACE_CHARS, parse_amount, parse_date, strip_space
from tallyspark.operators.cleaning import (
    clean_ledger, is_true_income, normalise_ledger, require_columns, split_flows, trim_headers,
)

OK = ("2024-01-05", "Shop", "10", "debit", "food", "main")


def one(ledger, **change):
    keys = ["Date", "Description", "Amount", "Transaction Type", "Category", "Account Name"]
    row = dict(zip(keys, OK, strict=True)) | {k.replace("_", " "): v for k, v in change.items()}
    return clean_ledger(ledger([tuple(row[k] for k in keys)]), read_nulls=True).collect()


def test_padded_header_is_trimmed_and_missing_columns_are_named(ledger):
    df = ledger([OK]).withColumnRenamed("Amount", "  Amount ")
    assert "Amount" in trim_headers(df).columns
    assert clean_ledger(df).count() == 1
    with pytest.raises(ValueError, match="Category.*Account Name"):
        require_columns(ledger([OK]).drop("Category", "Account Name"), ["Date", "Category", "Account Name"])


def test_every_white_space_is_stripped(spark):
    df = spark.createDataFrame([(c + "a" + c,) for c in SPACE_CHARS] + [("b  c",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(strip_space(F.col("s"))).collect()]
    assert got == ["a"] * len(SPACE_CHARS) + ["b  c", "", None]
    assert all(c.isspace() for c in SPACE_CHARS)


@pytest.mark.parametrize("text", ["", " nan ", "None", "NA", " "])
def test_missing_text_is_null(ledger, text):
    assert one(ledger, Description=text)[0]["Description"] is None
    assert one(ledger, Category=text) == []


def test_padded_na_is_text_and_case_matters_for_null_texts(ledger):
    assert one(ledger, Category=" NA ")[0]["Category"] == "na"
    assert one(ledger, Description="NONE")[0]["Description"] == "none"


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("10", 10.0), (" 5 ", 5.0), ("-10", -10.0), ("1e3", 1000.0), ("inf", float("inf")), ("abc", None),
        ("NaN", None), ("1d", None), ("1f", None), ("0x1p3", None), ("1,234", None), ("$4", None), (None, None),
    ],
)
def test_amounts(spark, text, value):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(parse_amount(strip_space(F.col("s")))).first()[0] == value


def test_zero_negative_and_typed_amounts(ledger, spark):
    assert one(ledger, Amount="0") == []
    row = one(ledger, Amount="-10")[0]
    assert (row["Amount"], row["Signed Amount"]) == (10.0, -10.0)
    assert one(ledger, Transaction_Type=" CREDIT")[0]["Signed Amount"] == 10.0
    assert one(ledger, Transaction_Type="fee") == []
    typed = ledger([OK, OK[:2] + ("x",) + OK[3:]]).withColumns(
        {"Amount": F.when(F.col("Amount") == "x", float("nan")).otherwise(F.lit(-3.5)), "Date": F.to_date("Date")}
    )
    assert [r["Amount"] for r in clean_ledger(typed).collect()] == [3.5]


def test_dates(spark, ledger):
    def parse(text, *formats):
        df = spark.createDataFrame([(text,)], "s string")
        return df.select(parse_date(F.col("s"), *([formats] if formats else []))).first()[0]

    assert parse("2024-01-05") == dt.datetime(2024, 1, 5)
    assert parse("2024-01-05 10:20:30") == dt.datetime(2024, 1, 5, 10, 20, 30)
    assert parse("2024-01") is None
    assert parse("2024-02-30") is None
    assert parse("01/02/2024", "M/d/yyyy") == dt.datetime(2024, 1, 2)
    assert parse("2024-01-05", "M/d/yyyy") is None
    assert parse("2024-01-05", "M/d/yyyy", "iso") == dt.datetime(2024, 1, 5)
    assert one(ledger, Date="not a date") == []


def test_duplicates_collapse_after_normalising(ledger):
    rows = [
        OK, OK, ("2024-01-05", " SHOP", "-10", "Debit", "Food", "main"),
        ("2024-01-05", None, "10", "debit", "food", None), ("2024-01-05", "nan", "10", "debit", "food", ""),
    ]
    assert clean_ledger(ledger(rows)).count() == 2
    assert normalise_ledger(ledger(rows)).count() == 5


def test_entities_keep_their_own_duplicates(ledger):
    both = ledger([OK, OK], "a").unionByName(ledger([OK], "b")).unionByName(ledger([OK], None).withColumn("entity", F.lit(None)))
    assert clean_ledger(both, ["entity"]).count() == 3


def test_true_income(ledger):
    rows = [
        ("2024-01-05", "salary", "1", "credit", "pay", None), ("2024-01-05", None, "2", "credit", "pay", None),
        ("2024-01-05", "x", "4", "credit", "Transfer", None), ("2024-01-05", "payment", "8", "credit", "pay", None),
        ("2024-01-05", "x", "16", "debit", "pay", None),
    ]
    clean = clean_ledger(ledger(rows))
    assert {r["Amount"] for r in clean.filter(is_true_income()).collect()} == {1.0, 2.0}
    total = split_flows(clean, "all").agg(F.sum("Income"), F.sum("Expense")).first()
    assert tuple(total) == (15.0, 16.0)
    assert split_flows(clean, "true").agg(F.sum("Income")).first()[0] == 3.0
    with pytest.raises(ValueError):
        split_flows(clean, "some")


def test_parse_is_not_repeated_in_the_filter(ledger):
    plan = clean_ledger(ledger([OK]), read_nulls=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as timestamp_ntz") == 1


def test_filters_on_typed_ledgers_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "typed")
    spark.sql(
        "SELECT timestamp_ntz'2024-03-04 10:00:00' AS Date, 'a' AS Description, 5.0D AS Amount, "
        "'debit' AS `Transaction Type`, 'food' AS Category, 'x' AS `Account Name`"
    ).write.parquet(path)
    rows = clean_ledger(spark.read.parquet(path)).filter("Date >= timestamp_ntz'2024-01-01'")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "GreaterThanOrEqual(Date,2024-01-01" in pushed
    assert rows.count() == 1
