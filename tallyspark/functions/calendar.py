"""Calendar keys. Grouping uses the date itself; texts are rendered per group, not per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def week_start(ts: Column) -> Column:
    """Monday of the ISO week, as a date."""
    return F.trunc(F.to_date(ts), "week")


def month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "month")


def iso_year_week(d: Column) -> Column:
    """``YYYY-Www``: the ISO year is the year of that week's Thursday."""
    thursday = F.date_add(F.trunc(F.to_date(d), "week"), 3)
    return F.concat(
        F.lpad(F.year(thursday).cast("string"), 4, "0"),
        F.lit("-W"),
        F.lpad(F.weekofyear(thursday).cast("string"), 2, "0"),
    )


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def with_calendar(df: DataFrame, date_col: str = "Date") -> DataFrame:
    d = F.col(date_col)
    return df.withColumns(
        {
            "Year": F.year(d),
            "Month": F.month(d),
            "Day": F.dayofmonth(d),
            "YearMonth": year_month(d),
            "MonthStartDate": month_start(d),
            "DayOfWeek": day_of_week(d),
            "IsWeekend": is_weekend(d).cast("int"),
            "YearWeek": iso_year_week(d),
        }
    )
