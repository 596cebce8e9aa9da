"""The part of a ledger that the latest week and month of each entity depend on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.calendar import month_start, week_start
from tallyspark.operators.prep import join_same


def _first_of_last(period: str, n: int) -> Column:
    """Start of the ``n``-th last period seen, or of the first one; the calendar bounds their number."""
    seen = F.sort_array(F.collect_set(period), asc=False)
    return F.element_at(seen, F.least(F.lit(n), F.size(seen)))


def recent_rows(rows: DataFrame, entity_cols: Sequence[str] = (), months: int = 4, weeks: int | None = None) -> DataFrame:
    """Rows since the start of each entity's last ``months`` existing months, or of its last ``weeks``
    existing weeks if these begin earlier. So many weeks and months are whole.

    Narrow (entity, month, week) rows fold on the map side and tell where to begin; then rows meet
    one row per entity. ``rows`` is read twice. Duplicates change nothing here.
    """
    periods = {"_month": month_start(F.col("Date"))}
    if weeks is not None:
        periods["_week"] = week_start(F.col("Date"))
    seen = rows.select(*entity_cols, *[c.alias(name) for name, c in periods.items()]).distinct()
    starts = [_first_of_last(name, n) for name, n in (("_month", months), ("_week", weeks)) if n is not None]
    start = (F.least(*starts) if len(starts) > 1 else starts[0]).alias("_start")
    if not entity_cols:
        return rows.filter(F.to_date("Date") >= seen.agg(start).scalar())
    begins = seen.groupBy(*entity_cols).agg(start)
    return join_same(rows, begins, entity_cols).filter(F.to_date("Date") >= F.col("_start")).select(*rows.columns)
