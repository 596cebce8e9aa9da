"""Reports on the latest week and month work on recent rows only, with the results of the whole ledger."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import monthly as M
from tallyspark.operators import risk as R
from tallyspark.operators import weekly as W
from tallyspark.operators.cleaning import clean_ledger
from tallyspark.operators.recent import recent_rows

E = ["entity"]
SCHEMA = (
    "entity string, Date timestamp_ntz, Description string, Amount double, `Transaction Type` string, "
    "Category string, `Account Name` string"
)


def made(seed: int) -> list[tuple]:
    """Rows of three entities, one of them without a key, with gaps of weeks and months and repeated rows."""
    draw, rows = random.Random(seed), []
    for entity, n, step in (("a", 300, 3), ("b", 9, 40), (None, 60, 11)):
        day = dt.datetime(2021, 1, 1)
        for i in range(n):
            day += dt.timedelta(days=draw.randrange(step + 1))
            kind = "credit" if draw.random() < 0.2 else "debit"
            rows.append((entity, day, f"d{i % 3}", float(draw.randrange(1, 900)), kind, f"c{i % 4}", "x"))
    return rows + rows[::7]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(made(5), SCHEMA).persist()


def _start(rows: list[tuple], entity: str | None, weeks: int | None, months: int) -> dt.date:
    days = {r[1].date() for r in rows if r[0] == entity}
    starts = [sorted({d.replace(day=1) for d in days})[-months:][0]]
    if weeks is not None:
        starts.append(sorted({d - dt.timedelta(days=d.weekday()) for d in days})[-weeks:][0])
    return min(starts)


@pytest.mark.parametrize("weeks, months", [(None, 4), (4, 4), (4, 1), (30, 2), (500, 500)])
def test_recent_rows(raw, weeks, months):
    rows = made(5)
    want = [r for r in rows if r[1].date() >= _start(rows, r[0], weeks, months)]
    got = [tuple(r) for r in recent_rows(raw, E, months, weeks).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    one = raw.filter("entity = 'a'").drop("entity")
    assert recent_rows(one, (), months, weeks).count() == sum(r[0] == "a" for r in want)
    assert recent_rows(raw.filter("false"), E, months, weeks).count() == 0
    assert recent_rows(one.filter("false"), (), months, weeks).count() == 0


def same_rows(got, want):
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (g, w)


def test_latest_month_folds_recent_months_only(raw, monkeypatch):
    clean = clean_ledger(raw, E)
    whole = M.month_table(clean, E, 15, effective_day=True).filter("is_latest")
    seen, cells = [], M.monthly_cells
    monkeypatch.setattr(M, "monthly_cells", lambda ledger, *args: seen.append(ledger) or cells(ledger, *args))
    got = M.latest_month_snapshot(clean, 15, E)
    folded = seen[0].groupBy(*E).agg(F.count_distinct(F.date_trunc("month", "Date")).alias("n")).collect()
    assert {r["entity"]: r["n"] for r in folded} == {"a": 4, "b": 4, None: 4}
    columns = ["entity", "YearMonth", "snapshot_day", *[c for c in M.FEATURE_COLUMNS if c != "snapshot_day"]]
    ok = got.filter("has_snapshot").select(*columns).orderBy("entity").collect()
    same_rows(ok, whole.filter(M.has_snapshot()).select(*columns).orderBy("entity").collect())
    assert got.count() == 3


def test_report_reads_recent_rows_once_each(spark, raw, monkeypatch):
    seen = []

    class Enough(Exception):
        pass

    def take(clean, *args):
        seen.append(clean)
        raise Enough

    monkeypatch.setattr(R, "risk_components", take)
    whole = clean_ledger(raw, E)
    for is_clean in (False, True):
        with pytest.raises(Enough):
            R.risk_report(whole if is_clean else raw, None, E, is_clean=is_clean)
        clean = seen.pop()
        assert clean.columns == whole.columns
        assert clean.inputFiles(), "the recent ledger is written once for all branches"
        rows = made(5)
        recent = {r for r in rows if r[1].date() >= _start(rows, r[0], 4, 4)}
        assert clean.count() == len(recent) < whole.count()
        last = [R.latest(W.weekly_features(c, E), "YearWeek", E).orderBy("entity").collect() for c in (clean, whole)]
        same_rows(*last)


def test_many_order_lines_are_dealt_to_bounded_tasks(spark, monkeypatch):
    from tallyspark.plans import ledgers as L

    sf = "/root/testdata/sf0.001"
    few = L.order_ledger(spark, sf)
    assert "REPARTITION_BY_NUM" not in few._jdf.queryExecution().toString()
    monkeypatch.setattr(L, "ROWS_PER_TASK", 300)
    many = L.order_ledger(spark, sf)
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().toString()
    assert many.exceptAll(few).count() == few.exceptAll(many).count() == 0
    by_segment, by_customer = L.order_ledgers(spark, sf, "c_mktsegment", "o_custkey")
    assert by_segment.exceptAll(few).count() == few.exceptAll(by_segment).count() == 0
    other = L.order_ledger(spark, sf, "o_custkey")
    assert by_customer.exceptAll(other).count() == other.exceptAll(by_customer).count() == 0


def test_report_joins_order_lines_once(monkeypatch, spark):
    from tallyspark.plans import ledgers as L
    from tallyspark.plans import queries as Q

    class Enough(Exception):
        pass

    joins, raws, lines = [], [], L._order_lines

    def take(raw, *args):
        raws.append(raw)
        raise Enough

    monkeypatch.setattr(L, "_order_lines", lambda *args: joins.append(args) or lines(*args))
    for module, name in ((Q, "fit_profiler"), (Q.A, "fit_anomaly"), (Q.FC, "fit_forecaster")):
        monkeypatch.setattr(module, name, lambda frame, *args, **named: (None, None, None))
    monkeypatch.setattr(Q.R, "risk_report", take)
    with pytest.raises(Enough):
        Q.all_queries()["risk_report"](spark, "/root/testdata/sf0.001")
    assert len(joins) == 1
    assert not any("lineitem" in f for f in raws[0].inputFiles())
