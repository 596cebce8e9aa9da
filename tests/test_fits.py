"""The registered fits do the whole job: default settings, all candidates, all category features."""

from __future__ import annotations

import pytest

from tallyspark.config import AnomalyConfig, ForecastConfig, ProfilerConfig
from tallyspark.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["kmeans_profiler", "profiler_evaluation", "kmeans_anomaly", "forecast_candidates", "risk_report"])
def test_fit_inputs(spark, monkeypatch, name):
    calls = {}

    class Enough(Exception):
        pass

    def take(kind, last):
        def fit(*args, **named):
            calls[kind] = (args, named)
            if last:
                raise Enough
            return None, None, None

        return fit

    whole = name == "risk_report"
    monkeypatch.setattr(Q, "fit_profiler", take("profiler", not whole))
    monkeypatch.setattr(Q.A, "fit_anomaly", take("anomaly", not whole))
    monkeypatch.setattr(Q.FC, "fit_forecaster", take("forecast", True))
    with pytest.raises(Enough):
        Q.all_queries()[name](spark, SF)
    defaults = {"profiler": ProfilerConfig(), "anomaly": AnomalyConfig(), "forecast": ForecastConfig()}
    for kind, (args, named) in calls.items():
        assert args[2] == defaults[kind], kind
        if kind == "forecast":
            assert len(args) == 3 and not named
        else:  # the long table of all categories, every week of it
            long = named.get("categories") or args[3]
            assert set(long.columns) == {"entity", "YearWeek", "category", "amount", "ratio"}, kind
            assert long.select("category").distinct().count() == 25
            assert long.select("entity", "YearWeek").distinct().count() == args[0].count()
    assert len(calls) == (3 if whole else 1)
