from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import contracts as C
from tallyspark.sources.ledger import read_ledger, write_ledger
from tallyspark.sources.registry import feature_list, load_metadata, model_registry, registry_violations


def values(spark, scores, column):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "i int, s double")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_anomaly_severity(spark):
    scores = [-1, 0, 0.1, 0.5, 0.6, 0.8, 0.9, 100]
    want = ["normal"] * 4 + ["anomaly"] * 2 + ["severe_anomaly"] * 2
    assert values(spark, scores, C.anomaly_severity(F.col("s"), 0.5, 0.8)) == want
    assert values(spark, [0.5, 0.6], C.anomaly_severity(F.col("s"), 0.5)) == ["normal", "severe_anomaly"]
    assert values(spark, [0, 0.1], C.anomaly_severity(F.col("s"))) == ["normal", "severe_anomaly"]


def test_risk_level(spark):
    scores = [-5, 0, 10, 40, 55, 70, 90, 100]
    want = ["LOW"] * 3 + ["MEDIUM"] * 2 + ["HIGH"] * 3
    assert values(spark, scores, C.risk_level(F.col("s"))) == want
    assert values(spark, scores, C.risk_level(F.col("s"), 40, 70)) == want
    assert values(spark, [19, 20, 30], C.risk_level(F.col("s"), 20, 30)) == ["LOW", "MEDIUM", "HIGH"]
    assert values(spark, [50], C.risk_level(F.col("s"), F.lit(None).cast("double"), F.lit(45.0))) == ["HIGH"]


def test_labels(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "c int")
    pick = lambda col: [r[0] for r in df.select(col).collect()]
    assert pick(C.map_label(F.col("c"), {"0": "saver"})) == ["saver", "unknown_profile", "unknown_profile"]
    assert pick(C.map_label(F.col("c"), {}, "none")) == ["none"] * 3
    assert pick(C.map_description(F.col("c"), {"1": "d"}))[:2] == ["No description available.", "d"]


def test_feature_frame(spark):
    df = spark.createDataFrame([(1.0, None, 3.0)], "a double, b double, extra double")
    out = C.feature_frame(df, ["b", "c", "a"], -1.0)
    assert out.columns == ["b", "c", "a"]
    assert tuple(out.first()) == (None, -1.0, 1.0)


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, extra int")
    assert C.validate(df, ["a", "b"]) is df
    assert C.validate_required(df, []) is df
    with pytest.raises(ValueError, match=r"Missing required features \(1\): \['c'\]"):
        C.validate(df, ["a", "c"])
    with pytest.raises(ValueError, match=r"Unexpected extra fields \(1\): \['extra'\]"):
        C.validate(df, ["a", "b"], reject_extras=True)
    assert C.validate(df, ["a", "b"], reject_extras=True, ignore={"extra"}) is df
    with pytest.raises(ValueError, match="Missing"):
        C.validate(df, ["z"], reject_extras=True)


def test_payload_violations(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": 2.0, "extra": 3.0},), ({"a": 1.0},)], "p map<string,double>")
    rows = C.payload_violations(df, "p", ["a", "b"], True).collect()
    assert [(r["missing_features"], r["extra_fields"], r["is_valid"]) for r in rows] == [
        ([], ["extra"], False), (["b"], [], False),
    ]
    assert C.payload_violations(df, "p", ["a"], True, ["b", "extra"]).filter("is_valid").count() == 2
    assert C.payload_violations(df, "p", ["a"]).filter("is_valid").count() == 2


@pytest.fixture
def store(tmp_path):
    common = {"model_version": "1.0.0"}
    files = {
        "profiler": {"feature_columns": ["total_transactions", "total_expense", "total_income"], "label_map": {"0": "saver"}},
        "anomaly": {
            "feature_columns": ["total_expense"],
            "thresholds": {"anomaly_score_threshold": 0.5, "severe_anomaly_score_threshold": 0.8},
        },
        "forecast": {"feature_columns": ["Year", "Month"]},
        "risk": {"risk_thresholds": {"low_threshold": 40, "medium_threshold": 70}},
    }
    for name, body in files.items():
        text = json.dumps(common | {"model_name": name} | body, indent=2)
        (tmp_path / f"{name}_metadata.json").write_text(text)
    (tmp_path / "other.json").write_text("{}")
    return str(tmp_path)


def test_registry(spark, store):
    reg = model_registry(spark, store)
    assert sorted(r["name"] for r in reg.collect()) == ["anomaly", "forecast", "profiler", "risk"]
    lacking = {r["name"]: r["missing_keys"] for r in registry_violations(reg, ["model_name", "feature_columns", "thresholds"]).collect()}
    assert lacking == {
        "profiler": ["thresholds"], "forecast": ["thresholds"], "risk": ["feature_columns", "thresholds"],
    }
    row = load_metadata(spark, "anomaly_metadata.json", store, ["model_name", "thresholds"])
    assert feature_list(row, "feature_columns") == ["total_expense"]
    with pytest.raises(ValueError, match="feature_names"):
        feature_list(row)
    with pytest.raises(FileNotFoundError):
        load_metadata(spark, "absent", store)
    with pytest.raises(ValueError, match="label_map"):
        load_metadata(spark, "risk", store, ["label_map"])
    with pytest.raises(FileNotFoundError):
        model_registry(spark, store + "/none").count()


def test_registry_row_drives_thresholds(spark, store):
    df = spark.createDataFrame([("anomaly", 0.6), ("risk", 0.6)], "name string, s double")
    out = C.with_registry(df, model_registry(spark, store)).select(
        "name", C.anomaly_severity(F.col("s"), F.col("thresholds.anomaly_score_threshold"), F.col("thresholds.severe_anomaly_score_threshold"))
    )
    assert dict(tuple(r) for r in out.collect()) == {"anomaly": "anomaly", "risk": "severe_anomaly"}


QUOTED = (
    ' Amount ,Date,Description,Transaction Type,Category,Account Name\n'
    '10,2024-01-05,"say ""hi"", twice",debit,NA,main\n'
    '20,2024-01-06,"two\nlines",debit, NA ,#N/A\n'
)


def test_csv_is_read_by_header_with_missing_tokens(spark, tmp_path):
    path = tmp_path / "ledger.csv"
    path.write_text(QUOTED)
    rows = read_ledger(spark, str(path), multi_line=True).orderBy("Date").collect()
    assert [r["Amount"] for r in rows] == ["10", "20"]
    assert [r["Description"] for r in rows] == ['say "hi", twice', "two\nlines"]
    assert [r["Category"] for r in rows] == [None, " NA "]
    assert rows[1]["Account Name"] is None


def test_a_broken_csv_row_is_an_error_and_never_data(spark, tmp_path):
    path = tmp_path / "ledger.csv"
    path.write_text(QUOTED)
    for columns in (["Amount"], ["Date", "Category"], ["*"]):
        with pytest.raises(Exception, match="multi_line=True"):
            read_ledger(spark, str(path)).select(*columns).collect()
    long = tmp_path / "long.csv"
    long.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="3,4,5"):
        read_ledger(spark, str(long)).collect()
    fine = tmp_path / "fine.csv"
    fine.write_text('a,b,c\n1,"x, ""y"", z",2\n3,5" pipe,NA\n4\n')
    rows = [tuple(r) for r in read_ledger(spark, str(fine)).collect()]
    assert rows == [("1", 'x, "y", z', "2"), ("3", '5" pipe', None), ("4", None, None)]
    assert read_ledger(spark, str(fine)).select("c").count() == 3


def test_weeks_are_written_in_order(spark, tmp_path):
    from tallyspark.plans.queries import weeks
    from tallyspark.sources.ledger import write_weeks

    frame = weeks(spark, "/root/testdata/sf0.001")
    write_weeks(frame, f"{tmp_path}/weeks", "csv", ["entity"])
    names = sorted(p for p in (tmp_path / "weeks").iterdir() if p.suffix == ".csv")
    keys = []
    for part in names:
        lines = part.read_text().splitlines()
        keys += [tuple(line.split(",")[:2]) for line in lines[1:]]
    assert keys == sorted(keys) and len(keys) == frame.count()


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_ledger_round_trip(spark, ledger, tmp_path, fmt):
    from tallyspark.operators.cleaning import clean_ledger

    raw = ledger([("2024-01-06", 'a "b"', "2.5", "debit", "x", None), ("2024-01-05", "c", "1", "credit", "y", "m")])
    write_ledger(raw, f"{tmp_path}/l", fmt, sort=True)
    back = read_ledger(spark, f"{tmp_path}/l", fmt)
    assert sorted(map(str, clean_ledger(back).collect())) == sorted(map(str, clean_ledger(raw).collect()))


def test_written_frames_are_cleared(spark, tmp_path):
    from tallyspark import session

    kept, session._WRITTEN[:] = list(session._WRITTEN), []
    try:
        frame = session.durable(spark.range(5).toDF("n"))
        assert frame.count() == 5 and session.clear_written(spark) == 1 and not session._WRITTEN
        with pytest.raises(Exception, match="(?i)exist"):
            session.durable(spark.range(5).toDF("n")).count() and frame.collect()
    finally:
        session._WRITTEN[:] = kept


def test_metadata_is_written_and_read(spark, tmp_path):
    from tallyspark.sources.registry import write_metadata

    write_metadata(spark, "risk", {"risk_thresholds": {"low_threshold": 30, "medium_threshold": 60}}, f"{tmp_path}/m")
    row = load_metadata(spark, "risk", f"{tmp_path}/m").first()
    assert row["model_name"] == "risk" and row["risk_thresholds"]["medium_threshold"] == 60
