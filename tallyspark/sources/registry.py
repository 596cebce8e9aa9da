"""Model metadata: one JSON object per model, read as a table with one row per model."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
model_name string, model_version string, feature_columns array<string>, feature_names array<string>,
thresholds struct<anomaly_score_threshold: double, severe_anomaly_score_threshold: double>,
risk_thresholds struct<low_threshold: double, medium_threshold: double>,
label_map map<string, string>, label_descriptions map<string, string>
"""
SUFFIX = "_metadata.json"


def model_registry(spark: SparkSession, path: str) -> DataFrame:
    """All ``<name>_metadata.json`` files of a folder. ``name`` comes from the file name."""
    try:
        df = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", f"*{SUFFIX}").json(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no model metadata at {path}") from e
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_metadata\.json$", 1)
    return df.select(name.alias("name"), "*")


def write_metadata(spark: SparkSession, name: str, content: Mapping[str, object], path: str) -> None:
    """Write one model's ``<name>_metadata.json`` into a folder of any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}{SUFFIX}")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(json.dumps({"model_name": name, **content}).encode()))
    finally:
        out.close()


def registry_violations(registry: DataFrame, required: Sequence[str]) -> DataFrame:
    """Models that lack a required key, with the keys they lack."""
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in required]))
    return registry.select("name", missing.alias("missing_keys")).filter(F.size("missing_keys") > 0)


def load_metadata(
    spark: SparkSession, name: str, path: str, required: Sequence[str] = ()
) -> DataFrame:
    """One model's row; an error when the model or a required key is missing."""
    short = name[: -len(SUFFIX)] if name.endswith(SUFFIX) else name
    row = model_registry(spark, path).filter(F.col("name") == short)
    if row.isEmpty():
        raise FileNotFoundError(f"no metadata for model {short!r} at {path}")
    unknown = [k for k in required if k not in row.columns]
    lacking = unknown + [k for r in registry_violations(row, [k for k in required if k not in unknown]).collect() for k in r["missing_keys"]]
    if lacking:
        raise ValueError(f"metadata of {short!r} is missing required keys: {lacking}")
    return row


def feature_list(registry_row: DataFrame, key: str = "feature_names") -> list[str]:
    """The ordered feature list of a one-row registry frame; an error when it is empty."""
    row = registry_row.select(key).first() if key in registry_row.columns else None
    if row is None or not row[0]:
        raise ValueError(f"metadata key {key!r} must be a non-empty list of feature names")
    return list(row[0])
