"""Saving and loading fitted models with all that a training found out.

An artifact folder holds versions. A version is written whole into a folder of its own: side tables,
configuration, metrics tables, and a model of Spark ML where there is one. Only then one line is
added to the artifact's manifest, and readers go by the manifest: a version that was not finished is
never seen, and older versions stay readable.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml.regression import LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession

from tallyspark.config import AnomalyConfig, ForecastConfig, ProfilerConfig
from tallyspark.operators.anomaly import AnomalyModel
from tallyspark.operators.categories import CategoryPrep
from tallyspark.operators.clustering import Centroids
from tallyspark.operators.forecast import ForecastModel, Preprocess
from tallyspark.operators.moments import Linear
from tallyspark.operators.prep import Prep
from tallyspark.operators.profiler import ProfilerModel

PREP = "position int, feature string, mean double, scale double, median double"
CENTERS = "cluster_label int, center array<double>, cost double"
MANIFEST = "version long, folder string, tables array<string>"
Model = ProfilerModel | AnomalyModel | ForecastModel
Config = ProfilerConfig | AnomalyConfig | ForecastConfig


@dataclass(frozen=True)
class Artifact:
    """A fitted model, the configuration it was fitted with, and named tables of its training:
    metrics, cross-validation, removed weeks, counts, whatever is to be kept."""

    model: Model
    config: Config | None = None
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    version: int = 0


def _write(spark: SparkSession, rows: list[tuple], schema: str, path: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"model not found: {path}") from e


def _write_prep(spark: SparkSession, prep: Prep, path: str, medians: tuple[float, ...] | None = None) -> None:
    mids = medians or (None,) * len(prep.columns)
    rows = list(zip(range(len(prep.columns)), prep.columns, prep.mean, prep.scale, mids, strict=True))
    _write(spark, rows, PREP, f"{path}/prep")


def _read_prep(spark: SparkSession, path: str) -> tuple[Prep, tuple[float, ...]]:
    rows = _read(spark, f"{path}/prep").orderBy("position").collect()
    prep = Prep(*[tuple(r[c] for r in rows) for c in ("feature", "mean", "scale")])
    return prep, tuple(r["median"] for r in rows)


def _write_centers(spark: SparkSession, c: Centroids, path: str) -> None:
    _write(spark, [(i, list(v), c.cost) for i, v in enumerate(c.centers)], CENTERS, f"{path}/centroids")


def _read_centers(spark: SparkSession, columns: tuple[str, ...], path: str) -> Centroids:
    rows = _read(spark, f"{path}/centroids").orderBy("cluster_label").collect()
    return Centroids(columns, tuple(tuple(r["center"]) for r in rows), rows[0]["cost"])


def _write_categories(spark: SparkSession, categories: CategoryPrep | None, path: str) -> None:
    """The table of category features, in as many files as it has ranges; its width tells whether there is one."""
    _write(spark, [(categories.width if categories else None,)], "width int", f"{path}/category_width")
    if categories:
        categories.table.write.parquet(f"{path}/categories")


def _read_categories(spark: SparkSession, path: str) -> CategoryPrep | None:
    width = _read(spark, f"{path}/category_width").first()["width"]
    return None if width is None else CategoryPrep(_read(spark, f"{path}/categories"), width)


def _save_parts(spark: SparkSession, model: Model, path: str) -> None:
    if isinstance(model, AnomalyModel):
        kind = "anomaly"
        _write_prep(spark, model.prep, path)
        _write_centers(spark, model.centroids, path)
        _write_categories(spark, model.categories, path)
        _write(
            spark, [(model.anomaly_threshold, model.severe_threshold)],
            "anomaly_threshold double, severe_threshold double", f"{path}/thresholds",
        )
    elif isinstance(model, ProfilerModel):
        kind = "profiler"
        _write_prep(spark, model.prep, path)
        _write_centers(spark, model.centroids, path)
        _write_categories(spark, model.categories, path)
        for name in ("summary", "evaluation", "scope"):
            getattr(model, name).coalesce(1).write.parquet(f"{path}/{name}")
    else:
        kind = "forecaster"
        pre = model.preprocess
        _write_prep(spark, pre.prep, path, pre.medians)
        texts = [(n, m, list(v)) for (n, m), v in zip(pre.modes, pre.categories, strict=True)]
        _write(spark, texts, "feature string, mode string, categories array<string>", f"{path}/texts")
        _write(
            spark,
            [
                (
                    model.name, model.snapshot_day, list(model.feature_columns),
                    type(model.model).__name__, model.target_shift, model.target_scale,
                )
            ],
            "name string, snapshot_day int, feature_columns array<string>, class string,"
            " target_shift double, target_scale double",
            f"{path}/forecaster",
        )
        if isinstance(model.model, Linear):
            row = (list(model.model.coefficients), model.model.intercept)
            _write(spark, [row], "coefficients array<double>, intercept double", f"{path}/regression")
        else:
            model.model.write().save(f"{path}/regression")
    _write(spark, [(kind,)], "kind string", f"{path}/kind")


def _load_parts(spark: SparkSession, path: str) -> Model:
    kind = _read(spark, f"{path}/kind").first()["kind"]
    prep, medians = _read_prep(spark, path)
    if kind == "anomaly":
        cut = _read(spark, f"{path}/thresholds").first()
        return AnomalyModel(prep, _read_centers(spark, prep.columns, path), cut[0], cut[1], _read_categories(spark, path))
    if kind == "profiler":
        tables = [_read(spark, f"{path}/{n}") for n in ("summary", "evaluation", "scope")]
        return ProfilerModel(prep, _read_centers(spark, prep.columns, path), *tables, _read_categories(spark, path))
    head = _read(spark, f"{path}/forecaster").first()
    texts = _read(spark, f"{path}/texts").orderBy("feature").collect()
    pre = Preprocess(
        prep, medians, tuple((r["feature"], r["mode"]) for r in texts), tuple(tuple(r["categories"]) for r in texts)
    )
    if head["class"] == "Linear":
        row = _read(spark, f"{path}/regression").first()
        fitted = Linear(tuple(row["coefficients"]), row["intercept"])
    else:
        loader = {c.__name__: c for c in (LinearRegressionModel, RandomForestRegressionModel)}[head["class"]]
        fitted = loader.load(f"{path}/regression")
    return ForecastModel(
        head["name"], head["snapshot_day"], tuple(head["feature_columns"]), pre, fitted,
        head["target_shift"], head["target_scale"],
    )


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of an artifact, oldest first; none where there is no artifact."""
    try:
        return sorted(r["version"] for r in spark.read.schema(MANIFEST).json(f"{path}/manifest").collect())
    except AnalysisException:
        return []


def save_artifact(spark: SparkSession, artifact: Artifact, path: str) -> int:
    """Add ``artifact`` to the folder ``path`` as a new version, and return its number.

    Two writers at once are told apart by their folders; should both take one number, readers
    follow the folder of the smaller name.
    """
    number = max(versions(spark, path), default=0) + 1
    folder = uuid.uuid4().hex
    whole = f"{path}/versions/{folder}"
    _save_parts(spark, artifact.model, whole)
    config = artifact.config
    values = (type(config).__name__, json.dumps(dataclasses.asdict(config))) if config else (None, None)
    _write(spark, [values], "class string, content string", f"{whole}/config")
    for name, table in artifact.tables.items():
        table.write.parquet(f"{whole}/tables/{name}")
    line = spark.createDataFrame([(number, folder, sorted(artifact.tables))], MANIFEST)
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return number


def load_artifact(spark: SparkSession, path: str, version: int | None = None) -> Artifact:
    """A finished version of an artifact, the newest unless one is named; an error where there is none."""
    try:
        lines = spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()  # one row a version
    except AnalysisException as e:
        raise FileNotFoundError(f"model not found: {path}") from e
    lines = sorted((r for r in lines if version in (None, r["version"])), key=lambda r: (-r["version"], r["folder"]))
    if not lines:
        raise FileNotFoundError(f"model not found: {path}, version {version}")
    line = lines[0]
    whole = f"{path}/versions/{line['folder']}"
    row = _read(spark, f"{whole}/config").first()
    config = None
    if row["class"]:
        known = {c.__name__: c for c in (ProfilerConfig, AnomalyConfig, ForecastConfig)}[row["class"]]
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(row["content"]).items()}
        config = known(**values)
    tables = {n: _read(spark, f"{whole}/tables/{n}") for n in line["tables"]}
    return Artifact(_load_parts(spark, whole), config, tables, line["version"])


def save_model(spark: SparkSession, model: Model, path: str, config: Config | None = None, **tables: DataFrame) -> int:
    """Save a model with its configuration and the tables of its training; see ``save_artifact``."""
    return save_artifact(spark, Artifact(model, config, tables), path)


def load_model(spark: SparkSession, path: str, version: int | None = None) -> Model:
    """The model of an artifact alone; an error when it does not exist."""
    return load_artifact(spark, path, version).model


def write_metrics(df: DataFrame, path: str) -> None:
    """A metrics table as JSON lines in one file."""
    df.coalesce(1).write.json(path)
