"""Month-end expense from the mid-month snapshot: five regressions, chosen by validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.config import ForecastConfig
from tallyspark.functions.quantiles import exact_medians
from tallyspark.operators.moments import Linear, Moments, Range
from tallyspark.operators.monthly import MONTH, TARGET
from tallyspark.operators.prep import Prep, deviation, feature_stats, number, unpivoted
from tallyspark.session import durable

PREDICTION = "predicted_month_end_expense"
MIN_MONTHS = 10


@dataclass(frozen=True)
class Preprocess:
    """Median-imputed, scaled numbers, then one-hot categories in sorted order."""

    prep: Prep
    medians: tuple[float, ...]
    modes: tuple[tuple[str, str | None], ...] = ()
    categories: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True)
class ForecastModel:
    name: str
    snapshot_day: int
    feature_columns: tuple[str, ...]
    preprocess: Preprocess
    model: Model | Linear
    target_shift: float = 0.0
    target_scale: float = 1.0


@dataclass(frozen=True)
class _Fitted:
    model: Model | Linear
    shift: float
    scale: float


def time_split(
    df: DataFrame, train_ratio: float = 0.70, valid_ratio: float = 0.15, month: str = MONTH
) -> DataFrame:
    """Add ``position`` (rank of the month) and ``split``. No month is in two splits.

    Positions come from the distinct months, a few hundred rows whatever the number of
    entities; they are the only rows in the unpartitioned window and in the broadcast.
    """
    line = Window.partitionBy()
    months = df.select(month).distinct().withColumns(
        {"position": F.row_number().over(line.orderBy(month)) - 1, "n": F.count(F.lit(1)).over(line)}
    )
    train_end = F.floor(F.col("n") * F.lit(train_ratio))
    valid_end = F.floor(F.col("n") * F.lit(train_ratio + valid_ratio))
    split = (
        F.when(F.col("n") < MIN_MONTHS, F.raise_error(F.lit(f"fewer than {MIN_MONTHS} months")).cast("string"))
        .when(F.col("position") < train_end, F.lit("train"))
        .when(F.col("position") < valid_end, F.lit("valid"))
        .otherwise(F.lit("test"))
    )
    placed = months.select(month, F.col("position").cast("int").alias("position"), split.alias("split"))
    return df.join(F.broadcast(placed), month)


def cv_folds(train_months: int, n_splits: int = 3) -> list[tuple[int, int, int]]:
    """(fold, first test position, end): each fold trains on everything before its test."""
    if train_months < n_splits + 2:
        n_splits = max(2, min(3, train_months - 1))
    size = train_months // (n_splits + 1)
    starts = [train_months - (n_splits - i) * size for i in range(n_splits)]
    return [(i + 1, s, s + size) for i, s in enumerate(starts)]


def fold_roles(train: DataFrame, n_splits: int = 3) -> DataFrame:
    """``train`` (with ``position``) once for each fold it takes part in: ``fold``, ``role`` (fit or score).

    The bounds of ``cv_folds`` as columns, so that no job runs while the plan is built.
    """
    n = train.agg(F.max("position") + 1).scalar()
    held = train.withColumn("_n", n)
    months = F.col("_n")
    k = F.when(months < n_splits + 2, F.greatest(F.lit(2), F.least(F.lit(3), months - 1))).otherwise(n_splits)
    held = held.withColumn("_k", k).withColumn("_size", F.floor(months / (F.col("_k") + 1)).cast("int"))

    def fold(i: Column) -> Column:
        start = months - (F.col("_k") - i + 1) * F.col("_size")
        role = F.when(F.col("position") < start, "fit").when(F.col("position") < start + F.col("_size"), "score")
        return F.struct(i.alias("fold"), role.alias("role"))

    folds = F.inline(F.transform(F.sequence(F.lit(1), F.col("_k")), fold))
    return held.select(*train.columns, folds).filter("role IS NOT NULL")


def _text_columns(df: DataFrame, features: Sequence[str]) -> list[str]:
    return [f for f in features if isinstance(df.schema[f].dataType, T.StringType)]


def fit_preprocess(df: DataFrame, features: Sequence[str], rows: int) -> Preprocess:
    """One row per feature reaches the driver, and one per category of a text feature.

    Mean and deviation after imputation follow from the counts.
    """
    texts = _text_columns(df, features)
    numbers = [f for f in features if f not in texts]
    medians = exact_medians(unpivoted(df, numbers), ["value"], ["feature"])
    stats = feature_stats(df, numbers).join(medians.withColumnRenamed("value", "median"), "feature", "left")
    by_name = {r["feature"]: r for r in stats.collect()}
    mids, means, scales = [], [], []
    for c in numbers:
        r = by_name[c]
        if not r["n"]:
            raise ValueError(f"feature {c!r} has no value to impute from")
        gaps = rows - r["n"]
        mean = (r["n"] * r["mean"] + gaps * r["median"]) / rows
        spread = r["n"] * (r["variance"] + (r["mean"] - mean) ** 2) + gaps * (r["median"] - mean) ** 2
        mids.append(r["median"])
        means.append(mean)
        scales.append(deviation(rows, mean, spread / rows))
    modes, categories = [], []
    for c in texts:
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).count()
        top = counts.orderBy(F.desc("count"), c).first()
        modes.append((c, top[0] if top else None))
        categories.append(tuple(r[0] for r in counts.select(c).orderBy(c).collect()))
    prep = Prep(tuple(numbers), tuple(means), tuple(scales))
    return Preprocess(prep, tuple(mids), tuple(modes), tuple(categories))


def apply_preprocess(df: DataFrame, pre: Preprocess, output: str = "features") -> DataFrame:
    """Aligned by name: an absent or null number takes its median, a text its mode; an
    unknown text is all zeros."""
    have = set(df.columns)
    parts: list[Column] = []
    for name, mid, mean, scale in zip(
        pre.prep.columns, pre.medians, pre.prep.mean, pre.prep.scale, strict=True
    ):
        x = f"coalesce(CAST(`{name}` AS DOUBLE), {number(mid)})" if name in have else number(mid)
        parts.append(F.expr(f"({x} - ({number(mean)})) / ({number(scale)})"))
    for (name, mode), values in zip(pre.modes, pre.categories, strict=True):
        x = F.coalesce(F.col(name), F.lit(mode)) if name in have else F.lit(mode)
        parts += [(x == v).cast("double") for v in values]
    return df.withColumn(output, F.array(*parts))


@dataclass(frozen=True)
class Candidate:
    """``build`` makes the estimator from the training size and the target's population
    deviation. ``standardise`` fits on the centred target in units of that deviation."""

    build: Callable[[int, float], Estimator]
    standardise: bool = False


def candidates(config: ForecastConfig = ForecastConfig()) -> dict[str, Candidate]:
    """The five regressions by name, in order of preference on equal scores.

    Spark's squared-loss models minimise a mean loss on a standardised target, so penalties
    given for a sum of squares or a mean are converted here. The Huber objective is
    equivariant: on the standardised target its penalty grows by the deviation, and the
    optimiser starts near the optimum instead of millions away.
    """
    cols = {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "_p"}

    def linear(n: int, sd: float) -> Estimator:
        return LinearRegression(regParam=0.0, solver="normal", **cols)

    def ridge(n: int, sd: float) -> Estimator:
        return LinearRegression(
            regParam=config.ridge_alpha / n * sd, elasticNetParam=0.0, solver="normal",
            standardization=False, **cols,
        )

    def elastic(n: int, sd: float) -> Estimator:
        l1 = config.elastic_alpha * config.elastic_l1_ratio
        l2 = config.elastic_alpha * (1 - config.elastic_l1_ratio) * sd
        return LinearRegression(
            regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2), solver="normal", standardization=False,
            maxIter=10000, **cols,
        )

    def huber(n: int, sd: float) -> Estimator:
        return LinearRegression(
            loss="huber", epsilon=config.huber_epsilon, regParam=config.huber_alpha * sd / n,
            standardization=False, maxIter=500, tol=1e-9, **cols,
        )

    def forest(n: int, sd: float) -> Estimator:
        return RandomForestRegressor(
            numTrees=config.forest_trees, maxDepth=config.forest_depth,
            minInstancesPerNode=config.forest_min_leaf, featureSubsetStrategy="all", seed=config.seed, **cols,
        )

    return {
        "baseline_linear": Candidate(linear),
        "ridge": Candidate(ridge),
        "elasticnet": Candidate(elastic),
        "huber": Candidate(huber, standardise=True),
        "random_forest_small": Candidate(forest),
    }


@dataclass(frozen=True)
class _Training:
    """Training rows as vectors, kept in memory or on disk for all candidates."""

    rows: DataFrame
    preprocess: Preprocess
    n: int
    mean: float
    deviation: float

    def fit(self, candidate: Candidate) -> _Fitted:
        shift, scale = (self.mean, self.deviation) if candidate.standardise else (0.0, 1.0)
        y = (F.col(TARGET) - shift) / scale
        model = candidate.build(self.n, self.deviation).fit(self.rows.select("_x", y.alias("_y")))
        return _Fitted(model, shift, scale)


def _prepare(train: DataFrame, features: Sequence[str]) -> _Training:
    n, mean, sd = train.agg(F.count(F.lit(1)), F.avg(TARGET), F.stddev_pop(TARGET)).first()
    pre = fit_preprocess(train, features, n)
    rows = _vectors(train, pre).select("_x", F.col(TARGET).cast("double").alias(TARGET)).persist()
    return _Training(rows, pre, n, mean, sd or 1.0)


def _vectors(df: DataFrame, pre: Preprocess) -> DataFrame:
    return apply_preprocess(df, pre, "_a").withColumn("_x", array_to_vector("_a")).drop("_a")


def _predict(vectors: DataFrame, fitted: _Fitted) -> DataFrame:
    out = fitted.model.transform(vectors)
    return out.withColumn(PREDICTION, F.col("_p") * fitted.scale + fitted.shift).drop("_x", "_p")


def _predict_linear(df: DataFrame, pre: Preprocess, model: Linear) -> DataFrame:
    weights = F.expr(f"array({', '.join(map(number, model.coefficients))})")
    total = F.aggregate(F.zip_with("_a", weights, lambda x, w: x * w), F.lit(model.intercept), lambda t, v: t + v)
    return apply_preprocess(df, pre, "_a").withColumn(PREDICTION, total).drop("_a")


def forecast(df: DataFrame, model: ForecastModel) -> DataFrame:
    """Add the predicted month-end expense. Absent and null features are imputed."""
    if isinstance(model.model, Linear):
        return _predict_linear(df, model.preprocess, model.model)
    fitted = _Fitted(model.model, model.target_shift, model.target_scale)
    return _predict(_vectors(df, model.preprocess), fitted)


def _metrics(y: str, prediction: str) -> list[Column]:
    err = F.col(prediction) - F.col(y)
    sse, sst = F.sum(err * err), F.var_pop(y) * F.count(y)
    r2 = F.when(sst > 0, 1 - sse / F.nullif(sst, F.lit(0.0))).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return [F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), r2.alias("r2")]


def regression_metrics(df: DataFrame, y: str = TARGET, prediction: str = PREDICTION) -> DataFrame:
    """One row: rmse, mae, r2. A constant target scores 1 when exact, else 0."""
    return df.agg(*_metrics(y, prediction))


def baseline_metrics(split: DataFrame) -> DataFrame:
    """The mean of everything before as forecast, for validation and test, in one grouped pass."""
    y = F.col(TARGET)
    means = split.agg(
        F.avg(F.when(F.col("split") == "train", y)).alias("valid"),
        F.avg(F.when(F.col("split") != "test", y)).alias("test"),
    )
    filled = split.filter(F.col("split") != "train").withColumn("_m", means.select(F.struct("*")).scalar())
    before = F.when(F.col("split") == "valid", F.col("_m.valid")).otherwise(F.col("_m.test"))
    scored = filled.withColumn(PREDICTION, before).groupBy("split").agg(*_metrics(TARGET, PREDICTION))
    return scored.select(F.lit("baseline_mean").alias("model"), "split", "rmse", "mae", "r2")


def _scores(predicted: DataFrame) -> tuple[float, float, float]:
    return tuple(regression_metrics(predicted).first())


#: Candidates that follow from moments; the others are fitted by Spark, range by range.
LINEAR = ("baseline_linear", "ridge", "elasticnet", "huber")


class _Trials:
    """Fits and held-out scores of candidates over ranges of months.

    Linear candidates of all ranges come from moments. Frames with a text feature, and the
    forest, go through Spark's own estimators range by range.
    """

    def __init__(self, rows: DataFrame, features: Sequence[str], ranges: Sequence[Range], config: ForecastConfig):
        self.rows, self.features, self.config = rows, list(features), config
        self.ranges = {r.name: r for r in ranges}
        self.moments = None if _text_columns(rows, features) else Moments(rows, features, TARGET, ranges)
        self.weights: dict[str, list] = {}
        self.held: dict[tuple[str, str], tuple[_Fitted, Preprocess]] = {}

    def _training(self, r: Range) -> _Training:
        before = self.rows.filter(F.col("position") < r.fit_end)
        if self.moments is None:
            return _prepare(before, self.features)
        pre = self.preprocess(r.name)
        vectors = _vectors(before, pre).select("_x", F.col(TARGET).cast("double").alias(TARGET)).persist()
        return _Training(vectors, pre, 0, 0.0, 1.0)

    def preprocess(self, name: str) -> Preprocess:
        found = self.moments.prepared(name)
        return Preprocess(Prep(tuple(self.features), found.mean, found.scale), found.medians)

    def scores(self, names: Sequence[str], ranges: Sequence[str]) -> dict[tuple[str, str], tuple[float, float, float]]:
        """(rmse, mae, r2) by candidate and range."""
        linear = [m for m in names if m in LINEAR and self.moments is not None]
        for m in linear:
            if m not in self.weights:
                self.weights[m] = self.moments.fit(m, self.config)
        out = {}
        if linear:
            found = self.moments.scores({m: self.weights[m] for m in linear})
            out = {key: value for key, value in found.items() if key[1] in ranges}
        others, builders = [m for m in names if m not in linear], candidates(self.config)
        for r in [self.ranges[n] for n in ranges] if others else []:
            training = self._training(r)
            after = self.rows.filter((F.col("position") >= r.fit_end) & (F.col("position") < r.score_end))
            held_out = _vectors(after, training.preprocess).select("_x", TARGET).persist()
            for m in others:
                fitted = training.fit(builders[m])
                self.held[m, r.name] = fitted, training.preprocess
                out[m, r.name] = _scores(_predict(held_out, fitted))
            training.rows.unpersist()
            held_out.unpersist()
        return out

    def model(self, name: str, range_: str) -> ForecastModel:
        """The fit that ``scores`` made of one candidate and range."""
        if name in self.weights:
            i = list(self.ranges).index(range_)
            fitted, pre = _Fitted(self.moments.linear(self.weights[name][i]), 0.0, 1.0), self.preprocess(range_)
        else:
            fitted, pre = self.held[name, range_]
        day = self.config.snapshot_day
        return ForecastModel(name, day, tuple(self.features), pre, fitted.model, fitted.shift, fitted.scale)


def _cv_ranges(train_months: int, n_splits: int) -> list[Range]:
    return [Range(f"fold {i}", start, end) for i, start, end in cv_folds(train_months, n_splits)]


def _cv_table(spark, names: Sequence[str], folds: Sequence[Range], scores: dict) -> DataFrame:
    rows = []
    for m in names:
        mine = [scores[m, r.name] for r in folds]
        rows.append((m, *[sum(s[i] for s in mine) / len(mine) for i in range(3)]))
    return spark.createDataFrame(rows, "model string, cv_rmse_mean double, cv_mae_mean double, cv_r2_mean double")


def time_series_cv(
    train: DataFrame,
    features: Sequence[str],
    config: ForecastConfig = ForecastConfig(),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Mean fold scores per candidate. ``train`` carries ``position``."""
    chosen = list(names or candidates(config))
    folds = _cv_ranges(train.select("position").distinct().count(), config.n_splits)
    scores = _Trials(train, features, folds, config).scores(chosen, [r.name for r in folds])
    return _cv_table(train.sparkSession, chosen, folds, scores)


def fit_forecaster(
    dataset: DataFrame,
    key_cols: Sequence[str] = (),
    config: ForecastConfig = ForecastConfig(),
    names: Sequence[str] | None = None,
    cross_validate: bool = True,
) -> tuple[ForecastModel, DataFrame, DataFrame | None]:
    """(model, metrics by model and split, cross-validation table).

    The lowest validation rmse wins, the earlier candidate on a tie; the winner is refitted
    on training and validation months and scored on the test months.
    """
    features = [c for c in dataset.columns if c not in {*key_cols, "YearMonth", MONTH, TARGET}]
    split = durable(time_split(dataset, config.train_ratio, config.valid_ratio))
    ends = {r[0]: r[1] + 1 for r in split.groupBy("split").agg(F.max("position")).collect()}
    if set(ends) != {"train", "valid", "test"}:
        raise ValueError(f"empty split: only {sorted(ends)} have rows")
    chosen = list(names or candidates(config))
    folds = _cv_ranges(ends["train"], config.n_splits) if cross_validate else []
    selection, final = Range("valid", ends["train"], ends["valid"]), Range("test", ends["valid"], ends["test"])
    trials = _Trials(split, features, [*folds, selection, final], config)
    scores = trials.scores(chosen, [r.name for r in (*folds, selection)])
    cv = _cv_table(split.sparkSession, chosen, folds, scores) if folds else None
    rows = [tuple(r) for r in baseline_metrics(split).collect()]
    rows += [(m, "valid", *scores[m, "valid"]) for m in chosen]
    best, best_rmse = None, float("inf")
    for m in chosen:
        if scores[m, "valid"][0] < best_rmse:
            best, best_rmse = m, scores[m, "valid"][0]
    if best is None:
        raise ValueError("no candidate reached a finite validation error")
    rows.append((best, "test", *trials.scores([best], ["test"])[best, "test"]))
    metrics = split.sparkSession.createDataFrame(rows, "model string, split string, rmse double, mae double, r2 double")
    return trials.model(best, "test"), metrics, cv
