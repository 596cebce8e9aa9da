"""Linear regressions of many training ranges from one pass of moments.

Ranges are runs of month positions: the folds of a cross-validation, the validation fit, the
refit. One job sums the products of all pairs of columns for each position; sums over a range of
positions are the Gram matrix of that range, and least squares, ridge and elastic net follow from
it on the driver. What moves is months x columns squared numbers, however many rows there are.

A missing number is carried as 0 with a flag column, so the same moments serve every range's own
median: an imputed column is the number plus median times flag. Columns are centred and scaled by
statistics of all rows before products are taken, which keeps the sums well conditioned.

The Huber loss needs reweighted moments: each Newton step of all ranges together is one job that
sums value, gradient and curvature at the present point of each range. One last job takes the
errors of all fits on all their held-out rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.config import ForecastConfig
from tallyspark.functions.quantiles import exact_medians
from tallyspark.operators.prep import deviation, feature_stats

#: Directions whose share of the largest is below this are not told apart from none.
RANK_TOLERANCE = 1e-12
#: A column varies if its variance is above this, in units of its variance over all rows.
VARIES = 1e-13


@dataclass(frozen=True)
class Range:
    """Fit on the positions before ``fit_end``, score those from there up to ``score_end``."""

    name: str
    fit_end: int
    score_end: int


@dataclass(frozen=True)
class Linear:
    """A prediction from prepared features."""

    coefficients: tuple[float, ...]
    intercept: float


@dataclass(frozen=True)
class Prepared:
    """How a range prepares its columns: medians for gaps, then mean and deviation."""

    medians: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]


def _vectors(batch: pa.RecordBatch, shape: _Shape) -> tuple[np.ndarray, np.ndarray]:
    """Positions, and rows (centred numbers, missing flags, 1, centred target)."""
    parts = [batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in ("position", *shape.names, "target")]
    x = (np.array(parts[1:-1]).reshape(len(shape.names), -1).T - shape.mean) / shape.scale
    gaps = np.isnan(x)
    x[gaps] = 0.0
    y = (parts[-1] - shape.target_mean) / shape.target_scale
    rows = np.column_stack([x, gaps[:, shape.gappy].astype(float), np.ones(len(y)), y])
    return parts[0].astype(np.int64), rows


@dataclass(frozen=True)
class _Shape:
    """What all rows' statistics fix: the columns' centres and scales, and which have gaps."""

    names: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    gappy: np.ndarray
    target_mean: float
    target_scale: float

    @property
    def width(self) -> int:
        return len(self.names) + len(self.gappy) + 2


def _deviation(stats) -> float:
    return deviation(stats["n"], stats["mean"], stats["variance"]) if stats["n"] else 1.0


class Moments:
    """Fits over ranges of positions of ``rows(position, features.., target)``.

    Rows whose target is missing take no part. A feature without any value in a range cannot be
    imputed and is an error. ``rows`` should be a written frame: every pass reads it again.
    """

    def __init__(self, rows: DataFrame, features: Sequence[str], target: str, ranges: Sequence[Range]):
        self.ranges, self.features = list(ranges), tuple(features)
        numbers = [F.col(f"`{c}`").cast("double") for c in (*features, target)]
        named = [F.when(~F.isnan(c), c).alias(n) for c, n in zip(numbers, (*features, "target"), strict=True)]
        self.rows = rows.select("position", *named).where("target IS NOT NULL")
        stats = {r["feature"]: r for r in feature_stats(self.rows, [*features, "target"]).collect()}
        y = stats.get("target")
        if not (y and y["n"]):
            raise ValueError("no rows to fit on")
        n = [stats[c]["n"] for c in features]
        self.shape = _Shape(
            self.features,
            np.array([stats[c]["mean"] or 0.0 for c in features]),
            np.array([_deviation(stats[c]) for c in features]),
            np.array([i for i, m in enumerate(n) if m < y["n"]], int),
            y["mean"], _deviation(y),
        )
        self.gram = self._by_position()
        self.medians = self._medians()
        self.frames = [self._frame(r) for r in self.ranges]

    # passes over the rows ---------------------------------------------------------------

    def _by_position(self) -> dict[int, np.ndarray]:
        shape = self.shape
        upper = np.triu_indices(shape.width)

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                position, rows = _vectors(batch, shape)
                for p in np.unique(position):
                    mine = rows[position == p]
                    total[int(p)] = total.get(int(p), 0.0) + mine.T @ mine
            for p, gram in total.items():
                cells = gram[upper]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cells), p, np.int32)), pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)],
                    ["position", "cell", "value"],
                )

        summed = self.rows.mapInArrow(products, "position int, cell int, value double")
        table = summed.groupBy("position", "cell").agg(F.sum("value").alias("value")).toArrow()  # months x cells
        position, cell, value = (table.column(c).to_numpy() for c in ("position", "cell", "value"))
        out = {}
        for p in np.unique(position):
            gram, mine = np.zeros((shape.width, shape.width)), position == p
            gram[upper[0][cell[mine]], upper[1][cell[mine]]] = value[mine]
            out[int(p)] = gram + np.triu(gram, 1).T
        return out

    def _medians(self) -> list[np.ndarray]:
        """Each range's medians: one grouped pass, every row once for each range it is fitted in."""
        parts = [F.when(F.col("position") < r.fit_end, F.lit(i)) for i, r in enumerate(self.ranges)]
        held = self.rows.withColumn("_range", F.explode(F.array_compact(F.array(*parts))))
        long = held.select("_range", *self.features).unpivot("_range", list(self.features), "feature", "value")
        found = exact_medians(long, ["value"], ["_range", "feature"]).collect()
        by_name = {(r["_range"], r["feature"]): r["value"] for r in found}
        out = []
        for i, r in enumerate(self.ranges):
            missing = [c for c in self.features if by_name.get((i, c)) is None]
            if missing:
                raise ValueError(f"feature {missing[0]!r} has no value to impute from in {r.name!r}")
            out.append(np.array([by_name[i, c] for c in self.features]))
        return out

    def over(self, first: int, end: int) -> np.ndarray:
        mine = [g for p, g in self.gram.items() if first <= p < end]
        return sum(mine, np.zeros((self.shape.width, self.shape.width)))

    # a range's own columns --------------------------------------------------------------

    def _frame(self, r: Range) -> _Frame:
        shape, d = self.shape, len(self.features)
        gram = self.over(0, r.fit_end)
        n = gram[-2, -2]
        if n == 0:
            raise ValueError(f"no rows to fit {r.name!r} on")
        fill = (self.medians[self.ranges.index(r)] - shape.mean) / shape.scale
        imputed = np.zeros((shape.width, d))
        imputed[:d] = np.eye(d)
        for j, column in enumerate(shape.gappy):
            imputed[d + j, column] = fill[column]
        mean = imputed.T @ gram[:, -2] / n
        variance = np.einsum("ij,ik,kj->j", imputed, gram, imputed) / n - mean**2
        scale = np.where(variance > VARIES * np.maximum(1.0, mean**2), np.sqrt(np.maximum(variance, 0.0)), 1.0)
        columns = imputed / scale
        columns[-2] -= mean / scale
        return _Frame(r, columns, gram, n, mean, scale)

    def prepared(self, name: str) -> Prepared:
        """The preparation of a range in the units of the data."""
        i = [r.name for r in self.ranges].index(name)
        frame, shape = self.frames[i], self.shape
        return Prepared(
            tuple(map(float, self.medians[i])), tuple(map(float, shape.mean + shape.scale * frame.mean)),
            tuple(map(float, shape.scale * frame.scale)),
        )

    def linear(self, weights: np.ndarray) -> Linear:
        """Weights of prepared features and intercept, for the centred target, in the units of the data."""
        shape = self.shape
        return Linear(
            tuple(map(float, weights[:-1] * shape.target_scale)), float(weights[-1] * shape.target_scale + shape.target_mean)
        )

    # fits -------------------------------------------------------------------------------

    def fit(self, name: str, config: ForecastConfig = ForecastConfig()) -> list[np.ndarray]:
        """Weights and intercept of every range for one of the linear candidates."""
        if name == "huber":
            return self._huber(config.huber_epsilon, config.huber_alpha)
        return [_solve(f, name, config, self.shape.target_scale) for f in self.frames]

    def _predictors(self, fits: Sequence[np.ndarray]) -> np.ndarray:
        """The fits as functions of the carried columns, one column each."""
        out = np.zeros((self.shape.width, len(fits)))
        for i, (frame, w) in enumerate(zip(self.frames, fits, strict=True)):
            out[:, i] = frame.columns @ w[:-1]
            out[-2, i] += w[-1]
        return out

    def _huber(self, epsilon: float, alpha: float, steps: int = 200, tolerance: float = 1e-10) -> list[np.ndarray]:
        """Minimise sum(s + H(r / s) s) + alpha |w|^2 over weights and s, by damped Newton steps.

        The loss is convex in both; a step that does not lower it is halved.
        """
        penalty = alpha * self.shape.target_scale  # of the centred, scaled target
        best = [_solve(f, "baseline_linear", ForecastConfig(), 1.0) for f in self.frames]
        points = {}
        for i, (frame, w) in enumerate(zip(self.frames, best, strict=True)):
            sse = frame.error(w)
            points[i] = _Point(w, np.sqrt(max(sse / frame.n, 1e-12)))
        done: dict[int, np.ndarray] = {}
        trials = dict(points)
        for _ in range(steps):
            for i, parts in self._weighted(trials, epsilon).items():
                here = self.frames[i].loss(trials[i], parts, epsilon, penalty)
                point = points[i]
                if point.loss is not None and not here.loss <= point.loss:
                    point.step /= 2
                    if point.step < 1e-8:  # rounding is all that is left
                        done[i] = point.weights
                else:
                    points[i] = point = here
                    if np.abs(point.gradient).max() <= tolerance * self.frames[i].n:
                        done[i] = point.weights
            trials = {i: p.moved() for i, p in points.items() if i not in done}
            if not trials:
                break
        return [done.get(i, points[i].weights) for i in range(len(self.frames))]

    def _weighted(self, points: dict[int, _Point], epsilon: float) -> dict[int, dict[str, np.ndarray]]:
        """One pass: products over the rows near each range's prediction; sums over those far off."""
        ids, shape = list(points), self.shape
        predict = np.zeros((shape.width, len(ids)))
        for j, i in enumerate(ids):
            predict[:, j] = self.frames[i].columns @ points[i].weights[:-1]
            predict[-2, j] += points[i].weights[-1]
        sigma = np.array([points[i].sigma for i in ids])
        ends = [self.ranges[i].fit_end for i in ids]
        w = shape.width

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near, far = np.zeros((len(ids), w, w)), np.zeros((len(ids), w + 2))
            for batch in batches:
                position, rows = _vectors(batch, shape)
                residual = rows[:, -1:] - rows @ predict
                for j, end in enumerate(ends):
                    mine = position < end
                    r, v = residual[mine, j], rows[mine]
                    inside = np.abs(r) < epsilon * sigma[j]
                    near[j] += v[inside].T @ v[inside]
                    sign = np.sign(r[~inside])
                    far[j, :w] += sign @ v[~inside]
                    far[j, w] += np.abs(r[~inside]).sum()
                    far[j, w + 1] += len(sign)
            flat = np.concatenate([near.reshape(len(ids), -1), far], axis=1).ravel()
            slots = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(flat[slots])], ["slot", "value"])

        table = self.rows.mapInArrow(sums, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
        flat = np.zeros(len(ids) * (w * w + w + 2))
        flat[table.column("slot").to_numpy()] = table.column("value").to_numpy()
        out = {}
        for i, part in zip(ids, flat.reshape(len(ids), -1), strict=True):
            out[i] = {"near": part[: w * w].reshape(w, w), "sign": part[w * w : w * w + w], "off": part[-2], "n_off": part[-1]}
        return out

    def scores(self, fits: dict[str, list[np.ndarray]]) -> dict[tuple[str, str], tuple[float, float, float]]:
        """(rmse, mae, r2) of every model in every range's held-out rows, in one pass."""
        models, shape, ranges = list(fits), self.shape, self.ranges
        predict = np.stack([self._predictors(fits[m]) for m in models])  # model, column, range
        size = (len(models), len(ranges), 5)

        def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                position, rows = _vectors(batch, shape)
                for j, r in enumerate(ranges):
                    mine = (position >= r.fit_end) & (position < r.score_end)
                    y = rows[mine, -1]
                    for m in range(len(models)):
                        e = rows[mine] @ predict[m, :, j] - y
                        total[m, j] += (len(y), np.abs(e).sum(), (e * e).sum(), y.sum(), (y * y).sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["slot", "value"]
            )

        table = self.rows.mapInArrow(errors, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
        total = np.zeros(size)
        total.ravel()[table.column("slot").to_numpy()] = table.column("value").to_numpy()
        out = {}
        for m, model in enumerate(models):
            for j, r in enumerate(ranges):
                n, off, square, y, yy = total[m, j]
                if n:
                    spread = yy - y * y / n
                    r2 = 1 - square / spread if spread > 0 else float(square == 0)
                    out[model, r.name] = (
                        float(np.sqrt(square / n) * shape.target_scale), float(off / n * shape.target_scale), float(r2)
                    )
        return out


@dataclass
class _Frame:
    """A range's prepared columns as combinations of the carried ones, and its Gram matrix."""

    range: Range
    columns: np.ndarray
    gram: np.ndarray
    n: float
    mean: np.ndarray
    scale: np.ndarray

    def products(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Centred products of the prepared columns with each other and the target; the target's mean."""
        mean = self.gram[-2, -1] / self.n
        with_target = self.columns.T @ self.gram[:, -1]  # the columns are centred in their own range
        return self.columns.T @ self.gram @ self.columns, with_target, mean

    def error(self, w: np.ndarray) -> float:
        v = np.zeros(len(self.gram))
        v += self.columns @ w[:-1]
        v[-2] += w[-1]
        v[-1] -= 1.0
        return float(v @ self.gram @ v)

    def loss(self, at: _Point, parts: dict[str, np.ndarray], epsilon: float, penalty: float) -> _Point:
        """Loss, gradient and curvature in (weights, intercept, sigma)."""
        basis = np.zeros((len(self.gram), len(at.weights)))
        basis[:, :-1] = self.columns
        basis[-2, -1] = 1.0
        residual = -(basis @ at.weights)
        residual[-1] += 1.0
        near, s = parts["near"], at.sigma
        square = residual @ near @ residual
        n_near = near[-2, -2]
        w = np.append(at.weights[:-1], 0.0)
        value = n_near * s + square / s + parts["n_off"] * s * (1 - epsilon**2) + 2 * epsilon * parts["off"] + penalty * w @ w
        by_weight = -2 * basis.T @ (near @ residual) / s - 2 * epsilon * basis.T @ parts["sign"] + 2 * penalty * w
        by_sigma = n_near - square / s**2 + parts["n_off"] * (1 - epsilon**2)
        cross = 2 * basis.T @ (near @ residual) / s**2
        curve = np.zeros((len(w) + 1, len(w) + 1))
        curve[:-1, :-1] = 2 * basis.T @ near @ basis / s + 2 * penalty * np.diag(np.append(np.ones(len(w) - 1), 0.0))
        curve[:-1, -1] = curve[-1, :-1] = cross
        curve[-1, -1] = 2 * square / s**3
        return _Point(at.weights, s, float(value), np.append(by_weight, by_sigma), curve)


@dataclass
class _Point:
    weights: np.ndarray
    sigma: float
    loss: float | None = None
    gradient: np.ndarray | None = None
    curve: np.ndarray | None = None
    step: float = 1.0

    def moved(self) -> _Point:
        """The Newton step, shortened to keep sigma positive."""
        ridge = 1e-10 * np.trace(self.curve) / len(self.curve)
        way = -np.linalg.lstsq(self.curve + ridge * np.eye(len(self.curve)), self.gradient, rcond=1e-14)[0]
        step = self.step
        if way[-1] < 0:
            step = min(step, 0.9 * self.sigma / -way[-1])
        return _Point(self.weights + step * way[:-1], self.sigma + step * way[-1])


def _solve(frame: _Frame, name: str, config: ForecastConfig, target_scale: float) -> np.ndarray:
    gram, with_target, mean = frame.products()
    if name == "baseline_linear":
        w = np.linalg.pinv(gram, rcond=RANK_TOLERANCE, hermitian=True) @ with_target
    elif name == "ridge":
        w = np.linalg.solve(gram + config.ridge_alpha * np.eye(len(gram)), with_target)
    elif name == "elasticnet":
        # the penalty is given for the target in its own units
        w = elastic_net(
            gram / frame.n, with_target / frame.n, config.elastic_alpha * config.elastic_l1_ratio / target_scale,
            config.elastic_alpha * (1 - config.elastic_l1_ratio),
        )
    else:
        raise ValueError(f"{name!r} is no linear candidate")
    return np.append(w, mean)


def elastic_net(gram: np.ndarray, with_target: np.ndarray, l1: float, l2: float, rounds: int = 20_000) -> np.ndarray:
    """Coordinate descent on moments: minimise w'Gw/2 - b'w + l1 |w| + l2 |w|^2 / 2."""
    w, slope = np.zeros(len(gram)), with_target.copy()  # slope = b - G w
    for _ in range(rounds):
        largest = 0.0
        for j in range(len(gram)):
            down = gram[j, j] + l2
            if down <= 0:
                continue
            pull = slope[j] + gram[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / down
            if new != w[j]:
                slope -= gram[:, j] * (new - w[j])
                largest = max(largest, abs(new - w[j]))
                w[j] = new
        if largest <= 1e-13 * max(1.0, np.abs(w).max()):
            break
    return w
