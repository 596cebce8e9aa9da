"""k-means with many restarts in one pass over the rows.

All restarts, of all candidate numbers of clusters, move together: one job an iteration sums the
rows of every (restart, cluster), and a restart that stands still drops out. Tasks add up their
rows in numpy, the sums of the tasks are added by a grouped aggregate, and only sums (restarts x
clusters x features numbers) reach the driver. Work is linear in the rows, and the number of jobs
is that of the slowest restart.

Starts are drawn by the k-means++ rule from the rows themselves: each row holds a hash of its
key, and the row of the least ``-ln(u) / weight`` wins, ``u`` being the hash mixed with restart
and step. The draw hangs on keys and values only, so partitions, their order and lost tasks change
nothing.

A row is an array of numbers, ``features``, and may go on with a wide part that is mostly zero,
given by the arrays ``idx`` and ``val`` of its other places: category features of any number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A restart stands still when its centres move less than this share of the features' variance.
TOLERANCE = 1e-4
#: Rows whose distances to all centres are held at once.
BLOCK_ROWS = 4096
#: Numbers of centres moved in one pass, about: runs beyond it move in passes of their own.
PASS_NUMBERS = 4_000_000
#: Modulus of the draws: products of two numbers below it fit a 64-bit integer.
PRIME = 2**31 - 1


@dataclass(frozen=True)
class Centroids:
    """Cluster centres in scaled space; the position of a centre is its cluster id."""

    columns: tuple[str, ...]
    centers: tuple[tuple[float, ...], ...]
    cost: float = 0.0

    @property
    def k(self) -> int:
        return len(self.centers)


@dataclass(frozen=True)
class Run:
    """One restart: where it stands, the cost of that, and how many times it moved."""

    centers: np.ndarray
    cost: float
    iterations: int


def matrix(batch: pa.RecordBatch, features: str) -> np.ndarray:
    """An array column of equal lengths as rows of numbers."""
    column = batch.column(features)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Rows:
    """Rows of numbers with a wide part of ``width`` places, mostly zero, in compressed form."""

    def __init__(self, x: np.ndarray, width: int = 0, sizes=None, idx=None, val=None):
        self.x, self.width = x, width
        if width:
            self.ends = np.concatenate([[0], np.cumsum(sizes)])
            self.idx, self.val = idx, val

    @classmethod
    def of(cls, batch: pa.RecordBatch, width: int = 0, features: str = "features") -> Rows:
        x = matrix(batch, features)
        if not width:
            return cls(x)
        idx, val = batch.column("idx"), batch.column("val")
        sizes = np.diff(idx.offsets.to_numpy())
        flat = idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(x, width, sizes, flat, val.flatten().to_numpy(zero_copy_only=False))

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, part: slice) -> Rows:
        if not self.width:
            return Rows(self.x[part])
        at = np.arange(len(self))[part]
        a, z = (self.ends[at[0]], self.ends[at[-1] + 1]) if len(at) else (0, 0)
        return Rows(self.x[part], self.width, np.diff(self.ends)[part], self.idx[a:z], self.val[a:z])

    def blocks(self) -> Iterator[Rows]:
        for at in range(0, len(self), BLOCK_ROWS):
            yield self[at : at + BLOCK_ROWS]

    def _owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends))

    def square_distances(self, centers: np.ndarray) -> np.ndarray:
        d = self.x.shape[1]
        out = square_distances(self.x, centers[:, :d])
        if self.width and len(self):
            wide, owner = centers[:, d:], self._owner()
            own = np.bincount(owner, self.val * self.val, len(self))
            # what the places given differ from zero by; the other places add the centre's squares
            cross = np.empty((len(self), len(centers)))
            for c in range(len(centers)):
                cross[:, c] = np.bincount(owner, self.val * wide[c, self.idx], len(self))
            out = np.maximum(out + own[:, None] - 2 * cross + (wide * wide).sum(1), 0.0)
        return out

    def sums(self, label: np.ndarray, size: int) -> np.ndarray:
        """The rows added up by label."""
        chosen = np.zeros((size, len(self)))
        chosen[label, np.arange(len(self))] = 1.0
        out = chosen @ self.x
        if not self.width:
            return out
        wide = np.bincount(label[self._owner()] * self.width + self.idx, self.val, size * self.width)
        return np.concatenate([out, wide.reshape(size, self.width)], axis=1)

    def dense(self, first: int, end: int) -> np.ndarray:
        """The places ``first`` to ``end`` of all rows, the numbers before the wide part."""
        d = self.x.shape[1]
        parts = [self.x[:, first:end]]
        if self.width and end > d:
            a, z = max(first - d, 0), end - d
            mine = (self.idx >= a) & (self.idx < z)
            wide = np.zeros((len(self), min(z, self.width) - a))
            wide[self._owner()[mine], self.idx[mine] - a] = self.val[mine]
            parts.append(wide)
        return np.concatenate(parts, axis=1)

    def row(self, i: int) -> tuple[list, list, list]:
        if not self.width:
            return self.x[i].tolist(), [], []
        a, z = self.ends[i], self.ends[i + 1]
        return self.x[i].tolist(), self.idx[a:z].tolist(), self.val[a:z].tolist()


def row_columns(width: int) -> list[str]:
    return ["features", "idx", "val"] if width else ["features"]


def square_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Of each row to each centre; where the difference of large squares is all rounding, plainly."""
    both = (x * x).sum(1)[:, None] + (centers * centers).sum(1)
    out = both - 2 * (x @ centers.T)
    i, j = np.nonzero(out < 1e-9 * both)
    for at in range(0, len(i), 10_000):
        near = i[at : at + 10_000], j[at : at + 10_000]
        out[near] = ((x[near[0]] - centers[near[1]]) ** 2).sum(1)
    return out


def multipliers(seed: int, restart: int, step: int) -> tuple[int, int]:
    """What a draw makes of a key's hash: ``(a * hash + b) mod PRIME``."""
    a = (48271 * (seed + 1) + 1_299_721 * (restart + 1) + 15_485_863 * (step + 1)) % PRIME
    a = a * a % PRIME * 69621 % PRIME
    return a or 1, (a * 16807 + 40692 * (restart + 1)) % PRIME


def _draws(keys: np.ndarray, seed: int, restart: int, step: int) -> np.ndarray:
    a, b = multipliers(seed, restart, step)
    return -np.log(((keys * np.int64(a) + np.int64(b)) % PRIME + 0.5) / PRIME)


def key_hash(key_cols: Sequence[str]):
    """The hash of a row's key below ``PRIME``, by MD5 of its text, so that any engine can compute it."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key_cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % PRIME


def draw_starts(rows: DataFrame, k: int, n_init: int, seed: int, width: int = 0) -> list[np.ndarray]:
    """Starts of ``n_init`` restarts: ``k`` passes over ``rows(key, features)``, one centre each.

    Centre j is drawn with odds of the squared distance to the nearest centre before it. Fewer
    distinct rows than ``k`` give fewer centres.
    """
    starts: list[list[np.ndarray]] = [[] for _ in range(n_init)]
    for step in range(k):
        held = [np.array(s) for s in starts]

        def best(batches: Iterator[pa.RecordBatch], held=held, step=step) -> Iterator[pa.RecordBatch]:
            found: dict[int, tuple] = {}
            for batch in batches:
                every, keys = Rows.of(batch, width), batch.column("key").to_numpy(zero_copy_only=False)
                if not len(every):
                    continue
                for r, centers in enumerate(held):
                    if len(centers) < step:
                        continue
                    weight = every.square_distances(centers).min(1) if step else np.ones(len(every))
                    with np.errstate(divide="ignore"):
                        score = np.where(weight > 0, _draws(keys, seed, r, step) / np.maximum(weight, 1e-300), np.inf)
                    least = score.min()
                    if np.isfinite(least):
                        at = np.flatnonzero(score == least)
                        row = min((float(least), int(keys[i]), *every.row(i)) for i in at)
                        if r not in found or row < found[r]:
                            found[r] = row
            table = [(r, *row) for r, row in found.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t[i] for t in table], kind) for i, kind in enumerate(_START_TYPES)], _START_NAMES
            )

        drawn = rows.mapInArrow(best, _START_SCHEMA).groupBy("restart").agg(
            F.min(F.struct("score", "key", "features", "idx", "val")).alias("row")
        )
        for r in drawn.collect():  # one row a restart
            wide = np.zeros(width)
            wide[np.array(r["row"]["idx"], int)] = r["row"]["val"]
            starts[r["restart"]].append(np.concatenate([r["row"]["features"], wide]))
    return [np.array(s) for s in starts]


_START_NAMES = ["restart", "score", "key", "features", "idx", "val"]
_START_TYPES = [pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64())]
_START_SCHEMA = "restart int, score double, key long, features array<double>, idx array<int>, val array<double>"


def add_up(rows: DataFrame, function, size: int) -> np.ndarray:
    """``size`` numbers that ``function`` adds up of each task's batches, added over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = function(batches)
        slots = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(flat[slots])], ["slot", "value"])

    added = rows.mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(size)
    total[added.column("slot").to_numpy()] = added.column("value").to_numpy()
    return total


def _sums(rows: DataFrame, runs: Sequence[np.ndarray], width: int = 0) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One pass: for each run, rows per cluster, their sums, and the cost of its centres."""
    sizes = [len(c) for c in runs]
    ends = np.cumsum(sizes)
    every = np.vstack(runs)
    d = every.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((len(every), d + 2))  # sums, number, cost
        for batch in batches:
            for block in Rows.of(batch, width).blocks():
                far = block.square_distances(every)
                for size, end in zip(sizes, ends, strict=True):
                    mine = far[:, end - size : end]
                    label = mine.argmin(1)
                    part = total[end - size : end]
                    part[:, :d] += block.sums(label, size)
                    part[:, d] += np.bincount(label, minlength=size)
                    part[:, d + 1] += np.bincount(label, mine[np.arange(len(block)), label], size)
        return total.ravel()

    total = add_up(rows, add, len(every) * (d + 2)).reshape(len(every), d + 2)
    parts = np.split(total, ends[:-1])
    return [(p[:, -2], p[:, :-2], float(p[:, -1].sum())) for p in parts]


def lloyd(
    rows: DataFrame, starts: Sequence[np.ndarray], max_iter: int, tolerance: float = 0.0,
    on_pass: Callable[[int], None] | None = None, width: int = 0,
) -> list[Run]:
    """Move all ``starts`` over ``rows(features)`` until they stand still or ``max_iter`` moves are made.

    A centre without rows stays where it is; a row as near to two centres goes to the first. A
    run stands still when the squared moves of its centres add up to ``tolerance`` or less; its
    cost is that of where it then stands. ``on_pass`` is told the number of runs of each pass.
    """
    at = {i: np.array(s, float) for i, s in enumerate(starts)}
    moves = dict.fromkeys(at, 0)
    still: set[int] = set()
    done: dict[int, Run] = {}
    while at:
        if on_pass:
            on_pass(len(at))
        # as many runs as the bound on numbers allows
        share = max(1, PASS_NUMBERS // max(c.size for c in at.values()))
        ids = list(at)
        groups = [ids[i : i + share] for i in range(0, len(ids), share)]
        found = [part for g in groups for part in _sums(rows, [at[i] for i in g], width)]
        for i, (n, sums, cost) in zip(ids, found, strict=True):
            if i in still or moves[i] == max_iter:
                done[i] = Run(at.pop(i), cost, moves[i])
                continue
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at[i])
            if ((moved - at[i]) ** 2).sum() <= tolerance:
                still.add(i)
            moves[i] += 1
            at[i] = moved
    return [done[i] for i in range(len(starts))]


def fit_restarts(
    df: DataFrame,
    columns: Sequence[str],
    ks: Sequence[int],
    n_init: int = 20,
    max_iter: int = 500,
    seed: int = 42,
    key_cols: Sequence[str] = (),
    features: str = "features",
    tolerance: float = TOLERANCE,
    width: int = 0,
) -> dict[int, Centroids]:
    """For each k the best of ``n_init`` restarts by cost, all fitted in the same passes.

    ``key_cols`` name rows for the draws of the starts; without them a row is named by its
    features. Restart i of a smaller k starts from the first centres of restart i of the largest.
    Ids are numbered by centre, so they do not hang on the winning restart; restarts of equal cost
    (to twelve digits) rank by number. ``df`` should be a written frame (``session.durable``): every
    pass reads it again.
    """
    wide = ["idx", "val"] if width else []
    named = key_hash(key_cols) if key_cols else F.pmod(F.xxhash64(features, *wide), F.lit(PRIME).cast("long"))
    rows = df.select(named.alias("key"), F.col(features).alias("features"), *wide).persist()
    try:
        starts = draw_starts(rows, max(ks), n_init, seed, width)
        runs = [(k, s[:k]) for k in ks for s in starts if len(s)]
        if not runs:
            raise ValueError("no rows to fit on")
        limit = tolerance * _mean_variance(rows, len(columns), width)
        fitted = lloyd(rows, [s for _, s in runs], max_iter, limit, width=width)
    finally:
        rows.unpersist()
    best: dict[int, Run] = {}
    for (k, _), run in zip(runs, fitted, strict=True):
        if k not in best or run.cost < best[k].cost * (1 - 1e-12):
            best[k] = run
    return {
        k: Centroids(tuple(columns), tuple(sorted(tuple(map(float, c)) for c in run.centers)), run.cost)
        for k, run in best.items()
    }


def _mean_variance(rows: DataFrame, dim: int, width: int) -> float:
    """The columns' mean population variance: the cost of one cluster at the mean, a row and column."""
    origin = np.zeros((1, dim + width))
    (n, sums, cost), = _sums(rows, [origin], width)
    return float((cost / n[0] - ((sums[0] / n[0]) ** 2).sum()) / (dim + width)) if n[0] else 0.0


def fit_kmeans(
    df: DataFrame,
    columns: Sequence[str],
    k: int,
    n_init: int = 20,
    max_iter: int = 500,
    seed: int = 42,
    features: str = "features",
    key_cols: Sequence[str] = (),
) -> Centroids:
    """Best of ``n_init`` restarts; see ``fit_restarts``."""
    return fit_restarts(df, columns, [k], n_init, max_iter, seed, key_cols, features)[k]
