"""k-means in one pass for all restarts, against plain versions of its parts."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import clustering as K
from tallyspark.operators import kmeans as KM

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    return np.vstack([rng.normal(c, 0.9, (60, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 4, 2), (2, 2, -3))])


def frame(spark, points, parts):
    rows = [(f"w{i:03d}", [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "YearWeek string, features array<double>").repartition(parts)


def plain_starts(points, k, n_init, seed):
    keys = [int(hashlib.md5(f"w{i:03d}".encode()).hexdigest()[:12], 16) % KM.PRIME for i in range(len(points))]
    out = []
    for r in range(n_init):
        chosen = []
        for step in range(k):
            a, b = KM.multipliers(seed, r, step)
            score = []
            for key, x in zip(keys, points, strict=True):
                weight = min(((x - c) ** 2).sum() for c in chosen) if chosen else 1.0
                u = ((key * a + b) % KM.PRIME + 0.5) / KM.PRIME
                score.append(-np.log(u) / weight if weight > 0 else np.inf)
            chosen.append(points[int(np.argmin(score))])
        out.append(np.array(chosen))
    return out


def plain_lloyd(points, centers, limit, max_iter):
    moves, still = 0, False
    while True:
        far = ((points[:, None] - centers[None]) ** 2).sum(2)
        label, cost = far.argmin(1), far.min(1).sum()
        if still or moves == max_iter:
            return centers, cost, moves
        moved = np.array([points[label == c].mean(0) if (label == c).any() else centers[c] for c in range(len(centers))])
        still, centers, moves = ((moved - centers) ** 2).sum() <= limit, moved, moves + 1


def test_all_restarts_equal_single_runs(spark, points):
    df = frame(spark, points, 3)
    rows = df.select(KM.key_hash(["YearWeek"]).alias("key"), "features").persist()
    starts = KM.draw_starts(rows, 4, 6, 42)
    want = plain_starts(points, 4, 6, 42)
    assert all(np.allclose(a, b) for a, b in zip(starts, want, strict=True))
    passes = []
    runs = KM.lloyd(rows, starts, 100, 1e-4, passes.append)
    for run, start in zip(runs, want, strict=True):
        centers, cost, moves = plain_lloyd(points, start, 1e-4, 100)
        assert run.iterations == moves and run.cost == pytest.approx(cost) and np.allclose(run.centers, centers)
    assert passes == sorted(passes, reverse=True) and passes[0] == 6  # finished restarts drop out
    assert len(passes) == max(r.iterations for r in runs) + 1  # jobs follow the slowest, not the number


def test_fit_does_not_hang_on_partitions(spark, points):
    fits = [KM.fit_restarts(frame(spark, points, p), COLS, [3, 4], 5, 100, 42, ["YearWeek"]) for p in (1, 3, 7)]
    for k in (3, 4):
        for other in fits[1:]:
            assert np.allclose(fits[0][k].centers, other[k].centers, rtol=0, atol=1e-9)
        starts = [s[:k] for s in plain_starts(points, 4, 5, 42)]
        limit = KM.TOLERANCE * points.var(0).mean()
        assert fits[0][k].cost == pytest.approx(min(plain_lloyd(points, s, limit, 100)[1] for s in starts))
        assert list(fits[0][k].centers) == sorted(fits[0][k].centers) and fits[0][k].k == k


def test_moves_are_bounded_and_empty_centres_stay(spark, points):
    rows = frame(spark, points, 2).select(F.lit(0).alias("key"), "features")
    far = np.array([[0.0, 0, 0], [900.0, 900, 900]])
    once, = KM.lloyd(rows, [far], 1)
    assert once.iterations == 1 and np.allclose(once.centers, [points.mean(0), far[1]])
    none, = KM.lloyd(rows, [far], 0)
    assert none.iterations == 0 and np.allclose(none.centers, far)


def test_few_and_repeated_rows(spark):
    same = spark.createDataFrame([("a", [1.0, 2.0])] * 5 + [("b", [3.0, 2.0])], "w string, features array<double>")
    model = K.fit_kmeans(same, ["x", "y"], 2, n_init=3, max_iter=10)
    assert model.centers == ((1.0, 2.0), (3.0, 2.0)) and model.cost == pytest.approx(0.0)
    fewer = K.fit_kmeans(same, ["x", "y"], 3, n_init=2, max_iter=10, key_cols=["w"])
    assert fewer.k == 2  # no third row that differs
    with pytest.raises(ValueError, match="no rows"):
        K.fit_kmeans(same.where("false"), ["x", "y"], 2, n_init=2)


@pytest.mark.parametrize("parts", [1, 5])
def test_block_pairs_of_the_silhouette(spark, points, parts):
    df = frame(spark, points, parts).withColumn("cluster_label", F.abs(F.hash("YearWeek")) % 3 * 2)
    rows = df.orderBy("YearWeek").collect()
    labels = np.array([r["cluster_label"] for r in rows])
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    want = []
    for i, g in enumerate(labels):
        means = {h: far[i][labels == h].sum() / ((labels == h).sum() - (h == g)) for h in set(labels)}
        a, b = means[g], min(v for h, v in means.items() if h != g)
        want.append((b - a) / max(a, b))
    for block_rows in (17, 100, 2000):
        got = K.silhouette(df, ["YearWeek"], block_rows=block_rows).first()
        assert got["silhouette_rows"] == len(points) and got["silhouette"] == pytest.approx(np.mean(want))
    none = K.silhouette(df.where("false"), ["YearWeek"]).first()
    assert none["silhouette"] is None and none["silhouette_rows"] == 0
    one = K.silhouette(df.withColumn("cluster_label", F.lit(0)), ["YearWeek"]).first()
    assert one["silhouette"] == 0.0 and one["silhouette_rows"] == len(points)
