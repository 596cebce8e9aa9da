"""Cluster assignment, quality, summaries and profile labels; the fit itself is in ``kmeans``.

Rows here are entity-weeks with a ``features`` array. Only tables with one row per
cluster or per candidate k reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tallyspark.config import ProfilerConfig
from tallyspark.functions.quantiles import exact_medians
from tallyspark.operators.kmeans import Centroids, Rows, add_up, fit_kmeans, fit_restarts, row_columns, square_distances
from tallyspark.operators.prep import number

__all__ = ["Centroids", "fit_kmeans", "fit_restarts"]

LABEL = "cluster_label"

# The columns a cluster summary reports.
SUMMARY_COLUMNS = (
    "total_expense", "total_income", "net_cash_flow", "expense_to_income_ratio", "weekend_expense_ratio",
    "weekday_expense_ratio", "avg_transaction_value", "expense_frequency_ratio", "income_presence_ratio",
    "expense_volatility_ratio", "dominant_category_ratio", "top2_category_ratio_sum", "category_entropy",
    "unique_categories", "active_days_ratio", "zero_income_week", "expense_vs_rolling_mean_ratio",
    "income_vs_rolling_mean_ratio",
)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))


def center(values: Sequence[float]) -> Column:
    return F.expr(f"array({', '.join(number(v) for v in values)})")


def assign(df: DataFrame, centroids: Centroids, features: str = "features", width: int = 0) -> DataFrame:
    """Add the nearest cluster and its distance; ties go to the lowest id.

    Centres are literals, k times d numbers fixed by the model, so nothing is joined. Rows with a
    wide part (``width`` places, see ``kmeans``) are measured in numpy.
    """
    if width:
        return _assign_wide(df, centroids, features, width)
    dists = F.array(*[distance(F.col(features), center(c)) for c in centroids.centers])
    return (
        df.withColumn("_d", dists)
        .withColumns(
            {
                "nearest_distance": F.array_min("_d"),
                LABEL: (F.array_position("_d", F.array_min("_d")) - 1).cast("int"),
            }
        )
        .drop("_d")
    )


def _assign_wide(df: DataFrame, centroids: Centroids, features: str, width: int) -> DataFrame:
    centers = np.array(centroids.centers)
    added = [StructField("nearest_distance", DoubleType()), StructField(LABEL, IntegerType())]
    schema = StructType([*df.schema.fields, *added])
    names = schema.names

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [b.square_distances(centers) for b in Rows.of(batch, width, features).blocks()]
            far = np.concatenate([np.zeros((0, len(centers))), *blocks])
            columns = [pa.array(np.sqrt(far.min(1))), pa.array(far.argmin(1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    return df.mapInArrow(nearest, schema)


def cluster_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("cluster_size"))


def balance(sizes: DataFrame) -> DataFrame:
    """One row: balance score, smallest share, number of clusters and rows."""
    one = sizes.agg(
        F.collect_list(F.col("cluster_size").cast("double")).alias("s"),
        F.sum("cluster_size").alias("n_rows"),
        F.count(F.lit(1)).alias("k"),
    )
    uneven = F.aggregate(
        F.transform("s", lambda v: F.abs(v / F.col("n_rows") - 1.0 / F.col("k"))),
        F.lit(0.0),
        lambda a, v: a + v,
    )
    return one.select(
        F.col("k").cast("int").alias("k"),
        "n_rows",
        F.greatest(F.lit(0.0), 1.0 - uneven).alias("balance_score"),
        (F.array_min("s") / F.col("n_rows")).alias("min_cluster_fraction"),
    )


def davies_bouldin(df: DataFrame, dim: int, features: str = "features", width: int = 0) -> DataFrame:
    """One row. Two passes of partial aggregates; the pairs are formed among k rows."""
    if width:
        return _davies_bouldin_wide(df, dim, features, width)
    centers = df.groupBy(LABEL).agg(
        F.array(*[F.avg(F.get(F.col(features), F.lit(i))) for i in range(dim)]).alias("c")
    )
    scatter = (
        df.join(F.broadcast(centers), LABEL)  # k rows
        .groupBy(LABEL)
        .agg(F.avg(distance(F.col(features), F.col("c"))).alias("s"), F.first("c").alias("c"))
    )
    packed = scatter.agg(F.collect_list(F.struct(LABEL, "s", "c")).alias("g"))

    def worst(a: Column) -> Column:
        others = F.filter("g", lambda b: b[LABEL] != a[LABEL])
        return F.array_max(F.transform(others, lambda b: (a["s"] + b["s"]) / distance(a["c"], b["c"])))

    total = F.aggregate(F.transform("g", worst), F.lit(0.0), lambda x, v: x + v)
    return packed.select((total / F.size("g")).alias("davies_bouldin"))


def _davies_bouldin_wide(df: DataFrame, dim: int, features: str, width: int) -> DataFrame:
    """As above for rows with a wide part: sums by label in numpy, k centres on the driver."""
    labels = sorted(r[LABEL] for r in cluster_sizes(df).collect())  # k rows
    k, d = len(labels), dim + width
    rows = df.select(LABEL, F.col(features).alias("features"), "idx", "val")

    def places(batch: pa.RecordBatch) -> np.ndarray:
        return np.searchsorted(labels, batch.column(LABEL).to_numpy(zero_copy_only=False))

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k, d + 1))
        for batch in batches:
            of = places(batch)
            total[:, :d] += Rows.of(batch, width).sums(of, k)
            total[:, d] += np.bincount(of, minlength=k)
        return total.ravel()

    total = add_up(rows, sums, k * (d + 1)).reshape(k, d + 1)
    centers = total[:, :d] / np.maximum(total[:, d:], 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        off = np.zeros(k)
        for batch in batches:
            of = places(batch)
            far = np.sqrt(Rows.of(batch, width).square_distances(centers)[np.arange(len(of)), of])
            off += np.bincount(of, far, k)
        return off

    scatter = add_up(rows, spread, k) / np.maximum(total[:, d], 1)
    apart = np.sqrt(square_distances(centers, centers))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (scatter[:, None] + scatter) / apart
    ratio[np.arange(k), np.arange(k)] = -np.inf
    value = float(np.mean(ratio.max(1))) if k > 1 else None
    return df.sparkSession.createDataFrame([(value,)], "davies_bouldin double")


def _width(a: str, b: str) -> Column:
    a, b = F.col(a), F.col(b)
    return F.when(a.isNotNull() & b.isNotNull() & (F.greatest(a, b) > 0), (b - a) / F.greatest(a, b)).otherwise(0.0)


def _between(a: Rows, b: Rows, places: int = 512) -> np.ndarray:
    """Distances of all rows of ``a`` to all of ``b``, so many places of the wide part at a time."""
    out = square_distances(a.x, b.x)
    d = a.x.shape[1]
    for at in range(d, d + a.width, places):
        out += square_distances(a.dense(at, at + places), b.dense(at, at + places))
    return np.sqrt(np.maximum(out, 0.0))


def _pair_sums(labels: Sequence[int], width: int):
    """For a function over one pair of blocks: each row's distances to the rows of the other block,
    summed by the cluster of these."""
    names = [f"s{c}" for c in range(len(labels))]

    def sums(pair: pa.Table) -> pa.Table:
        batch = pair.combine_chunks().to_batches()[0]
        rid, mine, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", LABEL, "side"))
        order = np.argsort(side, kind="stable")
        batch, rid, mine = batch.take(pa.array(order)), rid[order], mine[order]
        rows = Rows.of(batch, width)
        rows.x = rows.x - rows.x.mean(0)
        member = (mine[:, None] == np.array(labels)).astype(float)
        cut, n = int((side == 0).sum()), len(side)
        if cut == n:  # a block and itself, or nothing in the other
            meets = [(0, n, 0, n)] if batch.column("i")[0] == batch.column("j")[0] else []
        else:
            meets = [(0, cut, cut, n), (cut, n, 0, cut)]
        rids, owns, totals = [rid[:0]], [mine[:0]], [np.zeros((0, len(labels)))]
        for a, z, other_a, other_z in meets:
            for at in range(a, z, 500):
                end = min(at + 500, z)
                total = np.zeros((end - at, len(labels)))
                for b in range(other_a, other_z, 2000):
                    part = slice(b, min(b + 2000, other_z))
                    total += _between(rows[at:end], rows[part]) @ member[part]
                rids.append(rid[at:end])
                owns.append(mine[at:end])
                totals.append(total)
        total = np.vstack(totals)
        columns = [pa.array(np.concatenate(rids)), pa.array(np.concatenate(owns).astype(np.int32))]
        return pa.table(columns + [pa.array(total[:, c]) for c in range(len(labels))], names=["rid", "own", *names])

    return sums, "rid long, own int, " + ", ".join(f"{n} double" for n in names)


def silhouette(
    df: DataFrame, key_cols: Sequence[str], measure: str = "euclidean", features: str = "features",
    block_rows: int = 2000, width: int = 0,
) -> DataFrame:
    """One row: the mean silhouette of all rows, and their number.

    ``euclidean`` compares all pairs on the executors. Rows fall into blocks by a hash of the key;
    each row is copied to the pairs of blocks it takes part in, a task meets the two blocks of a
    pair, and only sums by row and cluster move on. That is quadratic work, meant for single
    ledgers. ``squared`` uses squared distances, whose sums follow from each cluster's count, sum
    and sum of squares: one pass and linear work, for any number of rows. The caller chooses; the
    number of rows never does. A row alone in its cluster counts 0. No row gives a null mean.
    ``df`` should be a written frame.
    """
    if measure == "squared":
        if width:
            raise ValueError("the squared measure takes rows without a wide part")
        return _squared_silhouette(df, features)
    if measure != "euclidean":
        raise ValueError(f"measure must be 'euclidean' or 'squared', not {measure!r}")
    sizes = {r[LABEL]: r["cluster_size"] for r in cluster_sizes(df).collect()}  # k rows
    labels = sorted(sizes)
    if not labels:
        return df.agg(F.lit(None).cast("double").alias("silhouette"), F.lit(0).cast("long").alias("silhouette_rows"))
    n_blocks = max(1, -(-sum(sizes.values()) // block_rows))
    block = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key_cols], features), F.lit(n_blocks)).cast("int")
    held = [F.col(features).alias("features"), *row_columns(width)[1:]]
    rows = df.select(block.alias("_block"), *key_cols, LABEL, *held)
    # a row's number: its block and its place in it
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*key_cols, *row_columns(width)))
    rows = rows.select("_block", (F.col("_block").cast("long") * 2**32 + place).alias("rid"), LABEL, *row_columns(width))
    pair = F.struct(
        F.least("_block", "other").alias("i"), F.greatest("_block", "other").alias("j"),
        (F.col("_block") > F.col("other")).cast("int").alias("side"),
    )
    copies = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other"))
    copies = copies.select("rid", LABEL, *row_columns(width), pair.alias("p")).select("rid", LABEL, *row_columns(width), "p.*")
    function, schema = _pair_sums(labels, width)
    summed = copies.groupBy("i", "j").applyInArrow(function, schema)
    per_row = summed.groupBy("rid", "own").agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in range(len(labels))])

    def mean(c: int, less: int) -> Column:
        return F.col(f"s{c}") / float(sizes[labels[c]] - less) if sizes[labels[c]] > less else F.lit(None).cast("double")

    same = [F.col("own") == label for label in labels]
    a = F.coalesce(*[F.when(s, mean(c, 1)) for c, s in enumerate(same)])
    b = F.array_min(F.array(*[F.when(~s, mean(c, 0)) for c, s in enumerate(same)]))
    widths = per_row.select(a.alias("a"), b.alias("b"))
    return widths.agg(F.avg(_width("a", "b")).alias("silhouette"), F.count(F.lit(1)).alias("silhouette_rows"))


def _squared_silhouette(df: DataFrame, features: str) -> DataFrame:
    """Mean squared distance to a cluster = |x|^2 - 2 x.S/n + Q/n for its count n, sum S, sum of squares Q."""
    spots = df.select(LABEL, F.posexplode(F.col(features)).alias("i", "v"))
    sums = spots.groupBy(LABEL, "i").agg(F.sum("v").alias("v"), F.sum(F.col("v") * F.col("v")).alias("q"))
    sums = sums.groupBy(LABEL).agg(
        F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"), F.sum("q").alias("q")
    )
    counts = cluster_sizes(df)
    packed = sums.join(counts, LABEL).select(
        F.struct(LABEL, F.transform("s", lambda t: t["v"]).alias("s"), "q", F.col("cluster_size").alias("n")).alias("c")
    ).agg(F.collect_list("c").alias("g"))  # k rows

    def plus(x: Column, y: Column) -> Column:
        return x + y

    held = df.select(LABEL, F.col(features).alias("x")).withColumn("g", packed.scalar())
    square = F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v)
    far = F.transform(
        "g",
        lambda c: F.struct(
            c[LABEL].alias("other"), c["n"].alias("n"),
            F.greatest(
                F.lit(0.0),
                square + c["q"] / c["n"] - 2 * F.aggregate(F.zip_with("x", c["s"], lambda v, t: v * t), F.lit(0.0), plus) / c["n"],
            ).alias("d"),
        ),
    )
    held = held.select(LABEL, far.alias("far"))
    mine = F.filter("far", lambda c: c["other"] == F.col(LABEL))[0]
    held = held.select(
        F.when(mine["n"] > 1, mine["d"] * mine["n"] / F.nullif(mine["n"] - 1, F.lit(0))).alias("a"),
        F.array_min(F.transform(F.filter("far", lambda c: c["other"] != F.col(LABEL)), lambda c: c["d"])).alias("b"),
    )
    return held.agg(F.avg(_width("a", "b")).alias("silhouette"), F.count(F.lit(1)).alias("silhouette_rows"))


def composite_score(min_cluster_ratio: float) -> Column:
    """Weighted quality; a cluster below the minimum share costs a fixed penalty."""
    score = (
        0.40 * F.col("silhouette")
        + 0.30 * F.col("balance_score")
        + 0.20 * F.col("min_cluster_fraction")
        - 0.10 * F.col("davies_bouldin")
    )
    return F.when(F.col("min_cluster_fraction") < min_cluster_ratio, score - 0.25).otherwise(score)


def cluster_quality(
    df: DataFrame,
    key_cols: Sequence[str],
    dim: int,
    min_cluster_ratio: float = 0.05,
    measure: str = "euclidean",
    features: str = "features",
    width: int = 0,
) -> DataFrame:
    """One row of quality measures for a labelled frame."""
    sil = silhouette(df, key_cols, measure, features, width=width).select(F.struct("*")).scalar()
    db = davies_bouldin(df, dim, features, width).scalar()
    return (
        balance(cluster_sizes(df))
        .withColumn("_s", sil)
        .select(
            "k", "n_rows",
            F.col("_s.silhouette").alias("silhouette"),
            F.col("_s.silhouette_rows").alias("silhouette_rows"),
            db.alias("davies_bouldin"),
            "balance_score", "min_cluster_fraction",
        )
        .withColumn("composite_score", composite_score(min_cluster_ratio))
    )


def profile_label(total: Column, min_cluster_ratio: float) -> Column:
    """Ordered rules on cluster means, the first that holds names the cluster.

    Cut-offs and names are fixed values.
    """

    def mean(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_mean"), F.lit(0.0))

    spend, shaky = mean("expense_to_income_ratio"), mean("expense_volatility_ratio")
    trend, top = mean("expense_vs_rolling_mean_ratio"), mean("dominant_category_ratio")
    rules = [
        ("uc_davranis_grubu", F.col("cluster_size") / total < min_cluster_ratio),
        ("tasarruf_odakli", (spend < 0.45) & (shaky < 0.50) & (trend <= 1.05)),
        (
            "kategori_yogun_harcama",
            (top > 0.55) | ((mean("top2_category_ratio_sum") > 0.75) & (mean("category_entropy") < 1.05)),
        ),
        ("hafta_sonu_agirlikli", mean("weekend_expense_ratio") > 0.42),
        ("dengesiz_yuksek_harcama", (spend > 0.90) & (shaky > 0.70) & (trend > 1.10)),
        ("gelirsiz_harcama_donemi", mean("zero_income_week") > 0.30),
        (
            "dengeli_harcama",
            (mean("total_income") > 0) & (spend <= 0.75) & (mean("active_days_ratio") >= 0.35),
        ),
    ]
    chain = F
    for name, rule in rules:
        chain = chain.when(rule, F.lit(name))
    return chain.otherwise(F.lit("genel_davranis_profili"))


def cluster_summary(df: DataFrame, min_cluster_ratio: float = 0.05) -> DataFrame:
    """One row per cluster: means, medians, size, profile label."""
    columns = [c for c in SUMMARY_COLUMNS if c in df.columns]
    means = df.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("cluster_size"), *[F.avg(c).alias(f"{c}_mean") for c in columns]
    )
    medians = exact_medians(df, columns, [LABEL])
    medians = medians.select(LABEL, *[F.col(c).alias(f"{c}_median") for c in columns])
    both = means.join(medians, LABEL, "left")
    for name in SUMMARY_COLUMNS:  # a feature absent from the frame counts as 0 in the rules
        if name not in columns:
            both = both.withColumn(f"{name}_mean", F.lit(None).cast("double"))
    total = F.sum("cluster_size").over(Window.partitionBy())  # k rows
    labelled = both.withColumn("profile_label", profile_label(total, min_cluster_ratio))
    ordered = [f"{c}_{kind}" for c in columns for kind in ("mean", "median")]
    return labelled.select(LABEL, *ordered, "cluster_size", "profile_label")


def evaluate_ks(
    df: DataFrame, key_cols: Sequence[str], columns: Sequence[str], config: ProfilerConfig, width: int = 0
) -> tuple[DataFrame, Centroids]:
    """Fit every candidate k below the row count; best composite, balance, silhouette wins."""
    n = df.count()
    ks = [k for k in config.candidate_ks if k < n]
    if not ks:
        raise ValueError(f"no candidate k below the number of rows ({n})")
    rows, schema = [], None
    fitted = fit_restarts(df, columns, ks, config.n_init, config.max_iter, config.seed, key_cols, width=width)
    for k, model in fitted.items():
        labelled = assign(df, model, width=width).select(*key_cols, LABEL, *row_columns(width)).persist()
        row = cluster_quality(
            labelled, key_cols, len(columns), config.min_cluster_ratio, config.silhouette_measure, width=width
        ).withColumn("k", F.lit(k))
        sizes = cluster_sizes(labelled).agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(LABEL), F.col("cluster_size")))))
        )
        row = row.withColumn("cluster_counts", sizes.scalar())
        rows += row.collect()  # one row per candidate k
        schema = row.schema
        labelled.unpersist()
    measured = df.sparkSession.createDataFrame(rows, schema)
    evaluation = measured.orderBy(F.desc("composite_score"), F.desc("balance_score"), F.desc("silhouette"))
    return evaluation, fitted[evaluation.first()["k"]]
