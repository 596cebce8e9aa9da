"""What the corpus operators share: text slices, written tables, connected components.

Texts arrive in Arrow batches. A batch may hold very long texts, so the numpy work goes
slice by slice (``slices``) and its memory does not follow the batch size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import durable, shared_dir

SLICE_CHARS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: Sequence[str], budget: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Consecutive runs of texts of about ``budget`` characters; one text is never cut."""
    run: list[str] = []
    size = 0
    for text in texts:
        if run and size + len(text) > budget:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def strings(column) -> list[str]:
    """The values of an Arrow or pandas string column, nulls as empty texts."""
    return ["" if t is None or t != t else t for t in column]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which outlives executors; also under tests."""
    return durable(df)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, where the session leaves Spark's default of 10,000.

    A row here is a whole text, so the default would hold tens of MB twice, in the JVM and in each worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, rows)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"


def in_sample(n_buckets: int, held_out: int, doc_id="doc_id"):
    """Whether a row may be learnt from: the CRC of its id, as text, misses the held-out class.

    Rows without an id can have no label and are never learnt from, so they count as held out.
    """
    return F.coalesce((F.crc32(F.col(doc_id).cast("string")) % n_buckets) != held_out, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, n_buckets: int, held_out: int,
    per_class: tuple[int, int], max_chars: int,
) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts, ``per_class`` rows of label 0 and 1, in a fixed order.

    The rows with the smallest hash of the id are taken, so the sample does not hang on
    partitions. Longer texts than ``max_chars`` are passed over (the sample must fit the
    driver); it is used for fitting only. A label given twice counts once, the larger one.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & in_sample(n_buckets, held_out))
        .groupBy(F.col("doc_id").alias("sample_id")).agg(F.max(label).alias("sample_label"))
        .withColumn("sample_rank", F.xxhash64("sample_id"))
    )
    picks = [
        known.where(F.col("sample_label") == y).orderBy("sample_rank", "sample_id").limit(n)
        for y, n in enumerate(per_class)
    ]
    # at most sum(per_class) rows of two numbers: small enough to go to every task
    chosen = F.broadcast(picks[0].unionByName(picks[1]))
    rows = (
        docs.select("doc_id", "text").where(F.length("text") <= max_chars)
        .join(chosen, F.col("doc_id") == F.col("sample_id"))
        .groupBy("sample_rank", "sample_id", "sample_label").agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: (r["sample_rank"], r["sample_id"]))
    return [(r["text"], int(r["sample_label"])) for r in rows]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, comp), comp the least node.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until the
    edge set stands still; every step is written to the shared folder. Nodes without an edge
    are not in the result.
    """

    def measure(df: DataFrame):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return row[0], row[1]

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select("a", "b")
        if large:
            both = both.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:  # larger neighbours move to the least one
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = measure(now)
    while seen[0]:
        now = written(star(star(now, True), False))
        then, seen = seen, measure(now)
        if then == seen:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))
