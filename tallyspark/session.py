"""Session helpers: a local session for tests, durable cuts of long lineages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # no Python stack capture per expression: building a wide plan costs a third
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Where none is named, a folder of the warehouse serves a local master, as in tests; on a
    cluster that could be a folder of one machine, so there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


#: Folders handed out by this driver, for ``clear_written``.
_WRITTEN: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clear_written(spark: SparkSession) -> int:
    """Delete the folders written so far by this driver, and say how many.

    Frames that were not used to the end read from them, so this belongs after the last action.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    Used before iterative fits: every later pass reads pruned columns from files that
    survive executors, and no pass goes back to the ledger.
    """
    path = fresh_path(df.sparkSession, "frames")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
