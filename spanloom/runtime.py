"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "spanloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the operators are written for (UTC, AQE, Arrow)."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "0")) or os.cpu_count() or 4
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def guard(spark: SparkSession) -> SparkSession:
    """Switch off that unions claim their children's partitioning.

    Spark 4.1 does so by default, and adaptive execution may then coalesce the children
    differently, which ends the query with "Can't zip RDDs with unequal numbers of partitions".
    """
    try:
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    except Exception:  # versions without the setting
        pass
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    guard(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that every executor reaches: the session's ``spark.checkpoint.dir``.

    Only a session on one machine may leave it unset (tests, notebooks); it then gets a private
    folder, deleted when Python ends. A cluster without the setting is refused.
    """
    sc = guard(spark).sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder and go on from the written rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the shared folder and go on from the table.

    Like ``cut``, but compressed and column by column: later steps read the columns they need only,
    and the optimizer knows the size. The partitioning is not kept.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete everything ``cut`` and ``stage`` wrote in this session; DataFrames built on it end with it."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(have.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for an expensive per-row stage when the input came in too few splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP or TIMESTAMP_NTZ column, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def seconds(ts: Column) -> Column:
    """Epoch seconds as DOUBLE (the one time unit of the recommendation operators)."""
    return micros(ts) / F.lit(1e6)
