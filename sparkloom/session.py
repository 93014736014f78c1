"""Session construction and table access shared by every query."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | None = None, app: str = "sparkloom") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller passes its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARKLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, megabytes: int = 1) -> DataFrame:
    """Rows of a table of few partitions, dealt to all cores before work that is heavy on each of them. A file of one row
    group is one partition, however long its texts are; tables with a partition for each core stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(df.sparkSession.sparkContext.defaultParallelism, size // (megabytes << 20))
    return df.repartition(int(n)) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share (spark.checkpoint.dir); a temporary one only in a local session."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = getattr(shared_path, "own", None) or tempfile.mkdtemp(prefix="sparkloom-")
        shared_path.own = top
    return f"{top.rstrip('/')}/{name}"


def settle(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: what reads them later sees the same rows, also after a lost executor. The
    table goes with the end of the application."""
    spark = df.sparkSession
    path = shared_path(spark, f"settled-{uuid.uuid4().hex}")
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
