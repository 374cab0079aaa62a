"""Session helpers: a session factory, and written intermediate tables that outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "veilmill", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with what the engine relies on; on a cluster, build the session by its own means instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        # Keys are binary literals; their text form stays out of plans.
        "spark.redaction.string.regex": "(?i)x'[0-9a-f]{64,}'",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_fallback: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster, intermediate tables need a folder that all machines share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="veilmill-"))
    return _fallback[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again; cuts lineage between rounds. Deleted when the application ends."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(f"{path}/table")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/table")


def spread(df: DataFrame) -> DataFrame:
    """df with its rows dealt evenly to as many tasks as the session has, by their places: for work that takes long on each row, where files
    have few row groups. One shuffle."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.withColumn("_dealt", F.monotonically_increasing_id()).repartition(n, "_dealt").drop("_dealt")
