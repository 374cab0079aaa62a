"""Helpers shared by the corpus operators: table loading and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: space and the ASCII control blanks 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster, intermediate tables need a folder that all machines share")
    fallback = getattr(shared_dir, "fallback", None)
    if fallback is None:
        fallback = shared_dir.fallback = "file://" + tempfile.mkdtemp(prefix="veilmill-")
    return fallback


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{new_folder(spark, label)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text, in order; an empty array where there is none."""
    return F.filter(F.split(text, BLANKS), lambda x: x != "")


def bucketed(df: DataFrame, label: str, n: int, key: str) -> DataFrame:
    """df as a table of n buckets by key in the shared folder: joins by key of such tables read bucket by bucket, without a shuffle."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.option("path", f"{new_folder(spark, label)}/table").option("compression", "zstd").bucketBy(n, key).sortBy(key).saveAsTable(name, format="parquet")
    return spark.table(name)
