"""Session defaults: UTC, ANSI and adaptive execution."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def tables(spark: SparkSession, sf_dir: str, *names: str):
    """The named Parquet tables, as a list of DataFrames."""
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under the one that the cluster names; a temporary
    one only where all run on this machine. Its files go when the session ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
    path = f"{shared or tempfile.mkdtemp(prefix='tidewell-')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
