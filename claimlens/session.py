"""Session defaults and the shared work folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []

# Number of partitions that the registered queries deal their tables out to; unset: as read.
INPUT_PARTITIONS = "spark.claimlens.inputPartitions"


def build_session(master: str | None = None, app: str = "claimlens", **conf: str) -> SparkSession:
    """Session with the settings the jobs count on; ``conf`` keys use _ for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("_", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """New folder name below the cluster's shared ``spark.checkpoint.dir``.

    Without that setting a job that needs the folder fails: executors would each write to their
    own disk, and what is read back would silently be incomplete.  Only a session whose executors
    are threads of this process (``local[...]``) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear_work(spark: SparkSession) -> None:
    """Delete the work folders handed out so far; call it when results read from them are done with."""
    conf = spark._jsc.hadoopConfiguration()
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: survives executor loss, unlike a cache."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.parquet(path)
