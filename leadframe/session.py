"""Session and table helpers shared by every query."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "leadframe", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir. Only a local session, which has no other machine, may do without the setting."""
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir", None):
        system, where = hadoop_path(spark, root)
        return re.sub("^file:/+", "file:///", system.makeQualified(where).toString().rstrip("/"))
    if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "leadframe-checkpoints")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/leadframe-{label}-{uuid.uuid4().hex}"
    system, where = hadoop_path(spark, path)
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path
