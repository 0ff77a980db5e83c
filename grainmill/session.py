"""Session with the engine's dialect."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Names are case-sensitive, and numbers in ORDER BY and GROUP BY are constants, not positions.
DIALECT = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.orderByOrdinal": "false",
    "spark.sql.groupByOrdinal": "false",
    "spark.sql.session.timeZone": "UTC",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session; registered queries do not rely on the dialect, only SQL text does."""
    builder = SparkSession.builder.appName("grainmill").config(map=DIALECT)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    found = builder.getOrCreate()
    for key, value in DIALECT.items():
        found.conf.set(key, value)
    return found


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, qualified as Spark reads it.

    Where it is unset, a session on a local master gets one of its own that goes at exit; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="grainmill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return qualified(spark, found.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority that Hadoop gives it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    made = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return made.replace("file:/", "file:///", 1) if made.startswith("file:/") and not made.startswith("file://") else made
