"""The Spark session that the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build(app: str = "skeinlog", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf adds or overrides settings (underscores for dots)."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the one that the cluster names in spark.checkpoint.dir, deleted when the application ends.
    Where that is unset, in a temporary folder of a local master's own; on a cluster it is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="skeinlog-")
    path = f"{shared.rstrip('/')}/skeinlog-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path
