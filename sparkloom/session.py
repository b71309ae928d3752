"""Sessions and table readers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that the engine is designed for; a cluster's own values win where they are set.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def session(app: str = "sparkloom", master: str | None = None, **settings: str) -> SparkSession:
    """The running session, or a new one."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return b.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generated table. The read is lazy: filters and columns reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder under ``spark.checkpoint.dir``, deleted when the application ends; a local session may use its machine's."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    parent = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/sparkloom-{uuid.uuid4().hex}")
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return f"{parent}/{name}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        top = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(tempfile.mkdtemp(prefix="sparkloom-"), "sparkloom.zip")
        with zipfile.ZipFile(to, "w") as z:
            for folder, _, names in os.walk(top):
                for x in names:
                    if x.endswith(".py"):
                        z.write(p := os.path.join(folder, x), os.path.relpath(p, os.path.dirname(top)))
        sc.addPyFile(to)
    return spark
