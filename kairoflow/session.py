"""Session helpers: shared storage, shipping this package to executors, cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def get_session(app: str = "kairoflow", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; extra settings by keyword, dots written as ``__``."""
    builder = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    for key, value in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of any cluster, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_kairoflow_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(), "kairoflow.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(target)
    sc._kairoflow_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). A temporary one stands in where that is
    unset and everything runs in this one process; a cluster must name its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not re.match(r"local(\[[^]]*\])?$", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(sc, "_kairoflow_shared", None):
        sc._kairoflow_shared = f"file://{tempfile.mkdtemp(prefix='kairoflow-')}"
    return sc._kairoflow_shared


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> str:
    """Have an existing path deleted when the driver's JVM ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, executors may go.
    ``discard`` deletes the files; what is left of them goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kairoflow_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised table that nothing reads any more."""
    path = getattr(df, "_kairoflow_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
