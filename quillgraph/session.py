"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "quillgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests on one machine) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + os.path.join(tempfile.gettempdir(), f"quillgraph-{uuid.uuid4().hex}")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system remove ``path`` when the JVM ends."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage, survives the loss of executors, and is deleted by ``release`` or when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete tables that ``stage`` wrote and nothing reads any more, such as those of the last round of a loop."""
    for df in frames:
        path = getattr(df, "_staged", None)
        if path is not None:
            jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)
