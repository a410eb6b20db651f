"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "plaudit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    They override the cluster's default files: pass ``conf`` to choose otherwise.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # One prompt holds up to 150 reviews of 500 characters: keep Arrow batches small.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: as the session names it, else beside the warehouse tables.

    A warehouse on a local disk, as Spark has it by default, is shared in local mode only: on a cluster it is refused.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), spark.conf.get("spark.master", "local")
    if warehouse.startswith(("file:", "/")) and not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"executors of {master} do not share {warehouse}: set {CHECKPOINT_DIR} to a folder that all of them reach")
    return f"{warehouse}/_scratch"


def scratch_folder(spark: SparkSession) -> str:
    """Where this application writes its intermediate tables."""
    return f"{shared_folder(spark).rstrip('/')}/plaudit/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for an intermediate table."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application, once all results are written: lazy ones read them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
