"""Spark session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fleetlens", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Session with adaptive execution on; ``conf`` wins over these defaults."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **(conf or {}),
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a folder of the warehouse, which a cluster shares too.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/fleetlens-shared"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def application_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_folder(spark)}/fleetlens-{spark.sparkContext.applicationId}"


def clear_written(spark: SparkSession) -> None:
    """Delete everything this application wrote to the shared folder; no result may be in use any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like a checkpoint and survives lost executors. Against a checkpoint it
    keeps column pruning, and its exact file size tells the planner what may be broadcast.
    ``clear_written`` removes the tables of this application.
    """
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
