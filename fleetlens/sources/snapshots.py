"""Inventory kept as dated snapshots, and the state that was known at a moment.

A table of snapshots is a Parquet folder with a subfolder per snapshot, so that looking at a few moments reads the
files of a few snapshots. Clusters report at times of their own: each one's last snapshot at or before the moment counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SNAPSHOT = "snapshot"


def add_snapshots(rows: DataFrame, folder: str) -> None:
    """Append rows with a ``snapshot`` time; the files of a snapshot lie together."""
    rows.repartition(SNAPSHOT).write.mode("append").partitionBy(SNAPSHOT).parquet(folder)


def read_snapshots(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


def known_at(history: DataFrame, moment: datetime, cluster: Sequence[str] = ("cluster",)) -> DataFrame:
    """Rows of each cluster's last snapshot at or before the moment.

    The join's small side names few snapshots, so the scan reads their folders alone (dynamic partition pruning);
    a cluster whose first snapshot is later has no rows.
    """
    at = F.lit(moment).cast("timestamp_ntz")
    last = history.where(F.col(SNAPSHOT) <= at).groupBy(*cluster).agg(F.max(SNAPSHOT).alias(SNAPSHOT))
    return history.where(F.col(SNAPSHOT) <= at).join(last, [*cluster, SNAPSHOT])
