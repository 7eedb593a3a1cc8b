"""When each selected item is visited."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_ordinal

# fixed values: pause between items when none is asked for, and the largest parallel batch
CONTAINER_INTERVAL = timedelta(minutes=1)
MANAGER_INTERVAL = timedelta(minutes=1)
AGENT_INTERVAL = timedelta(seconds=5)
PARALLEL_LIMIT = 32


def rolling_schedule(items: DataFrame, order: list[str], interval: timedelta = CONTAINER_INTERVAL) -> DataFrame:
    """One after the other: item i starts at i x interval."""
    numbered = with_ordinal(items, order, "position")
    return numbered.withColumn("starts_after", F.lit(interval) * F.col("position"))


def parallel_waves(items: DataFrame, order: list[str], limit: int = PARALLEL_LIMIT) -> DataFrame:
    """All at once, at most ``limit`` at a time."""
    numbered = with_ordinal(items, order, "position")
    return numbered.withColumn("wave", F.floor(F.col("position") / limit))
