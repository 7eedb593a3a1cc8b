"""Positions and running sums over one global order, without a one-task window.

A window without ``partitionBy`` runs in one task, and a window over a hot group
does the same for that group. Here rows are range-partitioned by the full order,
which splits any group over as many tasks as it needs; each range then works on
its own and only one small row per range is combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``_range`` and ``_position``; written once so that both stay the same for every reader."""
    tagged = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    )
    return tagged.select(
        *df.columns,
        F.shiftright("_id", _POSITION_BITS).alias("_range"),
        F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_position"),
    )


def with_ordinal(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """0-based position of each row in ``order``, which must identify rows."""
    rows = _ranged(df, order)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range (at most the shuffle partition count), so the window and the broadcast are bounded
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_range").select(
        *df.columns, (F.col("_start") + F.col("_position")).alias(name)
    )


def ordinal_within(df: DataFrame, group: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """0-based position of each row inside its group; a group may span many tasks."""
    rows = with_ordinal(df, [*group, *order], "_global")
    first = rows.groupBy(*group).agg(F.min("_global").alias("_first"))
    return rows.join(first, group).select(*df.columns, (F.col("_global") - F.col("_first")).alias(name))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str | Column, name: str) -> DataFrame:
    """Sum of ``value`` over the group's rows up to and including each row."""
    measured = df.withColumn("_value", value if isinstance(value, Column) else F.col(value))
    rows = _ranged(measured, [*group, *order])
    inside = Window.partitionBy("_range", *group).orderBy("_position").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_range", *group).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "_range", *group, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carried")
    )
    return (
        rows.withColumn("_inside", F.sum("_value").over(inside))
        .join(carried, ["_range", *group])
        .select(*df.columns, (F.col("_carried") + F.col("_inside")).alias(name))
    )
