"""Lowest and highest counter with their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def needs_rebalancing(low: Column | str = "min", high: Column | str = "max") -> Column:
    """A spread of one is balanced."""
    low = F.col(low) if isinstance(low, str) else low
    high = F.col(high) if isinstance(high, str) else high
    return high > low + 1


def min_max(counts: DataFrame, by: Sequence[str], key: str = "key", n: str = "n") -> DataFrame:
    """Per counter: min, max, the smallest key among the ties of each, and whether the spread is too wide."""
    return (
        counts.groupBy(*by)
        .agg(
            F.min(n).alias("min"),
            F.max(n).alias("max"),
            F.min_by(key, F.struct(F.col(n), F.col(key))).alias("min_key"),
            F.min_by(key, F.struct(-F.col(n), F.col(key))).alias("max_key"),
        )
        .withColumn("needs_rebalancing", needs_rebalancing())
    )


def min_max_ties(counts: DataFrame, by: Sequence[str], key: str = "key", n: str = "n") -> DataFrame:
    """Every tied key as its own row: (counter, bound, n, key). A counter may have any number of ties."""
    bounds = counts.groupBy(*by).agg(F.min(n).alias("_min"), F.max(n).alias("_max"))
    hit = F.array_compact(F.array(
        F.when(F.col(n) == F.col("_min"), F.lit("min")), F.when(F.col(n) == F.col("_max"), F.lit("max"))
    ))
    return counts.join(bounds, list(by)).select(*by, F.explode(hit).alias("bound"), F.col(n).alias("n"), key)


def zone_group_balance(counts: DataFrame, zones: Sequence[str], by: Sequence[str], n: str = "n") -> DataFrame:
    """min_max over the zone keys of one group; a counter without any of them gives no row."""
    inside = counts.where((F.col("axis") == "ZONE") & F.col("key").isin(*zones))
    return min_max(inside, by, n=n)
