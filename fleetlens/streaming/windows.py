"""Windowed counts of observations: imbalance over time and manager discovery.

Each function takes a batch or a streaming DataFrame; only the watermark differs. A stream appends a window
once the watermark has passed its end. Where bounds follow counts, both are aggregations of one streaming query, and the
second one gets a window's counts when the first one has finished them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.balance import min_max, needs_rebalancing
from ..operators.counts import AXES, axis_keys
from ..operators.placement import eligible_containers, requirement
from .source import append_to, micros, zone_free  # noqa: F401  append_to is the usual sink of these streams

# fixed value: probes made before manager discovery gives up
DISCOVERY_ATTEMPTS = 10


def _per_window(df: DataFrame, window: str, delay: str | None, keys: Sequence[str], *measures: Column) -> DataFrame:
    """Measures per window ``w`` and keys. A watermark needs an instant, so zone-free input is read as UTC there."""
    if delay is not None:
        df = df.withColumn("ts", F.timestamp_micros(micros(F.col("ts")))).withWatermark("ts", delay)
    return df.groupBy(F.window("ts", window).alias("w"), *keys).agg(*measures)


def _bounded(df: DataFrame, delay: str | None) -> DataFrame:
    """``w`` as zone-free window_start and window_end."""
    free = (lambda c: c) if delay is None else zone_free
    kept = [c for c in df.columns if c != "w"]
    return df.select(free(F.col("w.start")).alias("window_start"), free(F.col("w.end")).alias("window_end"), *kept)


def _windowed(df: DataFrame, window: str, delay: str | None, keys: list[str], *measures: Column) -> DataFrame:
    return _bounded(_per_window(df, window, delay, keys, *measures), delay)


def key_counts(observations: DataFrame, window: str, delay: str | None = None) -> DataFrame:
    """Observations (ts, pu, key) counted per window, PU and key; the state holds one row per key and window."""
    return _windowed(observations, window, delay, ["pu", "key"], F.count("*").alias("n"))


def imbalance(counts: DataFrame) -> DataFrame:
    """Bounds and verdict per window and PU, from finished key counts."""
    return min_max(counts, ["window_start", "window_end", "pu"])


def window_imbalance(observations: DataFrame, window: str, delay: str | None = None) -> DataFrame:
    """``imbalance`` of ``key_counts``; on a stream both aggregations run in the same query."""
    counts = _per_window(observations, window, delay, ["pu", "key"], F.count("*").alias("n"))
    return _bounded(min_max(counts, ["w", "pu"]), delay)


def placement_imbalance(
    sightings: DataFrame, pu: DataFrame, container: DataFrame, window: str, delay: str | None = None, axes: Sequence[str] = AXES
) -> DataFrame:
    """Bounds of the placement counters per window, PU and axis, from sightings (ts, pu, container_id) of instances.

    A counter holds the keys that its PU may use and those it was seen on: where fewer of the eligible keys were seen
    than there are, the minimum is zero, so no zero rows are made. Eligible keys are listed per requirement set,
    not per PU. Containers and PUs are tables; only counts per key and window are state.
    """
    keys = F.explode(axis_keys(axes)).alias("_key")
    # sightings are counted per container first, so that they meet its keys once a window and not once a row
    seen = _per_window(sightings, window, delay, ["pu", "container_id"], F.count("*").alias("n"))
    # Spark sizes what a stream's state gives by the batch at hand, so the batch that ends it, empty, would have every count
    # broadcast: the merge hint and the left joins below keep counts from being the broadcast side
    located = container.select("container_id", axis_keys(axes).alias("_keys")).hint("merge")
    keyed = seen.join(located, "container_id").select("w", "pu", "n", F.explode("_keys").alias("_key")).select("w", "pu", "n", "_key.*")
    allowed = eligible_containers(pu, container).select("required_zones", keys).select("required_zones", "_key.*").distinct()
    sizes = allowed.groupBy("required_zones", "axis").agg(F.count("*").alias("eligible"))
    sets = requirement(pu).select("pu", "required_zones", F.lit(True).alias("_known"))
    eligible = sets.join(sizes, "required_zones").groupBy("pu", "axis").agg(F.max("eligible").alias("eligible"))
    judged = (
        keyed.groupBy("w", "pu", "axis", "key").agg(F.sum("n").alias("n"))
        .join(sets, "pu", "left")
        .join(allowed.withColumn("_allowed", F.lit(1)), ["required_zones", "axis", "key"], "left")
    )
    # sizes meet bounds, not counts, which would sit in one task per requirement set and axis
    bounds = judged.groupBy("w", "pu", "axis").agg(
        F.min("n").alias("_min"), F.max("n").alias("max"), F.count("_allowed").alias("_held"), F.max("_known").alias("_known"))
    bounds = bounds.where("_known").join(eligible, ["pu", "axis"], "left")
    low = F.when(F.col("_held") < F.coalesce("eligible", F.lit(0)), 0).otherwise(F.col("_min")).cast("bigint")
    return _bounded(bounds.select("w", "pu", "axis", low.alias("min"), "max", needs_rebalancing(low, F.col("max")).alias("needs_rebalancing")), delay)


def manager_presence(heartbeats: DataFrame, window: str, delay: str | None = None) -> DataFrame:
    """Probes (ts, is_manager) per window; ``alert`` marks a window in which no manager answered."""
    measures = (F.count("*").alias("probes"), F.count_if("is_manager").alias("managers"))
    return _windowed(heartbeats, window, delay, [], *measures).withColumn("alert", F.col("managers") == 0)


def discovery_outcome(presence: DataFrame, attempts: int = DISCOVERY_ATTEMPTS) -> DataFrame:
    """One row: the probe window in which managers were first seen, FOUND when within the allowed attempts."""
    ends = presence.agg(
        F.min("window_start").alias("first"),
        F.min(F.when(F.col("managers") > 0, F.col("window_start"))).alias("seen"),
        F.min(micros(F.col("window_end")) - micros(F.col("window_start"))).alias("width"),
    )
    attempt = ((micros(F.col("seen")) - micros(F.col("first"))) / F.col("width") + 1).cast("bigint")
    return ends.select(
        attempt.alias("attempt"),
        F.when(attempt <= attempts, "FOUND").otherwise("NOT_FOUND").alias("status"),
    )
