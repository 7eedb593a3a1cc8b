"""How instances spread over zones, machines and containers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .placement import eligible_containers, requirement, zone_set

AXES = ("ZONE", "MACHINE", "CONTAINER")
ROLES = ("total", "primary", "backup")
# scope value of the whole PU; it sorts after every partition id (an int)
WHOLE = 1 << 40


def axis_keys(axes: Sequence[str] = AXES) -> Column:
    """Array of (axis, key) under which a container row is counted."""
    parts = []
    if "ZONE" in axes:
        parts.append(F.transform(zone_set("zones"), lambda z: F.struct(F.lit("ZONE").alias("axis"), z.alias("key"))))
    for axis, column in (("MACHINE", "host"), ("CONTAINER", "container_id")):
        if axis in axes:
            key = F.col(column).cast("string").alias("key")
            parts.append(F.array(F.struct(F.lit(axis).alias("axis"), key)))
    return F.concat(*parts)


def slot_counts(facts: DataFrame, *more: Column) -> DataFrame:
    """Instances per PU, partition and container; a primary that is also a backup counts as primary."""
    return facts.groupBy("pu", "partition_id", "container_id").agg(
        F.count("*").alias("total"),
        F.count_if("is_primary").alias("primary"),
        F.count_if(~F.col("is_primary") & F.col("is_backup")).alias("backup"),
        *more,
    )


def occupied(
    slots: DataFrame, keyed: DataFrame, key_columns: Sequence[str], on: Sequence[str] = ("container_id",)
) -> DataFrame:
    """Counts per PU, scope and key; ``keyed`` has a row per container and key.

    Instances were reduced to slots first, so the join sees one row per (PU, partition,
    container). Each partition and the whole PU come out of the same shuffle.
    """
    rows = slots.join(keyed, list(on)).select("pu", "partition_id", *ROLES, *key_columns)
    columns = ["pu", *key_columns]
    scope = F.when(F.grouping("partition_id") == 1, F.lit(WHOLE)).otherwise(F.col("partition_id").cast("bigint"))
    summed = rows.groupingSets(
        [[F.col(c) for c in (*columns, "partition_id")], [F.col(c) for c in columns]], *columns, "partition_id"
    ).agg(scope.alias("scope"), *[F.sum(r).alias(r) for r in ROLES])
    return summed.select("pu", "scope", *key_columns, *ROLES)


def potential_counts(pu: DataFrame, container: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """Eligible containers per PU, axis and key."""
    per_set = (
        eligible_containers(pu, container)
        .select("required_zones", F.explode(axis_keys(axes)).alias("_key"))
        .groupBy("required_zones", "_key.axis", "_key.key")
        .agg(F.count("*").alias("potential"))
    )
    return requirement(pu).select("pu", "required_zones").join(per_set, "required_zones").select(
        "pu", "axis", "key", "potential"
    )


def held_counts(
    container: DataFrame, facts: DataFrame, by_partition: bool = False, axes: Sequence[str] = AXES
) -> DataFrame:
    """``placement_snapshot`` without its zero rows and ``potential``: the keys that hold instances, no others."""
    keyed = container.select("container_id", F.explode(axis_keys(axes)).alias("_key")).select("container_id", "_key.*")
    held = occupied(slot_counts(facts), keyed, ["axis", "key"])
    held = held if by_partition else held.where(F.col("scope") == WHOLE)
    return held.select("pu", F.when(F.col("scope") != WHOLE, F.col("scope")).alias("partition_id"), "axis", "key", *ROLES)


def placement_snapshot(
    pu: DataFrame, container: DataFrame, facts: DataFrame, by_partition: bool = False, axes: Sequence[str] = AXES
) -> DataFrame:
    """Zero-filled counts: every key a PU may use, plus those it uses, with total, primary and backup instances.

    ``partition_id`` is null on the rows of the whole PU; ``by_partition`` adds the rows of each partition.
    """
    keyed = container.select("container_id", F.explode(axis_keys(axes)).alias("_key")).select("container_id", "_key.*")
    slots = slot_counts(facts)
    # partitions and the whole PU are read apart below; the slots are written so that instances are scanned once
    held = occupied(written(slots) if by_partition else slots, keyed, ["axis", "key"])
    whole = held.where(F.col("scope") == WHOLE).drop("scope")
    potential = potential_counts(pu, container, axes)
    filled = potential.join(whole, ["pu", "axis", "key"], "full")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("potential", *ROLES)]
    shape = ["pu", "partition_id", "axis", "key"]
    result = filled.withColumn("partition_id", F.lit(None).cast("bigint")).select(*shape, *zero)
    if by_partition:
        # the zero rows of each partition are part of the result, so keys meet partitions by PU here and only here
        parts = held.where(F.col("scope") != WHOLE).withColumnRenamed("scope", "partition_id")
        partitions = parts.select("pu", "partition_id").distinct()
        per_part = potential.join(partitions, "pu").join(parts, ["pu", "partition_id", "axis", "key"], "full")
        result = result.unionByName(per_part.select(*shape, *zero))
    return result


def hide_zeros(counts: DataFrame, column: str = "n") -> DataFrame:
    """Without the zeros of ``by_role`` rows, so that each role's counter hides its own."""
    return counts.where(F.col(column) != 0)


def remove_zeros(counts: DataFrame, column: str = "n") -> DataFrame:
    """Zeros of ``by_role`` rows go on the machine and container axes; the zone axis keeps them."""
    return counts.where((F.col("axis") == "ZONE") | (F.col(column) != 0))


def retain_zones(counts: DataFrame, zones: Sequence[str]) -> DataFrame:
    """Only the given zones on the zone axis; other axes stay whole."""
    return counts.where((F.col("axis") != "ZONE") | F.col("key").isin(*zones))


def by_role(counts: DataFrame) -> DataFrame:
    """One row per role: columns ``role`` and ``n`` in place of the three count columns.

    A key that is not eligible appears only in the roles that occupy it; where ``potential``
    is not known (``held_counts``), every key does.
    """
    pairs = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).cast("bigint").alias("n")) for r in ROLES])
    kept = [c for c in counts.columns if c not in ROLES]
    rows = counts.select(*kept, F.explode(pairs).alias("_pair")).select(*kept, "_pair.*")
    return rows.where("potential > 0 OR n > 0" if "potential" in kept else "n > 0")
