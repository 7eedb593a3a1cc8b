"""Which containers a PU may use and which of them are best.

Eligibility depends only on the PU's required zones, and PUs share few different
requirement sets. Everything here is therefore computed once per requirement set
and joined to the PUs by equality; PUs are never paired with containers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .ordering import ordinal_within


def zone_set(zones: Column | str) -> Column:
    """Canonical form, usable as a join key."""
    column = F.col(zones) if isinstance(zones, str) else zones
    return F.array_sort(F.array_distinct(F.coalesce(column, F.array().cast("array<string>"))))


def requirement(pu: DataFrame) -> DataFrame:
    """PU rows with ``required_zones`` in canonical form."""
    return pu.withColumn("required_zones", zone_set("required_zones"))


def matched_sets(pu: DataFrame, located: DataFrame) -> DataFrame:
    """(required_zones, zones): requirement sets and the container zone sets that satisfy them."""
    no_zone = F.array(F.lit(None).cast("string"))
    wanted = (
        requirement(pu).select("required_zones").distinct()
        # the null token stands for "no zone required"; every container carries it as well
        .select("required_zones", F.explode(F.when(F.size("required_zones") == 0, no_zone).otherwise(
            F.col("required_zones"))).alias("token"))
    )
    offered = located.select("zones").distinct().select(
        F.col("zones").alias("offered"), F.explode(F.concat("zones", no_zone)).alias("offered_token")
    )
    return (
        wanted.join(offered, F.col("token").eqNullSafe(F.col("offered_token")))
        .select("required_zones", F.col("offered").alias("zones"))
        .distinct()
    )


def eligible_containers(pu: DataFrame, container: DataFrame) -> DataFrame:
    """``required_zones`` plus the container columns, for each requirement set and container that satisfies it."""
    located = container.withColumn("zones", zone_set("zones"))
    # zone sets, not containers, are matched; containers follow by their zone set
    return matched_sets(pu, located).join(located, "zones")


def container_load(container: DataFrame, instance: DataFrame) -> DataFrame:
    """Containers with the instances they hold and the instances on their machine.

    ``instance`` may also be slot counts (a ``total`` per row), which saves a second scan.
    """
    held = F.sum("total") if "total" in instance.columns else F.count("*")
    per_container = instance.groupBy("container_id").agg(held.alias("n_container"))
    loaded = container.join(per_container, "container_id", "left").withColumn(
        "n_container", F.coalesce("n_container", F.lit(0))
    )
    per_host = loaded.groupBy("host").agg(F.sum("n_container").alias("n_machine"))
    return loaded.join(per_host, "host")


def loaded_containers(container: DataFrame, instance: DataFrame) -> DataFrame:
    """container_load written once: plans read it several times, and instances are to be scanned once for it."""
    return written(container_load(container, instance))


_BEST = ("n_container", "n_machine", "container_id")
# parts in which the containers of a requirement set are handed to PUs
PARTS = 16


def first_containers(pu: DataFrame, loaded: DataFrame, k: int, within: Sequence[str] = ()) -> DataFrame:
    """The ``k`` least loaded eligible containers per requirement set (and per ``within`` columns), with their rank.

    The first of every zone set are found before zone sets meet requirement sets, so no container is paired with a
    requirement. Both rank limits act before their shuffles too: a large group sends at most ``k`` rows a task.
    """
    located = loaded.withColumn("zones", zone_set("zones"))
    place = F.row_number().over(Window.partitionBy("zones", *within).orderBy(*_BEST))
    firsts = located.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
    best = Window.partitionBy("required_zones", *within).orderBy(*_BEST)
    rows = matched_sets(pu, located).join(firsts, "zones").withColumn("rank", F.row_number().over(best))
    return rows.where(F.col("rank") <= k)


def ranked_containers(pu: DataFrame, loaded: DataFrame) -> DataFrame:
    """All eligible containers of each requirement set by load, with ``rank`` from 1.

    One order over all sets, cut into ranges, gives the ranks, so that few large sets are ranked by many tasks.
    """
    rows = eligible_containers(pu, loaded).select("required_zones", *_BEST, "host")
    return ordinal_within(rows, ["required_zones"], list(_BEST), "_place").withColumn(
        "rank", (F.col("_place") + 1).cast("int")).drop("_place")


def best_containers(pu: DataFrame, container: DataFrame, instance: DataFrame, k: int | None = None) -> DataFrame:
    """Ranked containers each PU should use next: the whole list, or its first ``k``."""
    loaded = loaded_containers(container, instance)
    ranked = ranked_containers(pu, loaded) if k is None else first_containers(pu, loaded, k)
    # few requirement sets are dealt by parts of their ranks; a PU's row goes to each part
    part = F.col("rank") % PARTS
    wanted = requirement(pu).select("pu", "required_zones", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    return wanted.join(ranked.withColumn("_part", part), ["required_zones", "_part"]).select(
        "pu", "rank", "container_id", "host", "n_container", "n_machine"
    )


def best_two(pu: DataFrame, loaded: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """First and second choice; the second serves the instance that already sits in the first."""
    ranked = first_containers(pu, loaded, 2, within)
    pick = lambda rank, name: F.max(F.when(F.col("rank") == rank, F.col(name)))
    return ranked.groupBy("required_zones", *within).agg(
        pick(1, "container_id").alias("first_id"), pick(2, "container_id").alias("second_id")
    )


def choose(first: Column, second: Column, current: Column) -> Column:
    return F.when(first.eqNullSafe(current), second).otherwise(first)


def candidate_counts(pu: DataFrame, container: DataFrame, instance: DataFrame) -> DataFrame:
    """Containers each PU could start on: zones satisfied and, for an isolated PU, nothing running there."""
    located = container.withColumn("zones", zone_set("zones"))
    used = instance.select("container_id").distinct().withColumn("_used", F.lit(True))
    # containers are counted per zone set before the sets are matched
    sizes = located.join(used, "container_id", "left").groupBy("zones").agg(
        F.count("*").alias("n_all"), F.count_if(F.col("_used").isNull()).alias("n_empty"))
    per_set = matched_sets(pu, located).join(sizes, "zones").groupBy("required_zones").agg(
        F.sum("n_all").alias("n_all"), F.sum("n_empty").alias("n_empty"))
    isolated = F.coalesce("requires_isolation", F.lit(False))
    counted = F.when(isolated, F.col("n_empty")).otherwise(F.col("n_all"))
    return requirement(pu).join(per_set, "required_zones", "left").select(
        "pu", "planned", F.coalesce(counted, F.lit(0)).alias("candidates")
    )
