"""Instance-level facts and joins from an instance to what it runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from .ordering import ordinal_within


def instance_facts(instance: DataFrame) -> DataFrame:
    """The narrow row every count and plan works on: where an instance runs and which role it has."""
    return instance.select(
        "instance_id",
        "pu",
        "partition_id",
        "container_id",
        P.is_stateful(F.col("embedded"), F.col("embedded_space_ids")).alias("is_stateful"),
        P.has_primary(F.col("spaces")).alias("is_primary"),
        P.has_backup(F.col("spaces")).alias("is_backup"),
    )


def with_location(instance: DataFrame, container: DataFrame) -> DataFrame:
    """Instance, its container's host, address and zones."""
    return instance.join(container.select("container_id", "host", "addr", "zones"), "container_id")


def instances_on_machine(instance: DataFrame, container: DataFrame, name: str) -> DataFrame:
    """Instances on the machine with this host name or address."""
    there = container.where(P.is_machine(F.col("host"), F.col("addr"), name)).select("container_id", "host", "addr")
    return instance.join(there, "container_id")


def stateful_instances(instance: DataFrame) -> DataFrame:
    return instance.where(P.is_stateful(F.col("embedded"), F.col("embedded_space_ids")))


def spaces_of(instance: DataFrame) -> DataFrame:
    """One row per space of an instance."""
    space = F.explode("spaces").alias("space")
    return instance.select("instance_id", "pu", "partition_id", "container_id", space).select(
        "instance_id", "pu", "partition_id", "container_id",
        F.col("space.id").alias("space_id"), F.col("space.mode").alias("mode"),
    )


def partition_primaries(facts: DataFrame) -> DataFrame:
    """Partitions that have a primary."""
    return facts.where("is_primary").select("pu", "partition_id").distinct()


def labelled(facts: DataFrame) -> DataFrame:
    """Rows plus ``label``: the PU name, and for stateful instances partition and role."""
    # grouped, then joined back: a window over a hot partition would sit in one task
    primaries = partition_primaries(facts).withColumn("_has_primary", F.lit(True))
    label = X.instance_label(
        F.col("pu"), F.col("partition_id"), F.col("is_stateful"), F.col("is_primary"), F.col("_has_primary")
    )
    return facts.join(primaries, ["pu", "partition_id"], "left").withColumn("label", label).drop("_has_primary")


def backup_first(instances: DataFrame, order: str = "input_order") -> DataFrame:
    """Backups before all others, ties in input order."""
    return instances.orderBy(F.desc("is_backup"), order)


def backup_first_position(instances: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Place of each instance in its group, from 0: backups before all others, ties by ``order``. A group may span many tasks."""
    late = (~F.col("is_backup")).cast("int").alias("_late")
    return ordinal_within(instances.select("*", late), group, ["_late", *order], "position").drop("_late")
