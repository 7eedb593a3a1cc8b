"""Effective deployment settings: base configuration overlaid by a descriptor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.layers import LAYERS


def config_layers(pu: DataFrame, original: DataFrame, shared: DataFrame, descriptors: DataFrame) -> DataFrame:
    """The five layers of every PU as one long table, ready for operators.layers.effective_config.

    ``pu``: pu, directory. ``original``: pu, key, value. ``shared``: see read_shared_properties.
    ``descriptors``: see descriptor_layers, with an optional ``is_secret`` per entry.
    """
    if "is_secret" not in descriptors.columns:
        descriptors = descriptors.withColumn("is_secret", F.lit(False))
    text = F.lit("STRING").alias("value_type")
    secret_name = F.when(F.col("is_secret"), "descriptor_secrets").otherwise("descriptor_config")
    rows = (
        original.select(F.col("pu").alias("entity"), F.lit("original").alias("layer_name"), "key", "value", text,
                        F.lit(False).alias("is_secret"))
        .unionByName(shared.join(pu, "directory").select(
            F.col("pu").alias("entity"), "layer_name", "key", "value", text, "is_secret"))
        .unionByName(descriptors.select("entity", secret_name.alias("layer_name"), "key", "value", "value_type", "is_secret"))
    )
    order = F.array(*[F.lit(name) for name in LAYERS])
    return rows.withColumn("layer", F.array_position(order, F.col("layer_name")))


def overlaid_settings(base: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Base settings of each PU with its descriptor laid over them; both have one row per PU.

    ``base``: pu, cluster_schema, instances, backups, requires_isolation, max_per_vm, max_per_machine,
    zones, zone_limits. ``descriptors``: pu and ``descriptor`` (see sources.descriptors).
    A present sla or topology overwrites its plain fields even with null; zones, zone limits
    and the instance count change only when given, and partitions win over instances.
    """
    d = F.col("descriptor")
    sla, topology = d["sla"], d["topology"]

    def overwrite(part, field: str, old: str):
        return F.when(part.isNotNull(), part[field]).otherwise(F.col(old)).alias(old)

    return base.join(descriptors, "pu", "left").select(
        "pu",
        overwrite(topology, "schema", "cluster_schema"),
        F.coalesce(topology["partitions"], topology["instances"], F.col("instances")).alias("instances"),
        overwrite(topology, "backupsPerPartition", "backups"),
        overwrite(sla, "requiresIsolation", "requires_isolation"),
        overwrite(sla, "maxInstancesPerVM", "max_per_vm"),
        overwrite(sla, "maxInstancesPerMachine", "max_per_machine"),
        F.coalesce(sla["zones"], F.col("zones")).alias("zones"),
        F.when(sla["maxInstancesPerZone"].isNotNull(), X.parse_zone_limits(sla["maxInstancesPerZone"]))
        .otherwise(F.col("zone_limits")).alias("zone_limits"),
        # a descriptor without a resource gives null, not the default name
        F.when(d.isNotNull(), d["resource"]).otherwise(F.concat("pu", F.lit(".jar"))).alias("resource"),
    )


def descriptor_of(settings: DataFrame, count_first: bool = False) -> DataFrame:
    """Deployed settings back to a descriptor; sla and topology stay null unless a field is set."""
    limits = X.format_zone_limits(F.col("zone_limits"), count_first)
    zones = F.when(F.size("zones") > 0, F.col("zones"))
    partitioned = F.coalesce(F.col("cluster_schema") == "partitioned", F.lit(False))
    sla = [
        F.col("requires_isolation").alias("requiresIsolation"), zones.alias("zones"),
        F.col("max_per_vm").alias("maxInstancesPerVM"), F.col("max_per_machine").alias("maxInstancesPerMachine"),
        limits.alias("maxInstancesPerZone"),
    ]
    sla_given = [F.col("requires_isolation"), zones, F.col("max_per_vm"), F.col("max_per_machine"), limits]
    topology = [
        F.col("cluster_schema").alias("schema"),
        F.when(~partitioned, F.col("instances")).alias("instances"),
        F.when(partitioned, F.col("instances")).alias("partitions"),
        F.col("backups").alias("backupsPerPartition"),
    ]
    topology_given = [F.col("cluster_schema"), F.col("instances"), F.col("backups")]

    def optional(fields, given):
        missing = given[0].isNull()
        for column in given[1:]:
            missing = missing & column.isNull()
        return F.when(~missing, F.struct(*fields))

    return settings.select(
        "pu",
        F.struct(
            F.col("pu").alias("name"), F.col("resource").alias("resource"),
            optional(topology, topology_given).alias("topology"), optional(sla, sla_given).alias("sla"),
            *([F.col("contextProperties")] if "contextProperties" in settings.columns else []),
        ).alias("descriptor"),
    )
