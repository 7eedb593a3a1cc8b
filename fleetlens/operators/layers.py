"""Layered configuration as a long table: (entity, layer, key, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# layers of a PU's configuration, lowest first
LAYERS = ("original", "shared_config", "shared_secrets", "descriptor_config", "descriptor_secrets")


def merged_entries(layers: DataFrame) -> DataFrame:
    """Distinct key=value entries over all layers of an entity."""
    return layers.select("entity", "key", "value").distinct()


def merged_size(layers: DataFrame) -> DataFrame:
    """Sum of the layer sizes, so a key in two layers counts twice; null keys stand for an empty layer."""
    return layers.groupBy("entity").agg(
        F.count("key").alias("size"), (F.count("key") == 0).alias("is_empty")
    )


def merged_values(layers: DataFrame) -> DataFrame:
    """All values in layer order, duplicates kept: sort by (entity, layer, key)."""
    return layers.where("key IS NOT NULL").select("entity", "layer", "key", "value")


def effective_config(layers: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Value of each key: the distinct value that first appears in the latest layer.

    An identical value repeated in a later layer does not count again, so 1, 2, 1 gives 2.
    Values of different type are different: give ``value_type`` to tell 1 from "1". The flags in
    ``kept`` hold for a value if they hold in any of its layers.
    """
    typed = [c for c in ("value_type",) if c in layers.columns]
    first = (
        layers.where("key IS NOT NULL")
        .groupBy("entity", "key", "value", *typed)
        .agg(F.min("layer").alias("layer"), *[F.bool_or(c).alias(c) for c in kept])
    )
    return first.groupBy("entity", "key").agg(
        X.text_of(F.max_by("value", "layer")).alias("value"),
        *[F.max_by(c, "layer").alias(c) for c in kept],
    )


def shown_config(layers: DataFrame) -> DataFrame:
    """effective_config with secret values replaced by a placeholder."""
    return effective_config(layers, ["is_secret"]).withColumn("value", X.masked(F.col("value"), F.col("is_secret")))
