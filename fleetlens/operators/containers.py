"""Container selection: option filters, content scopes and both together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P


@dataclass(frozen=True)
class ContainerFilter:
    """Options of a container command; a group left at None lets every container pass."""

    include_zones: Sequence[str] | None = None
    exclude_zones: Sequence[str] | None = None
    include_machines: Sequence[str] | None = None
    exclude_machines: Sequence[str] | None = None
    include_pus: Sequence[str] | None = None
    exclude_pus: Sequence[str] | None = None
    longer_than: timedelta | None = None
    shorter_than: timedelta | None = None
    as_of: datetime | None = None


def _ids(instance: DataFrame) -> DataFrame:
    """Containers in use. Reduced before the shuffle: a semi join cannot split a hot right side."""
    return instance.select("container_id").distinct()


def running_any(container: DataFrame, instance: DataFrame, pus: Sequence[str]) -> DataFrame:
    """Containers with at least one instance of a listed PU."""
    return container.join(_ids(instance.where(F.col("pu").isin(*pus))), "container_id", "left_semi")


def running_none(container: DataFrame, instance: DataFrame, pus: Sequence[str]) -> DataFrame:
    """Containers with no instance of any listed PU."""
    return container.join(_ids(instance.where(F.col("pu").isin(*pus))), "container_id", "left_anti")


def filter_containers(container: DataFrame, instance: DataFrame, options: ContainerFilter) -> DataFrame:
    """All option groups, ANDed. Row conditions come first so they reach the scan below the joins."""
    conditions = [
        P.in_zones(F.col("zones"), options.include_zones, options.exclude_zones),
        P.on_machines(F.col("host"), F.col("addr"), options.include_machines, options.exclude_machines),
    ]
    if options.longer_than is not None or options.shorter_than is not None:
        if options.as_of is None:
            raise ValueError("an uptime filter needs as_of")
        conditions.append(P.uptime_between(F.col("start_ts"), options.as_of, options.longer_than, options.shorter_than))
    kept = container.where(P.all_of(*conditions))
    if options.include_pus is not None:
        kept = running_any(kept, instance, options.include_pus)
    if options.exclude_pus is not None:
        kept = running_none(kept, instance, options.exclude_pus)
    return kept


def empty_containers(container: DataFrame, instance: DataFrame) -> DataFrame:
    return container.join(_ids(instance), "container_id", "left_anti")


def non_empty_containers(container: DataFrame, instance: DataFrame) -> DataFrame:
    return container.join(_ids(instance), "container_id", "left_semi")


def _content(facts: DataFrame) -> DataFrame:
    """What each non-empty container holds; a hot container is reduced before the shuffle."""
    return facts.groupBy("container_id").agg(
        F.bool_or("is_stateful").alias("any_stateful"),
        F.bool_or(F.col("is_stateful") & F.col("is_primary")).alias("any_primary"),
        F.bool_or(F.col("is_stateful") & F.col("is_backup")).alias("any_backup"),
    )


def _with_content(container: DataFrame, facts: DataFrame, condition: str) -> DataFrame:
    return container.join(_content(facts).where(condition).select("container_id"), "container_id", "left_semi")


def stateful_backups_only(container: DataFrame, facts: DataFrame) -> DataFrame:
    """At least one stateful backup, no stateful primary; stateless instances may be there too."""
    return _with_content(container, facts, "any_backup AND NOT any_primary")


def stateful_primaries_only(container: DataFrame, facts: DataFrame) -> DataFrame:
    return _with_content(container, facts, "any_primary AND NOT any_backup")


def stateless_only(container: DataFrame, facts: DataFrame) -> DataFrame:
    """Not empty and nothing stateful."""
    return _with_content(container, facts, "NOT any_stateful")


# content scopes a restart can be limited to
SCOPES = {
    "all": lambda container, facts: container,
    "each-non-empty": non_empty_containers,
    "empty-only": empty_containers,
    "stateful-backups-only": stateful_backups_only,
    "stateful-primaries-only": stateful_primaries_only,
    "stateless-only": stateless_only,
}


def select_containers(
    container: DataFrame, facts: DataFrame, scope: str = "all", options: ContainerFilter | None = None
) -> DataFrame:
    """Containers in a content scope that also pass the options."""
    return SCOPES[scope](filter_containers(container, facts, options or ContainerFilter()), facts)
