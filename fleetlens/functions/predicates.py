"""Row conditions as Column builders.

Filter lists follow one rule throughout: ``None`` means "not asked for" and lets
every row pass, an empty include list rejects every row, an empty exclude list
lets every row pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def moment(value: datetime) -> Column:
    """A zone-free literal. A plain literal would be read in the machine's zone and shown in the session's."""
    return F.lit(value.isoformat(" ")).cast("timestamp_ntz")


def all_of(*conditions: Column) -> Column:
    """Conjunction; no condition at all is true."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def negate(condition: Column) -> Column:
    """Negation where an unknown condition counts as not met."""
    return ~F.coalesce(condition, F.lit(False))


def overlaps(zones: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(zones, _strings(wanted)), F.lit(False))


def in_zones(zones: Column, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> Column:
    kept = F.lit(True) if include is None else overlaps(zones, include)
    return kept if exclude is None else kept & ~overlaps(zones, exclude)


def on_machines(
    host: Column, addr: Column, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None
) -> Column:
    """A machine is named by its host name or by its address."""

    def named(values: Sequence[str]) -> Column:
        return F.coalesce(host.isin(*values), F.lit(False)) | F.coalesce(addr.isin(*values), F.lit(False))

    kept = F.lit(True) if include is None else named(include)
    return kept if exclude is None else kept & ~named(exclude)


def is_machine(host: Column, addr: Column, name: str) -> Column:
    return on_machines(host, addr, [name])


def same_machine(host: Column, other: Column | str) -> Column:
    return host.eqNullSafe(other)


def different_machine(host: Column, other: Column | str) -> Column:
    return ~host.eqNullSafe(other)


def pu_name_in(pu: Column, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> Column:
    kept = F.lit(True) if include is None else pu.isin(*include)
    return kept if exclude is None else kept & ~pu.isin(*exclude)


def uptime_between(
    start: Column, as_of: datetime, longer_than: timedelta | None = None, shorter_than: timedelta | None = None
) -> Column:
    """Strict on both sides. ``as_of`` is given, never read from the clock.

    Written as bounds on the start time, so that a scan can skip by its statistics.
    """
    kept = F.lit(True) if longer_than is None else start < moment(as_of - longer_than)
    return kept if shorter_than is None else kept & (start > moment(as_of - shorter_than))


def in_partition(partition_id: Column, wanted: int) -> Column:
    return partition_id == wanted


def satisfies_zones(required: Column, zones: Column) -> Column:
    """No required zone, or at least one of them on the container."""
    return (F.size(required) == 0) | F.coalesce(F.arrays_overlap(required, zones), F.lit(False))


def isolation_ok(requires_isolation: Column, instances: Column) -> Column:
    return ~F.coalesce(requires_isolation, F.lit(False)) | (instances == 0)


def is_agent_or_manager(component_type: Column) -> Column:
    return component_type.isin("GSA", "GSM")


# --- instances and their spaces -------------------------------------------------

def is_primary_space(mode: Column) -> Column:
    return mode.eqNullSafe("PRIMARY")


def is_backup_space(mode: Column) -> Column:
    return mode.eqNullSafe("BACKUP")


def _any_space(spaces: Column, condition) -> Column:
    # a missing space list is bad input, not "no such space"
    checked = F.when(spaces.isNull(), F.raise_error(F.lit("spaces is null"))).otherwise(spaces)
    return F.exists(checked, lambda s: condition(s["mode"]))


def has_primary(spaces: Column) -> Column:
    return _any_space(spaces, is_primary_space)


def has_backup(spaces: Column) -> Column:
    return _any_space(spaces, is_backup_space)


def is_stateful(embedded: Column, embedded_space_ids: Column) -> Column:
    """Embeds at least one space that is not a mirror."""
    real = F.exists(embedded_space_ids, lambda s: ~F.contains(F.lower(s), F.lit("mirror")))
    return F.coalesce(embedded & real, F.lit(False))


def is_stateless(embedded: Column, embedded_space_ids: Column) -> Column:
    return ~is_stateful(embedded, embedded_space_ids)


def is_stateful_primary(embedded: Column, embedded_space_ids: Column, spaces: Column) -> Column:
    return is_stateful(embedded, embedded_space_ids) & has_primary(spaces)


def is_stateful_backup(embedded: Column, embedded_space_ids: Column, spaces: Column) -> Column:
    return is_stateful(embedded, embedded_space_ids) & has_backup(spaces)
