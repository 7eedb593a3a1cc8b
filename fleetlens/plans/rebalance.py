"""Balance checks and the next move of every PU.

A check is (PU, scope, role, lane). Scope is a partition or the whole PU. Lanes are
the zone groups in order, then machine, then container. A check compares the
lowest and highest count over all keys the PU may use plus those it occupies, so most
keys have count zero. Those zero rows are never built: the minimum is zero as soon as a
check occupies fewer eligible keys than there are, and the smallest unoccupied key is found
from the occupied ones (it is the first key of the lane, or follows an occupied key).
The work grows with occupied keys instead of PUs x partitions x keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators.balance import needs_rebalancing
from ..operators.counts import ROLES, WHOLE, occupied, slot_counts
from ..operators.ordering import with_ordinal
from ..operators.placement import best_two, choose, eligible_containers, loaded_containers, matched_sets, requirement, zone_set
from ..session import written
from .relocation import NO_TARGET

NO_CANDIDATE = "no candidate instance"
_ACTIONS = ("relocate", "demote", "relocate")  # per role, in cascade order
_CHECK = ["pu", "scope", "role", "lane"]
_SINGLE = ("MACHINE", "CONTAINER")  # lanes after the zone groups


def zone_groups(groups: Sequence[Sequence[str]]) -> list[list[str]]:
    """Checked zone groups: at least two entries each (counted as given), then sorted and distinct."""
    for group in groups:
        if len(group) < 2:
            raise ValueError("a zone group needs at least two zones")
    return [sorted(set(group)) for group in groups]


def validated_zone_group(zones: Column) -> Column:
    """The same check for a column of zone lists."""
    short = F.raise_error(F.lit("a zone group needs at least two zones")).cast("array<string>")
    return F.when(F.size(zones) < 2, short).otherwise(zone_set(zones))


def _lane_keys(groups: Sequence[Sequence[str] | None], axes: Sequence[str] = _SINGLE) -> Column:
    """Array of (lane, key) of a container row; the lane number is its place in the cascade.

    A group of None holds every zone; ``axes`` are the lanes wanted besides the groups.
    """

    def zone_lane(lane: int, group: Sequence[str] | None) -> Column:
        inside = zone_set("zones")
        if group is not None:
            inside = F.array_intersect(inside, F.array(*[F.lit(z) for z in group]).cast("array<string>"))
        return F.transform(inside, lambda z: F.struct(F.lit(lane).alias("lane"), z.alias("key")))

    parts = [zone_lane(lane, group) for lane, group in enumerate(groups)]
    for lane, (axis, column) in enumerate(zip(_SINGLE, ("host", "container_id"), strict=True), len(groups)):
        if axis in axes:
            key = F.col(column).cast("string").alias("key")
            parts.append(F.array(F.struct(F.lit(lane).alias("lane"), key)))
    return F.concat(*parts)


def _axis(lane: Column, groups: Sequence) -> Column:
    n = len(groups)
    return F.when(lane < n, "ZONE").when(lane == n, "MACHINE").otherwise("CONTAINER")


def _nonzero(held: DataFrame) -> DataFrame:
    """Occupied keys per check: (pu, scope, role, lane, key, offered, n) with n > 0."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("role"), F.col(r).cast("bigint").alias("n")) for i, r in enumerate(ROLES)
    ])
    kept = ["pu", "scope", "lane", "key", "offered"]
    return (
        held.select(*kept, F.explode(F.filter(pairs, lambda p: p["n"] > 0)).alias("_pair"))
        .select(*kept, "_pair.role", "_pair.n")
    )


def _counted_key(lane, key, offered, n_keys) -> Column:
    return F.struct(
        F.col(lane).alias("lane") if isinstance(lane, str) else lane.alias("lane"),
        F.col(key).alias("key") if isinstance(key, str) else key.alias("key"),
        F.coalesce(offered, F.lit(False)).alias("offered"), F.coalesce(n_keys, F.lit(0)).cast("bigint").alias("n_keys"))


class _Keys:
    """Ordered eligible keys per requirement set and lane; PUs with the same requirements share a list."""

    def __init__(self, pu: DataFrame, container: DataFrame, groups: Sequence, axes: Sequence[str] = _SINGLE) -> None:
        self.lane_keys = _lane_keys(groups, axes)
        owner = F.array_join("required_zones", "\x01").alias("owner")
        self.owners = requirement(pu).select("pu", owner)
        eligible = (
            eligible_containers(pu, container)
            .select(owner, F.explode(self.lane_keys).alias("_key"))
            .select("owner", "_key.lane", "_key.key")
            .distinct()
        )
        self.ordered = written(with_ordinal(eligible, ["owner", "lane", "key"]))
        following = self.ordered.select(
            "owner", "lane", (F.col("ordinal") - 1).alias("ordinal"), F.col("key").alias("next")
        )
        # the last key of a list has no following key and drops out
        self.links = self.ordered.join(following, ["owner", "lane", "ordinal"]).select("owner", "lane", "key", "next")
        self.heads = self.ordered.groupBy("owner", "lane").agg(F.count("*").alias("n_keys"), F.min("key").alias("first"))
        self.pu, self.groups = pu, groups

    def per_pu(self) -> DataFrame:
        """Number of eligible keys and first eligible key per PU and lane."""
        return self.owners.join(self.heads, "owner").select("pu", "lane", "n_keys", "first")

    def held(self, container: DataFrame, slots: DataFrame) -> DataFrame:
        """Counts per PU, scope, lane and occupied key.

        ``offered`` tells whether the key is eligible too; other occupied keys never count as
        zero. It is settled per requirement set and container, so the large side is joined on
        that pair and never on a zone name, which a third of all rows may share. A PU without a
        row of its own is eligible nowhere.
        """
        owned = slots.join(self.owners, "pu", "left").withColumn("owner", F.coalesce("owner", F.lit("\x02")))
        lane_keys = container.select("container_id", F.explode(self.lane_keys).alias("_key")).select(
            "container_id", "_key.*"
        )
        offered = self.ordered.select("owner", "lane", "key", F.lit(True).alias("offered"))
        keyed = (
            owned.select("owner", "container_id").distinct()
            .join(lane_keys, "container_id")
            .join(offered, ["owner", "lane", "key"], "left")
            .withColumn("offered", F.coalesce("offered", F.lit(False)))
        )
        return occupied(owned, keyed, ["lane", "key", "offered"], ["owner", "container_id"])

    def places(self, container: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(container_id, place) and, per requirement set and place, the keys of its zones and host.

        Containers with equal zones and host share a place, so the second table is small: requirement sets meet places.
        It also tells the eligible keys of the container lane, and whether containers of the place are among them; a container
        listed with several zone sets is eligible if one of them is.
        """
        sets = container.select("container_id", "host", zone_set("zones").alias("zones"))
        listed = sets.groupBy("container_id").agg(F.array_sort(F.collect_set("zones")).alias("listed"))
        what = ["zones", "host", "listed"]
        rows = sets.join(listed, "container_id")
        numbered = written(with_ordinal(rows.select(*what).distinct(), what, "place"))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in what]
        located = written(rows.alias("a").join(numbered.alias("b"), same).select("a.container_id", "b.place"))

        owners = self.owners.select("owner").distinct().union(self.owners.sparkSession.range(1).select(F.lit("\x02")))
        pairs = owners.crossJoin(numbered)
        owner = F.array_join("required_zones", "\x01").alias("owner")
        every = numbered.select("place", F.explode("listed").alias("zones"))
        fitting = matched_sets(self.pu, every).join(every, "zones").select(owner, "place", F.lit(True).alias("fits")).distinct()
        sizes = self.heads.select("owner", "lane", "n_keys")
        offered = self.ordered.select("owner", "lane", "key", F.lit(True).alias("offered"))
        shared = (
            pairs.select("owner", "place", F.explode(_lane_keys(self.groups, ("MACHINE",))).alias("_key"))
            .select("owner", "place", "_key.*")
            .join(offered, ["owner", "lane", "key"], "left").join(sizes, ["owner", "lane"], "left")
            .groupBy("owner", "place").agg(F.collect_list(_counted_key("lane", "key", "offered", "n_keys")).alias("keys"))
        )
        single = sizes.where(F.col("lane") == len(self.groups) + 1).select("owner", "n_keys")
        return located, written(
            pairs.select("owner", "place").join(shared, ["owner", "place"]).join(fitting, ["owner", "place"], "left")
            .join(single, "owner", "left").select("owner", "place", "keys", "fits", "n_keys"))

    def keyed(self, slots: DataFrame, shared: DataFrame) -> DataFrame:
        """Counts per PU, scope, lane and key of slots with a ``scope`` and a ``place``; n_keys are the keys to choose from."""
        single = _counted_key(F.lit(len(self.groups) + 1), F.col("container_id").cast("string"), "fits", "n_keys")
        rows = slots.join(shared, ["owner", "place"]).withColumn("keys", F.concat("keys", F.array(single)))
        if "only_lane" in slots.columns:
            rows = rows.withColumn("keys", F.filter("keys", lambda k: k["lane"] == F.col("only_lane")))
        return (
            rows.select("pu", "scope", *ROLES, F.explode("keys").alias("_key")).select("pu", "scope", *ROLES, "_key.*")
            .groupBy("pu", "scope", "lane", "key", "offered")
            .agg(*[F.sum(r).alias(r) for r in ROLES], F.max("n_keys").alias("n_keys"))
        )

    def placed(self, slots: DataFrame, located: DataFrame) -> DataFrame:
        """Slots with the place of their container and the requirement set of their PU, if it has a row of its own."""
        return slots.join(located, "container_id").join(self.owners, "pu", "left").withColumn(
            "owner", F.coalesce("owner", F.lit("\x02")))

    def smallest_free(self, checks: DataFrame, taken: DataFrame) -> DataFrame:
        """Smallest eligible key without instances; ``taken`` holds the occupied keys of the checks."""
        firsts = checks.select(*_CHECK).join(self.owners, "pu").join(self.heads, ["owner", "lane"])
        nexts = taken.select(*_CHECK, "key").join(self.owners, "pu").join(self.links, ["owner", "lane", "key"])
        candidates = firsts.select(*_CHECK, F.col("first").alias("key")).unionByName(
            nexts.select(*_CHECK, F.col("next").alias("key"))
        )
        free = candidates.join(taken.select(*_CHECK, "key"), [*_CHECK, "key"], "left_anti")
        return free.groupBy(*_CHECK).agg(F.min("key").alias("free_key"))


def _failed_places(held: DataFrame, lanes: int) -> DataFrame:
    """Place in the cascade of the first failed check among those held, per PU; null where none fails.

    Works on numbers only, so both aggregations stay hash aggregations; keys are looked
    up later for the chosen checks. A check whose counts are all zero is balanced, so
    occupied checks are enough.
    """
    measures = []
    for r in ROLES:
        positive = F.when(F.col(r) > 0, F.col(r))
        measures += [
            F.count_if((F.col(r) > 0) & F.col("offered")).alias(f"taken_{r}"),
            F.min(positive).alias(f"low_{r}"), F.max(positive).alias(f"max_{r}"),
        ]
    bounds = held.groupBy("pu", "scope", "lane").agg(*measures, F.max("n_keys").alias("n_keys"))
    failed = []
    for role, r in enumerate(ROLES):
        low = F.when(F.col(f"taken_{r}") < F.col("n_keys"), F.lit(0)).otherwise(F.col(f"low_{r}"))
        place = (F.col("scope") * len(ROLES) + role) * lanes + F.col("lane")
        failed.append(F.when(needs_rebalancing(low, F.col(f"max_{r}")), place))
    return bounds.groupBy("pu").agg(F.min(F.least(*failed)).alias("place"))


def _first_failed(keys: _Keys, slots: DataFrame, located: DataFrame, shared: DataFrame, lanes: int) -> DataFrame:
    """First failed check of each PU: (pu, scope, role, lane).

    Partitions come first in the cascade, so the whole PU is counted only for PUs whose partitions are all balanced. Slots
    move to their partition as they are and become keys there: a partition has at most a slot per container.
    """
    scoped = keys.placed(slots.select("pu", "partition_id", "container_id", *ROLES), located).withColumn(
        "scope", F.col("partition_id").cast("bigint")).repartition("pu", "scope")
    parts = written(_failed_places(keys.keyed(scoped, shared), lanes))
    balanced = written(parts.where("place IS NULL").select("pu"))
    rest = slots.select("pu", "container_id", *ROLES).join(balanced, "pu", "left_semi").withColumn("scope", F.lit(WHOLE))
    whole = _failed_places(keys.keyed(keys.placed(rest, located), shared), lanes)
    return parts.unionByName(whole).where("place IS NOT NULL").select(
        "pu", F.expr(f"place div {lanes * len(ROLES)}").alias("scope"),
        F.expr(f"cast((place div {lanes}) % {len(ROLES)} as int)").alias("role"),
        F.expr(f"cast(place % {lanes} as int)").alias("lane"),
    )


def _occupied_stats(nonzero: DataFrame, *extra: str) -> DataFrame:
    return nonzero.groupBy(*_CHECK, *extra).agg(
        F.count_if("offered").alias("n_taken"),
        F.min("n").alias("low"),
        F.max("n").alias("max"),
        F.min_by("key", F.struct("n", "key")).alias("low_key"),
        F.min_by("key", F.struct(-F.col("n"), F.col("key"))).alias("max_key"),
    )


def _with_min_key(checks: DataFrame, nonzero: DataFrame, keys: _Keys) -> DataFrame:
    open_checks = checks.where(F.col("n_taken") < F.col("n_keys"))
    taken = nonzero.join(open_checks.select(*_CHECK), _CHECK, "left_semi")
    free = keys.smallest_free(open_checks, taken)
    return checks.join(free, _CHECK, "left").withColumn(
        "min_key", F.when(F.col("n_taken") < F.col("n_keys"), F.col("free_key")).otherwise(F.col("low_key"))
    )


def _minimum(stats: DataFrame) -> DataFrame:
    return stats.withColumn("min", F.when(F.col("n_taken") < F.col("n_keys"), F.lit(0)).otherwise(F.col("low")))


def _named(checks: DataFrame, groups: Sequence) -> list[Column]:
    lane = F.col("lane")
    return [
        F.col("pu"),
        F.when(F.col("scope") != WHOLE, F.col("scope")).alias("partition_id"),
        F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("role") + 1).alias("role"),
        _axis(lane, groups).alias("axis"),
        F.when(lane < len(groups), lane).alias("zone_group"),
    ]


def rebalance_checks(
    pu: DataFrame, container: DataFrame, facts: DataFrame, groups: Sequence[Sequence[str]] = ()
) -> DataFrame:
    """Every check of the cascade with its bounds, their smallest keys and its verdict."""
    keys = _Keys(pu, container, groups)
    held = written(keys.held(container, written(slot_counts(facts))))
    return _bounded(keys, held, held.select("pu", "scope"), ROLES, groups)


def balance_bounds(
    pu: DataFrame, container: DataFrame, facts: DataFrame, groups: Sequence[Sequence[str] | None] = (),
    axes: Sequence[str] = _SINGLE, by_partition: bool = False, roles: Sequence[str] = ROLES,
) -> DataFrame:
    """Bounds of the counters of the given zone groups and axes, also of PUs without instances.

    The same rows as ``min_max`` over zero-filled counts, from occupied keys alone. A group of None
    holds every zone. Without ``by_partition`` only the whole PU is measured.
    """
    keys = _Keys(pu, container, groups, axes)
    held = keys.held(container, written(slot_counts(facts)))
    held = written(held if by_partition else held.where(F.col("scope") == WHOLE))
    scopes = held.select("pu", "scope").union(pu.select("pu", F.lit(WHOLE)))
    return _bounded(keys, held, scopes, roles, groups)


def _bounded(keys: _Keys, held: DataFrame, scopes: DataFrame, wanted: Sequence[str], groups: Sequence) -> DataFrame:
    nonzero = _nonzero(held).where(F.col("role").isin([ROLES.index(r) for r in wanted]))
    roles = F.explode(F.array(*[F.lit(ROLES.index(r)) for r in wanted]))
    # a PU has a fixed few roles and lanes, so this adds a fixed factor to its partitions;
    # occupied checks without any eligible key come in from the other side
    every = scopes.distinct().withColumn("role", roles).join(keys.per_pu(), "pu")
    stats = every.join(_occupied_stats(nonzero), _CHECK, "full").fillna(0, ["n_taken", "n_keys"])
    full = _with_min_key(_minimum(stats), nonzero, keys)
    high = F.coalesce("max", F.lit(0))
    return full.select(
        *_named(full, groups), F.col("min"), high.alias("max"), "min_key",
        F.coalesce("max_key", "first").alias("max_key"), needs_rebalancing(F.col("min"), high).alias("needs_rebalancing"),
    )


def rebalance_step(
    pu: DataFrame, container: DataFrame, facts: DataFrame, groups: Sequence[Sequence[str]] = (),
    pus: DataFrame | None = None,
) -> DataFrame:
    """The next move of every PU that is out of balance, all PUs at once.

    The first failed check decides: partitions in order, then the whole PU; within a
    scope total, primary, backup; within a role the lanes. Only the machine lane binds
    the target to ``to_key``; zone and container moves may go to any machine.
    ``pus`` (a ``pu`` column) limits the PUs that move; loads still count everything.
    """
    wanted = pu if pus is None else pu.join(pus, "pu", "left_semi")
    # the scan of the instances is the costly part: its counts are written once with the instance of each slot that
    # would move first, so that loads and candidates need no other scan
    first_out = F.min(F.struct("is_backup", "instance_id", "is_stateful", "is_primary")).alias("first_out")
    all_slots = written(slot_counts(facts, first_out))
    slots = all_slots if pus is None else all_slots.join(pus, "pu", "left_semi")
    keys = _Keys(wanted, container, groups)
    located, shared = keys.places(container)

    # one small row per PU; written once because the joins below read it
    first = written(_first_failed(keys, slots, located, shared, len(groups) + 2))
    whole = F.col("scope") == WHOLE
    in_scope = whole | (F.col("partition_id") == F.col("scope"))
    # all that the rest needs of the slots: those of the failed scope, and for the container axis all of the PU
    mine = written(slots.join(first.select("pu", "scope", F.col("lane").alias("only_lane")), "pu").where(
        in_scope | (F.col("only_lane") == len(groups) + 1)))
    held = keys.keyed(
        keys.placed(mine.where(in_scope).select("pu", "scope", "only_lane", "container_id", *ROLES), located), shared)
    sizes = keys.per_pu().select("pu", "lane", "n_keys")
    taken = written(
        held.drop("n_keys").join(first.join(sizes, ["pu", "lane"], "left").fillna(0, ["n_keys"]), ["pu", "scope", "lane"])
        .withColumn("n", F.element_at(F.array(*[F.col(r).cast("bigint") for r in ROLES]), F.col("role") + 1))
        .where("n > 0")
        .select(*_CHECK, "n_keys", "key", "offered", "n")
    )
    stats = _minimum(_occupied_stats(taken, "n_keys"))
    chosen = written(_with_min_key(stats, taken, keys).withColumn("axis", _axis(F.col("lane"), groups)))

    standing = mine.join(chosen.select("pu", "axis", "max_key", "min_key"), "pu").join(
        container.select("container_id", "host", "zones"), "container_id")
    at = {
        "ZONE": lambda key: F.array_contains("zones", F.col(key)),
        "MACHINE": lambda key: F.col("host") == F.col(key),
        "CONTAINER": lambda key: F.col("container_id").cast("string") == F.col(key),
    }

    def on(key: str) -> Column:
        return F.coalesce(*[F.when(F.col("axis") == a, test(key)) for a, test in at.items()])

    # partitions already on the min key are out; the container axis looks at the scope only,
    # while its candidates are not limited to the scope; the zone axis excludes nothing
    barred = standing.where(
        ((F.col("axis") == "MACHINE") & on("min_key")) | ((F.col("axis") == "CONTAINER") & on("min_key") & in_scope)
    ).select("pu", "partition_id").distinct()
    sources = (
        standing.where(on("max_key") & (in_scope | (F.col("axis") == "CONTAINER")))
        .select("pu", "partition_id", "container_id", "first_out")
        .join(barred, ["pu", "partition_id"], "left_anti")
    )
    # instance ids are unique, so the order of the struct's first two fields decides
    candidate = sources.groupBy("pu").agg(F.min(F.struct("first_out", "partition_id", "container_id")).alias("_c")).select(
        "pu", F.struct("_c.first_out.instance_id", "_c.partition_id", "_c.container_id", "_c.first_out.is_stateful",
                       "_c.first_out.is_primary").alias("c"))

    loaded = loaded_containers(container, all_slots)
    anywhere = best_two(wanted, loaded)
    on_host = best_two(wanted, loaded, ["host"]).select(
        "required_zones", F.col("host").alias("min_key"), F.col("first_id").alias("host_first"),
        F.col("second_id").alias("host_second"),
    )
    machine_axis = F.col("axis") == "MACHINE"
    action = F.element_at(F.array(*[F.lit(a) for a in _ACTIONS]), F.col("role") + 1)
    target = F.when(
        F.col("c.instance_id").isNotNull() & (action == "relocate"),
        F.when(machine_axis, choose(F.col("host_first"), F.col("host_second"), F.col("c.container_id"))).otherwise(
            choose(F.col("first_id"), F.col("second_id"), F.col("c.container_id"))
        ),
    )
    return (
        chosen.join(candidate, "pu", "left")
        .join(requirement(wanted).select("pu", "required_zones"), "pu")
        .join(anywhere, "required_zones", "left")
        .join(on_host, ["required_zones", "min_key"], "left")
        .select(
            *_named(chosen, groups), action.alias("action"),
            F.col("c.instance_id").alias("instance_id"), F.col("c.container_id").alias("from_container"),
            F.col("max_key").alias("from_key"), F.col("min_key").alias("to_key"), "min", "max",
            target.alias("target_id"),
            (F.col("c.is_stateful") & (action == "relocate")).alias("demote_first"),
            F.when(F.col("c.instance_id").isNull(), NO_CANDIDATE)
            .when((action == "relocate") & target.isNull(), NO_TARGET).alias("problem"),
            F.col("c.partition_id").alias("instance_partition"), F.col("c.is_primary").alias("was_primary"),
        )
    )


def rebalance_plan(*args, **kwargs) -> DataFrame:
    """rebalance_step without its two working columns."""
    return rebalance_step(*args, **kwargs).drop("instance_partition", "was_primary")
