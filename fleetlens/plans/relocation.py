"""Where instances would move to, and the plan to empty a host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators.ordering import ordinal_within, running_sum
from ..operators.placement import best_two, choose, eligible_containers, loaded_containers, matched_sets, requirement, zone_set
from ..session import written
from .spread import BLOCK, shared_spread

NO_TARGET = "no container meets the requirements"


def _choices_per_pu(pu: DataFrame, choices: DataFrame) -> DataFrame:
    return requirement(pu).select("pu", "required_zones").join(choices, "required_zones").drop("required_zones")


def relocation_targets(
    pu: DataFrame, container: DataFrame, facts: DataFrame, same: str | None = None
) -> DataFrame:
    """Best other container for each instance; ``same`` names a container column the target must share.

    Each row answers for its instance alone, on the loads as they are; ``host_drain`` spreads
    movers that go together. Choices are made per requirement set and handed to the PUs first:
    there are so few sets that joining instances on them would fill only a handful of tasks.
    ``origin_empty`` tells that nothing is left in the old container after the move.
    """
    loaded = loaded_containers(container, facts)
    within = [same] if same else []
    choices = _choices_per_pu(pu, best_two(pu, loaded, within))
    origin = loaded.select("container_id", "n_container", *within)
    target = choose(F.col("first_id"), F.col("second_id"), F.col("container_id"))
    return (
        facts.join(origin, "container_id")
        .join(choices, ["pu", *within], "left")
        .select(
            "instance_id", "pu", "container_id", target.alias("target_id"),
            (F.col("n_container") - 1 == 0).alias("origin_empty"),
            F.when(target.isNull(), F.lit(NO_TARGET)).alias("problem"),
        )
    )


def _owner() -> Column:
    return F.array_join("required_zones", "\x01").alias("owner")


def _filled(eligible: DataFrame, sizes: DataFrame) -> DataFrame:
    """(owner, container_id, from, to): the places of each container when all movers of an owner are spread.

    Containers are filled from the least loaded up to a common level; what is then left over goes
    one each to the first containers by (n_machine, container_id). ``sizes`` has (owner, movers).
    """
    upwards = Window.partitionBy("owner").orderBy("n_container").rowsBetween(Window.unboundedPreceding, 0)
    # the window sees distinct loads, not containers
    steps = eligible.groupBy("owner", "n_container").agg(F.count("*").alias("n")).select(
        "owner", "n_container", F.sum("n").over(upwards).alias("below"),
        F.sum(F.col("n") * F.col("n_container")).over(upwards).alias("held"))
    need = F.col("below") * F.col("n_container") - F.col("held")
    top = steps.join(sizes, "owner").where(need <= F.col("movers")).groupBy("owner").agg(
        F.max(F.struct("n_container", "below", (F.col("movers") - need).alias("rest"))).alias("top"))
    levels = top.select("owner", F.col("top.n_container").alias("highest"), F.expr("top.n_container + top.rest div top.below").alias("level"),
                        F.expr("top.rest % top.below").alias("extra"))
    order = ["n_machine", "container_id"]
    used = ordinal_within(eligible.join(levels, "owner").where("n_container <= highest"), ["owner"], order, "place")
    room = F.col("level") - F.col("n_container") + (F.col("place") < F.col("extra")).cast("long")
    ends = running_sum(used.withColumn("room", room).where("room > 0"), ["owner"], order, "room", "to")
    return ends.select("owner", "container_id", (F.col("to") - F.col("room")).alias("from"), "to")


def _targets(pu: DataFrame, free: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Containers with their zone set as text, and (owner, zones): which requirement set may use which zone set."""
    located = free.withColumn("zones", zone_set("zones"))
    matched = matched_sets(pu, located).select(_owner(), F.array_join("zones", "\x01").alias("zones"))
    return located.withColumn("zones", F.array_join("zones", "\x01")).select("zones", "container_id", "n_container", "n_machine"), matched


def host_drain(
    pu: DataFrame, container: DataFrame, machine: DataFrame, facts: DataFrame, hosts: Sequence[str], shared: bool = False
) -> DataFrame:
    """Instances on the given hosts (names or addresses) with targets on the other machines.

    The movers of PUs with equal zone requirements are spread so that the containers they go to end
    up equally full, give or take one; every requirement set starts from the loads before the drain. With ``shared``
    this holds over all PUs together: containers that can take each other's movers end up equally full (``spread``).
    Naming every machine is an error. The error is part of the plan, so it is raised by the
    first job that reads the leaving containers and nothing is collected here.
    """
    return _drain(pu, container, machine, facts, hosts, shared)[0]


def drain_levels(pu: DataFrame, container: DataFrame, machine: DataFrame, facts: DataFrame, hosts: Sequence[str]) -> DataFrame:
    """Containers that a shared drain may use: load before and after, their class and the level of the class."""
    plan, levels, targets = _drain(pu, container, machine, facts, hosts, shared=True)
    taken = plan.where("target_id is not null").groupBy(F.col("target_id").alias("container_id")).agg(F.count("*").alias("taken"))
    return targets.join(levels.where("owner is null").select("zones", "class", "level"), "zones").join(taken, "container_id", "left").select(
        "container_id", F.col("n_container").alias("n_before"), "class", "level",
        (F.col("n_container") + F.coalesce("taken", F.lit(0))).alias("n_after"))


def _drain(
    pu: DataFrame, container: DataFrame, machine: DataFrame, facts: DataFrame, hosts: Sequence[str], shared: bool
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The plan, and for a shared one its levels and the containers that may take movers."""
    named = P.on_machines(F.col("host"), F.col("addr"), hosts)
    guard = machine.agg(F.count("*").alias("machines"), F.count_if(named).alias("matching")).select(
        F.when(
            (F.col("machines") > 0) & (F.col("machines") == F.col("matching")),
            F.raise_error(F.lit("this would shut down every machine")).cast("boolean"),
        ).otherwise(F.lit(True)).alias("allowed")
    )
    loaded = loaded_containers(container, facts)
    leaving = loaded.where(named).select("container_id", "host").join(F.broadcast(guard), F.col("allowed"))  # one row
    owners = requirement(pu).select("pu", _owner())
    # a PU without a row of its own has no targets
    movers = facts.join(leaving.drop("allowed"), "container_id").join(owners, "pu", "left").select(
        "instance_id", "pu", "host", "container_id", "is_stateful", F.coalesce("owner", F.lit("\x02")).alias("owner"))
    movers = written(ordinal_within(movers, ["owner"], ["instance_id", "container_id"], "place"))
    sizes = movers.groupBy("owner").agg(F.count("*").alias("movers"))
    if shared:
        targets, matched = _targets(pu, loaded.where(P.negate(named)))
        levels, filled = shared_spread(sizes, matched, targets)
    else:
        levels = targets = None
        filled = _filled(written(eligible_containers(pu, loaded.where(P.negate(named))).select(
            _owner(), "container_id", "n_container", "n_machine")), sizes)
    places = filled.select(
        F.col("owner").alias("_owner"), F.col("container_id").alias("target_id"), "from", "to",
        F.explode(F.sequence(F.expr(f"`from` div {BLOCK}"), F.expr(f"(`to` - 1) div {BLOCK}"))).alias("block"))
    place = F.col("place")
    plan = (
        movers.join(places, (F.col("owner") == F.col("_owner")) & (F.expr(f"place div {BLOCK}") == F.col("block"))
                    & (place >= F.col("from")) & (place < F.col("to")), "left")
        .select(
            "instance_id", "pu", "host", "container_id", "target_id", F.col("is_stateful").alias("demote_first"),
            F.when(F.col("target_id").isNull(), F.lit(NO_TARGET)).alias("problem"),
        )
    )
    return plan, levels, targets


def moved(facts: DataFrame, plan: DataFrame) -> DataFrame:
    """The instances as they are once the plan has been carried out; what has no target stays."""
    targets = plan.where("target_id is not null").select("instance_id", "container_id", "target_id")
    return facts.join(targets, ["instance_id", "container_id"], "left").withColumn(
        "container_id", F.coalesce("target_id", "container_id")).select(*facts.columns)


# a host is drained in at most this many passes
DRAIN_ROUNDS = 3


def drain_status(
    machine: DataFrame, container: DataFrame, facts: DataFrame, hosts: Sequence[str], round_no: int,
    skip_relocate: bool = False, rounds: int = DRAIN_ROUNDS,
) -> DataFrame:
    """After a pass: instances left per host, whether the agent may stop and whether another pass (of ``rounds``) is due."""
    left = container.join(facts.groupBy("container_id").agg(F.count("*").alias("n")), "container_id")
    per_host = left.groupBy("host").agg(F.sum("n").alias("remaining"))
    remaining = F.coalesce("remaining", F.lit(0))
    return (
        machine.where(P.on_machines(F.col("host"), F.col("addr"), hosts))
        .join(per_host, "host", "left")
        .select(
            "host", remaining.alias("remaining"),
            ((remaining == 0) | F.lit(skip_relocate)).alias("agent_may_stop"),
            ((remaining > 0) & F.lit(not skip_relocate and round_no < rounds)).alias("next_round"),
        )
    )


def demote_plan(facts_or_instance: DataFrame, container: DataFrame) -> DataFrame:
    """Primary spaces of stateful instances in the given (already selected) containers.

    Takes the raw instance rows, because each space gives its own row.
    """
    space = F.explode(F.filter("spaces", lambda s: P.is_primary_space(s["mode"]))).alias("space")
    return (
        facts_or_instance.where(P.is_stateful(F.col("embedded"), F.col("embedded_space_ids")))
        .join(container.select("container_id", "host"), "container_id")
        .select("host", "container_id", "pu", "instance_id", space)
        .select("host", "container_id", "pu", "instance_id", F.col("space.id").alias("space_id"))
    )


def demote_counts(plan: DataFrame) -> DataFrame:
    """Spaces to demote per instance."""
    return plan.groupBy("container_id", "instance_id").agg(F.count("*").alias("demoted"))
