"""Processes, JVMs and agents: lookups by (host, pid) and (host, agent id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X

_PROCESS = ["host", "pid"]
# report order of component types; anything else is UNKNOWN and comes last
COMPONENT_TYPES = ("GSA", "GSM", "GSC", "UNKNOWN")


def component_types(jvm: DataFrame, container: DataFrame, manager: DataFrame, agent: DataFrame) -> DataFrame:
    """JVM rows with ``component_type``: container first, then manager, then agent, else UNKNOWN."""

    def marked(df: DataFrame, flag: str) -> DataFrame:
        return df.select(*_PROCESS).distinct().withColumn(flag, F.lit(True))

    joined = (
        jvm.join(marked(container, "_gsc"), _PROCESS, "left")
        .join(marked(manager, "_gsm"), _PROCESS, "left")
        .join(marked(agent, "_gsa"), _PROCESS, "left")
    )
    kind = F.when(F.col("_gsc"), "GSC").when(F.col("_gsm"), "GSM").when(F.col("_gsa"), "GSA").otherwise("UNKNOWN")
    return joined.withColumn("component_type", kind).drop("_gsc", "_gsm", "_gsa")


def component_rank(component_type):
    return F.array_position(F.array(*[F.lit(c) for c in COMPONENT_TYPES]), component_type).cast("int")


def containers_of(processes: DataFrame, container: DataFrame, agent: DataFrame) -> DataFrame:
    """(host, pid) rows with their container id, null when there is none or the host has no agent."""
    found = (
        container.join(agent.select("host"), "host", "left_semi")
        .groupBy(*_PROCESS)
        .agg(F.min("container_id").alias("container_id"))
    )
    return processes.join(found, _PROCESS, "left")


def agent_ids_of(processes: DataFrame, agent_process: DataFrame) -> DataFrame:
    """(host, pid) rows with the agent id that runs them, null when no agent lists them."""
    found = agent_process.groupBy(*_PROCESS).agg(F.min("agent_id").alias("agent_id"))
    return processes.join(found, _PROCESS, "left")


def kill_requests(requests: DataFrame, agent: DataFrame, machine: DataFrame) -> DataFrame:
    """Requested (host, agent_id) pairs; the host may be a name or an address.

    ``problem`` is set on requests whose host has no agent.
    """
    agents = agent.select("host").distinct().join(machine, "host")
    names = agents.select(F.col("host").alias("wanted"), "host").unionByName(
        agents.select(F.col("addr").alias("wanted"), "host")
    ).groupBy("wanted").agg(F.min("host").alias("agent_host"))
    return requests.withColumnRenamed("host", "wanted").join(names, "wanted", "left").select(
        F.col("wanted").alias("host"), "agent_id", "agent_host",
        F.when(F.col("agent_host").isNull(), F.lit("no agent on this host")).alias("problem"),
    )


def bad_services(
    agent_process: DataFrame, jvm: DataFrame, container: DataFrame, manager: DataFrame, agent: DataFrame
) -> DataFrame:
    """Distinct (host, pid) seen by an agent or as a JVM that are neither agent, manager nor container."""
    typed = component_types(jvm, container, manager, agent)
    seen = agent_process.select(*_PROCESS).union(jvm.select(*_PROCESS)).distinct()
    known = [
        typed.where(P.is_agent_or_manager(F.col("component_type"))).select(*_PROCESS),
        container.select(*_PROCESS),
    ]
    return reduce(lambda rest, part: rest.subtract(part), known, seen)


def bad_service_actions(
    agent_process: DataFrame, jvm: DataFrame, container: DataFrame, manager: DataFrame, agent: DataFrame,
    container_now: DataFrame | None = None,
) -> DataFrame:
    """What to do with each bad service: restart its container, kill it by agent id, or a manual step.

    Within one snapshot no bad service has a container; ``container_now``, a later
    snapshot, makes the restart rows possible.
    """
    bad = bad_services(agent_process, jvm, container, manager, agent)
    located = containers_of(bad, container if container_now is None else container_now, agent)
    action = F.when(F.col("container_id").isNotNull(), "restart").when(F.col("agent_id").isNotNull(), "kill")
    return agent_ids_of(located, agent_process).select(
        *_PROCESS, "container_id", "agent_id", action.otherwise("manual").alias("action")
    )


def agents_off_managers(agent: DataFrame, manager: DataFrame) -> DataFrame:
    return agent.join(manager.select("host"), "host", "left_anti")


def process_counts(agent: DataFrame, agent_process: DataFrame) -> DataFrame:
    """Agents with their process count and the required global instances, passed through."""
    counts = agent_process.groupBy("host").agg(F.count("*").alias("processes"))
    return agent.join(counts, "host", "left").select(
        "host", "required_global_instances", F.coalesce("processes", F.lit(0)).alias("processes")
    )


def jvm_descriptions(typed: DataFrame, as_of) -> DataFrame:
    """Report columns of a JVM; see component_types for the input."""
    return typed.select(
        "host", "pid", "component_type", component_rank(F.col("component_type")).alias("component_rank"),
        X.round_half_up(F.col("heap_init_mb")).alias("heap_init_mb"),
        X.round_half_up(F.col("heap_max_mb")).alias("heap_max_mb"),
        X.uptime(P.moment(as_of), F.col("start_ts")).alias("uptime"),
        X.jvm_description(F.col("vendor"), F.col("vm_name"), F.col("version")).alias("description"),
        *[c for c in ("env", "sysprops") if c in typed.columns],
    )
