"""Scopes of deploy, restart and shut-down commands as plan tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators.containers import ContainerFilter, select_containers
from ..operators.processes import agents_off_managers
from ..operators.reports import container_report


def agent_shutdown_order(
    agent: DataFrame, manager: DataFrame, machine: DataFrame,
    include: Sequence[str] | None = None, exclude: Sequence[str] | None = None,
) -> DataFrame:
    """Pass 1 stops agents away from managers, pass 2 every agent; the machine filter holds for both."""
    selected = agent.join(machine, "host").where(P.on_machines(F.col("host"), F.col("addr"), include, exclude))
    first = agents_off_managers(selected, manager).select(F.lit(1).alias("pass"), "host")
    return first.unionByName(selected.select(F.lit(2).alias("pass"), "host"))


def deploy_scope(
    pu: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None, whole: bool = False
) -> DataFrame:
    """PUs of a deploy or undeploy with ``skipped``; ``whole`` takes the application as one and skips nothing."""
    kept = F.lit(True) if whole else P.pu_name_in(F.col("pu"), include, exclude)
    return pu.withColumn("skipped", ~kept)


def restart_selection(
    container: DataFrame, facts: DataFrame, scope: str = "all", options: ContainerFilter | None = None
) -> dict[str, DataFrame]:
    """Reports a restart shows: every container, then the selected ones."""
    selected = select_containers(container, facts, scope, options)
    return {"all": container_report(container, facts), "selected": container_report(selected, facts)}


def manager_selection(
    manager: DataFrame, machine: DataFrame,
    include: Sequence[str] | None = None, exclude: Sequence[str] | None = None,
) -> DataFrame:
    return manager.join(machine, "host").where(P.on_machines(F.col("host"), F.col("addr"), include, exclude))
