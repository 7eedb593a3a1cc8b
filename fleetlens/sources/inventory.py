"""Scans of inventory tables. Order is applied only where a listing is the result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# listing order of each table; JVMs have none
ORDER = {
    "container": ["container_id"],
    "manager": ["host"],
    "agent": ["host"],
    "machine": ["host"],
}


@dataclass(frozen=True)
class Inventory:
    """Inventory tables stored as one folder per table."""

    spark: SparkSession
    folder: str
    fmt: str = "parquet"

    def scan(self, name: str) -> DataFrame:
        return self.spark.read.format(self.fmt).load(f"{self.folder}/{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.scan(name)


def listing(df: DataFrame, table: str) -> DataFrame:
    """Rows in the table's listing order."""
    return df.orderBy(*ORDER[table]) if table in ORDER else df


def instances_of(instance: DataFrame, pu: str) -> DataFrame:
    return instance.where(F.col("pu") == pu)


def pu_names(pu: DataFrame) -> DataFrame:
    return pu.select("pu")


def find_pu(pu: DataFrame, name: str) -> DataFrame:
    """Every row of this name: none when the PU does not exist, several when the name is not unique."""
    return pu.where(F.col("pu") == name)


def require_pu(pu: DataFrame, name: str) -> DataFrame:
    """find_pu that fails when the PU does not exist."""
    found = find_pu(pu, name)
    if found.isEmpty():
        raise LookupError(f"no processing unit named {name}")
    return found


def flatten_processes(agent: DataFrame) -> DataFrame:
    """Agents with a nested ``processes`` array as one row per process."""
    return agent.select("host", F.explode("processes").alias("_p")).select("host", "_p.*")


def machines_with_agent(machine: DataFrame, agent: DataFrame) -> DataFrame:
    """Machines with their agent; null agent columns where none runs."""
    return machine.join(agent, "host", "left")


def containers_with_machine(container: DataFrame, machine: DataFrame) -> DataFrame:
    """Containers with the address of the machine they run on; a container of an unknown machine is left out."""
    return container.drop("addr").join(machine.select("host", "addr"), "host")
