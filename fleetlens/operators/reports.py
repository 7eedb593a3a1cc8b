"""Reports as DataFrames. Lists that can grow without bound come as rows, never as one collected cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..session import written
from .instances import labelled
from .ordering import ordinal_within
from .placement import zone_set
from .processes import component_types, jvm_descriptions, process_counts


def common_zones(container: DataFrame) -> DataFrame:
    """Zones that every container of a host has, with the host's container count.

    The collected zones all belong to each single container of the host, so the array
    is never longer than one container's own zone list.
    """
    totals = container.groupBy("host").agg(F.count("*").alias("n_containers"))
    per_zone = (
        container.select("host", F.explode(zone_set("zones")).alias("zone"))
        .groupBy("host", "zone")
        .agg(F.count("*").alias("n_zone"))
    )
    shared = (
        per_zone.join(totals, "host")
        .where(F.col("n_zone") == F.col("n_containers"))
        .groupBy("host")
        .agg(F.array_sort(F.collect_list("zone")).alias("common_zones"))
    )
    return totals.join(shared, "host", "left").withColumn(
        "common_zones", F.coalesce("common_zones", F.array().cast("array<string>"))
    )


def specific_zones(container: DataFrame) -> DataFrame:
    """Containers with the zones not shared by their whole host."""
    return container.join(common_zones(container), "host").withColumn(
        "specific_zones", F.array_sort(F.array_except(zone_set("zones"), "common_zones"))
    )


def pu_names(instance: DataFrame) -> DataFrame:
    """PU names per container; ``copies`` keeps the duplicates of the sorted name list."""
    return instance.groupBy("container_id", "pu").agg(F.count("*").alias("copies"))


def pu_labels(facts: DataFrame) -> DataFrame:
    """Described PU names per container, with multiplicity."""
    # equal instances are counted first, so labels are made and joined on few rows; written because
    # the partitions' primaries are read from it as well
    kinds = facts.groupBy("container_id", "pu", "partition_id", "is_stateful", "is_primary").agg(
        F.count("*").alias("copies")
    )
    return labelled(written(kinds)).groupBy("container_id", "label").agg(F.sum("copies").alias("copies"))


def containers_per_host(container: DataFrame) -> DataFrame:
    return container.groupBy("host").agg(F.count("*").alias("n_containers"))


def container_report(container: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per container and label: host summary, specific zones, instance count and the label's copies.

    An empty container gives one row with a null label. Sort by ``REPORT_ORDER`` for printing.
    """
    labels = pu_labels(facts)
    counts = labels.groupBy("container_id").agg(F.sum("copies").alias("n_instances"))
    return (
        specific_zones(container)
        .join(counts, "container_id", "left")
        .join(labels, "container_id", "left")
        .select(
            "host",
            F.array_join("common_zones", ",").alias("common_zones"),
            "n_containers",
            "container_id",
            # the rendered list is the sort key, so the brackets matter
            F.concat(F.lit("["), F.array_join("specific_zones", ", "), F.lit("]")).alias("specific_zones"),
            "pid",
            F.coalesce("n_instances", F.lit(0)).alias("n_instances"),
            "label",
            "copies",
        )
    )


def container_order(container: DataFrame) -> DataFrame:
    """Place of each container in the listing of its host, from 0: by its specific zones as printed, then by pid."""
    printed = F.concat(F.lit("["), F.array_join("specific_zones", ", "), F.lit("]"))
    rows = specific_zones(container).select("container_id", "host", printed.alias("specific_zones"), "pid")
    return ordinal_within(rows, ["host"], ["specific_zones", "pid", "container_id"], "position")


REPORT_ORDER = ["host", "specific_zones", "pid", "label"]


def agent_report(agent: DataFrame, agent_process: DataFrame) -> DataFrame:
    """One row per agent process with the agent's totals; an agent without processes keeps one row."""
    return process_counts(agent, agent_process).join(agent_process, "host", "left")


def manager_report(manager: DataFrame) -> DataFrame:
    """Distinct manager hosts, sorted."""
    return manager.select("host").distinct().orderBy("host")


def jvm_report(jvm: DataFrame, container: DataFrame, manager: DataFrame, agent: DataFrame, as_of) -> DataFrame:
    """One printable row per JVM; sort by ``JVM_ORDER``."""
    return jvm_descriptions(component_types(jvm, container, manager, agent), as_of)


JVM_ORDER = ["component_rank", "host", "heap_max_mb", "uptime"]


def iso_uptime(uptime) -> F.Column:
    """Interval as ISO-8601 text, hours not carried into days: ``PT49H0.5S``; zero is ``PT0S``."""
    micros = F.expr("0L") + F.round(F.extract(F.lit("SECOND"), uptime) * 1_000_000).cast("bigint")
    hours = F.extract(F.lit("DAY"), uptime).cast("bigint") * 24 + F.extract(F.lit("HOUR"), uptime).cast("bigint")
    minutes = F.extract(F.lit("MINUTE"), uptime).cast("bigint")
    seconds = F.regexp_replace((micros.cast("decimal(20,6)") / 1_000_000).cast("decimal(20,6)").cast("string"),
                               r"\.?0+$", "")
    body = F.concat(
        F.when(hours != 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""),
        F.when(minutes != 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""),
        F.when(micros != 0, F.concat(seconds, F.lit("S"))).otherwise(""),
    )
    return F.concat(F.lit("PT"), F.when(body == "", F.lit("0S")).otherwise(body))


def jvm_line(report: DataFrame) -> DataFrame:
    """Report rows with ``line``, the fixed-width text form."""
    line = F.concat(
        F.col("component_type"), F.lit(" : "), X.pad_left(F.col("pid"), 5), F.lit(" : running on "), F.col("host"),
        F.lit(" for "), X.pad_right(iso_uptime(F.col("uptime")), 17), F.lit(" : Heap ["),
        X.pad_left(F.col("heap_init_mb"), 5), F.lit(" MB, "), X.pad_left(F.col("heap_max_mb"), 5), F.lit(" MB] : "),
        F.col("description"),
    )
    return report.withColumn("line", line)


def component_totals(typed: DataFrame) -> DataFrame:
    return typed.groupBy("component_type").agg(F.count("*").alias("n"))


def full_report(fleet, facts: DataFrame, as_of) -> dict[str, DataFrame]:
    """The four reports in print order; ``fleet`` has the inventory tables as attributes."""
    return {
        "managers": manager_report(fleet.manager),
        "agents": agent_report(fleet.agent.drop("pid"), fleet.agent_process).orderBy("host", "pid"),
        "jvms": jvm_report(fleet.jvm, fleet.container, fleet.manager, fleet.agent, as_of).orderBy(*JVM_ORDER),
        "containers": container_report(fleet.container, facts).orderBy(*REPORT_ORDER),
    }


def dump_reports(container: DataFrame, instance: DataFrame, dump_types: list[str], start_time) -> DataFrame:
    """Metadata of a dump per container and PU; a container without instances has one row with no PU."""
    # a row per (container, PU) with its copies, because a hot container's name list has no bound
    return container.join(pu_names(instance), "container_id", "left").select(
        F.array(*[F.lit(t) for t in dump_types]).alias("dumps_types"),
        "container_id", F.col("host").alias("host_name"), F.col("addr").alias("host_address"), "pid",
        P.moment(start_time).alias("start_time"), F.col("pu").alias("pu_name"), "copies",
    )
