"""Named queries over the fleet derived from the test tables; each reads its tables whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..operators import balance, containers, counts, instances, layers, placement, processes, ranges, reports
from ..operators.containers import ContainerFilter
from ..plans import config, operations, rebalance, relocation, schedule
from ..session import application_folder
from ..sources import files, inventory, sinks, snapshots
from ..streaming import readiness, source, windows
from .fleet import Fleet

AS_OF, EARLY = datetime(2024, 2, 1), datetime(2024, 1, 3, 12)
DRAINED = ["NATION_9", "10.2.0.7"]
RACKS = [["RACK_0", "RACK_1", "RACK_2", "RACK_3"]]
RACK_PAIR = [["RACK_0", "RACK_1"]]
PLACEHOLDER = "${CONTAINER_OPTIONS}"
PLANNED = 5
TIMEOUT = timedelta(days=2)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(pu_level: str = "brand"):
    def register(build: Callable[[Fleet], DataFrame]) -> Callable:
        QUERIES[build.__name__] = lambda spark, folder: build(Fleet(spark, folder, pu_level))
        return build

    return register


def joined(column: str, separator: str = ",") -> Column:
    return F.array_join(column, separator).alias(column)


def seconds(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    day, hour, minute, second = (F.extract(F.lit(u), column) for u in ("DAY", "HOUR", "MINUTE", "SECOND"))
    return (day * 86400 + hour * 3600 + minute * 60 + second).cast("bigint")


def scope_name() -> Column:
    return F.coalesce(F.col("partition_id").cast("string"), F.lit("whole")).alias("scope")


def facts(fleet: Fleet) -> DataFrame:
    return instances.instance_facts(fleet.instance)


# --- scans and filters ------------------------------------------------------------

@query()
def scan_containers(f):
    rows = f.container.select("container_id", "host", "addr", "pid", joined("zones"), "start_ts")
    return inventory.listing(rows, "container")


@query()
def scan_machines(f):
    return inventory.listing(inventory.machines_with_agent(f.machine, f.agent.select("host", "pid")), "machine")


@query()
def scan_agents(f):
    return inventory.listing(f.agent.select("host", "pid", F.col("required_global_instances")["GSM"].alias("required_managers")), "agent")


@query()
def scan_managers(f):
    return inventory.listing(f.manager, "manager")


@query()
def scan_pus(f):
    return f.pu.select("pu", "planned", joined("required_zones"), "requires_isolation")


@query()
def pu_instances(f):
    return inventory.instances_of(facts(f), "Brand#7")


@query()
def pu_lookup(f):
    return inventory.find_pu(f.pu, "Brand#7").select("pu", "planned")


@query()
def machine_instances(f):
    found = instances.instances_on_machine(f.instance, f.container, "NATION_9")
    return found.select("instance_id", "pu", "container_id", "host", "addr")


@query()
def container_machines(f):
    return inventory.containers_with_machine(f.container, f.machine).select("container_id", "pid", "host", "addr")


@query()
def machine_split(f):
    """Containers on one machine and on all others."""
    there = F.when(P.same_machine(F.col("host"), "NATION_9"), "same").when(P.different_machine(F.col("host"), "NATION_9"), "different")
    return f.container.groupBy(there.alias("machine")).agg(F.count("*").alias("n"), F.min("container_id").alias("first"))


@query()
def scan_agent_processes(f):
    """Agents report their processes as a list."""
    listed = f.agent_process.groupBy("host").agg(F.collect_list(F.struct("pid", "agent_id", "service_type")).alias("processes"))
    return inventory.flatten_processes(listed)


@query()
def container_order(f):
    return reports.container_order(f.container)


@query("part")
def backup_first(f):
    """The order in which a container's instances are restarted."""
    return instances.backup_first_position(facts(f), ["container_id"], ["instance_id"]).select(
        "container_id", "instance_id", "is_backup", "position")


@query()
def zone_group_check(f):
    """Zones of each container as a checked zone group."""
    return f.container.select("container_id", F.array_join(rebalance.validated_zone_group(F.concat("zones", "zones")), ",").alias("zones"))


@query()
def options_without_passwords(f):
    options = F.array(F.concat(F.lit("-Xmx"), "p_size", F.lit("m")), F.concat(
        F.lit("-D"), "p_type", F.when(F.col("p_size") % 2 == 0, ".password=").otherwise(".name="), "p_partkey"))
    return f.table("part").select("p_partkey", F.array_join(X.without_passwords(options), " ").alias("options"))


@query()
def instance_locations(f):
    located = instances.with_location(facts(f), f.container)
    return located.groupBy("pu", "host").agg(
        F.count("*").alias("n"), F.min("addr").alias("addr"), F.max(F.array_join("zones", ",")).alias("last_zones"))


@query()
def filter_zones(f):
    kept = f.container.where(P.in_zones(F.col("zones"), ["RACK_1", "LARGE_HEAP"], ["ASIA"]))
    return kept.select("container_id", joined("zones"))


@query()
def filter_zones_empty_list(f):
    return f.container.where(P.in_zones(F.col("zones"), [])).select("container_id")


@query()
def filter_machines(f):
    kept = f.container.where(
        P.on_machines(F.col("host"), F.col("addr"), ["NATION_1", "NATION_2", "10.3.0.3", "10.1.0.6"], ["10.2.0.2"]))
    return kept.select("container_id", "host", "addr")


@query("part")
def filter_pu_semi(f):
    return containers.running_any(f.container, f.instance, ["PU_1", "PU_2"]).select("container_id", "host")


@query("part")
def filter_pu_anti(f):
    return containers.running_none(f.container, f.instance, ["PU_1", "PU_2"]).select("container_id", "host")


@query()
def filter_uptime(f):
    kept = f.container.where(P.uptime_between(
        F.col("start_ts"), AS_OF, timedelta(days=28), timedelta(days=30, hours=12)))
    return kept.select("container_id", "start_ts")


@query("part")
def filter_common(f):
    options = ContainerFilter(
        include_zones=["LARGE_HEAP", "RACK_0"], exclude_zones=["AFRICA"], exclude_machines=["NATION_4"],
        exclude_pus=["PU_3"], include_pus=[f"PU_{n}" for n in range(10, 20)], longer_than=timedelta(days=27), as_of=AS_OF)
    return containers.filter_containers(f.container, f.instance, options).select("container_id", "host", joined("zones"))


def _scope_query(name: str, scope: str) -> None:
    def build(f):
        return containers.select_containers(f.container, facts(f), scope).select("container_id", "host")

    build.__name__ = name
    query()(build)


for _name, _scope in {
    "containers_all": "all", "containers_non_empty": "each-non-empty", "containers_empty": "empty-only",
    "containers_backups_only": "stateful-backups-only", "containers_primaries_only": "stateful-primaries-only",
    "containers_stateless_only": "stateless-only",
}.items():
    _scope_query(_name, _scope)


@query()
def restart_scope_with_options(f):
    options = ContainerFilter(include_zones=["LARGE_HEAP"], longer_than=timedelta(days=28), as_of=AS_OF)
    return containers.select_containers(f.container, facts(f), "each-non-empty", options).select("container_id", "host")


@query()
def instances_stateful(f):
    return instances.stateful_instances(f.instance).select("instance_id", "pu", "container_id")


@query()
def instance_roles(f):
    e, ids, s = F.col("embedded"), F.col("embedded_space_ids"), F.col("spaces")
    return f.instance.groupBy("pu").agg(
        F.count_if(P.is_stateless(e, ids)).alias("stateless"),
        F.count_if(P.is_stateful_primary(e, ids, s)).alias("stateful_primary"),
        F.count_if(P.is_stateful_backup(e, ids, s)).alias("stateful_backup"),
        F.count_if(P.has_primary(s)).alias("has_primary"),
        F.count_if(P.in_partition(F.col("partition_id"), 2)).alias("in_partition_2"),
    )


@query()
def instance_spaces(f):
    return instances.spaces_of(f.instance).groupBy("space_id", F.coalesce("mode", F.lit("none")).alias("mode")).agg(
        F.count("*").alias("n"))


# --- counts -----------------------------------------------------------------------

def _zero_filled(f, by_partition=False, **kw):
    snapshot = counts.placement_snapshot(f.pu, f.container, facts(f), by_partition, **kw)
    return snapshot.select("pu", scope_name(), "axis", "key", "potential", "total", "primary", "backup")


def _bounds(f, groups=(), **kw):
    return rebalance.balance_bounds(f.pu, f.container, facts(f), groups, **kw).select(
        "pu", scope_name(), "axis", "role", "min", "max", "min_key", "max_key", "needs_rebalancing")


@query()
def flagship_machine_balance(f):
    """Least and most loaded machine of every PU, and whether the spread needs a move."""
    return _bounds(f, axes=["MACHINE"], roles=["total"]).drop("scope", "axis", "role")


@query()
def count_potential(f):
    return counts.potential_counts(f.pu, f.container)


@query()
def count_by_axis(f):
    return _zero_filled(f)


@query()
def count_by_partition(f):
    return _zero_filled(f, True)


@query()
def count_hide_zeros(f):
    held = counts.held_counts(f.container, facts(f), True)
    return counts.hide_zeros(counts.by_role(held.withColumn("partition_id", scope_name()))).withColumnRenamed("partition_id", "scope")


@query()
def count_remove_zeros(f):
    return counts.remove_zeros(counts.by_role(_zero_filled(f, True))).drop("potential")


@query()
def count_ranges(f):
    """Counts of every partition and PU, free keys as ranges."""
    rows = ranges.count_ranges(f.pu, f.container, facts(f), by_partition=True)
    return rows.select("pu", scope_name(), "axis", "role", "first_key", "last_key", "n_keys", "n")


@query("part")
def tie_ranges(f):
    """Tied keys of every small PU, nearly all of whose keys are free."""
    rows = ranges.tie_ranges(ranges.count_ranges(f.pu, f.container, facts(f)))
    return rows.drop("partition_id")


@query()
def count_retain_zones(f):
    return counts.retain_zones(_zero_filled(f), ["RACK_0", "ASIA"])


@query()
def min_max_keys(f):
    return _bounds(f, [None], by_partition=True)


@query()
def min_max_ties(f):
    return balance.min_max_ties(counts.by_role(_zero_filled(f)), ["pu", "axis", "role"])


@query()
def zone_group_balance(f):
    return _bounds(f, RACKS[:1], axes=(), by_partition=True).drop("axis")


@query()
def snapshot_json(f):
    snapshot = counts.held_counts(f.container, facts(f), True)
    return sinks.snapshot_json(snapshot, with_zeros=False).select("json")


# --- reports ----------------------------------------------------------------------

@query()
def common_zones(f):
    return reports.common_zones(f.container).select("host", "n_containers", joined("common_zones"))


@query()
def specific_zones(f):
    return reports.specific_zones(f.container).select("container_id", joined("specific_zones"))


@query()
def pu_names_per_container(f):
    return reports.pu_names(f.instance)


@query("part")
def instance_label(f):
    return instances.labelled(facts(f)).select("instance_id", "label")


@query()
def container_report(f):
    report = reports.container_report(f.container, facts(f))
    return report.withColumns({"label": F.coalesce("label", F.lit("")), "copies": F.coalesce("copies", F.lit(0))})


@query()
def restart_selection(f):
    """The report a restart shows for the containers it selects."""
    options = ContainerFilter(include_zones=["LARGE_HEAP"], longer_than=timedelta(days=28), as_of=AS_OF)
    report = operations.restart_selection(f.container, facts(f), "each-non-empty", options)["selected"]
    return report.groupBy("container_id").agg(F.count("label").alias("labels"), F.coalesce(F.sum("copies"), F.lit(0)).alias("copies"))


@query()
def containers_per_host(f):
    return reports.containers_per_host(f.container).orderBy("host")


@query()
def agent_report(f):
    return reports.agent_report(f.agent.drop("pid"), f.agent_process).select(
        "host", F.col("required_global_instances")["GSM"].alias("required_managers"), "processes",
        *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("pid", "agent_id")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("service_type", "instantiation_mode")])


@query()
def manager_report(f):
    return reports.manager_report(f.manager)


@query()
def component_type(f):
    return processes.component_types(f.jvm, f.container, f.manager, f.agent).select("host", "pid", "component_type")


@query()
def component_totals(f):
    return reports.component_totals(processes.component_types(f.jvm, f.container, f.manager, f.agent))


@query()
def jvm_report(f):
    report = reports.jvm_report(f.jvm, f.container, f.manager, f.agent, AS_OF)
    return reports.jvm_line(report).orderBy(*reports.JVM_ORDER).select(
        "component_type", "component_rank", "host", "pid", "heap_init_mb", "heap_max_mb",
        seconds("uptime").alias("uptime_seconds"), "description", "line")


@query()
def full_report(f):
    """The four reports one below the other: section, host, pid and text of each line."""
    parts = reports.full_report(f, facts(f), AS_OF)
    parts["jvms"] = reports.jvm_line(parts["jvms"])
    none, empty = F.lit(-1).cast("bigint"), F.lit("")
    texts = {
        "managers": (none, empty),
        "agents": (F.coalesce("pid", none), F.coalesce("service_type", empty)),
        "jvms": (F.col("pid"), F.col("line")),
        "containers": (F.col("pid"), F.coalesce(F.concat("label", F.lit(" x "), F.col("copies").cast("string")), empty)),
    }
    lines = [parts[name].select(F.lit(name).alias("section"), "host", pid.cast("bigint").alias("pid"), text.alias("text"))
             for name, (pid, text) in texts.items()]
    return lines[0].unionByName(lines[1]).unionByName(lines[2]).unionByName(lines[3])


@query()
def jvm_details(f):
    return sinks.jvm_details(reports.jvm_report(f.jvm, f.container, f.manager, f.agent, AS_OF))


@query()
def dump_reports(f):
    rows = reports.dump_reports(f.container, f.instance, ["heap", "thread"], AS_OF)
    return rows.select(
        joined("dumps_types"), "container_id", "host_name", "host_address", "pid", "start_time",
        F.coalesce("pu_name", F.lit("")).alias("pu_name"), F.coalesce("copies", F.lit(0)).alias("copies"))


# --- placement and plans ----------------------------------------------------------

@query()
def container_load(f):
    return placement.container_load(f.container, f.instance).select("container_id", "host", "n_container", "n_machine")


@query()
def best_containers(f):
    return placement.best_containers(f.pu, f.container, f.instance)


@query("part")
def relocation_target(f):
    targets = relocation.relocation_targets(f.pu, f.container, facts(f), same="region")
    return targets.withColumns({c: F.coalesce(c, F.lit("")) for c in ("target_id", "problem")})


@query()
def candidate_counts(f):
    return placement.candidate_counts(f.pu, f.container, f.instance)


@query()
def rebalance_checks(f):
    checks = rebalance.rebalance_checks(f.pu, f.container, facts(f), RACKS)
    return checks.select(
        "pu", scope_name(), "role", "axis", F.coalesce("zone_group", F.lit(-1)).alias("zone_group"), "min", "max",
        "min_key", "max_key", "needs_rebalancing")


def _named_step(step: DataFrame) -> DataFrame:
    text = ("instance_id", "from_container", "to_key", "target_id", "problem")
    return step.select(
        "pu", scope_name(), "role", "axis", F.coalesce("zone_group", F.lit(-1)).alias("zone_group"), "action", "from_key",
        "min", "max", *[F.coalesce(c, F.lit("")).alias(c) for c in text],
        F.coalesce("demote_first", F.lit(False)).alias("demote_first"))


@query("part")
def rebalance_step(f):
    return _named_step(rebalance.rebalance_plan(f.pu, f.container, facts(f), RACK_PAIR))


@query()
def rebalance_large(f):
    """Few large PUs, whose partitions have instances nearly everywhere: often none may move."""
    return _named_step(rebalance.rebalance_plan(f.pu, f.container, facts(f), RACK_PAIR))


@query("part")
def rebalance_one_machine(f):
    """All containers on one machine and no zone group with a zone: container checks decide."""
    one = f.container.withColumn("host", F.lit("HOST"))
    return _named_step(rebalance.rebalance_plan(f.pu, one, facts(f), [["NO_ZONE"]]))


@query("part")
def host_drain(f):
    plan = relocation.host_drain(f.pu, f.container, f.machine, facts(f), DRAINED, shared=False)
    return plan.withColumns({c: F.coalesce(c, F.lit("")) for c in ("target_id", "problem")})


@query("part")
def drain_status_after(f):
    """A second pass: what is left on the hosts when the first plan has been carried out."""
    held = facts(f)
    plan = relocation.host_drain(f.pu, f.container, f.machine, held, DRAINED, shared=True)
    return relocation.drain_status(f.machine, f.container, relocation.moved(held, plan), DRAINED, 2)


@query("part")
def host_drain_shared(f):
    """What a drain leaves in the containers it may use, checked against the levels of their classes."""
    rows = relocation.drain_levels(f.pu, f.container, f.machine, facts(f), DRAINED)
    low = F.greatest("n_before", "level")
    per_class = rows.groupBy("class").agg(
        F.sum(F.col("n_after") - low).alias("class_extras"), F.sum(F.col("n_after") - F.col("n_before")).alias("class_movers"))
    high = low + ((F.col("class_extras") > 0) & (F.col("n_before") <= F.col("level"))).cast("bigint")
    return rows.join(per_class, "class").select(
        "container_id", "n_before", low.alias("low"), high.alias("high"), "class_extras", "class_movers",
        F.col("n_after").between(low, high).alias("fits"))


@query()
def drain_status(f):
    return relocation.drain_status(f.machine, f.container, facts(f), DRAINED, 1)


@query()
def demote_plan(f):
    selected = containers.stateful_primaries_only(f.container, facts(f))
    return relocation.demote_plan(f.instance, selected)


@query()
def demote_counts(f):
    return relocation.demote_counts(relocation.demote_plan(f.instance, f.container)).groupBy("container_id").agg(
        F.sum("demoted").alias("demoted"))


@query()
def bad_services(f):
    return processes.bad_services(f.agent_process, f.jvm, f.container, f.manager, f.agent)


@query()
def bad_service_actions(f):
    actions = processes.bad_service_actions(f.agent_process, f.jvm, f.container, f.manager, f.agent)
    return actions.select(
        "host", "pid", F.coalesce("container_id", F.lit("")).alias("container_id"),
        F.coalesce("agent_id", F.lit(-1)).alias("agent_id"), "action")


def _history(f, name: str) -> DataFrame:
    """A history of the fleet as a snapshot folder."""
    folder = _scratch(f, name)
    rows = getattr(f, name)
    snapshots.add_snapshots(rows, folder)
    return snapshots.read_snapshots(f.spark, folder, rows.schema)


@query()
def bad_services_over_time(f):
    """Services that were bad early in January: known as containers since, killed by their agent, or left to be stopped by hand."""
    held, seen = _history(f, "container_history"), _history(f, "process_history")
    before, now = (snapshots.known_at(held, moment) for moment in (EARLY, AS_OF))
    actions = processes.bad_service_actions(
        snapshots.known_at(seen, AS_OF).select("host", "pid", "agent_id"), f.jvm, before, f.manager, f.agent, now)
    return actions.select(
        "host", "pid", F.coalesce("container_id", F.lit("")).alias("container_id"),
        F.coalesce("agent_id", F.lit(-1)).alias("agent_id"), "action")


@query()
def containers_known(f):
    """Containers of each cluster's last snapshot in early January."""
    return snapshots.known_at(_history(f, "container_history"), EARLY).select("cluster", "snapshot", "container_id", "host", "pid")


@query()
def process_containers(f):
    found = processes.containers_of(f.agent_process.select("host", "pid", "agent_id"), f.container, f.agent)
    return found.withColumn("container_id", F.coalesce("container_id", F.lit("")))


@query()
def kill_requests(f):
    by_name = f.agent_process.select("host", "agent_id")
    by_addr = f.agent_process.join(f.machine, "host").select(F.col("addr").alias("host"), "agent_id")
    nowhere = f.table("region").select(F.col("r_name").alias("host"), F.lit(1).cast("bigint").alias("agent_id"))
    found = processes.kill_requests(by_name.unionByName(by_addr).unionByName(nowhere), f.agent, f.machine)
    return found.withColumns({c: F.coalesce(c, F.lit("")) for c in ("agent_host", "problem")})


@query()
def agent_shutdown_order(f):
    return operations.agent_shutdown_order(f.agent.select("host"), f.manager, f.machine, exclude=["NATION_3"])


@query()
def deploy_scope(f):
    return operations.deploy_scope(f.pu, exclude=["Brand#3", "Brand#4"]).select("pu", "skipped")


@query()
def manager_selection(f):
    return operations.manager_selection(f.manager, f.machine, exclude=["10.1.0.1"]).select("host", "pid")


@query()
def rolling_schedule(f):
    selected = containers.select_containers(f.container, facts(f), "each-non-empty").select("container_id", "host")
    plan = schedule.rolling_schedule(selected, ["container_id"])
    return plan.select("container_id", "position", seconds("starts_after").alias("starts_after_seconds"))


@query()
def parallel_waves(f):
    return schedule.parallel_waves(f.jvm.select("host", "pid"), ["host", "pid"])


# --- configuration ----------------------------------------------------------------

@query()
def effective_config(f):
    return layers.effective_config(f.layer)


@query()
def shown_config(f):
    return layers.shown_config(f.layer.withColumn("is_secret", F.col("layer").isin(2, 4)))


@query()
def merged_size(f):
    return layers.merged_size(f.layer)


@query()
def merged_entries(f):
    return layers.merged_entries(f.layer)


@query()
def zone_limits_parse(f):
    text = F.concat(
        "p_brand", F.lit("/"), "p_size", F.lit(", "), "p_type", F.lit(" / "), F.col("p_size") + 1, F.lit(",bare,"),
        "p_brand", F.lit("/"), F.col("p_size") + 2, F.lit(" ,"))
    limits = F.explode(X.parse_zone_limits(text)).alias("zone", "max_instances")
    return f.table("part").select("p_partkey", limits)


@query()
def zone_limits_format(f):
    limits = F.create_map("p_type", F.col("p_size"), "p_brand", F.col("p_size") + 1)
    return f.table("part").select(
        "p_partkey", X.format_zone_limits(limits).alias("zone_first"),
        X.format_zone_limits(limits, count_first=True).alias("count_first"))


@query()
def duration_parse(f):
    text = F.concat(
        F.lit("P"), "l_linenumber", F.lit("DT"), F.col("l_quantity").cast("int"), F.lit("H"), F.col("l_suppkey") % 60,
        F.lit("M"), F.col("l_partkey") % 60, F.lit(".25S"))
    return f.table("lineitem").groupBy("l_linenumber").agg(F.sum(X.duration_micros(text)).alias("micros"))


@query()
def jvm_args_filter(f):
    text = F.concat(
        F.lit(PLACEHOLDER + " -Xmx"), F.col("pid"), F.lit("m  -Dzones="), F.array_join("zones", ","), F.lit(" -Dhost="), "host")
    return f.container.select("container_id", X.filter_jvm_args(text, PLACEHOLDER).alias("jvm_args"))


@query()
def xml_environment(f):
    body = F.concat(
        F.lit("<environment>-Xmx"), F.col("pid"), F.lit("m &amp; -Dhost="), "host", F.lit("</environment>"))
    xml = F.concat(
        F.lit("<process><script>"), F.when(F.col("heap_mb") >= 0, body).otherwise(F.lit("<other/>")),
        F.lit("</script></process>"))
    return f.container.select("container_id", files.xml_text(xml).alias("environment"))


@query()
def properties_read(f):
    text = F.concat(
        F.lit("# written for "), "c_name", F.lit(" \\\nname="), "c_name", F.lit("\nsegment : "), "c_mktsegment",
        F.lit("\n\n! more\n  nation\\ key "), "c_nationkey", F.lit("\r\nsegment=\\\n   "), "c_mktsegment", F.lit("\\u0041"))
    return files.parse_properties(f.table("customer").select("c_custkey", text.alias("text")))


def _descriptor_files(f) -> DataFrame:
    """A descriptor text per part: every third size has no topology, every fourth an unknown field."""
    size = F.col("p_size")
    json = F.to_json(F.struct(
        F.col("p_name").alias("name"), F.concat("p_brand", F.lit(".jar")).alias("resource"),
        F.when(size % 3 != 0, F.struct(
            F.lit("partitioned").alias("schema"), size.alias("instances"),
            F.when(size % 2 == 0, size + 100).alias("partitions"))).alias("topology"),
        F.struct(F.array("p_type").alias("zones"), size.alias("maxInstancesPerVM"),
                 F.concat("p_type", F.lit("/"), size).alias("maxInstancesPerZone")).alias("sla"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("contextProperties"),
        F.when(size % 4 == 0, F.lit(1)).alias("surprise"),
    ))
    return f.table("part").select(F.concat(F.lit("PU_"), "p_partkey").alias("pu"), json.alias("text"))


@query()
def descriptor_read(f):
    parsed = files.parse_descriptors(_descriptor_files(f), strict=False)
    d = F.col("descriptor")
    return parsed.select(
        "pu", F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce(d["name"], F.lit("")).alias("name"),
        F.coalesce(d["topology"]["partitions"], F.lit(-1)).alias("partitions"),
        F.coalesce(d["sla"]["maxInstancesPerZone"], F.lit("")).alias("max_per_zone"))


@query("part")
def descriptor_of_pu(f):
    """Every PU with its descriptor; a third of the parts has no file."""
    found = files.parse_descriptors(_descriptor_files(f), strict=False).join(
        f.table("part").where("p_size % 3 <> 1").select(F.concat(F.lit("PU_"), "p_partkey").alias("pu")), "pu", "left_semi")
    return files.descriptors_of(f.pu.select("pu"), found.select("pu", "descriptor", "context", "problem")).select(
        "pu", F.coalesce("descriptor.name", F.lit("")).alias("name"), F.coalesce("problem", F.lit("")).alias("problem"))


@query()
def descriptor_types(f):
    """Texts whose fields hold other types: three are refused, three are read all the same."""
    size, case = F.col("p_size"), F.col("p_size") % 7
    json = F.when(case == 0, F.concat(F.lit('{"topology":{"instances":"'), "p_type", F.lit('"}}'))).when(
        case == 1, F.concat(F.lit('{"topology":'), size, F.lit("}"))).when(
        case == 2, F.concat(F.lit("["), size, F.lit("]"))).when(
        case == 3, F.concat(F.lit('{"sla":{"zones":"'), "p_type", F.lit('"}}'))).when(
        case == 4, F.concat(F.lit('{"topology":{"instances":"'), size, F.lit('"}}'))).when(
        case == 5, F.concat(F.lit('{"sla":{"maxInstancesPerVM":'), size, F.lit(".5}}"))).otherwise(
        F.concat(F.lit('{"name":'), size, F.lit("}")))
    parsed = files.parse_descriptors(f.table("part").select("p_partkey", json.alias("text")), strict=False)
    d = F.col("descriptor")
    return parsed.select(
        "p_partkey", F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce(d["name"], F.lit("")).alias("name"),
        F.coalesce(d["topology"]["instances"], F.lit(-1)).alias("instances"),
        F.coalesce(d["sla"]["maxInstancesPerVM"], F.lit(-1)).alias("max_per_vm"))


@query()
def descriptor_round_trip(f):
    """Descriptors written with their context properties and read back."""
    parsed = files.parse_descriptors(_descriptor_files(f), strict=False).where("descriptor IS NOT NULL")
    texts = parsed.select("pu", files.descriptor_json(F.col("descriptor"), F.col("context")).alias("text"))
    d = F.col("descriptor")
    return files.parse_descriptors(texts).select(
        "pu", d["name"].alias("name"), F.coalesce(d["topology"]["partitions"], F.lit(-1)).alias("partitions"),
        F.array_join(d["sla"]["zones"], ",").alias("zones"), d["sla"]["maxInstancesPerVM"].alias("max_per_vm"),
        F.array_join(F.transform("context", lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("context"))


@query()
def descriptor_context(f):
    return files.descriptor_layers(files.parse_descriptors(_descriptor_files(f), strict=False))


def _deployment_files(f) -> str:
    """Configuration files of every brand, written from the parts: some are missing, blank or damaged."""
    number = F.regexp_extract("p_brand", r"(\d+)$", 1)
    part = f.table("part").withColumn("number", number.cast("int")).withColumn("directory", F.concat(F.lit("brand_"), "number"))

    def listed(prefix: str, column: str, value: Column) -> DataFrame:
        """A properties text per brand; its lines are as many as the column has values."""
        lines = part.groupBy("directory", "number", column).agg(value.alias("v")).select(
            "directory", "number", F.concat(F.lit(prefix), column, F.lit(" = "), "v").alias("line"))
        return lines.groupBy("directory", "number").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))

    n = F.col("number")
    per_brand = part.groupBy("directory", "number").agg(F.count("*").alias("n"))
    good = F.to_json(F.struct(F.col("directory").alias("name"), F.struct(
        F.col("n").alias("size.1"), F.concat(F.lit("x "), n).alias("extra")).alias("contextProperties")))
    shared = listed("size.", "p_size", F.max("p_partkey")).select("directory", F.lit("shared-public.properties").alias("file_name"), "text")
    secret = listed("pw.", "p_type", F.count("*")).where(n % 5 != 0).select(
        "directory", F.lit("shared-secrets.properties").alias("file_name"), F.when(n % 5 == 1, "").otherwise(F.col("text")).alias("text"))
    descriptor = per_brand.where(n % 4 != 0).select(
        "directory", F.concat("directory", F.lit(".json")).alias("file_name"),
        F.when(n % 4 == 1, F.substring(good, 1, 20)).when(n % 4 == 2, F.regexp_replace(good, "^.", '{"surprise":1,')).otherwise(good).alias("text"))
    process = per_brand.select(
        "directory", F.lit("process.xml").alias("file_name"),
        F.concat(F.lit("<process><script><environment>-Xmx"), "n", F.lit(f"m {PLACEHOLDER} -Dbrand="), n, F.lit(
            "</environment></script></process>")).alias("text"))
    folder = _scratch(f, "deployment")
    sinks.write_texts(shared.union(secret).union(descriptor).union(process), folder)
    return folder


@query()
def deployment_files(f):
    """Descriptor and process file of every brand, read from its directory."""
    folder = _deployment_files(f)
    brand = f.table("part").select(F.concat(F.lit("brand_"), F.regexp_extract("p_brand", r"(\d+)$", 1)).alias("pu")).distinct()
    found = files.descriptors_of(brand, files.read_descriptors(f.spark, folder, strict=False))
    process = files.read_process_files(f.spark, folder, PLACEHOLDER).select(
        F.regexp_extract("directory", "([^/]+)$", 1).alias("pu"), "environment", "jvm_args")
    return found.join(process, "pu").select(
        "pu", F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce("descriptor.name", F.lit("")).alias("name"), "environment", "jvm_args")


@query()
def deployment_config(f):
    """What is configured for every brand from its five layers, files among them."""
    folder = _deployment_files(f)
    part = f.table("part").select(F.concat(F.lit("brand_"), F.regexp_extract("p_brand", r"(\d+)$", 1)).alias("pu"))
    sizes = part.groupBy("pu").agg(F.count("*").cast("string").alias("value"))
    original = sizes.select("pu", F.lit("origin").alias("key"), "value").union(sizes.select("pu", F.lit("size.1"), F.lit("0")))
    shared = files.read_shared_properties(f.spark, folder).withColumn("directory", F.regexp_extract("directory", "([^/]+)$", 1))
    entries = files.descriptor_layers(files.read_descriptors(f.spark, folder, strict=False))
    places = sizes.select("pu", F.col("pu").alias("directory"))
    return layers.shown_config(config.config_layers(places, original, shared, entries))


@query("part")
def deployed_settings(f):
    base = f.pu.select(
        "pu", F.lit("default").alias("cluster_schema"), F.col("planned").cast("int").alias("instances"),
        F.lit(1).alias("backups"), "requires_isolation", F.lit(9).alias("max_per_vm"), F.lit(8).alias("max_per_machine"),
        F.col("required_zones").alias("zones"), F.lit(None).cast("map<string,int>").alias("zone_limits"))
    found = files.parse_descriptors(_descriptor_files(f), strict=False)
    settings = config.overlaid_settings(base, found)
    return settings.select(
        "pu", "cluster_schema", "instances", F.coalesce("backups", F.lit(-1)).alias("backups"),
        F.coalesce("max_per_vm", F.lit(-1)).alias("max_per_vm"), joined("zones"),
        F.coalesce(X.format_zone_limits(F.col("zone_limits")), F.lit("")).alias("zone_limits"), "resource")


@query()
def descriptor_of_settings(f):
    part = f.table("part")
    settings = part.select(
        F.col("p_name").alias("pu"), F.when(F.col("p_size") % 2 == 0, F.lit("partitioned")).alias("cluster_schema"),
        F.col("p_size").alias("instances"), F.lit(None).cast("int").alias("backups"),
        F.lit(None).cast("boolean").alias("requires_isolation"), F.lit(None).cast("int").alias("max_per_vm"),
        F.when(F.col("p_size") > 25, F.col("p_size")).alias("max_per_machine"),
        F.array().cast("array<string>").alias("zones"), F.create_map("p_type", "p_size").alias("zone_limits"),
        F.col("p_brand").alias("resource"))
    d = config.descriptor_of(settings).select(F.to_json("descriptor").alias("json"))
    return d.groupBy("json").agg(F.count("*").alias("n"))


# --- streams and their batch twins --------------------------------------------------

def _scratch(f, name: str) -> str:
    return f"{application_folder(f.spark)}/{name}-{uuid.uuid4().hex}"


class _Streamed(Fleet):
    """The same fleet with its timed tables read as streams."""

    def table(self, name: str) -> DataFrame:
        rows = super().table(name)
        # a pattern, because a stream source takes a file for a folder
        return (self.spark.readStream.schema(rows.schema).parquet(f"{self.folder}/{name[:-1]}[{name[-1]}].parquet")
                if name in ("events", "lineitem") else rows)


def _streamed(f) -> Fleet:
    return _Streamed(f.spark, f.folder, f.pu_level)


def _planned(f) -> DataFrame:
    return f.readiness.select("app", "pu").distinct().withColumn("planned", F.lit(PLANNED))


def _verdicts(df: DataFrame) -> DataFrame:
    return df.select("app", "pu", "planned", "running", "status", F.coalesce(
        F.date_format("done_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")).alias("done_ts"))


@query()
def readiness_batch(f):
    return _verdicts(readiness.readiness_batch(f.readiness, _planned(f), TIMEOUT))


@query()
def application_outcome(f):
    """Verdict of every application; its PUs are awaited from the last name to the first."""
    planned = _planned(f)
    declared = planned.select("app", "pu", F.row_number().over(
        Window.partitionBy("app").orderBy(F.col("pu").desc())).alias("place")).selectExpr("app", "pu", "place - 1 AS ordinal")
    judged = readiness.readiness_batch(f.readiness, planned, TIMEOUT)
    return readiness.outcomes(judged, declared).withColumns({
        "failed_pu": F.coalesce("failed_pu", F.lit("")),
        "done_ts": F.coalesce(F.date_format("done_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))})


@query()
def readiness_progress(f):
    return readiness.progress(f.readiness, "1 day")


@query()
def readiness_stream(f):
    planned = _planned(f)
    rows = source.drained(
        _streamed(f).readiness, lambda events: readiness.readiness_stream(events, planned, TIMEOUT), _scratch(f, "readiness"))
    return _verdicts(rows.where("closing"))


@query()
def imbalance_windowed(f):
    return windows.imbalance(windows.key_counts(f.observation, "1 day"))


@query()
def imbalance_stream(f):
    return source.drained(
        _streamed(f).observation, lambda rows: windows.window_imbalance(rows, "1 day", "2 hours"), _scratch(f, "imbalance"))


@query()
def placement_windowed(f):
    return windows.placement_imbalance(f.sighting, f.pu, f.container, "90 days")


@query()
def placement_stream(f):
    return source.drained(
        _streamed(f).sighting, lambda rows: windows.placement_imbalance(rows, f.pu, f.container, "90 days", "30 days"),
        _scratch(f, "placement"))


@query()
def manager_presence(f):
    return windows.manager_presence(f.heartbeat, "10 minutes")


@query()
def manager_presence_stream(f):
    return source.drained(
        _streamed(f).heartbeat, lambda rows: windows.manager_presence(rows, "10 minutes", "1 hour"), _scratch(f, "presence"))


@query()
def discovery_outcome(f):
    return windows.discovery_outcome(windows.manager_presence(f.heartbeat, "10 minutes"))
