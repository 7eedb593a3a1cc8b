import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import containers as C
from fleetlens.operators import layers, ordering, processes, reports
from fleetlens.operators.instances import backup_first
from fleetlens.operators.placement import best_containers, eligible_containers
from fleetlens.plans import operations, relocation, schedule
from fleetlens.sources import inventory, sinks

AS_OF = datetime(2024, 2, 1)
FACTS = ("instance_id string, pu string, partition_id int, container_id string, is_stateful boolean,"
         " is_primary boolean, is_backup boolean")


def test_uptime_filter(spark):
    minutes = timedelta(minutes=1)
    cases = [
        (timedelta(minutes=5, seconds=1), 5 * minutes, 10 * minutes, True),
        (timedelta(hours=24, seconds=5), timedelta(days=1), None, True),
        (timedelta(hours=23, seconds=5), timedelta(days=1), None, False),
        (timedelta(hours=24, seconds=5), None, timedelta(days=2), True),
        (timedelta(hours=49, seconds=5), None, timedelta(days=2), False),
        (timedelta(hours=24, seconds=5), None, None, True),
        (5 * minutes, 5 * minutes, None, False),
    ]
    empty = spark.createDataFrame([], "container_id string, pu string")
    for up, longer, shorter, kept in cases:
        df = spark.createDataFrame([("c", "h", "a", [], AS_OF - up)],
                                   "container_id string, host string, addr string, zones array<string>, start_ts timestamp_ntz")
        options = C.ContainerFilter(longer_than=longer, shorter_than=shorter, as_of=AS_OF)
        assert (C.filter_containers(df, empty, options).count() == 1) is kept
    with pytest.raises(ValueError):
        C.filter_containers(df, empty, C.ContainerFilter(longer_than=minutes))


def test_backup_first_order(spark):
    for flags, order in [([0, 1], [2, 1]), ([1, 0], [1, 2]), ([1, 1], [1, 2]), ([0, 0], [1, 2]), ([0, 0, 1, 1], [3, 4, 1, 2])]:
        rows = [(n, bool(b)) for n, b in enumerate(flags, 1)]
        df = spark.createDataFrame(rows, "input_order int, is_backup boolean")
        assert [r.input_order for r in backup_first(df).collect()] == order


@pytest.fixture
def many_ranges(spark):
    """Keeps small ranges apart, so that several tasks take part."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_positions_and_running_sums_with_a_hot_group(spark, many_ranges):
    rng = random.Random(7)
    rows = [("hot" if n % 3 else f"g{n % 5}", rng.random(), n, rng.choice([-1, 1])) for n in range(3000)]
    df = spark.createDataFrame(rows, "g string, t double, n int, d int").repartition(7)
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    got = {r.n: r.ordinal for r in ordering.with_ordinal(df, ["t", "n"]).collect()}
    assert got == {r[2]: i for i, r in enumerate(ordered)}

    inside, total, place, sums = {}, {}, {}, {}
    for g, _, n, d in ordered:
        place[n] = inside[g] = inside.get(g, -1) + 1
        sums[n] = total[g] = total.get(g, 0) + d
    assert {r.n: r.ordinal for r in ordering.ordinal_within(df, ["g"], ["t", "n"]).collect()} == place
    assert {r.n: r.s for r in ordering.running_sum(df, ["g"], ["t", "n"], "d", "s").collect()} == sums
    # the hot group must not end in one task
    ranges = ordering._ranged(df, ["g", "t", "n"]).where("g = 'hot'").select("_range").distinct().count()
    assert ranges > 1


def test_schedules(spark):
    df = spark.range(70).select(F.format_string("c%03d", "id").alias("c"))
    rolling = schedule.rolling_schedule(df, ["c"], schedule.AGENT_INTERVAL).orderBy("c").collect()
    assert rolling[0].starts_after == timedelta(0) and rolling[69].starts_after == timedelta(seconds=345)
    waves = [r.wave for r in schedule.parallel_waves(df, ["c"]).orderBy("c").collect()]
    assert waves == [n // 32 for n in range(70)]
    assert schedule.parallel_waves(df.where("false"), ["c"]).count() == 0


def test_layers(spark):
    def merged(*maps):
        rows = [("e", i, k, v) for i, m in enumerate(maps) for k, v in (m or {None: None}).items()]
        return spark.createDataFrame(rows, "entity string, layer int, key string, value string")

    def effective(df):
        return {r.key: r.value for r in layers.effective_config(df).collect()}

    empty = merged({}, {})
    assert effective(empty) == {} and layers.merged_size(empty).first()[1:] == (0, True)
    assert effective(merged({"p1": "v1"}, {"p2": "v2"})) == {"p1": "v1", "p2": "v2"}
    overlap = merged({"p": "v1"}, {"p": "v2"})
    assert effective(overlap) == {"p": "v2"} and layers.merged_size(overlap).first()["size"] == 2
    assert layers.merged_entries(overlap).count() == 2 and layers.merged_values(overlap).count() == 2
    assert effective(merged({"a": "1"}, {"a": "2"}, {"a": "1"})) == {"a": "2"}
    secret = merged({"a": "1"}, {"b": "x"}).withColumn("is_secret", F.col("layer") == 1)
    assert {r.key: r.value for r in layers.shown_config(secret).collect()} == {"a": "1", "b": "****"}


def small_fleet(spark):
    container = spark.createDataFrame(
        [("c1", "h1", "10.1", ["A", "X"], 1), ("c2", "h1", "10.1", ["A"], 2), ("c3", "h2", "10.2", ["B", "A"], 3), ("c4", "h3", "10.3", [], 4)],
        "container_id string, host string, addr string, zones array<string>, pid bigint")
    pu = spark.createDataFrame([("any", 2, [], False), ("a", 1, ["A", "Q"], True), ("q", 1, ["Q"], False)],
                               "pu string, planned int, required_zones array<string>, requires_isolation boolean")
    facts = spark.createDataFrame(
        [("i1", "any", 0, "c1", True, True, False), ("i2", "any", 0, "c3", True, False, True), ("i3", "a", 0, "c1", False, False, False),
         ("i4", "q", 0, "c4", False, False, False)], FACTS)
    machine = container.select("host", "addr").distinct()
    return pu, container, facts, machine


def test_eligibility_and_targets(spark):
    pu, container, facts, machine = small_fleet(spark)
    pairs = {(tuple(r.required_zones), r.container_id) for r in eligible_containers(pu, container).collect()}
    assert pairs == {((), "c1"), ((), "c2"), ((), "c3"), ((), "c4"), (("A", "Q"), "c1"), (("A", "Q"), "c2"), (("A", "Q"), "c3")}
    best = [(r.rank, r.container_id) for r in best_containers(pu, container, facts).where("pu = 'any'").orderBy("rank").collect()]
    assert best == [(1, "c2"), (2, "c3"), (3, "c4"), (4, "c1")]
    targets = {r.instance_id: (r.target_id, r.origin_empty, r.problem) for r in relocation.relocation_targets(pu, container, facts).collect()}
    assert targets == {"i1": ("c2", False, None), "i2": ("c2", True, None), "i3": ("c2", False, None),
                       "i4": (None, True, relocation.NO_TARGET)}


def test_host_drain(spark):
    pu, container, facts, machine = small_fleet(spark)
    plan = {r.instance_id: r.target_id for r in relocation.host_drain(pu, container, machine, facts, ["10.1"]).collect()}
    assert plan == {"i1": "c3", "i3": "c3"}
    with pytest.raises(Exception, match="every machine"):
        relocation.host_drain(pu, container, machine, facts, ["h1", "h2", "10.3"]).collect()
    status = relocation.drain_status(machine, container, facts, ["h1"], 3).first()
    assert (status.remaining, status.agent_may_stop, status.next_round) == (2, False, False)
    assert relocation.drain_status(machine, container, facts, ["h1"], 1, skip_relocate=True).first().agent_may_stop
    assert relocation.drain_status(machine, container, facts.where("container_id <> 'c1'"), ["h1"], 1).first().agent_may_stop


def test_drain_fills_evenly(spark):
    container = spark.createDataFrame([("from", "h0", "10.0", ["A"], 1), *[(f"c{n}", f"h{n}", f"10.{n}", ["A"], 1) for n in (0, 2, 5)]],
                                      "container_id string, host string, addr string, zones array<string>, pid bigint")
    container = container.withColumn("host", F.when(F.col("container_id") == "from", "old").otherwise(F.col("host")))
    pu = spark.createDataFrame([("a", 9, ["A"], False), ("none", 9, ["Z"], False)],
                               "pu string, planned int, required_zones array<string>, requires_isolation boolean")
    held = ["from"] * 7 + ["c2"] * 2 + ["c5"] * 5
    facts = spark.createDataFrame([(f"i{k:02}", "none" if k == 3 else "a", 0, c, False, False, False) for k, c in enumerate(held)], FACTS)
    machine = container.select("host", "addr").distinct()
    plan = relocation.host_drain(pu, container, machine, facts, ["old"]).collect()
    assert sorted(r.instance_id for r in plan) == [f"i{k:02}" for k in range(7)]
    assert sorted(r.target_id or r.problem for r in plan) == ["c0"] * 4 + ["c2"] * 2 + [relocation.NO_TARGET]
    assert {r.instance_id for r in plan if r.problem} == {"i03"}
    assert relocation.host_drain(pu, container, machine, facts.limit(0), ["old"]).count() == 0


def test_restart_selection_and_scopes(spark):
    pu, container, facts, machine = small_fleet(spark)
    ids = {s: {r.container_id for r in C.select_containers(container, facts, s).collect()} for s in C.SCOPES}
    assert ids == {"all": {"c1", "c2", "c3", "c4"}, "each-non-empty": {"c1", "c3", "c4"}, "empty-only": {"c2"},
                   "stateful-backups-only": {"c3"}, "stateful-primaries-only": {"c1"}, "stateless-only": {"c4"}}
    both = operations.restart_selection(container, facts, "stateless-only")
    assert both["selected"].count() == 1 and both["all"].count() == 5
    scope = {r.pu: r.skipped for r in operations.deploy_scope(pu, include=["a"]).collect()}
    assert scope == {"any": True, "a": False, "q": True}
    assert not any(r.skipped for r in operations.deploy_scope(pu, include=["a"], whole=True).collect())


def test_reports(spark):
    pu, container, facts, machine = small_fleet(spark)
    rows = reports.container_report(container, facts).orderBy(*reports.REPORT_ORDER).collect()
    assert [(r.host, r.common_zones, r.specific_zones, r.pid, r.label) for r in rows][:3] == [
        ("h1", "A", "[X]", 1, "a"), ("h1", "A", "[X]", 1, "any (#1P)"), ("h1", "A", "[]", 2, None)]
    assert reports.containers_per_host(container).where("host = 'h1'").first().n_containers == 2


def test_bad_services_restart_when_a_later_snapshot_knows_the_container(spark):
    p = lambda *rows: spark.createDataFrame(list(rows), "host string, pid bigint")
    jvm, agent = p(("h", 1), ("h", 2), ("h", 3), ("h", 10)), p(("h", 10))
    container = p(("h", 1)).withColumn("container_id", F.lit("c1"))
    later = p(("h", 1), ("h", 2)).withColumn("container_id", F.concat(F.lit("c"), "pid"))
    process = spark.createDataFrame([("h", 2, 7), ("h", 3, 8), ("h", 4, 9)], "host string, pid bigint, agent_id bigint")
    manager = jvm.where("false")
    got = {r.pid: (r.action, r.container_id, r.agent_id) for r in processes.bad_service_actions(
        process, jvm, container, manager, agent, later).collect()}
    assert got == {2: ("restart", "c2", 7), 3: ("kill", None, 8), 4: ("kill", None, 9)}


def test_scans(spark, tmp_path):
    _, container, _, _ = small_fleet(spark)
    container.write.parquet(str(tmp_path / "container"))
    inv = inventory.Inventory(spark, str(tmp_path))
    assert [r.container_id for r in inventory.listing(inv.container, "container").collect()] == ["c1", "c2", "c3", "c4"]
    agents = spark.createDataFrame([("h1", [(1, 5)]), ("h2", [])], "host string, processes array<struct<agent_id:int,pid:int>>")
    assert [tuple(r) for r in inventory.flatten_processes(agents).collect()] == [("h1", 1, 5)]
    pu = spark.createDataFrame([("a",)], "pu string")
    assert inventory.require_pu(pu, "a").count() == 1 and inventory.pu_names(pu).columns == ["pu"]
    with pytest.raises(LookupError):
        inventory.require_pu(pu, "b")


def test_sinks(spark, tmp_path):
    _, container, facts, _ = small_fleet(spark)
    report = spark.createDataFrame(
        [("h1", 7, "GSC", 3, 1, 2, timedelta(hours=49, milliseconds=500), "v : n : 1", {"B": "2", "A": "1"}, {})],
        "host string, pid bigint, component_type string, component_rank int, heap_init_mb bigint, heap_max_mb bigint,"
        " uptime interval day to second, description string, env map<string,string>, sysprops map<string,string>")
    sinks.write_jvm_details(report, str(tmp_path / "jvm"))
    rows = [json.loads(x) for f in (tmp_path / "jvm").glob("*.json") for x in f.read_text().splitlines()]
    assert rows == [{"host": "h1", "component_type": "GSC", "pid": 7, "value": (
        "GSC :     7 : running on h1 for PT49H0.5S         : Heap [    1 MB,     2 MB] : v : n : 1\n"
        "JVM Environment Variables : \nA : 1\nB : 2\nJVM System Properties : ")}]
    sinks.write_dump_reports(reports.dump_reports(container, facts, ["heap"], AS_OF), str(tmp_path / "dump"))
    lines = [json.loads(x) for f in (tmp_path / "dump").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 5 and "pu_name" not in next(x for x in lines if x["container_id"] == "c2")
    counts = spark.createDataFrame([("p", 1, "ZONE", "b", 2, 1, 0), ("p", None, "ZONE", "a", 0, 0, 0)],
                                   "pu string, partition_id int, axis string, key string, total int, primary int, backup int")
    for zeros, n in ((True, 2), (False, 1)):
        path = tmp_path / f"snap{zeros}"
        sinks.write_snapshot(counts, str(path), zeros)
        assert sum(len(f.read_text().splitlines()) for f in path.glob("*.txt")) == n


def test_written_tables_can_be_cleared(spark):
    from pathlib import Path

    from fleetlens.session import application_folder, clear_written, written

    assert written(spark.range(3)).count() == 3
    folder = Path(application_folder(spark).removeprefix("file:"))
    assert folder.is_dir()
    clear_written(spark)
    assert not folder.exists()


def test_shared_spread_by_force(spark):
    """Random overlapping requirements: the placed loads, sorted, are the best of all placements, and every mover is placed once."""
    import itertools
    import random

    from fleetlens.plans import spread

    draw = random.Random(4)
    for _ in range(4):
        zone_sets = [f"z{i}" for i in range(3)]
        containers = [(z, f"c{z}{i}", draw.randrange(4), draw.randrange(3)) for z in zone_sets for i in range(draw.randrange(1, 3))]
        owners = {f"o{i}": draw.randrange(1, 4) for i in range(3)}
        allowed = {o: sorted(draw.sample(zone_sets, draw.randrange(1, 4))) for o in owners}
        frames = (
            spark.createDataFrame([*owners.items(), ("nowhere", 5)], "owner string, movers bigint"),
            spark.createDataFrame([(o, z) for o, zs in allowed.items() for z in zs], "owner string, zones string"),
            spark.createDataFrame(containers, "zones string, container_id string, n_container bigint, n_machine bigint"))
        levels, places = spread.shared_spread(*frames)
        rows = places.collect()
        zone_of = {c: z for z, c, _, _ in containers}
        assert all(zone_of[r.container_id] in allowed[r.owner] for r in rows)
        for o, n in owners.items():
            assert sorted(x for r in rows if r.owner == o for x in range(r["from"], r["to"])) == list(range(n))
        loads = {c: n for _, c, n, _ in containers}
        after = dict(loads)
        for r in rows:
            after[r.container_id] += r["to"] - r["from"]
        movers = [o for o, n in owners.items() for _ in range(n)]
        best = None
        for choice in itertools.product(*[[c for c in loads if zone_of[c] in allowed[o]] for o in movers]):
            trial = dict(loads)
            for c in choice:
                trial[c] += 1
            key = sorted(trial.values(), reverse=True)
            best = key if best is None or key < best else best
        assert sorted(after.values(), reverse=True) == best
    empty = spread.shared_spread(frames[0].limit(0), frames[1], frames[2])
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_shared_spread_over_blocks(spark):
    """Many movers, ranges over several blocks of places; owners meet in the middle zone set."""
    from fleetlens.plans import spread

    containers = [(z, f"c{z}{i:03}", (i * 7) % 50, i % 4) for z in "abc" for i in range(40)]
    owners, allowed = {"left": 4000, "right": 900}, {"left": "ab", "right": "bc"}
    levels, places = spread.shared_spread(
        spark.createDataFrame(list(owners.items()), "owner string, movers bigint"),
        spark.createDataFrame([(o, z) for o, zs in allowed.items() for z in zs], "owner string, zones string"),
        spark.createDataFrame(containers, "zones string, container_id string, n_container bigint, n_machine bigint"))
    after = {c: n for _, c, n, _ in containers}
    spans = {o: [] for o in owners}
    for r in places.collect():
        after[r.container_id] += r["to"] - r["from"]
        spans[r.owner].append((r["from"], r["to"]))
    for o, n in owners.items():
        assert sorted(spans[o])[0][0] == 0 and sum(b - a for a, b in spans[o]) == n
        assert all(x[1] == y[0] for x, y in itertools_pairs(sorted(spans[o])))
    by_zone = {z: sorted(after[c] for y, c, _, _ in containers if y == z) for z in "abc"}
    assert {r["class"]: r.level for r in levels.where("owner is null").collect()}.keys() == {0, 1}
    for zones in ("ab", "c"):
        used = [x for z in zones for x in by_zone[z]]
        assert max(used) - min(used) <= 1 or zones == "c"
    assert max(by_zone["c"]) <= min(by_zone["a"])


def itertools_pairs(rows):
    return zip(rows, rows[1:], strict=False)


@pytest.mark.parametrize("by_partition", [False, True])
def test_held_keys_of_ranges(spark, by_partition):
    """The rows of held_counts, where no row per key is moved: slots are."""
    from fleetlens.operators import counts, ranges

    container = spark.createDataFrame(
        [("a", "h1", ["z1", "z2"]), ("b", "h1", ["z2"]), ("c", "h2", None), ("a", "h3", ["z1"])], "container_id string, host string, zones array<string>").coalesce(1)
    facts = spark.createDataFrame(
        [(f"p{n % 50}", None if n == 5 else n % 3, "abcx"[n % 4], n % 7 == 0, n % 7 == 1) for n in range(900)],
        "pu string, partition_id int, container_id string, is_primary boolean, is_backup boolean")
    held = ranges._held(container, facts, by_partition, counts.AXES)
    expected = counts.held_counts(container, facts, by_partition)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert held.columns == expected.columns and order(held.collect()) == order(expected.collect())
    plan = held._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    generate = next(i for i, x in enumerate(plan) if "Generate" in x)
    assert not any("Exchange hashpartitioning" in x for x in plan[:generate])
