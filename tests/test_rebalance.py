import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.balance import min_max, min_max_ties, needs_rebalancing
from fleetlens.operators.instances import instance_facts
from fleetlens.plans import rebalance as R

import brute

CONTAINER = "container_id string, host string, addr string, zones array<string>"
FACTS = ("instance_id string, pu string, partition_id int, container_id string, is_stateful boolean,"
         " is_primary boolean, is_backup boolean")
PU = "pu string, planned int, required_zones array<string>, requires_isolation boolean"


def fleet(spark, containers, instances, pus):
    return (
        spark.createDataFrame([(p, 1, req, False) for p, req in pus.items()], PU),
        spark.createDataFrame([(i, c["host"], "10." + c["host"], c["zones"]) for i, c in containers.items()], CONTAINER),
        spark.createDataFrame(
            [(i["id"], i["pu"], i["partition"], i["container"], True, i["primary"], i["backup"]) for i in instances], FACTS),
    )


def inst(i, pu, partition, container, role=None):
    return {"id": i, "pu": pu, "partition": partition, "container": container, "primary": role == "P", "backup": role == "B"}


def box(host, *zones):
    return {"host": host, "zones": list(zones)}


def test_min_max(spark):
    cases = {
        "different": {"foo": 3, "bar": 7},
        "ties": {"min1": 3, "max1": 7, "max2": 7, "max3": 7, "max4": 7, "min2": 3},
        "equal": {"foo": 3, "bar": 3}, "single": {"foo": 3}, "one apart": {"a": 1, "b": 2},
    }
    rows = [(c, k, n) for c, d in cases.items() for k, n in d.items()]
    counts = spark.createDataFrame(rows, "case string, key string, n bigint")
    got = {r["case"]: (r.min_key, r.max_key, r.needs_rebalancing) for r in min_max(counts, ["case"]).collect()}
    assert got == {"different": ("foo", "bar", True), "ties": ("min1", "max1", True), "equal": ("bar", "bar", False),
                   "single": ("foo", "foo", False), "one apart": ("a", "b", False)}
    ties = min_max_ties(counts, ["case"]).where("case = 'ties'").collect()
    assert sorted((r.bound, r.key) for r in ties) == sorted(
        [("min", "min1"), ("min", "min2"), ("max", "max1"), ("max", "max2"), ("max", "max3"), ("max", "max4")])
    empty = min_max(counts.where("false"), ["case"])
    assert empty.count() == 0
    assert spark.range(1).select(needs_rebalancing(F.lit(None), F.lit(None))).first()[0] is None


SCENARIOS = {
    "nothing": ({}, []),
    "one of each": ({"m1~1": box("m1")}, [inst("i1", "p", 1, "m1~1")]),
    "two on one machine": (
        {"m1~1234": box("m1"), "m1~1235": box("m1"), "m2~3456": box("m2"), "m2~3457": box("m2")},
        [inst("i1", "p", 1, "m1~1234"), inst("i2", "p", 2, "m1~1235")]),
    "two in one container": (
        {"m1~1234": box("m1"), "m1~1235": box("m1")}, [inst("i1", "p", 1, "m1~1234"), inst("i2", "p", 2, "m1~1234")]),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios(spark, name):
    containers, instances = SCENARIOS[name]
    moves = R.rebalance_plan(*fleet(spark, containers, instances, {"p": []})).collect()
    if name in ("nothing", "one of each"):
        assert moves == []
    elif name == "two on one machine":
        assert [(m.axis, m.action, m.instance_id, m.to_key, m.target_id) for m in moves] == [
            ("MACHINE", "relocate", "i1", "m2", "m2~3456")]
    else:
        assert [(m.axis, m.instance_id, m.target_id) for m in moves] == [("CONTAINER", "i1", "m1~1235")]


GROUPS = [["Z0", "Z1"], ["Z2", "Z3", "Z9"], ["X0", "X1"]]


def random_fleet(seed, hot=False):
    """``hot`` puts a third of all instances into one PU and one container."""
    rng = random.Random(seed)
    hosts = [f"h{n}" for n in range(rng.randint(1, 4))]
    zones = ["Z0", "Z1", "Z2", "Z3", "BIG"]
    containers = {
        f"c{n:02}": box(rng.choice(hosts), *rng.sample(zones, rng.randint(0, 3))) for n in range(rng.randint(2, 9))}
    pus = {f"p{n}": rng.sample(zones, rng.choice([0, 0, 1, 2])) for n in range(36)}
    instances = []
    for pu in pus:
        spread = rng.sample(sorted(containers), rng.randint(1, len(containers)))
        for n in range(rng.randint(0, 10)):
            role = rng.choice([None, "P", "B"])
            instances.append(inst(f"{pu}-{n:02}", pu, rng.randrange(rng.choice([1, 3])), rng.choice(spread), role))
    if hot:
        instances += [inst(f"p0-x{n:03}", "p0", n % 3, "c00", rng.choice([None, "P", "B"])) for n in range(len(instances) // 2)]
    return containers, instances, pus


@pytest.mark.parametrize(
    "seed, groups, hot", [(0, [], False), (1, GROUPS, False), (2, GROUPS, True)], ids=["no groups", "groups", "hot"])
def test_step_and_checks_match_brute_force(spark, seed, groups, hot):
    containers, instances, pus = random_fleet(seed, hot)
    pu, container, facts = fleet(spark, containers, instances, pus)
    wanted = [m for p, req in pus.items() if (m := brute.step(p, req, containers, instances, groups))]
    names = list(wanted[0])
    got = [{n: r[n] for n in names} for r in R.rebalance_plan(pu, container, facts, groups).collect()]
    order = lambda m: m["pu"]
    assert sorted(got, key=order) == sorted(wanted, key=order)

    expected = {
        (p, partition, role, axis, group, v["min"], v["max"], v["min_key"], v["max_key"], v["needs"])
        for p, req in pus.items()
        for partition, role, axis, group, _, v in brute.checks(p, req, containers, instances, groups)}
    rows = R.rebalance_checks(pu, container, facts, groups).collect()
    assert len(rows) == len(expected)
    assert {(r.pu, r.partition_id, r.role, r.axis, r.zone_group, r.min, r.max, r.min_key, r.max_key, r.needs_rebalancing)
            for r in rows} == expected


def test_step_limited_to_some_pus(spark):
    containers, instances, pus = random_fleet(1)
    pu, container, facts = fleet(spark, containers, instances, pus)
    every = {r.pu: r for r in R.rebalance_plan(pu, container, facts, GROUPS).collect()}
    some = sorted(every)[:2]
    only = spark.createDataFrame([(p,) for p in some], "pu string")
    assert {r.pu: r for r in R.rebalance_plan(pu, container, facts, GROUPS, only).collect()} == {p: every[p] for p in some}


def test_whole_pu_is_counted_only_where_partitions_balance(spark, monkeypatch):
    containers = {"m1~1": box("m1"), "m1~2": box("m1"), "m2~1": box("m2"), "m2~2": box("m2")}
    instances = [inst("i1", "p", 1, "m1~1"), inst("i2", "p", 1, "m1~2"), inst("j1", "q", 1, "m1~1"), inst("j2", "q", 2, "m1~2")]
    counted, plain = [], R._failed_places

    def watched(held, lanes):
        counted.append(sorted(r.pu for r in held.select("pu").distinct().collect()))
        return plain(held, lanes)

    monkeypatch.setattr(R, "_failed_places", watched)
    moves = R.rebalance_plan(*fleet(spark, containers, instances, {"p": [], "q": []})).collect()
    assert sorted((m.pu, m.partition_id, m.axis, m.instance_id, m.to_key) for m in moves) == [
        ("p", 1, "MACHINE", "i1", "m2"), ("q", None, "MACHINE", "j1", "m2")]
    assert counted == [["p", "q"], ["q"]]


def test_keys_of_slots_match_the_counts_of_the_checks(spark):
    """Also for containers listed twice, slots without a partition and PUs without a row of their own."""
    containers, instances, pus = random_fleet(3)
    instances += [inst("x1", "none", 0, "c00"), inst("x2", "p1", None, "c01"), inst("x3", "p1", 0, None)]
    pu, container, facts = fleet(spark, containers, instances, pus)
    container = container.union(spark.createDataFrame([("c00", "h9", "10.9", ["Z3"]), ("c01", None, None, None)], CONTAINER))
    keys, slots = R._Keys(pu, container, GROUPS), R.slot_counts(facts)
    located, shared = keys.places(container)
    columns = ["pu", "scope", "lane", "key", "offered", "total", "primary", "backup"]
    parts = slots.withColumn("scope", F.col("partition_id").cast("bigint"))
    both = parts.unionByName(slots.withColumn("scope", F.lit(R.WHOLE)))
    got = keys.keyed(keys.placed(both, located), shared)
    expected = keys.held(container, slots)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got.select(columns).collect()) == order(expected.select(columns).collect())
    assert expected.count() > 100


def test_zone_group_validation(spark):
    assert R.zone_groups([["b", "a", "a"]]) == [["a", "b"]]
    assert R.zone_groups([["a", "a"]]) == [["a"]]
    with pytest.raises(ValueError):
        R.zone_groups([["a"]])
    df = spark.createDataFrame([(["b", "a"],)], "z array<string>")
    assert df.select(R.validated_zone_group(F.col("z"))).first()[0] == ["a", "b"]
    with pytest.raises(Exception):
        spark.createDataFrame([(["b"],)], "z array<string>").select(R.validated_zone_group(F.col("z"))).collect()


def test_facts_from_instances(spark):
    df = spark.createDataFrame(
        [("i", "p", 0, "c", True, ["space"], [("space", "PRIMARY"), ("t", "BACKUP")])],
        "instance_id string, pu string, partition_id int, container_id string, embedded boolean,"
        " embedded_space_ids array<string>, spaces array<struct<id:string,mode:string>>")
    r = instance_facts(df).first()
    assert (r.is_stateful, r.is_primary, r.is_backup) == (True, True, True)
