"""Ranges of placement keys against the whole zero-filled snapshot."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import counts, ranges
from fleetlens.operators.instances import instance_facts
from fleetlens.operators.placement import requirement


@pytest.fixture(scope="module")
def fleet(spark):
    """PUs with and without instances, one unknown, one null, keys that are not eligible, a container and a PU twice."""
    zones = [["A"], ["B"], ["A", "B"], None, ["B"], ["A"], ["C"]]
    container = spark.createDataFrame(
        [(f"c{i}", f"h{i % 3}", z) for i, z in enumerate(zones)] + [("c4", "h1", ["B"])],
        "container_id string, host string, zones array<string>")
    pu = spark.createDataFrame([("p", ["A"]), ("q", None), ("r", ["B", "A"]), ("none", ["A"]), ("far", ["Z"]), ("q", None)],
                               "pu string, required_zones array<string>")
    rows = [("p", 1, "c0"), ("p", 1, "c0"), ("p", 2, "c5"), ("p", 2, "c6"), ("q", 1, "c3"), ("q", 2, "c4"), ("r", 1, "c2"),
            ("far", 1, "c1"), ("lost", 1, "c1"), (None, 1, "c1"), ("r", 3, "c9"), ("p", 2, None)]
    modes = ["PRIMARY", "BACKUP", None]
    instance = spark.createDataFrame(
        [(f"i{n}", p, k, c, True, ["space"], [("space", modes[n % 3])]) for n, (p, k, c) in enumerate(rows)],
        "instance_id string, pu string, partition_id int, container_id string, embedded boolean, embedded_space_ids array<string>,"
        " spaces array<struct<id:string,mode:string>>")
    return pu, container, instance_facts(instance)


@pytest.mark.parametrize("by_partition", [False, True])
def test_ranges_stand_for_the_whole_snapshot(fleet, by_partition):
    pu, container, facts = fleet
    eligible = {(r.pu, r.axis, r.key) for r in ranges.numbered_keys(pu, container).join(requirement(pu), "required_zones").collect()}
    counters = {}
    for r in counts.by_role(counts.placement_snapshot(pu.distinct(), container, facts, by_partition)).collect():
        counters.setdefault((r.pu, r.partition_id, r.axis, r.role), []).append((r.key, r.n))
    want = []
    for counter, keys in counters.items():
        free = []
        for key, n in [*sorted(keys), (None, 1)]:
            if n and free and (key is None or (counter[0], counter[2], key) in eligible):
                want.append((*counter, free[0], free[-1], len(free), 0))
                free = []
            if not n:
                free.append(key)
            elif key is not None:
                want.append((*counter, key, key, 1, n))
    got = [tuple(r) for r in ranges.count_ranges(pu, container, facts, by_partition).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 60


def test_ranges_and_ties_share_one_shuffle(fleet):
    """From the place where the slots of a counter meet, nothing is dealt anew."""
    plan = ranges.tie_ranges(ranges.count_ranges(*fleet))._jdf.queryExecution().executedPlan().toString()
    later = plan[:plan.index("Exchange hashpartitioning")]
    assert later.count("Window [") == 2 and "HashAggregate" in later and "REPARTITION_BY_NUM" in plan


def test_keys_know_their_neighbours(fleet):
    pu, container, _ = fleet
    keys = ranges._neighbours(ranges.numbered_keys(pu, container)).where("axis = 'CONTAINER'")
    rows = keys.where(F.size("required_zones") == 0).orderBy("place").collect()
    names = [f"c{i}" for i in range(7)]
    assert [(r.prev, r.key, r.next) for r in rows] == list(zip([None, *names], names, [*names[1:], None]))
