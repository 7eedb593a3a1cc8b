"""Spreading movers of many owners over containers whose sets overlap, as evenly as their requirements allow.

An owner (a requirement set) may use the containers of some zone sets. The final loads are to be as even as possible: no
solution lowers a container's load without raising one that is at least as full. The containers fall into classes: in
each, all that take movers end at one level, give or take one, and no mover of a class could go to a class
with a lower level. The classes are found on the compressed graph alone: owners with their number of movers, zone
sets with the number of containers at each load, and which owner may use which zone set. The least level at which a
flow places all movers, less one, leaves a deficiency; the owners that still miss places there, with all the zone
sets they may use, are the fullest class, and the missing places its containers with one more. The rest is solved alike.

The graph has a row per owner, per pair of owner and zone set, and per zone set and load, so its size is that of the
requirements and loads in use and does not grow with instances; one task solves it. Movers and containers follow by
prefix sums and equality joins over blocks of places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_sum
from ..session import written

BLOCK = 64  # places that are looked up together
_FLOWS = "owner string, zones string, movers bigint, level bigint, extras bigint, class int"


def _solver():
    """The solver as a value, so that workers need no module of ours."""
    import numpy as np
    import pandas as pd

    def flow(movers, room, allowed, given=None):
        """Place movers in the room of zone sets; placed amounts, and the owners that reach no free room."""
        placed = given or {o: {} for o in movers}
        used = {}
        for amounts in placed.values():
            for z, n in amounts.items():
                used[z] = used.get(z, 0) + n
        missing = {o: n - sum(placed[o].values()) for o, n in movers.items()}
        holders = {}
        for o, amounts in placed.items():
            for z in amounts:
                holders.setdefault(z, set()).add(o)
        while True:
            # alternating paths from an owner that misses places over zone sets and the owners that fill them
            came, queue, free = {("o", o): None for o, n in missing.items() if n}, [o for o, n in missing.items() if n], None
            at = 0
            while at < len(queue) and free is None:
                o = queue[at]
                at += 1
                for z in allowed[o]:
                    if ("z", z) in came:
                        continue
                    came["z", z] = o
                    if room[z] > used.get(z, 0):
                        free = z
                        break
                    for other in holders.get(z, ()):
                        if placed[other].get(z) and ("o", other) not in came:
                            came["o", other] = z
                            queue.append(other)
            if free is None:
                return placed, [k[1] for k in came if k[0] == "o"], [k[1] for k in came if k[0] == "z"]
            path, z = [], free
            amount = room[free] - used.get(free, 0)
            while True:
                o = came["z", z]
                back = came["o", o]
                path.append((o, z, back))
                if back is None:
                    amount = min(amount, missing[o])
                    break
                amount = min(amount, placed[o][back])
                z = back
            for o, z, back in path:
                placed[o][z] = placed[o].get(z, 0) + amount
                holders.setdefault(z, set()).add(o)
                if back is None:
                    missing[o] -= amount
                else:
                    placed[o][back] -= amount
            used[free] = used.get(free, 0) + amount

    def solve(frame):
        rows = frame.to_dict("records")
        movers = {r["owner"]: int(r["n"]) for r in rows if r["kind"] == "movers"}
        edges, steps = {}, {}
        for r in rows:
            if r["kind"] == "edge" and r["owner"] in movers:
                edges.setdefault(r["owner"], []).append(r["zones"])
            elif r["kind"] == "load":
                steps.setdefault(r["zones"], []).append((int(r["load"]), int(r["n"])))
        movers = {o: movers[o] for o in sorted(edges)}  # an owner without a container places nothing
        edges = {o: sorted(edges[o]) for o in movers}
        held = {z: np.array(sorted(s)) for z, s in steps.items()}

        def room(z, level):
            below = np.maximum(level - held[z][:, 0], 0)
            return int((below * held[z][:, 1]).sum())

        out, number = [], 0
        while movers:
            sets = sorted({z for o in movers for z in edges[o]})
            low = min(int(held[z][0, 0]) for z in sets)
            high = max(int(held[z][-1, 0]) for z in sets) + sum(movers.values())
            while low + 1 < high:  # at low some movers miss a place, at high none does
                middle = (low + high) // 2
                lost = flow(movers, {z: room(z, middle) for z in sets}, edges)[1]
                low, high = (middle, high) if lost else (low, middle)
            level = low
            placed, owners, full = flow(movers, {z: room(z, level) for z in sets}, edges)
            own = {o: movers[o] for o in owners}
            placed = {o: placed[o] for o in owners}
            at_level, larger = {z: room(z, level) for z in full}, {z: room(z, level) for z in full}
            for z in sorted(full):  # one more for the containers at the level, in the order of zone sets
                larger[z] = room(z, level + 1)
                placed, lost, _ = flow(own, larger, edges, placed)
                if not lost:
                    break
            for z in sorted(full):
                taken = sum(p.get(z, 0) for p in placed.values())
                out.append((None, z, taken, level, taken - at_level[z], number))
                out.extend((o, z, placed[o][z], level, None, number) for o in sorted(own) if placed[o].get(z))
            movers = {o: n for o, n in movers.items() if o not in own}
            edges = {o: [z for z in edges[o] if z not in larger] for o in movers}
            number += 1
        return pd.DataFrame(out, columns=["owner", "zones", "movers", "level", "extras", "class"]).astype({"extras": "Int64"})

    return solve


def shared_levels(sizes: DataFrame, matched: DataFrame, containers: DataFrame) -> DataFrame:
    """Rows (owner, zones, movers) of how many movers of an owner go to a zone set, and one row per zone set (owner null)
    with its class, the level of the class and its containers with one more.

    ``sizes``: owner, movers. ``matched``: owner, zones. ``containers``: zones, n_container.
    """
    nothing = F.lit(None).cast("string")
    graph = (
        sizes.select(F.lit("movers").alias("kind"), "owner", nothing.alias("zones"), F.lit(0).cast("bigint").alias("load"), F.col("movers").alias("n"))
        .unionByName(matched.select(F.lit("edge").alias("kind"), "owner", "zones", F.lit(0).cast("bigint").alias("load"), F.lit(0).cast("bigint").alias("n")))
        .unionByName(containers.groupBy("zones", F.col("n_container").cast("bigint").alias("load")).agg(F.count("*").alias("n")).select(
            F.lit("load").alias("kind"), nothing.alias("owner"), "zones", "load", "n"))
    )
    return graph.groupBy().applyInPandas(_solver(), _FLOWS)


def _blocks(df: DataFrame) -> DataFrame:
    """One row per block of places that a range [from, to) meets."""
    return df.where("`from` < `to`").withColumn(
        "block", F.explode(F.sequence(F.expr(f"`from` div {BLOCK}"), F.expr(f"(`to` - 1) div {BLOCK}"))))


def shared_places(levels: DataFrame, containers: DataFrame) -> DataFrame:
    """(owner, container_id, from, to): which movers of each owner, counted from 0, every container takes.

    ``levels``: rows of ``shared_levels``. ``containers``: zones, container_id, n_container, n_machine.
    """
    order = ["n_machine", "container_id"]
    # containers below the level rise to it; of those up to it, the first in order take one more
    zone_level = levels.where("owner is null").select("zones", "level", "extras")
    risen = containers.join(zone_level, "zones").where("n_container <= level")
    counted = running_sum(risen.select("zones", *order, "n_container", "level", "extras"), ["zones"], order, F.lit(1), "place")
    room = F.col("level") - F.col("n_container") + (F.col("place") <= F.col("extras")).cast("bigint")
    taken = running_sum(counted.withColumn("room", room).where("room > 0"), ["zones"], order, "room", "to")
    places = _blocks(taken.select("zones", "container_id", (F.col("to") - F.col("room")).alias("from"), "to"))
    # an owner's movers go to its zone sets in order, a zone set's places to its owners in order
    flows = levels.where("owner is not null").select("owner", "zones", "movers")
    flows = running_sum(flows, ["owner"], ["zones"], "movers", "mover_end")
    flows = running_sum(flows, ["zones"], ["owner"], "movers", "to").withColumn("from", F.col("to") - F.col("movers"))
    shift = F.col("mover_end") - F.col("to")
    owned = _blocks(flows.select("owner", "zones", "from", "to", shift.alias("shift")))
    both = owned.select("zones", "block", "owner", F.col("from").alias("a"), F.col("to").alias("b"), "shift").join(places, ["zones", "block"])
    start, end = F.greatest("a", "from", F.col("block") * BLOCK), F.least("b", "to", (F.col("block") + 1) * BLOCK)
    return both.where(start < end).select(
        "owner", "container_id", (start + F.col("shift")).alias("from"), (end + F.col("shift")).alias("to"))


def shared_spread(sizes: DataFrame, matched: DataFrame, containers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``shared_levels``, written once, and ``shared_places``."""
    levels = written(shared_levels(sizes, matched, containers))
    return levels, shared_places(levels, containers)
