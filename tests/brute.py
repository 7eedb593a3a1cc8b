"""Plain-Python statement of the rebalance rules, used as the expected result on small fleets."""

from collections import Counter


def eligible(required, zones):
    return not required or bool(set(required) & set(zones))


def keys_of(containers, cid, axis):
    c = containers[cid]
    return {"ZONE": sorted(set(c["zones"])), "MACHINE": [c["host"]], "CONTAINER": [cid]}[axis]


def zero_filled(pu_required, containers, instances, axis, role):
    """Eligible keys at zero plus every key an instance of this role occupies."""
    result = Counter()
    for cid, c in containers.items():
        if eligible(pu_required, c["zones"]):
            for k in keys_of(containers, cid, axis):
                result[k] += 0
    for i in instances:
        if {"total": True, "primary": i["primary"], "backup": i["backup"] and not i["primary"]}[role]:
            for k in keys_of(containers, i["container"], axis):
                result[k] += 1
    return dict(result)


def verdict(counter):
    low, high = min(counter.values()), max(counter.values())
    return {
        "min": low, "max": high,
        "min_key": min(k for k, n in counter.items() if n == low),
        "max_key": min(k for k, n in counter.items() if n == high),
        "needs": high > low + 1,
    }


def checks(pu, required, containers, instances, groups):
    mine = [i for i in instances if i["pu"] == pu]
    scopes = [(p, [i for i in mine if i["partition"] == p]) for p in sorted({i["partition"] for i in mine})]
    if mine:
        scopes.append((None, mine))
    for partition, inside in scopes:
        for role in ("total", "primary", "backup"):
            lanes = [("ZONE", g) for g in range(len(groups))] + [("MACHINE", None), ("CONTAINER", None)]
            for axis, group in lanes:
                counter = zero_filled(required, containers, inside, axis, role)
                if group is not None:
                    counter = {k: n for k, n in counter.items() if k in groups[group]}
                if counter:
                    yield partition, role, axis, group, inside, verdict(counter)


def best(required, containers, load, current, host=None):
    machine = Counter()
    for cid, c in containers.items():
        machine[c["host"]] += load[cid]
    ranked = sorted(
        (load[cid], machine[c["host"]], cid) for cid, c in containers.items()
        if cid != current and eligible(required, c["zones"]) and (host is None or c["host"] == host))
    return ranked[0][2] if ranked else None


def step(pu, required, containers, instances, groups):
    mine = [i for i in instances if i["pu"] == pu]
    load = Counter(i["container"] for i in instances)
    for partition, role, axis, group, inside, v in checks(pu, required, containers, instances, groups):
        if not v["needs"]:
            continue
        at = lambda i, key: key in keys_of(containers, i["container"], axis)
        if axis == "ZONE":
            candidates = [i for i in inside if at(i, v["max_key"])]
        elif axis == "MACHINE":
            barred = {i["partition"] for i in mine if at(i, v["min_key"])}
            candidates = [i for i in inside if at(i, v["max_key"]) and i["partition"] not in barred]
        else:
            barred = {i["partition"] for i in inside if at(i, v["min_key"])}
            candidates = [i for i in mine if at(i, v["max_key"]) and i["partition"] not in barred]
        action = "demote" if role == "primary" else "relocate"
        chosen = min(candidates, key=lambda i: (i["backup"], i["id"])) if candidates else None
        target = None
        if chosen and action == "relocate":
            target = best(required, containers, load, chosen["container"], v["min_key"] if axis == "MACHINE" else None)
        return {
            "pu": pu, "partition_id": partition, "role": role, "axis": axis, "zone_group": group, "action": action,
            "instance_id": chosen and chosen["id"], "from_key": v["max_key"], "to_key": v["min_key"],
            "min": v["min"], "max": v["max"], "target_id": target,
        }
    return None
