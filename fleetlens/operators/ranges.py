"""Placement counts with their zeros as ranges of keys instead of a row per key.

The keys a PU may use are numbered per requirement set and axis, once for all PUs that share them. What a PU
occupies lies at some of these numbers; the stretches between them are free and become one row each: first key,
last key, number of keys. So the rows grow with occupied keys, whatever the number of keys.

A slot learns its PU's requirement set and the number of its container there as one row; then the slots of a counter
meet once and become keys, counts, ranges and ties without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .counts import AXES, ROLES, WHOLE, axis_keys, slot_counts
from .ordering import ordinal_within
from .placement import eligible_containers, requirement

_COUNTER = ["pu", "partition_id", "axis", "role"]
# about as many slots become keys and ranges in one task
SLOTS = 100_000


def numbered_keys(pu: DataFrame, container: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """(required_zones, axis, key, place): the eligible keys of each requirement set and axis in order, from 0."""
    keys = eligible_containers(pu, container).select("required_zones", F.explode(axis_keys(axes)).alias("_key")).select(
        "required_zones", "_key.axis", "_key.key").distinct()
    return ordinal_within(keys, ["required_zones", "axis"], ["key"], "place")


def _neighbours(keys: DataFrame) -> DataFrame:
    """Numbered keys with the names before and after; by joins, as a set may have very many keys."""
    by = ["required_zones", "axis", "place"]
    before = keys.select("required_zones", "axis", (F.col("place") + 1).alias("place"), F.col("key").alias("prev"))
    after = keys.select("required_zones", "axis", (F.col("place") - 1).alias("place"), F.col("key").alias("next"))
    return keys.join(before, by, "left").join(after, by, "left")


def _entry(axis: Column, key: Column, own: dict[str, Column], end: bool) -> Column:
    return F.struct(axis.alias("axis"), key.alias("key"), *[c.alias(name) for name, c in own.items()], F.lit(end).alias("end"))


def _scoped(facts: DataFrame, by_partition: bool) -> tuple[DataFrame, int]:
    """Slots of each whole PU, and of each partition where wanted, and a bound of their number.

    A counter has at most one slot per container.
    """
    sums = [F.sum(r).alias(r) for r in ROLES]
    none = F.lit(None).cast("bigint")
    if not by_partition:
        slots = slot_counts(facts.withColumn("partition_id", F.lit(WHOLE)))
        return slots.select("pu", F.lit(WHOLE).alias("scope"), none.alias("partition_id"), "container_id", *ROLES), facts.count()
    parts = written(slot_counts(facts).withColumn("partition_id", F.col("partition_id").cast("bigint")))
    whole = parts.groupBy("pu", "container_id").agg(*sums).select(
        "pu", F.lit(WHOLE).alias("scope"), none.alias("partition_id"), "container_id", *ROLES)
    return parts.select("pu", F.col("partition_id").alias("scope"), "partition_id", "container_id", *ROLES).unionByName(whole), 2 * parts.count()


def _placed_keys(
    pu: DataFrame, container: DataFrame, facts: DataFrame, keys: DataFrame, by_partition: bool, axes: Sequence[str]
) -> DataFrame:
    """Occupied keys of each counter's PU and partition with their counts and place, and an ``end`` row per axis.

    Containers, the most numerous keys, bring their place along with the slot; zones and machines get theirs when the
    slots of a counter have met. The number of tasks follows from the rows there, since AQE would merge them by the size
    of the slots.
    """
    scoped, most = _scoped(facts, by_partition)
    tasks = max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // SLOTS))
    sets = requirement(pu).where("pu IS NOT NULL").select("pu", "required_zones").distinct().repartition(tasks, "pu")
    # should a PU come with several sets, its occupied keys are told once, with the first
    sets = sets.withColumn("_lead", F.col("required_zones") == F.min("required_zones").over(Window.partitionBy("pu")))
    seats = keys.where("axis = 'CONTAINER'").select("required_zones", F.col("key").alias("_name"), "place", "prev", "next")
    shape = ["pu", "scope", "partition_id", "required_zones", "_lead"]
    located = written(container.select("container_id", "host", "zones"))
    # where the tables joined next are small, slots and sets still lie so at the last call, which then shuffles nothing
    slots = (scoped if by_partition else scoped.repartition(tasks, "pu")).withColumn(
        "_name", F.col("container_id").cast("string")).join(sets, "pu", "left").join(
        written(seats), ["required_zones", "_name"], "left").join(located, "container_id").select(
        *shape, *ROLES, "place", "prev", "next", *located.columns)
    # PUs without instances have the counters of the whole PU
    fixed = {"scope": F.lit(WHOLE), **{r: F.lit(0) for r in ROLES}}
    marks = sets.select(*[
        F.col(f.name) if f.name in sets.columns else fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in slots.schema])
    met = slots.unionByName(marks).repartition(tasks, *(["pu", "partition_id"] if by_partition else ["pu"]))
    none = {"place": F.lit(None).cast("bigint"), "prev": F.lit(None).cast("string"), "next": F.lit(None).cast("string")}
    ends = F.array(*[_entry(F.lit(axis), none["prev"], none, True) for axis in axes])
    entries = F.transform(axis_keys(axes), lambda k: _entry(
        k["axis"], k["key"], {c: F.when(k["axis"] == "CONTAINER", F.col(c)) for c in none}, False))
    entries = F.when(F.col("container_id").isNull(), ends).otherwise(F.concat(entries, ends) if by_partition else entries)
    # place and neighbours follow from the requirement set and the key
    return met.select(*shape, *ROLES, F.explode(entries).alias("_entry")).select(*shape, *ROLES, "_entry.*").groupBy(
        *shape, "axis", "key", *none, "end").agg(*[F.sum(r).cast("bigint").alias(r) for r in ROLES])


def _held(container: DataFrame, facts: DataFrame, by_partition: bool, axes: Sequence[str]) -> DataFrame:
    """The rows of ``held_counts``: the occupied keys alone, where no PU has a requirement set."""
    spark = facts.sparkSession
    pu = spark.createDataFrame([], "pu string, required_zones array<string>")
    keys = spark.createDataFrame([], "required_zones array<string>, axis string, key string, place bigint, prev string, next string")
    rows = _placed_keys(pu, container, facts, keys, by_partition, axes).where("NOT end")
    return rows.select("pu", "partition_id", "axis", "key", *ROLES)


def count_ranges(
    pu: DataFrame, container: DataFrame, facts: DataFrame, by_partition: bool = False, axes: Sequence[str] = AXES
) -> DataFrame:
    """The rows of ``by_role`` over ``placement_snapshot`` as ranges: pu, partition_id, axis, role, first_key, last_key, n_keys, n.

    An occupied key is a row of its own (n above 0, eligible or not); a row with n = 0 stands for all free keys from
    first_key to last_key in the order of the requirement set.
    """
    keys = written(_neighbours(written(numbered_keys(pu, container, axes))))
    sizes = written(keys.groupBy("required_zones", "axis").agg(
        F.count("*").alias("_size"), F.min_by("key", "place").alias("_first"), F.max_by("key", "place").alias("_last")))
    others = written(keys.where("axis <> 'CONTAINER'").select(
        "required_zones", "axis", "key", F.col("place").alias("_place"), F.col("prev").alias("_prev"), F.col("next").alias("_next")))
    shape = ["pu", "partition_id", "required_zones", "_lead"]
    held = _placed_keys(pu, container, facts, keys, by_partition, axes).join(
        others, ["required_zones", "axis", "key"], "left").join(sizes, ["required_zones", "axis"], "left")
    place = F.when(F.col("end"), F.col("_size")).otherwise(F.coalesce("place", "_place"))
    # an end is there for each role, a key for those that occupy it; a key that is not eligible has no place
    rows = held.select(*shape, "axis", "key", "end", *ROLES, place.alias("place"), "_first",
                       F.when(F.col("end"), F.col("_last")).otherwise(F.coalesce("prev", "_prev")).alias("prev"),
                       F.coalesce("next", "_next").alias("next")).where("NOT end OR place IS NOT NULL")
    earlier = Window.partitionBy("pu", "partition_id", "axis", "required_zones").orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1)
    taken = F.struct("place", "next")
    rows = rows.withColumns({f"_{r}": F.last(F.when((F.col(r) > 0) & F.col("place").isNotNull(), taken), True).over(earlier) for r in ROLES})

    def span(role: str, first: Column, last: Column, size: Column, n: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), first.alias("first_key"), last.alias("last_key"), size.alias("n_keys"), n.alias("n"))

    spans = []
    for role in ROLES:
        n, before, key = F.col(role), F.col(f"_{role}"), F.col("key")
        free = F.col("place") - F.coalesce(before["place"], F.lit(-1)) - 1
        first = F.when(before.isNull(), F.col("_first")).otherwise(before["next"])
        spans.append(F.when(~F.col("end") & (n > 0) & F.coalesce("_lead", F.lit(True)), span(role, key, key, F.lit(1).cast("bigint"), n)))
        spans.append(F.when((F.col("end") | (n > 0)) & (free > 0), span(role, first, F.col("prev"), free, F.lit(0).cast("bigint"))))
    return rows.select("pu", "partition_id", "axis", F.explode(F.array_compact(F.array(*spans))).alias("_span")).select(
        "pu", "partition_id", "axis", "_span.*")


def tie_ranges(ranges: DataFrame) -> DataFrame:
    """Keys tied for the least and for the highest count of each counter, free ones as ranges."""
    # nulls of partition_id are equal here: bounds come from a window over the few rows of a counter
    counter = Window.partitionBy(*_COUNTER)
    bounded = ranges.withColumn("_min", F.min("n").over(counter)).withColumn("_max", F.max("n").over(counter))
    hit = F.array_compact(F.array(
        F.when(F.col("n") == F.col("_min"), F.lit("min")), F.when(F.col("n") == F.col("_max"), F.lit("max"))))
    return bounded.select(*_COUNTER, F.explode(hit).alias("bound"), "n", "first_key", "last_key", "n_keys")
