"""Fleet tables derived from the star-schema test tables, always from all of their rows.

``pu_level`` chooses how finely instances are grouped into processing units:
``brand`` gives few large PUs, ``part`` gives one small PU per part row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = {"brand": 4, "part": 8}
SNAPSHOTS = 6


@dataclass(frozen=True)
class Fleet:
    spark: SparkSession
    folder: str
    pu_level: str = "brand"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def nation(self) -> DataFrame:
        return self.table("nation").select(
            "n_nationkey", "n_regionkey", F.col("n_name").alias("host"),
            F.concat(F.lit("10."), F.col("n_regionkey"), F.lit(".0."), F.col("n_nationkey")).alias("addr"),
        )

    @cached_property
    def machine(self) -> DataFrame:
        return self.nation.select("host", "addr")

    @cached_property
    def container(self) -> DataFrame:
        heap = F.when(F.col("s_acctbal") >= 5000, "LARGE_HEAP").otherwise("SMALL_HEAP")
        rack = F.concat(F.lit("RACK_"), (F.col("s_suppkey") % 4).cast("string"))
        return (
            self.table("supplier")
            .join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_name").alias("container_id"),
                (F.col("s_suppkey") + 1000).alias("pid"),
                "host", "addr",
                F.array("r_name", rack, heap).alias("zones"),
                (F.lit("2024-01-01").cast("timestamp_ntz")
                 + F.make_dt_interval(hours=F.col("s_suppkey").cast("int"))).alias("start_ts"),
                F.col("r_name").alias("region"),
                F.col("s_acctbal").alias("heap_mb"),
            )
        )

    @cached_property
    def instance(self) -> DataFrame:
        """One instance per lineitem row; instances of containers ending in 3 live in the next container."""
        key = F.col("l_suppkey") + F.when(F.col("l_suppkey") % 10 == 3, 1).otherwise(0)
        mode = (
            F.when(key % 10 == 1, "BACKUP").when(key % 10 == 2, "PRIMARY").when(key % 10 == 4, F.lit(None))
            .when(F.col("l_returnflag") == "A", "PRIMARY").when(F.col("l_returnflag") == "R", "BACKUP")
        )
        space_id = F.when(F.col("l_linenumber") == 7, "Mirror-space").otherwise("space")
        lineitem = self.table("lineitem")
        if self.pu_level == "brand":
            part = self.table("part").select("p_partkey", F.col("p_brand").alias("pu"))
            rows = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        else:
            rows = lineitem.withColumn("pu", F.concat(F.lit("PU_"), F.col("l_partkey")))
        return rows.select(
            F.concat_ws(
                "~", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"),
                F.floor(F.col("l_extendedprice") * 100 + 0.5),
            ).alias("instance_id"),
            "pu",
            (F.col("l_orderkey") % PARTITIONS[self.pu_level]).alias("partition_id"),
            F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0")).alias("container_id"),
            mode.isNotNull().alias("embedded"),
            F.array(space_id).alias("embedded_space_ids"),
            F.array(F.struct(space_id.alias("id"), mode.alias("mode"))).alias("spaces"),
        )

    @cached_property
    def pu(self) -> DataFrame:
        number = F.substring("p_brand", 7, 10).cast("int")
        zones = (
            F.when(number % 2 == 0, F.array(F.lit("LARGE_HEAP")))
            .when(number % 4 == 3, F.array(F.lit("RACK_0"), F.lit("SMALL_HEAP")))
            .otherwise(F.array().cast("array<string>"))
        )
        part = self.table("part")
        if self.pu_level == "brand":
            rows = part.groupBy("p_brand").agg(F.count("*").alias("planned")).withColumn("pu", F.col("p_brand"))
        else:
            rows = part.select("p_brand", F.col("p_size").cast("bigint").alias("planned"),
                               F.concat(F.lit("PU_"), F.col("p_partkey")).alias("pu"))
        return rows.select("pu", "planned", zones.alias("required_zones"), (number % 5 == 0).alias("requires_isolation"))

    @cached_property
    def manager(self) -> DataFrame:
        """One manager per region, on the region's first host."""
        first = self.nation.groupBy("n_regionkey").agg(F.min_by(F.struct("host", "n_nationkey"), "host").alias("m"))
        return first.select("m.host", (F.col("m.n_nationkey") + 100).cast("bigint").alias("pid"))

    @cached_property
    def agent(self) -> DataFrame:
        return self.nation.select(
            "host", (F.col("n_nationkey") + 10).cast("bigint").alias("pid"),
            F.create_map(F.lit("GSM"), (F.col("n_regionkey") + 1).cast("int")).alias("required_global_instances"),
        )

    @cached_property
    def customer(self) -> DataFrame:
        return self.table("customer").join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))

    @cached_property
    def agent_process(self) -> DataFrame:
        """Processes the agents report: containers, managers, and leftovers no container belongs to."""
        containers = self.container.select(
            "host", "pid", (F.col("pid") - 999).alias("agent_id"), F.lit("GSC").alias("service_type"),
            F.lit("ON_DEMAND").alias("instantiation_mode"))
        managers = self.manager.select(
            "host", "pid", F.lit(0).cast("bigint").alias("agent_id"), F.lit("GSM").alias("service_type"),
            F.lit("STATIC").alias("instantiation_mode"))
        leftovers = self.customer.select(
            "host", (F.col("c_custkey") + 200000).alias("pid"), (F.col("c_custkey") + 5001).alias("agent_id"),
            F.lit("GSC").alias("service_type"), F.lit("ON_DEMAND").alias("instantiation_mode"))
        return containers.unionByName(managers).unionByName(leftovers)

    def _reported(self, rows: DataFrame) -> DataFrame:
        """Rows (cluster, started) in the weekly snapshots of their cluster, from the first one after their start."""
        weeks = F.explode(F.sequence(F.lit(0), F.lit(SNAPSHOTS - 1))).alias("week")
        day = F.col("week") * 7 + F.col("cluster")
        seen = rows.select("*", weeks).withColumn(
            "snapshot", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=day.cast("int")))
        return seen.where("started <= snapshot").drop("week", "started")

    @cached_property
    def container_history(self) -> DataFrame:
        cluster = self.nation.select("host", F.col("n_regionkey").alias("cluster"))
        return self._reported(self.container.join(cluster, "host").select(
            "cluster", "container_id", "host", "pid", F.col("start_ts").alias("started")))

    @cached_property
    def process_history(self) -> DataFrame:
        """What agents reported: containers from their start on, managers always, leftovers from a day of their own on."""
        cluster = self.nation.select("host", F.col("n_regionkey").alias("cluster"))
        first = F.lit("2024-01-01").cast("timestamp_ntz")
        starts = self.container.select("host", "pid", F.col("start_ts").alias("started")).unionByName(
            self.customer.select("host", (F.col("c_custkey") + 200000).alias("pid"),
                                 (first + F.make_dt_interval(days=(F.col("c_custkey") % 40).cast("int"))).alias("started")))
        rows = self.agent_process.join(starts, ["host", "pid"], "left").withColumn("started", F.coalesce("started", first))
        return self._reported(rows.join(cluster, "host").select("cluster", "host", "pid", "agent_id", "started"))

    @cached_property
    def jvm(self) -> DataFrame:
        fixed = F.lit("2024-01-10").cast("timestamp_ntz")

        def rows(df: DataFrame, heap, start, region) -> DataFrame:
            return df.select(
                "host", "pid",
                (heap / 4).alias("heap_init_mb"), heap.alias("heap_max_mb"), start.alias("start_ts"),
                F.lit("OpenVM").alias("vendor"), F.lit("64-Bit Server").alias("vm_name"),
                F.concat(F.lit("17.0."), (F.col("pid") % 10).cast("string")).alias("version"),
                F.create_map(F.lit("REGION"), region).alias("env"),
                F.create_map(F.lit("pid"), F.col("pid").cast("string"), F.lit("host"), F.col("host")).alias("sysprops"),
            )

        none = F.lit(0.0)
        unknown = F.lit("unknown")
        return (
            rows(self.container, F.col("heap_mb"), F.col("start_ts"), F.col("region"))
            .unionByName(rows(self.manager, none, fixed, unknown))
            .unionByName(rows(self.agent, none, fixed, unknown))
            .unionByName(rows(
                self.customer.withColumn("pid", F.col("c_custkey") + 200000), F.col("c_acctbal"), fixed, unknown))
        )

    @cached_property
    def layer(self) -> DataFrame:
        """Configuration layers: one value per entity, layer and key."""
        number = F.get_json_object("props", "$.k").cast("int")
        return (
            self.table("events")
            .groupBy(F.col("user_id").alias("entity"), (F.col("event_id") % 5).alias("layer"),
                     F.col("event_type").alias("key"))
            .agg(F.max(number % 3).cast("string").alias("value"))
        )

    @cached_property
    def readiness(self) -> DataFrame:
        kind = F.col("event_type")
        delta = F.when(kind.isin("signup", "purchase"), 1).when(kind == "error", -1).otherwise(0)
        return self.table("events").select(
            F.concat(F.lit("app_"), (F.col("user_id") % 5).cast("string")).alias("app"),
            F.concat(F.lit("pu_"), (F.col("user_id") % 25).cast("string")).alias("pu"),
            "ts", "event_id", delta.alias("delta"))

    @cached_property
    def observation(self) -> DataFrame:
        """Timed sightings of a PU on a key."""
        return self.table("events").select(
            "ts", F.concat(F.lit("pu_"), (F.col("user_id") % 25).cast("string")).alias("pu"),
            F.col("event_type").alias("key"))

    @cached_property
    def sighting(self) -> DataFrame:
        """Instances seen on their container on the day their row was shipped."""
        rows = self.table("lineitem").select(
            "l_partkey", "l_suppkey", F.col("l_shipdate").cast("timestamp_ntz").alias("ts"))
        key = F.col("l_suppkey") + F.when(F.col("l_suppkey") % 10 == 3, 1).otherwise(0)
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("pu"))
        named = rows.join(part, "l_partkey") if self.pu_level == "brand" else rows.withColumn("pu", F.concat(F.lit("PU_"), F.col("l_partkey")))
        return named.select("ts", "pu", F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0")).alias("container_id"))

    @cached_property
    def heartbeat(self) -> DataFrame:
        return self.table("events").select("ts", (F.col("event_type") == "signup").alias("is_manager"))
