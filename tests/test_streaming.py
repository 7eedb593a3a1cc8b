from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetlens.functions import predicates as P
from fleetlens.streaming import readiness as R
from fleetlens.streaming import source
from fleetlens.streaming import windows as W

START = datetime(2024, 1, 1)
EVENTS = "app string, pu string, ts timestamp_ntz, event_id bigint, delta int"


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_readiness_of_three_pus(spark):
    planned = spark.createDataFrame([("app", "stateful", 2), ("app", "stateless", 2), ("app", "mirror", 1)],
                                    "app string, pu string, planned int")
    rows = [("app", "stateful", at(0), 1, 1), ("app", "stateful", at(4), 2, 1), ("app", "stateless", at(5), 3, 1),
            ("app", "stateless", at(6), 4, 1), ("app", "mirror", at(7), 5, 1)]
    events = spark.createDataFrame(rows, EVENTS)
    got = {r.pu: (r.status, r.done_ts) for r in R.readiness_batch(events, planned, timedelta(seconds=10)).collect()}
    assert got == {"stateful": ("DONE", at(4)), "stateless": ("DONE", at(6)), "mirror": ("DONE", at(7))}
    got = {r.pu: r.status for r in R.readiness_batch(events, planned, timedelta(seconds=6)).collect()}
    assert got == {"stateful": "DONE", "stateless": "DONE", "mirror": "TIMED_OUT"}


def test_application_fails_at_its_first_late_pu(spark):
    judged = spark.createDataFrame(
        [("a", "x", "DONE", at(3)), ("a", "y", "DONE", at(2)), ("b", "x", "DONE", at(1)), ("b", "y", "TIMED_OUT", None),
         ("b", "z", "TIMED_OUT", None), ("b", "undeclared", "TIMED_OUT", None)], "app string, pu string, status string, done_ts timestamp_ntz")
    declared = spark.createDataFrame(
        [("a", "y", 0), ("a", "x", 1), ("b", "x", 0), ("b", "z", 1), ("b", "y", 2), ("c", "q", 0)], "app string, pu string, ordinal int")
    got = {r.app: (r.status, r.declared, r.deployed, r.failed_pu, r.done_ts) for r in R.outcomes(judged, declared).collect()}
    assert got == {"a": ("DEPLOYED", 2, 2, None, at(3)), "b": ("TIMED_OUT", 3, 1, "z", None), "c": ("TIMED_OUT", 1, 0, "q", None)}
    assert R.outcomes(judged, declared.limit(0)).count() == 0


def write_parts(df, folder, parts):
    """Time-ordered files, so that a stream sees several batches."""
    ordered = df.orderBy("ts", "event_id").collect() if "event_id" in df.columns else df.orderBy("ts").collect()
    size = -(-len(ordered) // parts)
    for n in range(parts):
        chunk = df.sparkSession.createDataFrame(ordered[n * size:(n + 1) * size], df.schema).coalesce(1)
        chunk.write.mode("append").parquet(folder)


def readings(spark):
    return spark.range(400).select(
        F.concat(F.lit("app"), F.col("id") % 2).alias("app"), F.concat(F.lit("pu"), F.col("id") % 6).alias("pu"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int") * 7)).alias("ts"),
        F.col("id").alias("event_id"), F.when(F.col("id") % 5 == 0, -1).otherwise(1).alias("delta"))


def test_readiness_stream_of_late_and_unordered_files(spark, tmp_path):
    events = readings(spark)
    # files in order of arrival: up to ten hours late and shuffled inside
    arrival = events.withColumn("late", F.col("ts") + F.make_dt_interval(mins=F.pmod(F.hash("event_id"), F.lit(600))))
    ordered = [r[:-1] for r in arrival.orderBy("late").collect()]
    for n in range(0, 400, 80):
        spark.createDataFrame(ordered[n:n + 80], events.schema).orderBy(F.rand(n)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    planned = events.select("app", "pu").distinct().withColumn("planned", F.when(F.col("pu") < "pu3", 10).otherwise(39))
    # a PU without events, in an application with and without others; events of a PU that is not planned
    planned = planned.where("pu <> 'pu5'").union(spark.createDataFrame([("app0", "silent", 1), ("app9", "silent", 1)], planned.schema))
    timeout, delay = timedelta(hours=30), timedelta(hours=11)
    want = sorted(map(tuple, R.readiness_batch(events, planned, timeout).collect()), key=repr)
    assert {"DONE", "TIMED_OUT"} == {r[5] for r in want} and len(want) == 7
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            rows = source.drained(
                stream, lambda df: R.readiness_stream(df, planned, timeout, timedelta(minutes=40), delay), str(tmp_path / zone.replace("/", "")))
            columns = ["app", "pu", "planned", "running", "done_ts", "status"]
            assert sorted(map(tuple, rows.where("closing").select(*columns).collect()), key=repr) == want
            early = sorted(map(tuple, rows.where("not closing").select("app", "pu", "done_ts", "status").collect()), key=repr)
            assert early == sorted(((r[0], r[1], r[4], r[5]) for r in want), key=repr)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_readiness_stream_takes_verdicts_in_time(spark, tmp_path):
    """A verdict comes with the file that moves the watermark past it, not with the end; a restart goes on from the state."""
    base = str(tmp_path)
    planned = spark.createDataFrame([("a", "x", 2), ("a", "y", 1)], "app string, pu string, planned int")
    schema = spark.createDataFrame([], EVENTS).schema

    def drain(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        out = R.readiness_stream(stream, planned, timedelta(minutes=5), timedelta(minutes=1), timedelta(seconds=0))
        with source.keyed_state(spark):
            source.append_to(out, f"{base}/out", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.pu, r.running, r.status) for r in spark.read.parquet(f"{base}/out").collect())

    assert drain(("a", "x", at(0), 1, 1)) == []
    assert drain(("a", "x", at(30), 2, 1), ("a", "y", at(200), 3, 0)) == [("x", 2, "DONE")]
    assert drain(("a", "z", at(900), 4, 1)) == [("x", 2, "DONE"), ("y", 0, "TIMED_OUT")]
    # too late: behind the watermark, so it changes nothing
    assert drain(("a", "y", at(10), 5, 1)) == [("x", 2, "DONE"), ("y", 0, "TIMED_OUT")]


def test_placement_bounds(spark, tmp_path):
    pus = spark.createDataFrame([("p", ["z1"]), ("q", [])], "pu string, required_zones array<string>")
    container = spark.createDataFrame([("c1", "h1", ["z1"]), ("c2", "h1", ["z1"]), ("c3", "h2", ["z2"])],
                                      "container_id string, host string, zones array<string>")
    rows = spark.createDataFrame(
        [(at(0), "p", "c1"), (at(1), "p", "c1"), (at(2), "p", "c2"), (at(90), "p", "c3"), (at(91), "q", "c3"), (at(92), "none", "c1")],
        "ts timestamp_ntz, pu string, container_id string")
    got = {(r.window_start, r.pu, r.axis): (r.min, r.max, r.needs_rebalancing)
           for r in W.placement_imbalance(rows, pus, container, "1 minute").collect()}
    assert got == {
        (at(0), "p", "ZONE"): (3, 3, False), (at(0), "p", "MACHINE"): (3, 3, False), (at(0), "p", "CONTAINER"): (1, 2, False),
        (at(60), "p", "ZONE"): (0, 1, False), (at(60), "p", "MACHINE"): (0, 1, False), (at(60), "p", "CONTAINER"): (0, 1, False),
        (at(60), "q", "ZONE"): (0, 1, False), (at(60), "q", "MACHINE"): (0, 1, False), (at(60), "q", "CONTAINER"): (0, 1, False)}
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ended = source.drained(stream, lambda df: W.placement_imbalance(df, pus, container, "1 minute", "10 seconds"), str(tmp_path / "run"))
    assert {(r.window_start, r.pu, r.axis): (r.min, r.max, r.needs_rebalancing) for r in ended.collect()} == got


def test_placement_counts_are_not_broadcast(spark, tmp_path):
    """The batch that ends a stream is empty, but its state gives every count there is."""
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    pus = table("pus", [(f"p{n}", []) for n in range(9)], "pu string, required_zones array<string>")
    container = table("containers", [(f"c{n}", "h", ["z"]) for n in range(9)], "container_id string, host string, zones array<string>")
    rows = table("in", [(at(0), "p1", "c1")], "ts timestamp_ntz, pu string, container_id string")
    stream = source.with_end(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "end"))
    source.mark_end(spark, rows.schema, str(tmp_path / "end"))
    out = W.placement_imbalance(stream, pus, container, "1 minute", "10 seconds")
    with source.keyed_state(spark):
        run = source.append_to(out, str(tmp_path / "out"), str(tmp_path / "progress")).trigger(availableNow=True).start()
        run.awaitTermination()
    lines = run._jsq.explainInternal(False).split("== Physical Plan ==")[1].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            assert not any("StateStoreSave" in x for x in lines[i:below])
    assert any("StateStoreSave" in x for x in lines) and spark.read.schema(out.schema).parquet(str(tmp_path / "out")).count() == 3


def test_window_streams_match_their_batch_twins(spark, tmp_path):
    rows = readings(spark).select("ts", "pu", F.col("app").alias("key"), (F.col("event_id") % 50 == 49).alias("is_manager"))
    write_parts(rows, str(tmp_path / "in"), 3)
    newest = rows.agg(F.max("ts")).first()[0]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for name, build, window, delay in (
                ("keys", W.key_counts, "6 hours", timedelta(hours=1)), ("presence", W.manager_presence, "1 hour", timedelta(0))):
                stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
                out = build(stream, window, f"{int(delay.total_seconds())} seconds")
                base = str(tmp_path / f"{name}-{zone.replace('/', '')}")
                W.append_to(out, base + "/out", base + "/progress").trigger(availableNow=True).start().awaitTermination()
                got = sorted(map(tuple, spark.read.schema(out.schema).parquet(base + "/out").collect()), key=repr)
                batch = build(rows, window).where(F.col("window_end") <= P.moment(newest - delay))
                assert got == sorted(map(tuple, batch.collect()), key=repr) and got
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_imbalance_and_discovery(spark):
    rows = spark.createDataFrame(
        [(at(1), "p", "a"), (at(2), "p", "a"), (at(3), "p", "a"), (at(4), "p", "b"), (at(70), "p", "a")],
        "ts timestamp_ntz, pu string, key string")
    got = W.imbalance(W.key_counts(rows, "1 minute")).orderBy("window_start").collect()
    assert [(r.min, r.max, r.needs_rebalancing) for r in got] == [(1, 3, True), (1, 1, False)]
    for second, status, attempt in ((3, "FOUND", 4), (15, "NOT_FOUND", 16)):
        beats = spark.createDataFrame([(at(n), n == second) for n in range(20)], "ts timestamp_ntz, is_manager boolean")
        presence = W.manager_presence(beats, "1 second")
        outcome = W.discovery_outcome(presence).first()
        assert (outcome.status, outcome.attempt) == (status, attempt)
        assert presence.where("alert").count() == 19
    never = W.discovery_outcome(W.manager_presence(beats.withColumn("is_manager", F.lit(False)), "1 second")).first()
    assert never.status == "NOT_FOUND"
