"""Has every PU of an application reached its planned instances before the shared deadline?"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_sum
from ..session import written
from .source import END, micros, zone_free

_PU = ["app", "pu"]
#: Microseconds of the time buckets in which events are summed first.
BUCKET = 600_000_000


def _reached(events: DataFrame, planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per PU: instances running at last and its first event; and when the plan was first met.

    Buckets are summed first and put in order, so the running sums are over buckets. Single events are looked at
    only in buckets that may meet the plan: the rises in them would do, and no bucket before has met it for certain.
    """
    rows = events.select(*_PU, "ts", "event_id", "delta", F.floor(micros(F.col("ts")) / BUCKET).alias("_bucket"))
    per_bucket = rows.groupBy(*_PU, "_bucket").agg(
        F.sum("delta").alias("change"), F.sum(F.greatest("delta", F.lit(0))).alias("rise"), F.min("ts").alias("first"))
    sums = running_sum(per_bucket.join(planned, _PU), _PU, ["_bucket"], "change", "after")
    sums = written(sums.withColumn("before", F.col("after") - F.col("change")))
    total = sums.groupBy(*_PU).agg(F.sum("change").alias("running"), F.min("first").alias("first"))
    certain = sums.where("after >= planned").groupBy(*_PU).agg(F.min("_bucket").alias("_last"))
    # a plan that is met from the start is met by the first event
    doubtful = sums.where("before + rise >= planned").join(certain, _PU, "left").where("_last IS NULL OR _bucket <= _last")
    start = doubtful.select(*_PU, "_bucket", "before", "planned")
    inside = Window.partitionBy(*_PU, "_bucket").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(start, [*_PU, "_bucket"]).withColumn("n", F.col("before") + F.sum("delta").over(inside)).where("n >= planned")
    return total, met.groupBy(*_PU).agg(F.min("ts").alias("done_ts"))


def verdicts(state: DataFrame, planned: DataFrame, timeout: timedelta) -> DataFrame:
    """DONE when the plan was met by the deadline, which all PUs of an application share."""
    deadline = F.col("app_first_ts") + F.lit(timeout)
    in_time = F.coalesce(F.col("done_ts") <= deadline, F.lit(False))
    return state.join(planned, _PU).select(
        *_PU, "planned", "running",
        F.when(in_time, F.col("done_ts")).alias("done_ts"),
        F.when(in_time, "DONE").otherwise("TIMED_OUT").alias("status"),
    )


def readiness_batch(events: DataFrame, planned: DataFrame, timeout: timedelta) -> DataFrame:
    """Verdict per planned PU over a complete event table."""
    total, met = _reached(events, planned)
    merged = planned.select(*_PU).join(total, _PU, "left").join(met, _PU, "left")
    per_app = merged.groupBy("app").agg(F.min("first").alias("app_first_ts"))
    state = merged.join(per_app, "app").withColumn("running", F.coalesce("running", F.lit(0)).cast("bigint"))
    return verdicts(state, planned, timeout)


def outcomes(judged: DataFrame, declared: DataFrame) -> DataFrame:
    """One row per application: PUs are awaited in declared order and the first late one fails the whole.

    ``judged``: rows of ``verdicts``; ``declared``: app, pu, ordinal (from 0 without gaps). A declared
    PU without a verdict is late; PUs that are not declared are not awaited.
    """
    late = ~F.coalesce(F.col("status") == "DONE", F.lit(False))
    per_app = declared.join(judged.select(*_PU, "status", "done_ts"), _PU, "left").groupBy("app").agg(
        F.count("*").alias("declared"), F.max("done_ts").alias("last"),
        F.min(F.when(late, F.struct("ordinal", "pu"))).alias("failed"))
    failed = F.col("failed").isNotNull()
    return per_app.select(
        "app", F.when(failed, "TIMED_OUT").otherwise("DEPLOYED").alias("status"), "declared",
        F.coalesce("failed.ordinal", "declared").cast("bigint").alias("deployed"), F.col("failed.pu").alias("failed_pu"),
        F.when(~failed, F.col("last")).alias("done_ts"))


def progress(events: DataFrame, every: str = "5 seconds") -> DataFrame:
    """Instances running at the end of each interval that saw a change: running sums over intervals, not over events."""
    changes = events.groupBy(*_PU, F.window("ts", every).alias("w")).agg(F.sum("delta").alias("change")).select(
        *_PU, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "change")
    return running_sum(changes, _PU, ["window_start"], "change", "running").drop("change")


_VERDICTS = "app string, pu string, planned bigint, running bigint, done bigint, status string, closing boolean"


def _processor(timeout: timedelta, every: timedelta):
    """Keyed state of an application: what each PU should and does run, and the application's first event.

    Defined inside a function, so that it travels to the workers by value.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    step, allowed = every // timedelta(microseconds=1), timeout // timedelta(microseconds=1)
    end_ms = int(END.timestamp() * 1000)
    names = [c.split()[0] for c in _VERDICTS.split(", ")]

    class Readiness(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.pus = handle.getMapState("pus", "pu string", "planned bigint, running bigint, done bigint")
            self.first = handle.getValueState("first", "micros bigint")

        def handleInitialState(self, key, initialState, timerValues) -> None:
            for pu, planned in zip(initialState["pu"], initialState["planned"], strict=True):
                self.pus.updateValue((pu,), (int(planned), 0, None))
            self.handle.registerTimer(end_ms)

        def handleInputRows(self, key, rows, timerValues):
            state = dict(self._state())
            buckets = sorted((b for frame in rows for b in frame.itertuples() if b.pu in state), key=lambda b: (b.at[0], b.pu))
            if not buckets:
                return
            if not self.first.exists():
                # buckets arrive in the order of time, so no later one holds an earlier event
                self.first.update((int(buckets[0].at[0]),))
                deadline = int(buckets[0].at[0]) + allowed
                # the bucket of the deadline has been counted when its end has passed
                self.handle.registerTimer((deadline // step + 1) * step // 1000)
            deadline, reached = self.first.get()[0] + allowed, []
            for b in buckets:
                planned, running, done = state[b.pu]
                sums = running + np.cumsum(b.delta)
                if done is None and (sums >= planned).any():
                    done = int(b.at[int((sums >= planned).argmax())])
                    if done <= deadline:
                        reached.append(b.pu)
                state[b.pu] = planned, int(sums[-1]), done
            for pu in {b.pu for b in buckets}:
                self.pus.updateValue((pu,), state[pu])
            if reached:
                yield self._rows(key, {pu: state[pu] for pu in reached}, deadline, closing=False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            started, state = self.first.exists(), dict(self._state())
            deadline = self.first.get()[0] + allowed if started else -1
            late = {pu: v for pu, v in state.items() if v[2] is None or v[2] > deadline}
            ended = expiredTimerInfo.getExpiryTimeInMs() == end_ms
            if late and not (ended and started):
                yield self._rows(key, late, deadline, closing=False)
            if ended:
                yield self._rows(key, state, deadline, closing=True)

        def close(self) -> None:
            pass

        def _state(self):
            return ((k[0], tuple(v)) for k, v in self.pus.iterator())

        def _rows(self, key, state, deadline, closing):
            rows = []
            for pu, (planned, running, done) in sorted(state.items()):
                fine = done is not None and done <= deadline
                rows.append((key[0], pu, planned, running, done if fine else None, "DONE" if fine else "TIMED_OUT", closing))
            frame = pd.DataFrame(rows, columns=names)
            return frame.astype({"done": "Int64"})

    return Readiness()


def readiness_stream(
    events: DataFrame, planned: DataFrame, timeout: timedelta, every: timedelta = timedelta(minutes=10),
    delay: timedelta = timedelta(hours=2),
) -> DataFrame:
    """Verdicts of a stream of events, which may come late by ``delay`` and in any order.

    Events are first gathered in one row per PU and ``every``, so a busy PU is spread over many tasks and the state
    of an application sees a row per PU and interval. Such a row is passed on when the watermark has passed its end;
    so the rows of an application come in the order of time. Its state holds a row per planned PU: a PU that reaches its
    plan by the deadline gives a DONE row at once, a timer behind the deadline gives TIMED_OUT rows for the others, those
    without any event among them. When the input ends (``source.mark_end``), each planned PU gives one row
    with ``closing`` set: its verdict and the instances it runs at last, the rows of ``readiness_batch``.
    An application without events times out then. Events without an app or PU, and of PUs not planned, are ignored.
    """
    minutes = f"{every // timedelta(milliseconds=1)} milliseconds"
    rows = events.select(*_PU, F.timestamp_micros(micros(F.col("ts"))).alias("instant"), micros(F.col("ts")).alias("at"),
                         "event_id", F.col("delta").cast("bigint").alias("delta"))
    gathered = rows.withWatermark("instant", f"{delay // timedelta(milliseconds=1)} milliseconds").groupBy(
        F.window("instant", minutes).alias("w"), *_PU).agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "delta"))).alias("events"))
    buckets = gathered.select(
        *_PU, F.col("events.at").alias("at"), F.col("events.delta").alias("delta"))
    first = planned.select(*_PU, F.col("planned").cast("bigint").alias("planned")).where("app is not null and pu is not null")
    judged = buckets.groupBy("app").transformWithStateInPandas(
        _processor(timeout, every), _VERDICTS, "Append", "EventTime", initialState=first.groupBy("app"))
    return judged.select(*_PU, "planned", "running", zone_free(F.timestamp_micros("done")).alias("done_ts"), "status", "closing")
