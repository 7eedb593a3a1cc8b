"""Parts that streams share: time without zones, keyed state, sinks and the end of a bounded input."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: No event is as late as this; timers that wait for the end of the input wait for it.
END = datetime(9000, 1, 1, tzinfo=timezone.utc)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session time zone is."""
    since = ts - F.lit("1970-01-01").cast("timestamp_ntz")
    day, hour, minute, second = (F.extract(F.lit(u), since) for u in ("DAY", "HOUR", "MINUTE", "SECOND"))
    whole = day.cast("bigint") * 86400 + hour * 3600 + minute * 60
    return (whole * 1_000_000 + second * 1_000_000).cast("bigint")


def zone_free(instant: Column) -> Column:
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed state with timers needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Writer that appends finished rows to a Parquet folder."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    )


def with_end(stream: DataFrame, folder: str) -> DataFrame:
    """The stream and the end marker that ``mark_end`` may write to ``folder``: a row with a time and empty values.

    They are not null, since Spark moves the null filters of later joins below the watermark, which is to see the marker.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def mark_end(spark: SparkSession, schema: StructType, folder: str) -> None:
    """Say that no more events come: the watermark passes every window and timer. Call it when the rest has been read."""
    later = F.lit(f"{END.year + 500}-01-01").cast("timestamp_ntz")
    empty = {"string": "", "boolean": False, "int": 0, "bigint": 0, "double": 0.0}
    columns = [(later if c.name == "ts" else F.lit(empty.get(c.dataType.simpleString()))).cast(c.dataType).alias(c.name) for c in schema]
    spark.range(1).select(*columns).write.mode("append").parquet(folder)


def drained(events: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """All rows that ``build`` appends for the events there are, up to the end of the input; ``folder`` is shared and new."""
    spark = events.sparkSession
    result = build(with_end(events, f"{folder}/end"))
    with keyed_state(spark):
        append_to(result, f"{folder}/out", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
        mark_end(spark, events.schema, f"{folder}/end")
        append_to(result, f"{folder}/out", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")
