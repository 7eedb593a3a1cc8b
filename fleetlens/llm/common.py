"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; ``bytes.split`` cuts at exactly the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound so that a worker's memory stays bounded."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers once per application, wherever they were started."""
    context = spark.sparkContext
    if getattr(context, "_fleetlens_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="fleetlens-code-")) / "fleetlens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(archive))
    context._fleetlens_shipped = True


_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_REMEMBERED: dict[str, object] = {}


def remembered(name: str, made: Callable[[], object]):
    """What tasks of one worker share under ``name``, made by the first that asks."""
    if name not in _REMEMBERED:
        _REMEMBERED[name] = made()
    return _REMEMBERED[name]


def forget_others(name: str) -> None:
    """Drop what earlier tasks of this worker remembered, but for ``name``."""
    for other in [x for x in _REMEMBERED if x != name]:
        del _REMEMBERED[other]


def in_arrow(df: DataFrame, function: Callable[[Iterable], Iterable], schema, keeps: str = "") -> DataFrame:
    """``keeps`` names what the tasks share by ``remembered``; workers are used again by other operators, whose memory goes.

    Unless the session says otherwise, Arrow batches are bounded by BATCH_BYTES, as texts have no common length.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)

    def run(batches):
        forget_others(keeps)
        return function(batches)

    return df.mapInArrow(run, schema)


def in_parts(batches: Iterable, rows: int = 500) -> Iterable:
    """Slices of the batches, so that a worker's objects do not grow with the rows Spark puts into a batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def in_groups(df: DataFrame, keys: list[str], function: Callable, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(function, schema)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Row count and a sum of row hashes, to tell whether an iteration changed its table."""
    row = df.select(
        F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")
    ).first()
    return row.n, int(row.h or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternates large-star and small-star steps. Each is a minimum per node, combined before
    the shuffle, and a join that adaptive execution may split, so a hub needs no single task.
    Every step is written, so a lost executor costs one step; the loop ends when a round
    changes nothing, whatever the number of rounds.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct())
    seen = fingerprint(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .where("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        near = down.join(least, "a")
        edges = written(
            near.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        now = fingerprint(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
