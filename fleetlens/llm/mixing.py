"""Mixing sources to target weights by the cube method.

Each source may take ``target`` words: its weight's share of all words, at most ``most`` times its
own; what a full source cannot take is shared again by weight. A document is taken whole, floor of
target over size times, and once more with the fraction that is left. The cube method rounds these
fractions: it moves them along the null space of two constraints per source, the number of
documents and the number of words, so both totals stay put until two open fractions are left.

Flights run in chunks of a source (by id hash, about ``CHUNK`` rows), so a hot source is many
tasks; the at most two open rows of each chunk meet in the next round, and the last two of a
source are landed on the rounding nearest to the target. Every step is seeded by source, round
and chunk and works from long to short documents, then by id, so reruns agree and short ones stay
open last.

Null and empty texts have size 0 and take nothing. A null source is a source of its own, last in
order. Rows are documents, repeated ones too. An empty table gives no rows. Extra columns do not matter.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import WORD, in_groups

CHUNK, FAN_IN, MOST = 8192, 2048, 3
WEIGHTS = (1, 2, 3)
_EDGE = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row per source; the windows see only these rows."""
    own = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = own.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    full = F.col("source_size") * float(most)
    # in the order in which rising water fills sources: before a source, all earlier ones are full
    filled = [full / F.col("w"), F.col("source").asc_nulls_last()]
    earlier = Window.orderBy(*filled).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(*filled).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(earlier), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))
    levels = weighed.withColumn("_level", level)
    # the first source that its level does not fill sets the level of all that are not full
    rows = levels.withColumn("_level", F.first(F.when(full / F.col("w") >= F.col("_level"), F.col("_level")), True).over(everything))
    return rows.select("source", "source_size", F.least(F.col("w") * F.col("_level"), full).alias("target"))


def flight(fractions: list[float], words: list[int], seed: str) -> list[float]:
    """Move along the null space of the constraints until at most two fractions are open.

    Units come from long to short. The longer half moves three at a time and keeps documents and
    words; the shorter half two at a time and keeps words alone, since next to nearly equal short
    documents a long one would hardly move and would stay open to the end.
    """
    draw = random.Random(seed)
    out, open_ = list(fractions), []

    def settle(units: list[int], step: tuple[float, ...]) -> list[int]:
        moved = [(k, s) for k, s in zip(units, step, strict=True) if s]
        ahead = min(((1 - out[k]) / s if s > 0 else out[k] / -s) for k, s in moved)
        back = min((out[k] / s if s > 0 else (1 - out[k]) / -s) for k, s in moved)
        by = ahead if draw.random() * (ahead + back) < back else -back
        for k, s in moved:
            out[k] += by * s
            if not _EDGE < out[k] < 1 - _EDGE:
                out[k] = float(round(out[k]))
        return [k for k in units if _EDGE < out[k] < 1 - _EDGE]

    for i, value in enumerate(out):
        if not _EDGE < value < 1 - _EDGE:
            out[i] = float(round(value))
            continue
        open_.append(i)
        if 2 * i < len(out):
            if len(open_) == 3:
                a, b, c = open_
                step = (float(words[c] - words[b]), float(words[a] - words[c]), float(words[b] - words[a]))
                open_ = settle(open_, step if any(step) else (1.0, -1.0, 0.0))
        else:
            while len(open_) > 1:
                a, b = open_[-2:]
                open_ = open_[:-2] + settle([a, b], (float(words[b]), -float(words[a])))
    return out


def landed(fractions: list[float], words: list[int], started: list[float]) -> list[float]:
    """Round the last open fractions to the choice whose words are nearest to what they stand for.

    What is still missing or over is then made up by turning single units around, as long as that
    brings the words nearer; ``started`` has the fractions before the flight, whole ones never turn.
    """
    open_ = [i for i, v in enumerate(fractions) if _EDGE < v < 1 - _EDGE]
    aim = sum(fractions[i] * words[i] for i in open_)
    best = min(range(1 << len(open_)), key=lambda bits: abs(sum(words[i] for j, i in enumerate(open_) if bits >> j & 1) - aim))
    out = list(fractions)
    for j, i in enumerate(open_):
        out[i] = float(best >> j & 1)
    over = sum(words[i] * out[i] for i in open_) - aim
    free = [i for i, v in enumerate(started) if _EDGE < v < 1 - _EDGE and words[i]]
    while free:
        k = min(free, key=lambda i: (abs(over + words[i] * (1 - 2 * out[i])), i))
        turned = over + words[k] * (1 - 2 * out[k])
        if abs(turned) >= abs(over):
            break
        over, out[k] = turned, 1 - out[k]
    return out


def _flown(seed: int, last: bool):
    def run(pdf):
        # long documents first, so that what stays open is short
        pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
        words = [int(x) for x in pdf["size"]]
        key = f"{seed}/{pdf['source'].iloc[0]}/{pdf['chunk'].iloc[0]}"
        shares = [float(x) for x in pdf["share"]]
        values = flight(shares, words, key)
        return pdf.assign(share=landed(values, words, shares) if last else values)

    return run


def copies(units: DataFrame, aims: DataFrame, seed: int = 0) -> DataFrame:
    """``units`` (doc_id, source, size) with source_size, target and how often each is taken."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = units.join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = written(rows.withColumn("whole", F.floor(ratio)).withColumn(
        "share", F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(0.0)))
    chunks = -(-rows.count() // CHUNK) or 1
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    done, number = None, 0
    while True:
        flown = written(in_groups(rows, ["source", "chunk"], _flown(f"{seed}/{number}", chunks == 1), rows.schema))
        if chunks == 1:
            break
        is_open = (F.col("share") > _EDGE) & (F.col("share") < 1 - _EDGE)
        settled = flown.where(~is_open)
        done = settled if done is None else done.unionByName(settled)
        rows = flown.where(is_open).withColumn("chunk", F.floor(F.col("chunk") / FAN_IN))
        chunks, number = -(-chunks // FAN_IN), number + 1
    done = flown if done is None else done.unionByName(flown)
    return done.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("whole") + F.col("share").cast("long")).alias("copies"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies."""
    units = written(sizes(docs))
    got = copies(units, written(targets(units, weights, most)))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; rows that share id and source are taken together."""
    units = written(sizes(docs).groupBy("doc_id", "source").agg(F.sum("size").alias("size")))
    # written, so that Spark knows its size: where it is small, the texts stay where they are
    got = written(copies(units, written(targets(units, weights, most))).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("copies").cast("int").alias("_copies")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = docs.join(got, same)
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*docs.columns)
