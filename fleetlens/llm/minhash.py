"""Near-duplicate documents by bottom-k sketches of one hash function.

Equal shingle sets form a class first, so exact copies never meet each other. Each class keeps
the ``k`` smallest hashes of its shingles. Inverted lists of the retained values give overlaps;
pairs with enough of them pass the estimate over the sketch of the union, and the exact Jaccard
similarity on whole sets decides.

A value held by more than ``rare`` classes makes no pairs. A linked pair shares about 80 % of its
sketch, so it either shares a rare value, or both classes hold mostly frequent values. For those
*saturated* classes there is an exact way without all pairs of a list: every member is compared
with the list's most typical class (its hub), and whatever is then not in the list's largest
component is compared, in blocks of bounded size, with every member of similar size.

Chance: a pair at similarity 0.8 misses a list only if fewer than 40 % of its ``k`` = 24 smallest
union values are common (below 1e-5); sets up to ``k`` are kept whole and lose nothing. A saturated class is on
the lists of its ``SPREAD`` = 8 smallest frequent values; two at 0.8 have none of them in common with a chance below 0.2 ** 8,
3e-6, as each of them is a value of the other with a chance of 0.8.

Null and empty texts have no shingles and link with nothing. Repeated rows fall in one class. A
document is a row: rows with equal ids but different texts are judged apart. Extra columns do not
matter. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import WordHashes, components, in_arrow, in_groups, in_parts, mixed, words_of

K, RARE, SHARE, SPREAD, SALT = 24, 32, 0.4, 8, 16
BLOCK_VALUES = 400_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle of all its words."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    width = min(n, width)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = (total ^ hashes[i:n - width + 1 + i]) * _STEP + (total >> np.uint64(29))
    return np.unique(mixed(total).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


def sketched(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """doc_id, n_shingles, class (digest of the set), sketch of every row."""

    def run(batches):
        known = WordHashes()
        for batch in in_parts(batches):
            sets = [shingle_hashes(known.of(words_of(t)), width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                _lists([s[:k] for s in sets]),
            ], ["doc_id", "n_shingles", "class", "sketch"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                    "doc_id long, n_shingles long, class binary, sketch array<long>")


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """class, values (the sorted set as bytes) of every row with words."""

    def run(batches):
        known = WordHashes()
        for batch in in_parts(batches):
            sets = [shingle_hashes(known.of(words_of(t)), width) for t in batch.column(0).to_pylist()]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ], ["class", "values"])

    return in_arrow(docs.select("text"), run, "class binary, values binary")


def _similar(n_a, n_b, percent: int):
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _estimated(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Pairs whose union sketch has at least SHARE of its values in both sketches."""
    side = classes.select("class", "sketch")
    both = (pairs.join(side.withColumnsRenamed({"class": "a", "sketch": "sketch_a"}), "a")
            .join(side.withColumnsRenamed({"class": "b", "sketch": "sketch_b"}), "b"))
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
    return both.where(common >= F.floor(SHARE * F.size(union))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose exact Jaccard similarity is at least ``percent`` hundredths."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sides = (pairs.join(sets.withColumnsRenamed({"class": "a", "values": "values_a"}), "a")
             .join(sets.withColumnsRenamed({"class": "b", "values": "values_b"}), "b"))
    return in_arrow(sides.select("a", "b", "values_a", "values_b"), run, "a binary, b binary")


def _block_links(percent: int):
    """Links between components, from one block of open classes and one block of members."""

    def run(pdf):
        import pandas as pd

        open_, other = pdf[pdf["open"]], pdf[~pdf["open"]]
        if not len(open_) or not len(other):
            return pd.DataFrame({"a": [], "b": []})
        left = [np.frombuffer(v, np.int64) for v in open_["values"]]
        right = [np.frombuffer(v, np.int64) for v in other["values"]]
        vocabulary = np.intersect1d(np.concatenate(left), np.concatenate(right))
        common = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, len(vocabulary), 4096):
            part = vocabulary[start:start + 4096]

            def incidence(sets, part=part):
                out = np.zeros((len(sets), len(part)), np.float32)
                for row, s in enumerate(sets):
                    at = np.searchsorted(part, s)
                    at[at == len(part)] = 0
                    out[row, at[part[at] == s]] = 1
                return out

            common += incidence(left) @ incidence(right).T
        sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
        i, j = np.nonzero(100 * common >= percent * (sizes - common))
        links = pd.DataFrame({"a": open_["comp"].to_numpy()[i], "b": other["comp"].to_numpy()[j]})
        return links[links["a"] != links["b"]].drop_duplicates()

    return run


def _residual_links(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the hubs left open; ``members(v, class, n)`` are the lists of frequent values."""
    step = float(np.log(100 / percent))
    placed = written(
        members.join(roots.withColumnsRenamed({"node": "class"}), "class", "left")
        .select("v", "class", "n", F.coalesce("root", "class").alias("comp"))
        .withColumn("bucket", F.floor(F.log("n") / step))
    )
    giant = placed.groupBy("v", "comp").agg(F.count("*").alias("c")).groupBy("v").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("giant"), F.count("*").alias("comps")).where("comps > 1")
    here = placed.join(giant, "v")
    # a block holds about BLOCK_VALUES hashes; classes of one bucket have like sizes
    room = F.greatest(F.lit(8), F.floor(BLOCK_VALUES / F.exp((F.col("bucket") + 1) * step)))
    counted = (
        here.withColumn("bucket", F.explode(F.array([F.col("bucket") + i for i in (-1, 0, 1)])))
        .where("comp <> giant").groupBy("v", "bucket").agg(F.count("*").alias("n_open"))
        .join(here.groupBy("v", "bucket").agg(F.count("*").alias("n_member")), ["v", "bucket"])
        .select("v", "bucket", F.ceil(F.col("n_open") / room).alias("opens"), F.ceil(F.col("n_member") / room).alias("blocks"))
    )
    counted = written(counted)
    at = F.abs(F.xxhash64("class"))
    opens = (
        here.where("comp <> giant").withColumn("bucket", F.explode(F.array([F.col("bucket") + i for i in (-1, 0, 1)])))
        .join(counted, ["v", "bucket"])
        .select("v", "bucket", "class", "comp", F.lit(True).alias("open"), (at % F.col("opens")).alias("x"),
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("y"))
    )
    others = here.join(counted, ["v", "bucket"]).select(
        "v", "bucket", "class", "comp", F.lit(False).alias("open"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("opens") - 1)).alias("x"), (at % F.col("blocks")).alias("y"))
    rows = opens.unionByName(others).join(sets, "class")
    return in_groups(rows, ["v", "bucket", "x", "y"], _block_links(percent), "a binary, b binary")


def linked_classes(docs: DataFrame, rows: DataFrame, width: int, percent: int, k: int = K, rare: int = RARE) -> DataFrame:
    """(node, root) of the classes that have a link; ``rows`` is the written ``sketched`` table."""
    classes = rows.where("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes)
    values = classes.select("class", F.explode("sketch").alias("v"))
    held = written(values.groupBy("v").agg(F.count("*").alias("held")).where("held > 1"))
    # a frequent value may be held by a third of all classes, so its holders are dealt to SALT keys
    salted = values.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALT)))
    frequent = held.where(f"held > {rare}").select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    hot = salted.join(frequent, ["v", "salt"], "left_semi").groupBy("class").agg(F.sort_array(F.collect_list("v")).alias("hot"))
    none = F.array().cast("array<bigint>")
    full = written(classes.join(hot, "class", "left").withColumn("hot", F.coalesce("hot", none)).withColumn("n_hot", F.size("hot")))

    entry = F.struct("class", "n", "n_hot")
    lists = (
        full.select(F.explode(F.array_except("sketch", "hot")).alias("v"), entry.alias("x")).join(held, "v", "left_semi")
        .groupBy("v").agg(F.collect_list("x").alias("xs"))
    )
    pairs = lists.select("xs", F.explode("xs").alias("x")).select(
        "x", F.explode(F.filter("xs", lambda y: y["class"] > F.col("x.class"))).alias("y")
    ).where(_similar(F.col("x.n"), F.col("y.n"), percent))
    size = F.least(F.lit(k), F.greatest("x.n", "y.n"))
    pairs = (
        pairs.groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
        .agg(F.count("*").alias("shared"), F.min(F.least("x.n_hot", "y.n_hot")).alias("n_hot"), F.min(size).alias("size"))
        .where(F.col("shared") + F.col("n_hot") >= F.floor(SHARE * F.col("size"))).select("a", "b")
    )
    saturated = full.where(F.col("n_hot") >= F.greatest(F.lit(1), F.floor(SHARE * F.least(F.lit(k), F.col("n")))))
    members = written(saturated.select(F.explode(F.slice("hot", 1, SPREAD)).alias("v"), "class", "n", "n_hot"))
    hubs = members.groupBy("v").agg(F.min(F.struct(-F.col("n_hot"), F.col("class"), F.col("n"))).alias("hub"))
    spokes = members.join(hubs, "v").where(_similar(F.col("n"), F.col("hub.n"), percent)).select(
        F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")).where("a <> b").distinct()
    found = written(_estimated(pairs.union(spokes), full, k).distinct())
    # written, so that Spark knows how small it is and need not move the texts to it
    wanted = written(found.select(F.col("a").alias("class")).union(found.select(F.col("b").alias("class"))).union(
        members.select("class")).distinct().join(classes.select("class", F.col("doc_id").alias("_id")), "class").select("_id").distinct())
    ids = F.col("doc_id").cast("long")
    texts = docs.select(ids.alias("doc_id"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = written(whole_sets(texts, width).dropDuplicates(["class"]))
    links = written(_verified(found, sets, percent))
    roots = written(components(links))
    rest = written(_residual_links(members.select("v", "class", "n"), roots, sets, percent).distinct())
    if not rest.isEmpty():
        roots = written(components(links.union(rest)))
    return roots


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K, rare: int = RARE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, class.

    ``kept`` is true where doc_id equals component_id. ``percent`` is the least similarity in hundredths.
    """
    rows = written(sketched(docs, width, k))
    roots = linked_classes(docs, rows, width, percent, k, rare)
    named = rows.groupBy("class").agg(F.min("doc_id").alias("least_id")).where("class is not null")
    named = named.join(roots.withColumnsRenamed({"node": "class"}), "class", "left").withColumn(
        "root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select("class", "component_id")
    return rows.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"), "class",
    )


def first_of_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group; documents without words stay.

    The group's smallest id stays. Rows that share an id are one document; of equal rows one stays.
    """
    judged = written(near_duplicates(docs, width, percent))
    # texts meet the ids that go or that several rows share, which are fewer than those that stay
    ids = written(judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("class").alias("n")).where(
        "not kept or n > 1").select(F.col("doc_id").alias("_id"), "kept"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    once = docs.join(ids.select("_id"), same, "left_anti")
    again = docs.join(ids.where("kept").select("_id"), same, "left_semi")
    return once.unionByName(again.dropDuplicates([c for c, t in docs.dtypes if not t.startswith("map")]))
