"""Benchmark passages in documents, also re-parameterised ones, by templates.

Numbers, names (capitalised words inside a sentence) and units become typed placeholders, the rest
is lower-cased words without punctuation. Every ``WINDOW`` tokens in a row are hashed and joined
with the windows of the benchmark items that hold at least ``LITERALS`` words of their own. Windows
of one item on one alignment belong together; what stands in their placeholders must be consistent:
equal values in the item are equal in the document and different ones different. A document is
contaminated by an item if a consistent alignment has ``LEAST`` windows, or all the item has.
An item or document shorter than a window is one window of all its tokens.

Beside the templates, the windows of plain lower-cased words of every item are looked up, all words for
an item shorter than a window, so copies word for word are found however many numbers or names they
hold and whatever their case; ``LITERALS`` and consistency restrict only templates. So a copy with one value
changed is found by the windows that hold the item's own values, wherever there are ``LEAST`` of them.

Native: regular expressions, array functions and joins only. Null and empty texts have no windows.
Rows that share a doc_id (or a null id) are one document, rows that share an item_id one item with
several wordings. Empty tables contaminate nothing. Extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

WINDOW, LITERALS, LEAST = 8, 5, 2
NUMBER, NAME, UNIT = "\uE001", "\uE002", "\uE003"
#: Around a value: unit, name and number follow the first three, whichever it is.
_MARKS = ("\uE001", "\uE002", "\uE003", "\uE004")
_NUMBER = r"(?<![\p{L}\p{N}])\p{N}+(?:[.,:/]\p{N}+)*"
_NAME = r"(?<=[^.!?\s] )\p{Lu}\p{Ll}+"
UNITS = ("km", "m", "cm", "mm", "miles", "mile", "feet", "foot", "inches", "inch", "kg", "g", "mg", "pounds", "pound",
         "litres", "liters", "l", "ml", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks",
         "week", "months", "month", "years", "year", "dollars", "dollar", "euros", "euro", "cents", "percent", "degrees")
_UNIT = r"(?<=\p{N} ?)(?:" + "|".join(UNITS) + r"|[%$€£°])(?!\p{L})"


def pieces(text: Column) -> Column:
    """Words of a text, lower-cased, and its values, each behind the marks of its kind; one pass finds all kinds."""
    plain = F.translate(F.coalesce(text, F.lit("")), "".join(_MARKS), " " * len(_MARKS))
    marked = F.regexp_replace(plain, f"({_UNIT})|({_NAME})|({_NUMBER})", " {}$1{}$2{}$3{} ".format(*_MARKS))
    return F.regexp_extract_all(F.lower(marked), F.lit("{0}[^{3}]*{3}|[\\p{{L}}\\p{{N}}]+".format(*_MARKS)), F.lit(0))


def template_tokens(text: Column) -> Column:
    """Lower-cased words and placeholders of a text."""
    return F.transform(pieces(text), _token)


def _token(piece: Column) -> Column:
    unit, name, number, _ = _MARKS
    return (F.when(piece.startswith(unit + name + number), NUMBER).when(piece.startswith(unit + name), NAME)
            .when(piece.startswith(unit), UNIT).otherwise(piece))


def _is_slot(token: Column) -> Column:
    return token.isin(NUMBER, NAME, UNIT)


def _window_hash(start: Column, width: int, *more: Column) -> Column:
    """Hash of ``width`` hashes in a row, taken one by one, since a slice for every window would be copied."""
    return F.xxhash64(*[F.get("hashes", start + j) for j in range(width)], *more)


def _with_windows(rows: DataFrame, window: int) -> DataFrame:
    """Add ``windows``: the hash of every run of ``window`` of the tokens; of all tokens when there are fewer."""
    # posexplode_outer below: the filter that Spark infers for an inner one would repeat all this for each window
    rows = rows.withColumn("hashes", F.transform("tokens", lambda x: F.xxhash64(x)))
    size = F.size("hashes")
    runs = F.transform(F.sequence(F.lit(0), size - window), lambda i: _window_hash(i, window))
    return rows.withColumn("windows", F.when(size >= window, runs).when(size > 0, F.array(F.xxhash64("hashes", size))).otherwise(
        F.array().cast("array<bigint>"))).drop("hashes")


def benchmark_windows(items: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """item_id, wording, item_pos, hash, windows (how many of the wording are listed)."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("wording"),
                        template_tokens(F.col("text")).alias("tokens")).distinct()
    listed = _with_windows(rows, window).select("item_id", "wording", "tokens", F.posexplode_outer("windows").alias("item_pos", "hash"))
    own = F.size(F.filter(F.slice("tokens", F.col("item_pos") + 1, window), lambda x: ~_is_slot(x)))
    listed = listed.where(own >= F.least(F.lit(literals), F.ceil(F.size("tokens") * literals / window)))
    counts = listed.groupBy("item_id", "wording").agg(F.count("*").alias("windows"))
    return listed.select("item_id", "wording", "item_pos", "hash").join(counts, ["item_id", "wording"])


def _slots(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, value of every placeholder."""
    placed = F.transform("pieces", lambda x, i: F.when(x.startswith(_MARKS[0]), F.struct(
        i.alias("pos"), F.translate(x, "".join(_MARKS), "").alias("value"))))
    pairs = rows.select(*keys, F.explode(F.filter(placed, lambda s: s.isNotNull())).alias("s"))
    return pairs.select(*keys, F.col("s.pos").alias("pos"), F.col("s.value").alias("value"))


def literal_runs(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, wording, n: alignments on ``least`` windows of plain words, or on all that the item has."""
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}\\p{N}]+"), "").alias("tokens")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("wording"), words).distinct()
    bench = written(_with_windows(rows, window).where(F.size("tokens") > 0).select(
        "item_id", "wording", F.least(F.size("tokens"), F.lit(window)).alias("width"), F.size("windows").alias("windows"),
        F.posexplode("windows").alias("item_pos", "hash")))
    widths = sorted(r.width for r in bench.select("width").distinct().collect())  # at most ``window`` numbers
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words).select(
        "doc_id", F.transform("tokens", lambda x: F.xxhash64(x)).alias("hashes"))
    size = F.size("hashes")
    none = F.array().cast("array<struct<width:int,pos:int,hash:bigint>>")

    def runs(width: int) -> Column:
        more = [] if width == window else [F.lit(width)]  # as in _with_windows
        return F.when(size >= width, F.transform(F.sequence(F.lit(0), size - width), lambda i: F.struct(
            F.lit(width).alias("width"), i.alias("pos"), _window_hash(i, width, *more).alias("hash")))
        ).otherwise(none)

    found = hashed.select("doc_id", F.explode_outer(F.concat(none, *map(runs, widths))).alias("w")).select("doc_id", "w.*")
    return found.join(bench, ["width", "hash"]).groupBy(
        "doc_id", "item_id", "wording", "windows", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.count_distinct("item_pos").alias("n")).where(F.col("n") >= F.least(F.lit(least), F.col("windows")))


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: int = LEAST, literals: int = LITERALS) -> DataFrame:
    """doc_id, item_id, windows: each document and item that it is contaminated by."""
    ids = F.col("doc_id").cast("long")
    bench = written(benchmark_windows(items, window, literals))
    tokens = docs.select(ids.alias("doc_id"), template_tokens(F.col("text")).alias("tokens"))
    found = _with_windows(tokens, window).select("doc_id", F.posexplode_outer("windows").alias("pos", "hash"))
    hits = written(found.join(bench, "hash").select(
        "doc_id", "item_id", "wording", "windows", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())
    runs = hits.groupBy("doc_id", "item_id", "wording", "windows", "shift").agg(F.collect_set("item_pos").alias("covered"))
    runs = written(runs.where(F.size("covered") >= F.least(F.lit(least), F.col("windows"))))
    wanted = runs.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select(ids.alias("doc_id"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    detail = pieces(F.col("text")).alias("pieces")
    there = _slots(texts.select("doc_id", detail), ["doc_id"]).withColumnsRenamed({"doc_id": "_id", "pos": "_pos", "value": "there"})
    here = _slots(items.select(F.col("item_id").cast("long").alias("_item"), F.xxhash64("text").alias("_wording"), detail),
                  ["_item", "_wording"]).withColumnRenamed("value", "here")
    inside = F.exists("covered", lambda p: (F.col("pos") >= p) & (F.col("pos") < p + window))
    filled = (
        runs.join(here, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("wording") == F.col("_wording")) & inside)
        .join(there, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("pos") + F.col("shift") == F.col("_pos")))
        .groupBy("doc_id", "item_id", "wording", "shift")
        .agg(F.count_distinct("here").alias("n_here"), F.count_distinct("there").alias("n_there"),
             F.count_distinct("here", "there").alias("n_both"))
    )
    odd = written(filled.where("n_both > n_here or n_both > n_there").select(
        *[F.col(c).alias(f"_{c}") for c in ("doc_id", "item_id", "wording", "shift")]))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "item_id", "wording", "shift")]
    good = runs.join(odd, same[0] & same[1] & same[2] & same[3], "left_anti").select("doc_id", "item_id", F.size("covered").alias("n"))
    words = literal_runs(docs, items, window, least)
    return good.unionByName(words.select("doc_id", "item_id", "n")).groupBy("doc_id", "item_id").agg(
        F.max("n").cast("long").alias("windows"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, kept, n_windows, item_ids (sorted)."""
    found = leaks(docs, items).groupBy(F.col("doc_id").alias("_id")).agg(
        F.sum("windows").alias("_windows"), F.sort_array(F.collect_set("item_id")).alias("_items"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = ids.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return rows.select(
        "doc_id", F.col("_windows").isNotNull().alias("contaminated"), F.col("_windows").isNull().alias("kept"),
        F.coalesce("_windows", F.lit(0)).alias("n_windows"),
        F.coalesce("_items", F.array().cast("array<bigint>")).alias("item_ids"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents."""
    bad = written(leaks(docs, items).select(F.col("doc_id").alias("_id")).distinct())
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_anti")
