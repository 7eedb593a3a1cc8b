"""Language of a text by interpolated Kneser-Ney character models.

One model of ``ORDER`` characters per learned language. Counts come from a bounded sample: at most
``SAMPLE`` documents of a language, those with the smallest id hashes, whole texts. Four fifths of
it give the counts, one fifth calibrates the rejection. Highest-order counts are raw, lower orders
count distinct left neighbours, each order interpolates with the next by one absolute discount.

All languages share one sorted array of n-gram keys per order (four 16-bit characters in a 64-bit
key) beside a row of log probabilities, one for each language, and one sorted array of contexts
beside back-off weights. A text's score is its cross-entropy per character; the lowest wins, ties
go to the first language by code point. ``score`` is the winner's posterior at the temperature
``TEMPER``. A text is rejected when its cross-entropy is above the ceiling of the winner, the
highest seen in calibration plus ``SLACK`` standard deviations over the root of its length.

A null text and one without a letter are ``und``, score 0 and rejected. Repeated rows get equal
results; where rows share an id and a language, the least of their texts is learned. With nothing to learn from, every text is ``und``. Extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import id_remainder, in_arrow, in_parts, ship

ORDER, SAMPLE, TEMPER, SLACK = 4, 1000, 0.2, 4.0
SLICES = 1 << 12
UNKNOWN = "und"
CHARACTERS = 1 << 16
PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def character_codes(text: str) -> np.ndarray:
    """Lower-cased characters as 16-bit numbers after ORDER - 1 spaces; rarer planes are folded into a private range."""
    codes = np.frombuffer((" " * (ORDER - 1) + text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.max() >= CHARACTERS:
        codes = np.where(codes < CHARACTERS, codes, 0xE000 + codes % 0x1900)
    return codes.astype(np.uint64)


def keys_of(codes: np.ndarray) -> np.ndarray:
    """The key of every ORDER characters in a row."""
    total = codes[: len(codes) - ORDER + 1].copy()
    for i in range(1, ORDER):
        total = (total << np.uint64(16)) | codes[i : len(codes) - ORDER + 1 + i]
    return total


def suffix(keys: np.ndarray, length: int) -> np.ndarray:
    """Last ``length`` characters."""
    return keys & np.uint64((1 << (16 * length)) - 1)


def context(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(16)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each key and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == keys


@dataclass
class CharacterModel:
    languages: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    backoff: dict[int, np.ndarray] = field(default_factory=dict)
    ceiling: np.ndarray | None = None
    spread: np.ndarray | None = None

    def lookup(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of the last character of each key under each language."""
        if order == 0:
            return np.full((len(keys), len(self.languages)), -np.log(CHARACTERS), np.float32)
        at, there = find(self.keys[order], keys)
        out = self.logs[order][at]
        if not there.all():
            missed = keys[~there]
            at, known = find(self.contexts[order], context(missed))
            weight = np.where(known[:, None], self.backoff[order][at], np.float32(0))
            out[~there] = weight + self.lookup(suffix(missed, order - 1), order - 1)
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Nats per character of each non-empty text under each language; pieces bound the memory, not the text."""
        out, lengths = np.zeros((len(texts), len(self.languages))), np.ones(len(texts))
        rows, parts, size = [], [], 0

        def flush():
            if rows:
                got = self.lookup(np.concatenate(parts))
                starts = np.cumsum([0, *map(len, parts)])[:-1]
                np.add.at(out, rows, np.add.reduceat(got.astype(np.float64), starts, axis=0))

        for row, text in enumerate(texts):
            keys = keys_of(character_codes(text))
            lengths[row] = max(1, len(keys))
            for start in range(0, len(keys), PIECE):
                part = keys[start:start + PIECE]
                rows.append(row)
                parts.append(part)
                size += len(part)
                if size >= PIECE:
                    flush()
                    rows, parts, size = [], [], 0
        flush()
        return -out / lengths[:, None]


def _discount(counts: np.ndarray) -> float:
    once, twice = np.sum(counts == 1), np.sum(counts == 2)
    return float(once / (once + 2 * twice)) if once and twice else 0.75


def fitted(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> CharacterModel:
    """Model from the ORDER-gram (keys, counts) of each language."""
    model = CharacterModel(sorted(counts))
    n_languages = len(model.languages)
    by_order: dict[int, list] = {ORDER: [tuple(map(np.asarray, counts[x])) for x in model.languages]}
    for order in range(ORDER - 1, 0, -1):
        by_order[order] = [np.unique(suffix(keys, order), return_counts=True) for keys, _ in by_order[order + 1]]
    for order in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([k for k, _ in by_order[order]]))
        contexts = np.unique(context(keys))
        share, back = np.zeros((len(keys), n_languages)), np.zeros((len(contexts), n_languages))
        for i, (own, n) in enumerate(by_order[order]):
            d = _discount(n)
            ctx, first, kinds = np.unique(context(own), return_inverse=True, return_counts=True)
            total = np.bincount(first, weights=n, minlength=len(ctx))
            share[np.searchsorted(keys, own), i] = np.maximum(n - d, 0) / total[first]
            weight = np.ones(len(contexts))
            weight[np.searchsorted(contexts, ctx)] = d * kinds / total
            back[:, i] = np.log(np.maximum(weight, 1e-9))
        model.keys[order], model.contexts[order] = keys, contexts
        model.backoff[order] = back.astype(np.float32)
        lower = model.lookup(suffix(keys, order - 1), order - 1).astype(np.float64)
        at = np.searchsorted(contexts, context(keys))
        model.logs[order] = np.log(share + np.exp(back[at] + lower)).astype(np.float32)
    return model


def _sample(docs: DataFrame, size: int) -> DataFrame:
    """At most ``size`` documents of each language: text, lang and whether the row only calibrates."""
    ids = F.col("doc_id").cast("long")
    known = docs.where("lang is not null and text is not null").where(id_remainder("doc_id", 4) != 2)
    hashed = known.select(ids.alias("_id"), "lang").withColumn("_hash", F.xxhash64("_id")).withColumn(
        "_slice", F.shiftright("_hash", 64 - (SLICES.bit_length() - 1)))
    # only slices that begin before the sample is full go on, so ranking a language sees little more than the sample
    counts = hashed.distinct().groupBy("lang", "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(
        Window.partitionBy("lang").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row per language and at most ``size`` ids of each, written so that Spark knows their size when it joins them
    ends = written(counts.withColumn("_before", before).where(F.col("_before") < size)
                   .groupBy("lang").agg(F.max("_slice").alias("_end")))
    order = Window.partitionBy("lang").orderBy("_hash", "_id")
    chosen = written(hashed.join(ends, "lang").where("_slice <= _end").distinct()
                     .withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= size).select("lang", "_id", "_place"))
    return written(known.select(ids.alias("_id"), "text", "lang").join(chosen, ["lang", "_id"])
                   .groupBy("lang", "_id", (F.col("_place") % 5 == 0).alias("checks")).agg(F.min("text").alias("text"))
                   .select("text", "lang", "checks"))


def _counted(sample: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(keys_of(character_codes(text)))
            for lang, parts in by.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "key", "n"])

    return in_arrow(sample.select("text", "lang"), run, "lang string, key long, n long").groupBy("lang", "key").agg(
        F.sum("n").alias("n"))


def learned(docs: DataFrame, sample: int = SAMPLE) -> CharacterModel | None:
    """Model from the training rows of ``docs``, None when there are none."""
    rows = _sample(docs, sample)
    got = _counted(rows.where("not checks")).toArrow()
    if not got.num_rows:
        return None
    languages, keys = got["lang"].to_numpy(zero_copy_only=False), got["key"].to_numpy().view(np.uint64)
    counts, n = {}, got["n"].to_numpy()
    for language in set(languages):
        own = languages == language
        order = np.argsort(keys[own])
        counts[language] = keys[own][order], n[own][order]
    model = fitted(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            values = shared.value.entropies(texts := batch.column(0).to_pylist())
            best = values.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(best), pa.array(values.min(axis=1)), pa.array([len(t) for t in texts], pa.int64())], ["best", "h", "n"])

    checks = in_arrow(rows.where("checks and length(text) >= 20").select("text"), measure, "best long, h double, n long")
    # spread: of one character, from the deviations of texts of all lengths
    found = {r.best: r for r in checks.groupBy("best").agg(
        F.max("h").alias("top"), F.stddev_pop(F.col("h") * F.sqrt("n")).alias("spread")).collect()}
    top = [found[i].top if i in found else np.inf for i in range(len(model.languages))]
    spread = [found[i].spread if i in found else 0.0 for i in range(len(model.languages))]
    model.ceiling, model.spread = np.array(top), np.array(spread)
    return model


def judged(model: CharacterModel | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, rejection and cross-entropy of each text."""
    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    rejected, entropy = np.ones(len(texts), bool), np.full(len(texts), np.nan)
    rows = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    if rows:
        values = model.entropies([texts[i] for i in rows])
        size = np.array([len(texts[i]) for i in rows])
        best = values.argmin(axis=1)
        least = values.min(axis=1)
        gap = np.exp(-TEMPER * size[:, None] * (values - least[:, None]))
        score[rows] = 1 / gap.sum(axis=1)
        entropy[rows] = least
        rejected[rows] = least > model.ceiling[best] + SLACK * model.spread[best] / np.sqrt(size)
        for i, b in zip(rows, best, strict=True):
            names[i] = model.languages[b]
    return names, score, rejected, entropy


def languages(docs: DataFrame, model: CharacterModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, cross_entropy (null when und) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in in_parts(batches):
            names, score, rejected, entropy = judged(shared.value, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(rejected),
                pa.array(entropy, from_pandas=True)], ["doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder("doc_id", 4) == 2).alias("held_out"), "text")
    return in_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double")


def accepted(docs: DataFrame, model: CharacterModel | None) -> DataFrame:
    """``docs`` without the rows that the models reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for batch in in_parts(batches):
            rejected = judged(shared.value, batch.column(place).to_pylist())[2]
            yield batch.filter(pa.array(~rejected))

    return in_arrow(docs, run, docs.schema)
