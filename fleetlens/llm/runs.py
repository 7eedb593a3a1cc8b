"""Periodic runs of words, found as maximal pairs in a bottom-up LCP-interval tree.

A run is a stretch of consecutive words with smallest period q and length >= max(LEAST, 4 * q) that no neighbouring word
extends keeping period q. Two occurrences i < j of the same l words, followed and preceded by different words, are a
maximal pair; with j - i <= l / 3 the words i .. j + l have period j - i and neither side extends them, so maximal pairs whose
distance meets the length constraints are exactly the runs (a multiple of the smallest period gives the same stretch again;
the least distance of a stretch is kept).

Suffixes are sorted by prefix doubling over numpy arrays. Words are numbered per document and each document ends in a symbol
of its own, so that many short documents share the arrays and no match crosses documents; only suffixes that share four words
with another one stay in the sort. The tree is never stored: intervals are closed bottom-up from a stack, each with the
positions of its suffixes, in word order and tagged by the word to their left (their left-word class). When a child joins an
interval, the smaller list looks up its next neighbours of another class in the larger one. For a run's own period these two
are neighbours in word order: an occurrence between them would give the stretch a smaller period. So a text of n words takes
O(n log n) look-ups, however long or repetitive it is.

Every document is a map task's own work: no shuffle, no state, a lost executor repeats its partition. Memory is bounded by
SLICE words and the longest text.

Cases: null, empty and blank texts have no words, no run and an empty collapsed text. A null id stays null. Rows that share
an id or a text are judged one by one, empty tables give no rows, other columns are ignored. Bytes that are not white space
are never interpreted, so any text is valid.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: A run has at least so many words, and at least four periods.
LEAST = 6
#: A pair of such a stretch shares so many words at least.
SHARED = LEAST - 1
#: Words that share one set of arrays; a longer text has arrays of its own.
SLICE = 400_000
#: Positions in a block of a long list.
BLOCK = 2_000
SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

Change = Callable[[int | None, list[bytes]], list[bytes]]


class Positions:
    """Sorted positions in blocks, so that adding one moves few others."""

    def __init__(self, values: list[int]) -> None:
        self.blocks = [values[i:i + BLOCK] for i in range(0, len(values), BLOCK)]
        self.firsts = [b[0] for b in self.blocks]
        self.size = len(values)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def near(self, x: int) -> Iterator[int]:
        """The next smaller and the next larger position."""
        at = max(bisect_left(self.firsts, x) - 1, 0)
        block = self.blocks[at]
        i = bisect_left(block, x)
        if i:
            yield block[i - 1]
        if i < len(block):
            yield block[i]
        elif at + 1 < len(self.blocks):
            yield self.firsts[at + 1]

    def add(self, x: int) -> None:
        at = max(bisect_left(self.firsts, x) - 1, 0)
        block = self.blocks[at]
        insort(block, x)
        self.firsts[at] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[at:at + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts[at:at + 1] = [block[0], block[BLOCK]]


def suffix_ranks(codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... symbols, and those that share four symbols with another one.

    Equal ranks mean equal symbols. The last symbol of every document must occur nowhere else.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    place = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    levels, shared = [rank.astype(np.int32) if n < 1 << 31 else rank], np.arange(0)
    active = order[~(new & np.append(new[1:], True))]
    step = 1
    while len(active):
        group = rank[active]
        key = group * n + rank[active + step]
        by = np.argsort(key, kind="stable")
        active, key, group = active[by], key[by], group[by]
        place = np.arange(len(active))
        new, first = np.ones(len(active), bool), np.ones(len(active), bool)
        new[1:], first[1:] = key[1:] != key[:-1], group[1:] != group[:-1]
        rank[active] = group + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        levels.append(rank.astype(levels[0].dtype))
        active = active[~(new & np.append(new[1:], True))]
        step *= 2
        if step == 4:
            shared = active
    return levels, shared[np.argsort(rank[shared])]


def shared_lengths(levels: list[np.ndarray], suffixes: np.ndarray) -> np.ndarray:
    """Number of leading symbols that each suffix shares with the next one."""
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    for j in range(len(levels) - 1, -1, -1):
        more = (levels[j][a] == levels[j][b]).astype(np.int64) << j
        a += more
        b += more
    return a - suffixes[:-1]


def maximal_pairs(codes: np.ndarray) -> dict[tuple[int, int], int]:
    """Least distance of the maximal pairs by the stretch (start, end) that they cover, for pairs that are runs."""
    levels, suffixes = suffix_ranks(codes)
    found: dict[tuple[int, int], int] = {}
    if len(suffixes) < 2:
        return found
    lengths = shared_lengths(levels, suffixes).tolist()
    left = codes[suffixes - 1].tolist()
    suffixes = suffixes.tolist()
    left_class = dict(zip(suffixes, left, strict=True))

    def joined(one, other, length: int):
        """All positions of two children of an interval of ``length`` shared words; their maximal pairs are noted."""
        if len(other) > len(one):
            one, other = other, one
        reach = length // 3
        for x in other:
            if type(one) is list:
                i = bisect_left(one, x)
                near = one[max(i - 1, 0):i + 1]
            else:
                near = one.near(x)
            for y in near:
                if -reach <= y - x <= reach and left_class[x] != left_class[y]:
                    period = abs(x - y)
                    stretch = min(x, y), max(x, y) + length
                    if found.setdefault(stretch, period) > period:
                        found[stretch] = period
        if type(one) is list and len(one) + len(other) > 4 * BLOCK:
            one = Positions(one)
        if type(one) is list:
            if len(other) > 12:
                one.extend(other)
                one.sort()
            else:
                for x in other:
                    insort(one, x)
        else:
            for x in other:
                one.add(x)
        return one

    stack: list[tuple[int, list | Positions]] = []
    for at, length in enumerate([*lengths, 0]):
        child = [suffixes[at]]
        while stack and stack[-1][0] > length:
            depth, before = stack.pop()
            child = joined(before, child, depth)
        if length >= SHARED:
            if stack and stack[-1][0] == length:
                stack[-1] = length, joined(stack[-1][1], child, length)
            else:
                stack.append((length, child))
    return found


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each word list, by start, then period."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    codes = np.empty(1 + (int(ends[-1]) if len(ends) else 0), np.int64)
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(sizes.sum()))
    last = np.concatenate([[0], ends])  # the places of the symbols between documents
    inner = np.ones(len(codes), bool)
    inner[last] = False
    codes[last] = -1 - np.arange(len(last))
    codes[inner] = words + np.repeat(np.arange(len(texts)), sizes) * max(len(numbers), 1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    pairs = maximal_pairs(codes)
    if pairs:
        starts = np.fromiter((s for s, _ in pairs), np.int64, len(pairs))
        documents = np.searchsorted(last, starts) - 1
        for d, ((start, end), period) in zip(documents.tolist(), pairs.items(), strict=True):
            out[d].append((start - int(last[d]) - 1, end - start, period))
    for rows in out:
        rows.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join(w for w, d in zip(words, np.cumsum(depth).tolist(), strict=False) if not d)


def periodic_runs(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """doc_id, runs (start, length, period) and the collapsed text of every row; ``change`` may replace a row's words first."""

    def judged(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts)
        rows = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
        kept = pa.array([collapsed(t, r) for t, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string(), safe=False)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, kind), kept], ["doc_id", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").split()  # bytes are cut at exactly the six ASCII white-space bytes
                ids.append(i)
                texts.append(change(i, words) if change else words)
                size += len(words)
                if size >= SLICE:
                    yield judged(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield judged(ids, texts)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def with_planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a row as the contract of the query changes them: every tenth document gets a periodic tail."""
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def run_digest(found: DataFrame) -> DataFrame:
    """Counts, longest run and digests of the rows of ``periodic_runs``."""
    # sorted by length, then by smaller start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line: Callable[[Column], Column] = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"), F.floor(1000 * F.col("best.n") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
