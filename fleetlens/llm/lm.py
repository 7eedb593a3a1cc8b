"""Bigram language model in compact tries, and the scores of all texts.

Text is cut into words (A-Z lower-cased) and one end token. The model is the interpolation
p(w | h) = WEIGHT * c(h w) / c(h) + (1 - WEIGHT) * p(w) with p(w) = (c + 0.1) / (N + 0.1 (V + 1)); after
a word that training never saw, p(w | h) = p(w). Before the first word stands a start mark.

Documents are packed into blocks: token numbers beside one list of distinct words, written once.
Each block sends every distinct pair once, with its training count, to a bucket of the context's
hash; the bucket adds up what all blocks sent, builds its part of the trie and answers each block:
a probability code for each pair and the count of each context. Every word has a successor, so the
contexts' counts are the words' counts. The blocks then sum up their documents. So the counts of
the whole corpus are used, a task holds one block or one bucket, and both numbers follow the tokens.

* level one: sorted context hashes in Elias-Fano code, and an Elias-Fano list of monotone pointers;
* level two: the successors' hashes, made monotone over contexts, in Elias-Fano code, beside the
  weighted probabilities WEIGHT * c(h w) / c(h) as 16-bit logarithms;
* a pair is looked up by the context's range and a successor search inside it.

The levels are written to a file and memory-mapped by the task, which unlinks the file at once. A
context with more than 1 / ``HOT`` of all tokens is dealt by context and word over all buckets; each
counts its part, and the parts are added up. At most ``HOT`` such contexts exist; only their hashes
and counts go through the driver.

Null and empty texts are the end token alone. A null id counts as training. Rows are documents;
repeated rows are scored alike. Without training rows N is 0 and every token is unknown. Extra
columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import id_remainder, in_arrow, in_groups, mixed, words_of

WEIGHT, SMOOTHING = 0.4, 0.1
BLOCK_TOKENS, BUCKET_TOKENS, LEAST_BUCKETS, HOT = 500_000, 1 << 20, 32, 1024
END, START = b"\n", b"\t"  # never words
STEPS, LOWEST, MISSING = 65534, -24.0, 65535
SUCCESSOR_BITS = 40


class EliasFano:
    """A non-decreasing list of numbers below 2**62: low bits packed, high parts in unary, sampled for access."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int, size: int):
        self.low, self.high, self.bits, self.size = low, high, bits, size
        self._ones: np.ndarray | None = None

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max(0, (most // max(1, n)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(places[-1]) + 8) // 8 if n else 1, np.uint8)
        np.bitwise_or.at(unary, places >> 3, (1 << (places & 7)).astype(np.uint8))
        return EliasFano(low, unary, bits, n)

    def _places(self) -> np.ndarray:
        if self._ones is None:
            self._ones = np.nonzero(np.unpackbits(np.asarray(self.high), bitorder="little"))[0][:self.size]
        return self._ones

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self._places()[at] - at).astype(np.uint64) << np.uint64(self.bits)
        if not self.bits:
            return high
        start = at.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
        value = self.low[word] >> shift
        spill = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return high | ((value | spill) & np.uint64((1 << self.bits) - 1))

    def search(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """First position in [lo, hi) whose number is at least the value, for many values at once."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.nonzero(lo < hi)[0]
            if not len(open_):
                return lo
            middle = (lo[open_] + hi[open_]) >> 1
            less = self.get(middle) < values[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]


def quantised(logs: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(logs, LOWEST, 0) / LOWEST * STEPS).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (LOWEST / STEPS)


class Trie:
    """Two levels: contexts, then their successors with quantised log10 probabilities."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @staticmethod
    def build(contexts: np.ndarray, ranges: np.ndarray, successors: np.ndarray, logs: np.ndarray) -> Trie:
        """``ranges`` has one entry more than ``contexts``; ``successors`` are sorted within a range."""
        base = np.repeat(np.arange(len(contexts), dtype=np.uint64) << np.uint64(SUCCESSOR_BITS), np.diff(ranges))
        return Trie(EliasFano.encode(contexts), EliasFano.encode(ranges), EliasFano.encode(base | successors), quantised(logs))

    def mapped(self) -> Trie:
        """The same levels in one memory-mapped file of this task, which is unlinked while it is open."""
        parts = [x for level in (self.contexts, self.pointers, self.successors) for x in (level.low, level.high)] + [self.codes]
        with tempfile.NamedTemporaryFile(delete=False) as out:
            starts = []
            for part in parts:
                out.write(b"\0" * (-out.tell() % 8))
                starts.append(out.tell())
                out.write(np.ascontiguousarray(part).tobytes())
        try:
            whole = np.memmap(out.name, np.uint8, "r")
        finally:
            os.unlink(out.name)
        views = [whole[s:s + p.nbytes].view(p.dtype) for s, p in zip(starts, parts, strict=True)]
        levels = [EliasFano(views[2 * i], views[2 * i + 1], e.bits, e.size)
                  for i, e in enumerate((self.contexts, self.pointers, self.successors))]
        return Trie(*levels, views[6])

    def lookup(self, contexts: np.ndarray, owner: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Code of each pair (contexts[owner], successor); MISSING where the trie has no such pair."""
        out = np.full(len(owner), MISSING, np.uint16)
        if not len(owner) or not self.successors.size:
            return out
        n = self.contexts.size
        at = self.contexts.search(contexts, np.zeros(len(contexts), np.int64), np.full(len(contexts), n))
        there = at < n
        there[there] = self.contexts.get(at[there]) == contexts[there]
        at = np.minimum(at, n - 1)
        lo, hi = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        hi[~there] = lo[~there]
        # relative to the context: a successor is searched for inside the context's range alone
        value = (at.astype(np.uint64) << np.uint64(SUCCESSOR_BITS))[owner] | successors
        end = hi[owner]
        place = self.successors.search(value, lo[owner], end)
        hit = np.nonzero(place < end)[0]
        hit = hit[self.successors.get(place[hit]) == value[hit]]
        out[hit] = self.codes[place[hit]]
        return out


def _packed(batches):
    """Blocks of whole documents with at most BLOCK_TOKENS tokens, or one longer document."""
    place: dict[bytes, int] = {START: 0, END: 1}
    ids, flags, lengths, parts, size = [], [], [], [], 0

    def block():
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, len(place)) >> np.uint64(2)
        tokens, sizes = np.concatenate(parts), np.array(lengths, np.int32)
        train = np.repeat(np.array(flags, np.uint8) & 1 == 0, sizes)
        counts = np.bincount(tokens, minlength=len(place))
        counts[0] = len(ids)
        often = np.nonzero(counts * 2 * HOT >= size)[0]
        # one byte plane after the other: the upper ones are nearly all zero
        planes = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        return pa.RecordBatch.from_arrays([
            *[pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, np.int64), np.array(flags, np.uint8), sizes, planes, hashes)],
            pa.array([size], pa.int64()), pa.array([int(train.sum())], pa.int64()),
            pa.array([sum(1 for f in flags if not f & 1)], pa.int64()),
            pa.array([hashes[often].view(np.int64).tolist()], pa.list_(pa.int64())),
            pa.array([counts[often].tolist()], pa.list_(pa.int64()))],
            ["ids", "flags", "lengths", "tokens", "words", "n", "n_train", "train_docs", "hot", "hot_n"])

    for batch in batches:
        for i, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = words_of(text)
            if ids and size + len(words) >= BLOCK_TOKENS:
                yield block()
                place = {START: 0, END: 1}
                ids, flags, lengths, parts, size = [], [], [], [], 0
            for w in words:
                if w not in place:
                    place[w] = len(place)
            ids.append(i or 0)
            flags.append(held | (i is None) << 1)
            lengths.append(len(words) + 1)
            parts += [np.fromiter(map(place.__getitem__, words), np.int32, len(words)), np.ones(1, np.int32)]
            size += len(words) + 1
    if ids:
        yield block()


class Block:
    """A block's arrays and its pairs in the order in which they are sent and answered."""

    def __init__(self, flags, lengths, tokens, words, hot: np.ndarray, buckets: int):
        self.flags, self.lengths = np.frombuffer(flags, np.uint8), np.frombuffer(lengths, np.int32)
        self.tokens = np.ascontiguousarray(np.frombuffer(tokens, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int32)
        self.words = np.frombuffer(words, np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = 0
        self.before = before
        keys, self.pair_of = np.unique(before.astype(np.int64) << 32 | self.tokens, return_inverse=True)
        context, word = keys >> 32, keys & 0xFFFFFFFF
        spread = np.isin(self.words, hot)
        target = np.where(spread[context], mixed(self.words[context] ^ mixed(self.words[word])), mixed(self.words[context]))
        to = (target % np.uint64(buckets)).astype(np.int64)
        successor = self.words[word] & np.uint64((1 << SUCCESSOR_BITS) - 1)
        self.order = np.lexsort((successor, self.words[context], to))
        self.context, self.successor = context[self.order], successor[self.order]
        self.edges = np.searchsorted(to[self.order], np.arange(buckets + 1))

    def part(self, bucket: int) -> tuple[slice, np.ndarray, np.ndarray]:
        """The bucket's pairs, the first pair of each context, and these contexts."""
        own = slice(self.edges[bucket], self.edges[bucket + 1])
        context = self.context[own]
        first = np.nonzero(np.diff(context, prepend=-1))[0] if len(context) else np.empty(0, np.int64)
        return own, first, context[first]


def _sent(hot: np.ndarray, buckets: int):
    """The pairs of each block for each bucket: contexts, number of successors, successors, training counts."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(*(batch.column(i)[row].as_buffer() for i in range(1, 5)), hot, buckets)
                train = np.repeat(block.flags & 1 == 0, block.lengths)
                counts = np.bincount(block.pair_of[train], minlength=len(block.order))[block.order].astype(np.uint32)
                for i in range(buckets):
                    own, first, contexts = block.part(i)
                    if not len(first):
                        continue
                    size = own.stop - own.start
                    bytes_ = block.successor[own].view(np.uint8).reshape(-1, 8)[:, :SUCCESSOR_BITS // 8].T
                    yield pa.RecordBatch.from_arrays([
                        pa.array([i], pa.int64()), pa.array([batch.column(0)[row].as_py()], pa.int64()),
                        *[pa.array([x.tobytes()], pa.binary()) for x in (
                            block.words[contexts], np.diff(np.append(first, size)).astype(np.uint32), np.ascontiguousarray(bytes_),
                            counts[own])]], ["bucket", "block", "contexts", "sizes", "successors", "counts"])

    return run


def _answered(hot: np.ndarray):
    """Build the bucket's trie from what all blocks sent and answer each of them."""
    start = xxhash.xxh3_64_intdigest(START) >> 2

    def run(pdf):
        import pandas as pd

        contexts = [np.frombuffer(x, np.uint64) for x in pdf["contexts"]]
        sizes = [np.frombuffer(x, np.uint32) for x in pdf["sizes"]]
        successors = []
        for x in pdf["successors"]:
            planes = np.frombuffer(x, np.uint8).reshape(SUCCESSOR_BITS // 8, -1)
            full = np.zeros((planes.shape[1], 8), np.uint8)
            full[:, :SUCCESSOR_BITS // 8] = planes.T
            successors.append(full.view(np.uint64).ravel())
        every = np.unique(np.concatenate(contexts))
        at = [np.repeat(np.searchsorted(every, c), n) for c, n in zip(contexts, sizes, strict=True)]
        counts = [np.frombuffer(x, np.uint32).astype(np.int64) for x in pdf["counts"]]
        used = [c > 0 for c in counts]
        owner = np.concatenate([a[u] for a, u in zip(at, used, strict=True)])
        word = np.concatenate([s[u] for s, u in zip(successors, used, strict=True)])
        number = np.concatenate([c[u] for c, u in zip(counts, used, strict=True)])
        order = np.lexsort((word, owner))
        owner, word, number = owner[order], word[order], number[order]
        del at, counts, used, order
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])
        first = np.nonzero(new)[0]
        number = np.add.reduceat(number, first) if len(first) else number
        owner, word = owner[first], word[first]
        total = np.bincount(owner, weights=number, minlength=len(every)).astype(np.int64)
        logs = np.log10(WEIGHT * number / np.maximum(total[owner], 1))
        kept, begin = np.unique(owner, return_index=True)
        trie = Trie.build(every[kept], np.append(begin, len(owner)), word, logs).mapped()
        del owner, word, number, logs, new, first
        codes, back = [], []
        for c, n, s in zip(contexts, sizes, successors, strict=True):
            codes.append(trie.lookup(c, np.repeat(np.arange(len(c)), n), s).tobytes())
            back.append(total[np.searchsorted(every, c)].astype(np.int64).tobytes())
        hot_here = np.isin(every, hot)
        counted = int(np.sum((total > 0) & ~hot_here & (every != np.uint64(start))))
        seen = (total > 0) & hot_here
        seen, seen_n = every[seen].view(np.int64).tolist(), total[seen].tolist()
        one = np.arange(len(codes)) == 0
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "codes": codes, "totals": back,
                             "kinds": np.where(one, counted, 0), "hot_seen": [seen if x else [] for x in one],
                             "hot_n": [seen_n if x else [] for x in one]})

    return run


def _summed(hot: np.ndarray, hot_totals: np.ndarray, buckets: int, tokens: int, kinds: int, training_docs: int):
    """Scores of the documents of each block from the buckets' answers."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(*(batch.column(i)[row].as_buffer() for i in range(1, 5)), hot, buckets)
                answers = {x["bucket"]: x for x in batch.column(6)[row].as_py()}
                counts = np.zeros(len(block.words), np.int64)
                share = np.zeros(len(block.order))
                for i, x in answers.items():
                    _, _, contexts = block.part(i)
                    counts[contexts] += np.frombuffer(x["totals"], np.int64)
                # parts of a spread context may lie in buckets that this block never asked
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, block.words), len(hot) - 1)
                    counts = np.where(hot[at] == block.words, hot_totals[at], counts)
                for i, x in answers.items():
                    own, first, contexts = block.part(i)
                    mine = np.frombuffer(x["totals"], np.int64) / np.maximum(counts[contexts], 1)
                    codes = np.frombuffer(x["codes"], np.uint16)
                    part = np.repeat(mine, np.diff(np.append(first, own.stop - own.start)))
                    share[own] = np.where(codes == MISSING, 0.0, part * 10 ** restored(codes))
                # the end of a text has no successor; it ends every training document, as the start begins it
                counts[1] = training_docs
                single = (counts + SMOOTHING) / (tokens + SMOOTHING * (kinds + 1))
                by_pair = np.empty(len(block.order))
                by_pair[block.order] = share
                known_context = counts[block.before] > 0
                p = by_pair[block.pair_of] + np.where(known_context, 1 - WEIGHT, 1.0) * single[block.tokens]
                sums = [np.add.reduceat(x, block.starts) for x in (
                    (counts > 0)[block.tokens].astype(np.int64), np.log10(single)[block.tokens], np.log10(p))]
                ids = np.frombuffer(batch.column(5)[row].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, mask=block.flags & 2 > 0), pa.array(block.flags & 1 > 0), pa.array(block.lengths.astype(np.int64)),
                    pa.array(sums[0]), pa.array(np.full(len(ids), tokens)), pa.array(sums[1]), pa.array(sums[2])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def scored(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = (id_remainder("doc_id", 10) == 0).cast("int").alias("held")
    blocks = in_arrow(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text"), _packed,
        "ids binary, flags binary, lengths binary, tokens binary, words binary, n long, n_train long, train_docs long,"
        " hot array<long>, hot_n array<long>")
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()))
    size = blocks.agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"), F.sum("train_docs").alias("docs")).first()
    buckets = max(LEAST_BUCKETS, -(-(size.n or 0) // BUCKET_TOKENS))
    often = blocks.select(F.explode(F.arrays_zip("hot", "hot_n")).alias("h")).groupBy("h.hot").agg(F.sum("h.hot_n").alias("n"))
    hot = np.array([r.hot for r in often.where(F.col("n") * HOT >= (size.n or 0)).select("hot").collect()], np.int64).view(np.uint64)
    hot.sort()
    body = ["block", "flags", "lengths", "tokens", "words"]
    sent = in_arrow(blocks.select(*body), _sent(hot, buckets),
                    "bucket long, block long, contexts binary, sizes binary, successors binary, counts binary")
    answers = written(in_groups(sent, ["bucket"], _answered(hot),
                                "block long, bucket long, codes binary, totals binary, kinds long, hot_seen array<long>, hot_n array<long>"))
    kinds = answers.agg(F.sum("kinds").alias("k")).first().k or 0
    parts = answers.select(F.explode(F.arrays_zip("hot_seen", "hot_n")).alias("h")).groupBy("h.hot_seen").agg(F.sum("h.hot_n").alias("n"))
    totals = {np.uint64(r.hot_seen): r.n for r in parts.collect()}  # at most HOT rows
    hot_totals = np.array([totals.get(h, 0) for h in hot], np.int64)
    kinds += sum(h != np.uint64(xxhash.xxh3_64_intdigest(START) >> 2) for h in totals) + (1 if size.docs else 0)
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "codes", "totals")).alias("answers"))
    rows = blocks.select(*body, "ids").join(by_block, "block").select(*body, "ids", "answers")
    return in_arrow(rows, _summed(hot, hot_totals, buckets, size.n_train or 0, int(kinds), size.docs or 0),
                    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
