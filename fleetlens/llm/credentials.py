"""Secret scan: fixed patterns, and probabilistic automata inferred from the credentials that they find.

Base: three patterns (assign, access, hex), each leftmost and without overlaps. A match that is too short is dropped and the
search goes on behind it.

Method: the credentials of the base spans are labelled by their kind (for an assignment the value alone). Of each kind the
distinct values form a prefix tree whose states are merged where their frequencies of ending and of each next byte agree by
Hoeffding's bound (state merging in red-blue order, the merged state made deterministic by folding). The result is a
probabilistic automaton per kind. Candidates are all longest runs of at least CANDIDATE credential characters outside the
base spans. They train the ordinary side: one automaton of all candidates, and one for each plain shape (letters or digits
but not both, each with or without other characters), so that card numbers, addresses and words are likely there however
rare they are. Every candidate is scored: its log-likelihood under the best kind, less that under the best ordinary automaton.
A score of at least ODDS bits and RATE bits a byte adds a span of kind ``format``.

The automata are fitted on a bounded sample of labelled tokens: of each kind the SAMPLE distinct values with the smallest
hashes in the whole table, values longer than LONGEST bytes left out. The bottom of the hashes is taken per task, then per
hash bucket, then per kind, so every step is bounded and the sample does not depend on partitions. Base patterns, candidates
and scores cover all rows and whole texts at every size. Both passes are map tasks; only sample tokens are shuffled.

Cases: null and empty texts have no span (empty strings, digest of the empty text). Spans count code points. Rows that share
an id or a text are judged one by one. Without a labelled credential nothing is added. Empty tables give no rows; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from heapq import nsmallest
from math import log, log2

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow

#: Kinds in their order, with their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # a longest stretch of such characters, so the least length may stand in the pattern
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: Kind of the spans that the automata add, and of the tokens they are compared with.
ADDED, ORDINARY = "format", "ordinary"
_LOWER, _UPPER, _DIGIT = re.compile(rb"[a-z]"), re.compile(rb"[A-Z]"), re.compile(rb"[0-9]")
_OTHER = re.compile(rb"[+/_.=-]")
#: Least length of a candidate, and the alphabet of credentials (66 characters).
CANDIDATE = 12
TOKEN = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % CANDIDATE)
SYMBOLS = 68  # the alphabet, the end and one for any other byte
#: Bits by which a token must be likelier as a credential, in all and a byte.
ODDS, RATE = 20.0, 0.5
#: Distinct values of a kind to learn from, their longest, and hash buckets that are cut to the sample on their own.
SAMPLE, LONGEST, BUCKETS = 1000, 256, 256
#: Risk of the test that keeps two states apart, and what a state adds to the count of every symbol.
ALPHA, FLOOR = 0.05, 0.05
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,added:boolean>>"

Span = tuple[int, int, int]  # byte offsets and kind number: start, end, kind


def base_spans(text: bytes) -> list[Span]:
    """Base spans in bytes, by start, then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def candidates(text: bytes, spans: list[Span]) -> list[tuple[int, int]]:
    """Longest runs of credential characters that meet no base span."""
    out, at = [], 0
    ends = sorted((s, e) for s, e, _ in spans)
    for m in TOKEN.finditer(text):
        while at < len(ends) and ends[at][1] <= m.start():
            at += 1
        if not any(s < m.end() and e > m.start() for s, e in ends[at:at + 1]):
            out.append(m.span())
    return out


def plain_shape(token: bytes) -> str | None:
    """Name of a candidate's plain shape; None for letters mixed with digits, the shape of many credentials."""
    lower, upper, digit, other = (bool(p.search(token)) for p in (_LOWER, _UPPER, _DIGIT, _OTHER))
    return None if digit and (lower or upper) else f"{ORDINARY}{lower:d}{upper:d}{digit:d}{other:d}"


class Automaton:
    """Probabilistic automaton of a set of tokens, by merging compatible states of their prefix tree.

    A state has the number of tokens that pass it and that end in it, and for each next byte a count and a target.
    """

    def __init__(self, tokens: list[bytes]) -> None:
        self.passed, self.ended = [0], [0]
        self.counts: list[dict[int, int]] = [{}]
        self.targets: list[dict[int, int]] = [{}]
        for token in tokens:
            at = 0
            for symbol in token:
                self.passed[at] += 1
                self.counts[at][symbol] = self.counts[at].get(symbol, 0) + 1
                if symbol not in self.targets[at]:
                    self.targets[at][symbol] = len(self.passed)
                    self.passed.append(0)
                    self.ended.append(0)
                    self.counts.append({})
                    self.targets.append({})
                at = self.targets[at][symbol]
            self.passed[at] += 1
            self.ended[at] += 1
        kept = self._merged()
        self.table = {}
        for at in kept:
            total = self.passed[at] + FLOOR * SYMBOLS
            row = {s: (log2((n + FLOOR) / total), self.targets[at][s]) for s, n in self.counts[at].items()}
            self.table[at] = row, log2((self.ended[at] + FLOOR) / total), (log2(FLOOR / total), 0)
        del self.passed, self.ended, self.counts, self.targets

    def _merged(self) -> list[int]:
        """Merge states in breadth-first order; the states that stay."""
        kept = [0]
        while True:
            open_states = ((a, s, b) for a in kept for s, b in sorted(self.targets[a].items()) if b not in kept)
            following = next(open_states, None)
            if following is None:
                return kept
            parent, symbol, state = following
            like = next((a for a in kept if self._compatible(a, state)), None)
            if like is None:
                kept.append(state)
            else:
                self.targets[parent][symbol] = like
                self._fold(like, state)

    def _differ(self, n1: int, f1: int, n2: int, f2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > (0.5 * log(2 / ALPHA)) ** 0.5 * (n1 ** -0.5 + n2 ** -0.5)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether two states, and all that follows both, agree; ``b`` is the root of a tree, so this ends."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.passed[a], self.passed[b]
            if self._differ(n1, self.ended[a], n2, self.ended[b]):
                return False
            for s in self.counts[a].keys() | self.counts[b].keys():
                if self._differ(n1, self.counts[a].get(s, 0), n2, self.counts[b].get(s, 0)):
                    return False
                if s in self.targets[a] and s in self.targets[b]:
                    todo.append((self.targets[a][s], self.targets[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to what follows ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for s, n in self.counts[b].items():
                self.counts[a][s] = self.counts[a].get(s, 0) + n
                if s in self.targets[a]:
                    todo.append((self.targets[a][s], self.targets[b][s]))
                else:
                    self.targets[a][s] = self.targets[b][s]

    def bits(self, token: bytes) -> float:
        """Logarithm of the token's probability; an unknown byte goes back to the first state."""
        at, out = 0, 0.0
        for symbol in token:
            row, _, unknown = self.table[at]
            bits, at = row.get(symbol, unknown)
            out += bits
        return out + self.table[at][1]


class Scorer:
    """Automata of the kinds and of ordinary tokens; remembers the tokens of a worker up to a bound."""

    LIMIT = 200_000

    def __init__(self, samples: dict[str, list[bytes]]) -> None:
        self.formats = [Automaton(samples[k]) for k in KINDS if samples.get(k)]
        self.ordinary = [Automaton(tokens) for kind, tokens in sorted(samples.items()) if kind not in KINDS]
        self.seen: dict[bytes, bool] = {}

    def odds(self, token: bytes) -> float:
        """Bits by which the token is likelier as a credential of its best kind than as the best ordinary token."""
        return max(a.bits(token) for a in self.formats) - max((a.bits(token) for a in self.ordinary), default=float("-inf"))

    def secret(self, token: bytes) -> bool:
        if token not in self.seen:
            if len(self.seen) >= self.LIMIT:
                self.seen.clear()
            self.seen[token] = self.odds(token) >= max(ODDS, RATE * len(token))
        return self.seen[token]


def spans_of(text: bytes, scorer: Scorer) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, added) in code points, by start, then kind."""
    base = base_spans(text)
    found = [(s, e, k) for s, e, k in base]
    found += [(s, e, len(KINDS)) for s, e in candidates(text, base) if scorer.secret(text[s:e])] if scorer.formats and scorer.ordinary else []
    if not found:
        return []
    place, at, points = {}, 0, 0
    for offset in sorted({x for s, e, _ in found for x in (s, e)}):
        points += len(text[at:offset].decode("utf-8", "replace"))
        place[offset], at = points, offset
    found.sort(key=lambda s: (s[0], s[2]))
    return [((*KINDS, ADDED)[k], place[s], place[e], k == len(KINDS)) for s, e, k in found]


def _tokens(docs: DataFrame, sample: int) -> DataFrame:
    """(kind, value, hash): of every task and kind, the distinct values with the smallest hashes."""

    def run(batches):
        best: dict[str, dict[bytes, int]] = {}

        def note(kind: str, value: bytes) -> None:
            own = best.setdefault(kind, {})
            if len(value) <= LONGEST and value not in own:
                own[value] = xxhash.xxh3_64_intdigest(value) >> 1
                if len(own) >= 4 * sample:
                    best[kind] = dict(nsmallest(sample, own.items(), key=lambda r: (r[1], r[0])))

        for batch in batches:
            for cell in batch.column(0).cast(pa.binary()):
                if text := cell.as_py():
                    spans = base_spans(text)
                    for start, end, kind in spans:
                        value = ASSIGN.fullmatch(text[start:end]).group(2) if kind == 0 else text[start:end]
                        note(KINDS[kind], value)
                    for start, end in candidates(text, spans):
                        note(ORDINARY, token := text[start:end])
                        if shape := plain_shape(token):
                            note(shape, token)
        for kind, own in best.items():
            rows = nsmallest(sample, own.items(), key=lambda r: (r[1], r[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(rows), pa.string()), pa.array([v for v, _ in rows], pa.binary()),
                 pa.array([h for _, h in rows], pa.int64())], ["kind", "value", "hash"])

    return in_arrow(docs.select("text"), run, "kind string, value binary, hash long")


def learned(docs: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Automata from the credentials that the base patterns label in ``docs``, and from other tokens."""
    rows = _tokens(docs, sample).dropDuplicates(["kind", "value"]).withColumn("bucket", F.col("hash") % BUCKETS)
    for group in (["kind", "bucket"], ["kind"]):  # the second step sees at most BUCKETS samples of each kind
        order = Window.partitionBy(*group).orderBy("hash", "value")
        rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    samples: dict[str, list[bytes]] = {}
    for r in sorted(rows.select("kind", "hash", "value").collect()):
        samples.setdefault(r.kind, []).append(bytes(r.value))
    return Scorer(samples)


def secret_spans(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and spans (kind, start, end, added) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))
    names = ("kind", "start", "end", "added")

    def run(batches):
        for batch in batches:
            rows = [[dict(zip(names, span, strict=True)) for span in spans_of(cell.as_py() or b"", shared.value)]
                    for cell in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def span_digest(found: DataFrame) -> DataFrame:
    """Base counts, the base digest and the list of all spans of the rows of ``secret_spans``."""
    base = F.filter("spans", lambda s: ~s["added"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
