"""Prefix trie of conversations: union-find over the LCP edges of sorted neighbours, in descending depth.

A conversation is the sequence of its turns; a turn counts as its role and text, known by a 128-bit part of their SHA-256, so
texts are never shuffled. Sequences are sorted and dealt to ranges by (sequence, conv_id), which spreads a group of equal
sequences over as many ranges as its rows need. Inside a range every neighbour pair is an edge whose depth is the number of
turns that both share. Edges join components deepest first: a merge at depth d makes (or adds to) a branching node of d
turns, and the turns between it and a merged component's own node are nodes with one child.

A node of a range is closed when it holds neither the range's first nor its last sequence: all its members are there, and its
rows are final. The others lie on the two boundary paths. Each range hands them on as a contracted forest: one item per open
branching node, with the sums over what is closed below it. Items of FAN neighbouring ranges go through the same step again,
until one forest is left and nothing is open. An item count depends on the turns of two sequences a range, not on members.
Rows below a node that was still open get their parent's conv_id by a join on the node's digest, from a table of open nodes.

Sums over a subtree are final where a node is closed, so there is no pass over levels. The digest of the members that end in
a node is a stream of ids in order; a group that crosses a range boundary is written as pieces of IDS ids, and the task
that joins them holds one piece at a time.

Bounds: a conversation is one row of about 40 bytes a turn while it is put in order; a task holds one range (about RANGE
turns, and the longest conversation) or the items of FAN ranges. Tables are written between steps, so a lost executor
repeats tasks of one step.

Cases: rows without a conv_id belong to no conversation and are left out. Null turns come first, then smaller numbers; equal
turn numbers go by role, then by digest. Null roles and texts are empty. Repeated rows are turns of their own. Conversations
without turns end in the root. An empty table has no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import WORD, in_arrow, in_groups

#: Bytes of a turn's digest.
WIDTH = 16
#: Turns of a range, ranges whose contracted forests meet in one task, ids in a piece of a long list.
RANGE, FAN, IDS = 500_000, 64, 4096
EMPTY = hashlib.sha256(b"").hexdigest()
OPEN = "?"  # the ids of this node are joined from pieces
#: Columns of a step's rows: trie nodes, items of the contracted forest, and pieces of id lists.
FIELDS = [
    ("tag", pa.string(), "string"), ("conv_id", pa.int64(), "long"), ("depth", pa.int64(), "long"),
    ("parent_conv_id", pa.int64(), "long"), ("parent_ref", pa.binary(), "binary"), ("ref", pa.binary(), "binary"),
    ("n_convs", pa.int64(), "long"), ("n_children", pa.int64(), "long"), ("n_leaves", pa.int64(), "long"),
    ("saved_tokens", pa.int64(), "long"), ("ends", pa.string(), "string"), ("range", pa.int64(), "long"),
    ("path", pa.binary(), "binary"), ("words", pa.list_(pa.int64()), "array<long>"), ("first", pa.bool_(), "boolean"),
    ("last", pa.bool_(), "boolean"), ("piece", pa.int64(), "long"), ("ids", pa.string(), "string"),
]
NAMES = [n for n, _, _ in FIELDS]
SCHEMA = ", ".join(f"{n} {t}" for n, _, t in FIELDS)
ARROW = pa.schema([(n, t) for n, t, _ in FIELDS])


def ref_of(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()[:WIDTH]


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of leading turns of both paths, by halving."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[:high * WIDTH] == b[:high * WIDTH]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        if a[low * WIDTH:middle * WIDTH] == b[low * WIDTH:middle * WIDTH]:
            low = middle
        else:
            high = middle
    return low


class Node:
    """A component's node: its place, and the sums over members and closed subtrees that hang directly below it."""

    __slots__ = ("path", "words", "depth", "n", "least", "children", "leaves", "saved", "ends", "first", "last", "below")

    def __init__(self, path: bytes, words: list[int], depth: int, n: int = 0, least: int | None = None, children: int = 0,
                 leaves: int = 0, saved: int = 0, ends: str | None = None, first: bool = False, last: bool = False) -> None:
        self.path, self.words, self.depth = path, words, depth
        self.n, self.least, self.children, self.leaves, self.saved, self.ends = n, least, children, leaves, saved, ends
        self.first, self.last = first, last
        self.below: list[dict] = []  # rows that wait for this node's conv_id

    def add(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)


class Forest:
    """Joins neighbouring nodes to a forest and gives the rows of what is closed and the items of what is open."""

    def __init__(self, inner: bool) -> None:
        self.inner = inner  # rows of later steps carry their digest, for the rows that wait for them
        self.rows: list[dict] = []
        self.items: list[dict] = []

    def _absorb(self, node: Node, same: Node) -> None:
        node.add(same.n, same.least)
        node.children += same.children
        node.leaves += same.leaves
        node.saved += same.saved
        node.ends = same.ends if node.ends is None or same.ends == OPEN else node.ends
        node.first |= same.first
        node.last |= same.last
        small, large = sorted((node.below, same.below), key=len)
        large.extend(small)
        node.below = large

    def _attach(self, node: Node, child: Node) -> None:
        """Add a component of a deeper node: closed ones as rows and sums, open ones as an item."""
        if child.first or child.last:
            self._hand_on(child)
            node.first |= child.first
            node.last |= child.last
            return
        leaves, saved = child.leaves if child.children else 1, child.saved
        for depth in range(child.depth, node.depth, -1):
            own = depth == child.depth
            saved += (child.n - 1) * child.words[depth - 1]
            row = {"conv_id": child.least, "depth": depth, "parent_conv_id": child.least, "n_convs": child.n,
                   "n_children": child.children if own else 1, "n_leaves": leaves, "saved_tokens": saved,
                   "ends": child.ends if own else None, "ref": ref_of(child.path[:depth * WIDTH]) if own and self.inner else None}
            self.rows.append(row)
        for waiting in child.below:
            waiting["parent_conv_id"] = child.least
        node.below.append(row)
        node.add(child.n, child.least)
        node.children += 1
        node.leaves += leaves
        node.saved += saved

    def _hand_on(self, node: Node) -> None:
        path = node.path[:node.depth * WIDTH]
        if node.below:
            ref = ref_of(path)
            for waiting in node.below:
                waiting["parent_conv_id"], waiting["parent_ref"] = None, ref
        if node.n:
            self.items.append({
                "path": path, "words": node.words[:node.depth], "n_convs": node.n, "conv_id": node.least, "ends": node.ends,
                "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved,
                "first": node.first, "last": node.last})

    def grow(self, nodes: list[Node], final: bool) -> None:
        """Union-find over the edges between neighbours of ``nodes``, which are sorted by path."""
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        depths = [shared_turns(nodes[i].path, nodes[i + 1].path) for i in range(len(nodes) - 1)]
        top = list(nodes)
        for edge in sorted(range(len(depths)), key=depths.__getitem__, reverse=True):
            depth, a, b = depths[edge], root(edge), root(edge + 1)
            one, other = top[a], top[b]
            if one.depth > depth and other.depth == depth:
                one, other = other, one
            if one.depth > depth:
                branch = Node(one.path, one.words, depth)
                self._attach(branch, one)
                one = branch
            if other.depth == depth:
                self._absorb(one, other)
            else:
                self._attach(one, other)
            parent[b] = a
            top[a] = one
        last = top[root(0)]
        if not final:
            self._hand_on(last)
            return
        if last.depth:
            whole = Node(last.path, last.words, 0)
            self._attach(whole, last)
            last = whole
        for waiting in last.below:
            waiting["parent_conv_id"] = last.least
        self.rows.append({
            "conv_id": last.least, "depth": 0, "n_convs": last.n, "n_children": last.children, "ends": last.ends,
            "n_leaves": last.leaves if last.children else 1, "saved_tokens": last.saved, "ref": ref_of(b"")})


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, ARROW)


def _leaves(batches, pieces: list[dict], number: int) -> list[Node]:
    """One node per distinct sequence of a sorted range; id pieces of the first and the last one."""
    nodes: list[Node] = []
    digest, held, open_held = None, [], []

    def close(last: bool) -> None:
        """Finish the ids of the newest node."""
        if not nodes:
            return
        if held:
            digest.update(("," if nodes[-1].n > len(held) else "").encode() + ",".join(map(str, held)).encode())
        if len(nodes) == 1 or last:
            pieces.extend({"tag": "ids", "ref": ref_of(nodes[-1].path), "range": number, "piece": i, "ids": text}
                          for i, text in enumerate([*open_held, *([",".join(map(str, held))] if held else [])]))
            nodes[-1].ends = OPEN
        else:
            nodes[-1].ends = digest.hexdigest()

    for batch in batches:
        paths, ids, words = (batch.column(n) for n in ("path", "conv_id", "words"))
        for path, conv_id, at in zip(paths.to_pylist(), ids.to_pylist(), range(len(ids)), strict=True):
            if not nodes or nodes[-1].path != path:
                close(last=False)
                nodes.append(Node(path, words[at].as_py(), len(path) // WIDTH, 0, conv_id))
                digest, held, open_held = hashlib.sha256(), [], []
            node = nodes[-1]
            node.n += 1
            held.append(conv_id)
            if len(held) == IDS:
                text = ",".join(map(str, held))
                digest.update(("," if node.n > IDS else "").encode() + text.encode())
                open_held.append(text)
                held = []
    close(last=True)
    if nodes:
        nodes[0].first = nodes[-1].last = True
    return nodes


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, path (the digests of its turns in order) and words (of each turn) from conv_id, position, key, words.

    A row without a position only says that the conversation is there.
    """
    turn = F.when(F.col("position").isNotNull(), F.struct("position", "key", "words"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), ""))
    return rows.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"].cast("long")).alias("words"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, position from 0, key and number of words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key: Column = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role), role, text), 256), 1, 2 * WIDTH))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"),
        F.regexp_count(text, F.lit(WORD)).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "key")
    return rows.withColumn("position", F.row_number().over(order) - 1).select("conv_id", "position", "key", "words")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the ``sequences``: members, children, leaves, saved tokens and the digest of its ends."""
    spark = paths.sparkSession
    paths = written(paths)
    turns = paths.agg(F.sum(F.size("words") + 1).alias("n")).first().n or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // RANGE))

    def first_step(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        pieces: list[dict] = []
        nodes = _leaves(batches, pieces, number)
        if nodes:
            forest = Forest(inner=False)
            forest.grow(nodes, final=False)
            yield from _rows(forest, number, pieces)

    dealt = paths.repartitionByRange(ranges, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    steps = [written(in_arrow(dealt, first_step, SCHEMA))]
    while ranges > FAN:
        steps.append(written(_next_step(steps[-1], final=False)))
        ranges = -(-ranges // FAN)
    steps.append(written(_next_step(steps[-1], final=True)))
    nodes, later = steps[0], steps[1]
    for more in steps[2:]:
        later = later.union(more)
    nodes = nodes.union(later).where("tag = 'node'")
    # nodes that were open somewhere: a few for each range
    parents = later.where("tag = 'node' and ref is not null").select(F.col("ref").alias("parent_ref"), F.col("conv_id").alias("found"))
    ends = _joined_ids(steps[0].where("tag = 'ids'"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    plain = nodes.where(f"parent_ref is null and not (ends <=> '{OPEN}')").select(*columns, "ends")
    waiting = nodes.where(f"parent_ref is not null or ends <=> '{OPEN}'").join(parents, "parent_ref", "left").join(ends, "ref", "left").select(
        *[F.coalesce("parent_conv_id", "found").alias(c) if c == "parent_conv_id" else c for c in columns],
        F.when(F.col("ends") == OPEN, F.col("digest")).otherwise(F.col("ends")).alias("ends"))
    return plain.union(waiting).select(*columns, F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def _rows(forest: Forest, number: int, pieces: list[dict]) -> Iterator[pa.RecordBatch]:
    for row in forest.rows:
        row["tag"] = "node"
    for item in forest.items:
        item["tag"], item["range"] = "item", number
    rows = [*forest.rows, *forest.items, *pieces]
    for at in range(0, len(rows), 10_000):
        yield _batch(rows[at:at + 10_000])


def _next_step(rows: DataFrame, final: bool) -> DataFrame:
    """Contract the items of FAN neighbouring ranges, or of all when at most FAN are left."""

    def step(frame):
        low, high = frame["range"].min(), frame["range"].max()
        nodes = [
            Node(bytes(r.path), list(r.words), len(r.path) // WIDTH, r.n_convs, r.conv_id, r.n_children, r.n_leaves, r.saved_tokens,
                 r.ends, not final and bool(r.first) and r.range == low, not final and bool(r.last) and r.range == high)
            for r in frame.itertuples()]
        nodes.sort(key=lambda n: n.path)
        forest = Forest(inner=True)
        forest.grow(nodes, final)
        return pa.Table.from_batches(list(_rows(forest, int(frame["group"].iloc[0]), [])), ARROW).to_pandas(integer_object_nulls=True)

    group = F.lit(0).cast("long") if final else F.floor(F.col("range") / FAN).cast("long")
    items = rows.where("tag = 'item'").withColumn("group", group)
    return in_groups(items, ["group"], step, SCHEMA)


def _joined_ids(pieces: DataFrame) -> DataFrame:
    """Digest of each id list that crosses ranges, from its pieces in order, one piece in memory at a time."""

    def run(batches):
        ref, digest = None, None
        out: list[tuple[bytes, str]] = []
        for batch in batches:
            for own, ids in zip(batch.column("ref").to_pylist(), batch.column("ids"), strict=True):
                if own != ref:
                    if ref is not None:
                        out.append((ref, digest.hexdigest()))
                    ref, digest = own, hashlib.sha256()
                    digest.update(ids.as_py().encode())
                else:
                    digest.update(b"," + ids.as_py().encode())
        if ref is not None:
            out.append((ref, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.binary()), pa.array([d for _, d in out])], ["ref", "digest"])

    rows = pieces.select("ref", "range", "piece", "ids").repartition("ref").sortWithinPartitions("ref", "range", "piece")
    return in_arrow(rows.select("ref", "ids"), run, "ref binary, digest string")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns as the contract of the query rebuilds them: the first h turns of conversation c - c % 20, then c's own after its first h."""
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    convs = turns.select("conv_id").distinct()
    own = turns.where(F.col("position") >= h)
    heads = turns.where("conv_id % 20 = 0 and position < 3").withColumnRenamed("conv_id", "base")
    borrowed = convs.withColumn("base", F.expr("conv_id - conv_id % 20")).join(heads, "base").where(F.col("position") < h)
    there = convs.select("conv_id", F.lit(None).cast("int").alias("position"), F.lit(None).cast("binary").alias("key"),
                         F.lit(None).cast("int").alias("words"))
    return own.unionByName(borrowed.drop("base")).unionByName(there)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    return prefix_trie(sequences(rebuilt(written(turns_of(conversations)))))
