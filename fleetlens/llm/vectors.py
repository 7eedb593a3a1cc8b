"""Near-duplicate vectors through a robust-pruned flat graph.

Equal vectors of a label are one class. The classes of a label are dealt to cells: pivots from a
bounded sample (at most ``FANOUT`` of a cell, by id hash) split every cell of more than ``CELL`` classes, cell
by cell and level by level; a class lives in the cell of its nearest pivot and also joins the cells
whose pivot is at most ``margin`` of cosine further off, or nearer than ``NEAR``. Cells that do not
split further are cut by id hash, and whoever joins such a cell joins all its cuts. So a cell has a
bounded size whatever the data; long vectors make it smaller (``CELL_BYTES``).

Those who join a cell come to it in blocks of about ``BLOCK``; a block and all that live in the cell are an overlapping
shard. Each builds its own pruned graph of the block, among all its classes and among those that live in it (at most ``DEGREE``
edges of a class, a neighbour is left out when a chosen one is ``ALPHA`` times nearer to it). The adjacency lists of a class are
united over its shards: each edge goes to the cell where its end lives, the only place where it leads anywhere. Every class then
queries each cell it joined: greedy search of width ``WIDTH`` starts from the cell's medoids, one for each connected part, and
from its own neighbours; from what it found the range is
expanded over edges while the cosine stays above the threshold less ``SLACK``. Cosines are in double
precision, so what is counted is verified; a cell counts only the classes that live in it, so no
link counts twice and no pair leaves a task: a task returns counts and a spanning forest.
Vectors are stored as they come and dealt to shards once: graphs and search read the same shuffle.

Recall is audited on each run against brute force: ``AUDIT`` classes (bounded, by id hash) meet all
classes of their label. Below ``RECALL`` the search is repeated with a wider margin, at last with
every cell, which is exhaustive routing.

Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label
or a null vec_id, link with nothing. Vectors of different length do not link. Rows that share a
vec_id are one vector where equal, and share their result where not. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..session import written
from .common import components, in_groups

CELL, CELL_BYTES, CELL_LEAST, FANOUT, LEVELS, BLOCK = 16384, 8 << 20, 1024, 16, 6, 4096
# values of a block of rows against a cell, so that a worker's matrices are bounded
VALUES = 1 << 21
DEGREE, CANDIDATES, ALPHA, WIDTH, EXPAND, SLACK = 12, 32, 1.2, 16, 4, 0.06
MARGINS, NEAR = (0.22, 0.4, 2.0), 0.8
AUDIT, RECALL = 256, 0.98


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(values) -> np.ndarray:
    """Rows scaled to length one in double precision, safe for very large and very small values."""
    x = np.array([np.asarray(v, np.float64) for v in values])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _values(rows: DataFrame, vector: str) -> Column:
    """Single precision stays as it is, half the size of doubles; all else becomes double. Sums are in double precision."""
    if isinstance(rows.schema[vector].dataType.elementType, FloatType):
        return F.col(vector)
    return F.transform(vector, lambda x: x.cast("double"))


def _bounded(most: int) -> Column:
    """``most`` classes, fewer where the vectors of a cell are long. The cell's name begins with their length."""
    length = F.greatest(F.lit(1), F.substring_index("cell", ":", 1).cast("int"))
    return F.least(F.lit(most), F.greatest(F.lit(CELL_LEAST), F.floor(CELL_BYTES / (8 * length))))


def vector_classes(rows: DataFrame, vector: str) -> DataFrame:
    """rep (smallest vec_id), cell, embedding, copies: one row per label and vector."""
    good = rows.where(usable(F.col(vector)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("_label"),
                       _values(rows, vector).alias("embedding")).groupBy("_label", "embedding").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select(
        "rep", F.concat_ws(":", F.size("embedding").cast("string"), "_label").alias("cell"), "embedding", "copies")


def _split(margin: float):
    def run(pdf):
        import pandas as pd

        rows, pivots = pdf[~pdf["pivot"]], pdf[pdf["pivot"]].sort_values("rep")
        if not len(rows):
            return pd.DataFrame({"rep": [], "cell": [], "home": []}).astype({"rep": "int64", "cell": "str", "home": "bool"})
        near = unit(rows["embedding"]) @ unit(pivots["embedding"]).T
        best = near.argmax(axis=1)
        i, j = np.nonzero((near >= near.max(axis=1, keepdims=True) - margin) | (near >= NEAR))
        names = np.array([f"{rows['cell'].iloc[0]}/{k}" for k in range(len(pivots))], object)
        return pd.DataFrame({"rep": rows["rep"].to_numpy()[i], "cell": names[j], "home": rows["home"].to_numpy()[i] & (best[i] == j)})

    return run


def placed(classes: DataFrame, margin: float) -> DataFrame:
    """(rep, cell, home) for each class and cell it joins; ``home`` marks the cell it lives in."""
    vectors = classes.select("rep", "embedding")
    rows = written(classes.select("rep", "cell", F.lit(True).alias("home")))
    whole = None
    for level in range(LEVELS):
        sizes = rows.where("home").groupBy("cell").agg(F.count("*").alias("n"))
        # cells of about half the bound, so that few of them have to be split again
        fan = F.least(F.lit(FANOUT), F.ceil(2 * F.col("n") / F.col("most")))
        large = written(sizes.withColumn("most", _bounded(CELL)).where("n > most").withColumn("fan", fan))
        if large.isEmpty():
            break
        order = Window.partitionBy("cell").orderBy(F.xxhash64("rep", F.lit(level)))
        sample = (rows.where("home").select("cell", "rep").join(large, "cell").withColumn("_place", F.row_number().over(order))
                  .where(F.col("_place") <= FANOUT).where("_place <= fan"))
        done = rows.join(large, "cell", "left_anti")
        whole = done if whole is None else whole.unionByName(done)
        # about BLOCK of those at home to a task, however many a cell has; the pivots go to each
        parts = F.ceil(F.col("n") / F.least(F.lit(BLOCK), F.col("most")))
        open_ = rows.join(large, "cell").select("rep", "cell", "home", F.pmod(F.xxhash64("rep"), parts).alias("_part"), F.lit(False).alias("pivot"))
        pivots = sample.select("rep", "cell", F.lit(True).alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"),
                               F.lit(True).alias("pivot"))
        dealt = open_.unionByName(pivots).join(vectors, "rep")
        rows = written(in_groups(dealt, ["cell", "_part"], _split(margin), rows.schema))
    rows = rows if whole is None else whole.unionByName(rows)
    cuts = rows.where("home").groupBy("cell").agg(F.count("*").alias("n")).select(
        "cell", F.ceil(F.col("n") / (2 * _bounded(CELL))).alias("cuts"))
    rows = rows.join(cuts, "cell")
    mine = F.pmod(F.xxhash64("rep"), F.col("cuts"))
    rows = rows.withColumn("_cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    return written(rows.select("rep", F.concat_ws("#", "cell", F.col("_cut").cast("string")).alias("cell"),
                               (F.col("home") & (mine == F.col("_cut"))).alias("home")))


def _step(n: int) -> int:
    return max(16, min(256, VALUES // max(n, 1)))


def pruned_graph(x: np.ndarray, degree: int = DEGREE, of: np.ndarray | None = None) -> list[np.ndarray]:
    """Robust pruning of the nearest rows of each row, or of the rows ``of``, for many rows at once."""
    n = len(x)
    of = np.arange(n) if of is None else of
    count = min(CANDIDATES, n - 1)
    if count < 1:
        return [np.empty(0, np.int64) for _ in of]
    out = []
    for start in range(0, len(of), _step(n)):
        own = of[start:start + _step(n)]
        near = x[own] @ x.T
        rows = np.arange(len(near))
        near[rows, own] = -2
        ids = np.argpartition(-near, count - 1, axis=1)[:, :count]
        ids = np.take_along_axis(ids, np.argsort(-np.take_along_axis(near, ids, 1), axis=1, kind="stable"), 1)
        far = 1 - np.take_along_axis(near, ids, 1)
        chosen = x[ids]
        between = 1 - np.einsum("qad,qbd->qab", chosen, chosen)
        alive, picked = np.ones(ids.shape, bool), np.zeros(ids.shape, bool)
        for _ in range(degree):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            picked[rows[some], first[some]] = True
            covered = ALPHA * between[rows, first] <= far
            alive &= ~(covered & some[:, None])
            alive[rows, first] = False
        out += [ids[i][picked[i]] for i in range(len(ids))]
    return out


def _built(pdf):
    """Edges of the block's graph in the whole shard, and among those who live in it, which a search there can count on.

    Each goes to the cell where its end lives.
    """
    import pandas as pd

    reps, x, at_home, asks = pdf["rep"].to_numpy(), unit(pdf["embedding"]), pdf["home"].to_numpy(), np.nonzero(pdf["asks"].to_numpy())[0]
    home = np.nonzero(at_home)[0]
    own = np.searchsorted(home, asks[at_home[asks]])
    a, b = [asks, home[own]], [pruned_graph(x, of=asks)]
    # where all live here, both graphs are one
    b.append([home[e] for e in pruned_graph(x[home], of=own)] if len(home) < len(x) else [np.empty(0, np.int64)] * len(own))
    ends = [e for near in b for e in near]
    a = np.repeat(np.concatenate(a), [len(e) for e in ends])
    b = np.concatenate([np.empty(0, np.int64), *ends]).astype(np.int64)
    code, names = pd.factorize(pdf["lives"])
    pairs = np.unique(np.stack([a, code[b], b]), axis=1)
    a, cell, b = pairs
    first = np.nonzero(np.r_[True, (a[1:] != a[:-1]) | (cell[1:] != cell[:-1])])[0] if len(a) else np.empty(0, np.int64)
    near = np.split(reps[b], first[1:]) if len(a) else []
    return pd.DataFrame({"rep": reps[a[first]], "lives": pdf["lives"].to_numpy()[a[first]], "cell": names[cell[first]].to_numpy(),
                         "near": pd.Series(near, dtype=object)})


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's connected part."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def range_search(x: np.ndarray, near: list[np.ndarray], queries: np.ndarray, entries: list[np.ndarray],
                 threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For blocks of queries: (query, row) pairs with cosine at or above the threshold that the graph leads to.

    A query starts from the medoids and from its own ``entries``.
    """
    n = len(x)
    a = np.repeat(np.arange(n), [len(e) for e in near])
    b = np.concatenate([np.empty(0, np.int64), *near]).astype(np.int64)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    degree = np.bincount(a, minlength=n)
    table = np.full((n, max(1, degree.max(initial=0))), -1, np.int64)
    table[a, np.arange(len(a)) - np.repeat(np.cumsum(degree) - degree, degree)] = b
    label = _parts(n, a, b)
    starts = []
    for part in np.unique(label):
        rows = np.nonzero(label == part)[0]
        starts.append(rows[(x[rows] @ x[rows].mean(axis=0)).argmax()])
    starts = np.array(starts)
    out = []
    for begin in range(0, len(queries), step := _step(n)):
        q = queries[begin:begin + step]
        score = np.full((len(q), n), -2.0)
        opened = np.zeros((len(q), n), bool)
        score[:, starts] = q @ x[starts].T
        own = entries[begin:begin + step]
        i, j = np.repeat(np.arange(len(q)), [len(e) for e in own]), np.concatenate(own)
        score[i, j] = np.einsum("id,id->i", q[i], x[j])

        def visit(i, j, q=q, score=score):
            """Score the neighbours of node j for query i."""
            k = table[j]
            rows = np.broadcast_to(i[:, None], k.shape)
            fresh = (k >= 0) & (score[rows, k] == -2.0)
            rows, k = rows[fresh], k[fresh]
            if len(k):
                pairs = np.unique(rows * n + k)
                rows, k = pairs // n, pairs % n
                for at in range(0, len(k), 65536):
                    r, c = rows[at:at + 65536], k[at:at + 65536]
                    score[r, c] = np.einsum("id,id->i", q[r], x[c])

        width = min(WIDTH, n)
        while True:
            beam = np.argpartition(-score, width - 1, axis=1)[:, :width]
            rank = np.take_along_axis(score, beam, 1)
            rank[np.take_along_axis(opened, beam, 1)] = -3
            pick = np.argsort(-rank, axis=1)[:, :EXPAND]
            go = np.take_along_axis(rank, pick, 1) > -2
            if not go.any():
                break
            i, p = np.nonzero(go)
            j = beam[i, pick[i, p]]
            opened[i, j] = True
            visit(i, j)
        while True:
            i, j = np.nonzero((score >= threshold - SLACK) & ~opened)
            if not len(i):
                break
            opened[i, j] = True
            for at in range(0, len(i), 16384):
                visit(i[at:at + 16384], j[at:at + 16384])
        i, j = np.nonzero(score >= threshold)
        out.append((i + begin, j))
    return out


def _lists(n: int, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """For each of n numbers, the distinct values of b beside it in a."""
    pairs = np.unique(np.stack([a, b]), axis=1)
    return np.split(pairs[1], np.searchsorted(pairs[0], np.arange(1, n))) if n else []


def _searched(threshold: float):
    def run(pdf, edges):
        import pandas as pd

        index, asks = pdf[pdf["home"]], pdf[pdf["asks"]]
        if not len(index) or not len(asks):
            return pd.DataFrame({"rep": [], "links": [], "a": []}).astype("int64")
        index, asks = index.sort_values("rep"), asks.sort_values("rep")
        reps, copies, names = index["rep"].to_numpy(), index["copies"].to_numpy(), asks["rep"].to_numpy()
        a = np.repeat(edges["rep"].to_numpy().astype(np.int64), [len(e) for e in edges["near"]])
        b = np.concatenate([np.empty(0, np.int64), *edges["near"]]).astype(np.int64)

        def known(among, ids):
            i = np.minimum(np.searchsorted(among, ids), len(among) - 1)
            return i, among[i] == ids

        end, lives = known(reps, b)
        start, inside = known(reps, a)
        near = _lists(len(reps), start[inside & lives], end[inside & lives])
        # the query itself, where it lives here, and those of its neighbours that do
        start, asking = known(names, a)
        own, here = known(reps, names)
        entries = _lists(len(names), np.r_[np.nonzero(here)[0], start[asking & lives]], np.r_[own[here], end[asking & lives]])
        x = unit(index["embedding"])
        links = np.zeros(len(asks), np.int64)
        every, own = np.unique(np.concatenate([reps, names]), return_inverse=True)
        own_index, own_ask = own[:len(reps)], own[len(reps):]
        a, b = [], []
        for i, j in range_search(x, near, unit(asks["embedding"]), entries, threshold):
            other = reps[j] != names[i]
            i, j = i[other], j[other]
            np.add.at(links, i, copies[j])
            # a forest of this block's links is enough
            label = _parts(len(every), own_ask[i], own_index[j])
            moved = np.nonzero(label != np.arange(len(every)))[0]
            a.append(every[moved])
            b.append(every[label[moved]])
        a, b = np.concatenate(a), np.concatenate(b)
        label = _parts(len(every), np.searchsorted(every, a), np.searchsorted(every, b))
        moved = np.nonzero(label != np.arange(len(every)))[0]
        return pd.concat([
            pd.DataFrame({"rep": names, "links": links, "a": names}),
            pd.DataFrame({"rep": every[moved], "links": 0, "a": every[label[moved]]}),
        ]).astype("int64")

    return run


def searched(classes: DataFrame, threshold: float, margin: float) -> DataFrame:
    """rep, links, a: counts of linked rows and forest edges (rep, a) of every class."""
    rows = placed(classes, margin)
    lives = rows.where("home").select("rep", F.col("cell").alias("lives"))
    asked = written(rows.groupBy("cell").agg(F.count("*").alias("n")).select(
        "cell", F.ceil(F.col("n") / _bounded(BLOCK)).alias("blocks")))
    # the work goes with the rows, so AQE must not merge tasks by their bytes
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * rows.count() // BLOCK))
    mine, every = F.pmod(F.xxhash64("rep"), F.col("blocks")), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    shards = rows.join(asked, "cell").join(lives, "rep").join(classes.select("rep", "embedding", "copies"), "rep").select(
        "cell", F.explode(F.when(F.col("home"), every).otherwise(F.array(mine))).alias("block"), mine.alias("_mine"),
        "rep", "lives", "home", "copies", "embedding")
    shards = shards.withColumn("asks", F.col("block") == F.col("_mine")).drop("_mine").repartition(tasks, "cell", "block")
    edges = in_groups(shards, ["cell", "block"], _built, "rep long, lives string, cell string, near array<long>").join(asked, "cell")
    edges = edges.select(
        "cell", F.explode(F.when(F.col("lives") == F.col("cell"), every).otherwise(F.array(mine))).alias("block"), "rep", "near")
    both = shards.groupBy("cell", "block").cogroup(edges.repartition(tasks, "cell", "block").groupBy("cell", "block"))
    return both.applyInPandas(_searched(threshold), "rep long, links long, a long")


def audited(classes: DataFrame, found: DataFrame, threshold: float, size: int = AUDIT) -> float:
    """Share of the brute-force links of a bounded sample of classes that ``found`` (rep, links) has."""
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(size).select("rep", "cell", "embedding").toPandas()
    if not len(sample):
        return 1.0
    by = {cell: (g["rep"].to_numpy(), unit(g["embedding"])) for cell, g in sample.groupby("cell")}

    def run(batches):
        for pdf in batches:
            import pandas as pd

            for cell, rows in pdf.groupby("cell"):
                if cell in by:
                    reps, q = by[cell]
                    hits = (q @ unit(rows["embedding"]).T >= threshold) & (reps[:, None] != rows["rep"].to_numpy()[None, :])
                    yield pd.DataFrame({"rep": reps, "links": hits @ rows["copies"].to_numpy()})

    true = classes.mapInPandas(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("true"))
    row = true.join(found.select("rep", "links"), "rep", "left").agg(
        F.sum("true").alias("t"), F.sum(F.least("true", F.coalesce("links", F.lit(0)))).alias("f")).first()
    return row.f / row.t if row.t else 1.0


def linked_vectors(rows: DataFrame, vector: str = "embedding", threshold: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    classes = written(vector_classes(rows, vector))
    for margin in MARGINS:
        got = written(searched(classes, threshold, margin))
        counts = written(got.groupBy("rep").agg(F.sum("links").alias("links")))
        if audited(classes, counts, threshold) >= RECALL:
            break
    roots = components(got.select("rep", "a").where("rep <> a").withColumnRenamed("rep", "b"))
    named = classes.select("rep", "cell", "embedding", "copies").join(counts, "rep", "left").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(
        F.col("cell").alias("_cell"), F.col("embedding").alias("_vector"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("root", "rep").alias("_root"))
    good = usable(F.col(vector)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    values = F.when(good, _values(rows, vector))
    mine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("_v"),
                       F.concat_ws(":", F.size(vector).cast("string"), F.col("label").cast("string")).alias("_c"))
    out = mine.join(named, (F.col("_c") == F.col("_cell")) & (F.col("_v") == F.col("_vector")), "left")
    component = F.coalesce("_root", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      component.eqNullSafe(F.col("vec_id")).alias("kept"))
