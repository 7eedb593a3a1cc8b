"""Vectors are dealt to shards once, as narrow as they come, in blocks."""

import numpy as np

from fleetlens.llm import vectors


def _table(spark, kind):
    draw = np.random.default_rng(5)
    centre = draw.normal(size=24)
    x = np.concatenate([draw.normal(size=(260, 24)), centre + 0.15 * draw.normal(size=(140, 24))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>, label int")
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    return df, (u @ u.T >= 0.93).sum(axis=1) - 1


def test_places_hold_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 100)
    df, _ = _table(spark, "float")
    classes = vectors.vector_classes(df, "embedding")
    assert dict(classes.dtypes)["embedding"] == "array<float>"
    rows = vectors.placed(classes, 0.22)
    assert rows.columns == ["rep", "cell", "home"]
    assert rows.where("home").count() == rows.select("rep").distinct().count() == 400
    assert rows.where("home").groupBy("cell").count().where("count > 200").count() == 0 and rows.count() > 400


def test_blocks_of_a_cell_lose_no_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 150)
    monkeypatch.setattr(vectors, "BLOCK", 90)
    df, true = _table(spark, "float")
    got = vectors.linked_vectors(df).orderBy("vec_id").collect()
    assert sum(r.n_links for r in got) >= 0.98 * true.sum() and all(r.n_links <= n for r, n in zip(got, true, strict=True))


def test_graph_of_some_rows_is_that_of_all():
    x = vectors.unit(np.random.default_rng(6).normal(size=(300, 8)))
    whole, of = vectors.pruned_graph(x), np.array([3, 7, 299])
    assert all((a == whole[i]).all() for a, i in zip(vectors.pruned_graph(x, of=of), of, strict=True))


def test_lists_of_neighbours_are_distinct():
    got = vectors._lists(4, np.array([2, 0, 2, 2]), np.array([9, 5, 9, 1]))
    assert [x.tolist() for x in got] == [[5], [], [1, 9], []]
