"""What Python workers hold: parts of a batch, and what one operator remembers between its tasks."""

import numpy as np
import pyarrow as pa

from fleetlens.llm import common, minhash, records


def test_batches_come_in_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1201))], ["doc_id"])
    parts = list(common.in_parts([batch, batch.slice(0, 0)], 500))
    assert [p.num_rows for p in parts] == [500, 500, 201]
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(1201))


def test_sketches_hold_few_sets_at_once(spark, monkeypatch):
    """Sets of shingles are made for a part of Spark's batch, not for all its rows."""
    held = []
    monkeypatch.setattr(minhash, "in_arrow", lambda df, run, schema: held.append(run))
    docs = spark.createDataFrame([], "doc_id long, text string")
    minhash.sketched(docs, 4)
    minhash.whole_sets(docs, 4)
    texts = pa.array([f"a b c d {i % 7}" for i in range(1100)])
    sketches, sets = ([p.num_rows for p in run(iter([pa.RecordBatch.from_arrays([ids, texts][-n:], ["doc_id", "text"][-n:])]))]
                      for run, n, ids in ((held[0], 2, pa.array(range(1100))), (held[1], 1, None)))
    assert sketches == sets == [500, 500, 100]


def test_other_operators_drop_what_a_worker_remembers(spark):
    texts = spark.createDataFrame([("one two",)], "text string").coalesce(1)

    def names(keeps):
        def run(batches):
            common.remembered("words", dict)
            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array(sorted(common._REMEMBERED))], ["name"])

        return [r.name for r in common.in_arrow(texts, run, "name string", keeps=keeps).collect()]

    assert names("words") == ["words"]
    common.remembered("encoder", dict)
    common.forget_others("words")
    assert "encoder" not in common._REMEMBERED


def test_words_used_again_stay(monkeypatch):
    """A full memory drops the words that came once; ids stay the library's."""
    monkeypatch.setattr(records, "REMEMBERED", 8)
    words, plain = records.WordEncoder(records.VOCABULARY), records.tokenizer(records.VOCABULARY)
    for text in ["often seen words", "often seen words again", "often a b c d e", "words f g", "often seen h i j k l m"]:
        assert words.encode_all([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(words.place) <= 8 + 7 and len(words.used) == len(words.place) == len(words.sizes)
    learned = []
    monkeypatch.setattr(words, "_learn", lambda fresh, learn=words._learn: (learned.append(list(fresh)), learn(fresh)))
    words.encode_all(["often"])
    assert learned == [] and np.all(words.starts == np.cumsum(words.sizes) - words.sizes)


def test_batches_are_bounded_by_bytes(spark):
    session = spark.newSession()
    common.in_arrow(session.createDataFrame([("a",)], "text string"), lambda batches: batches, "text string")
    assert int(session.conf.get(common._BATCH).rstrip("b")) == common.BATCH_BYTES
    session.conf.set(common._BATCH, 1 << 20)
    common.in_arrow(session.createDataFrame([("a",)], "text string"), lambda batches: batches, "text string")
    assert int(session.conf.get(common._BATCH).rstrip("b")) == 1 << 20
