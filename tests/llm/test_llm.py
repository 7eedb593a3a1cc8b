"""Operators of fleetlens.llm against brute force, SQL twins, exact round trips and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, difference
from fleetlens.llm import chat, langid, lm, minhash, mincut, mixing, queries, records, templates, urls, vectors
from fleetlens.llm.common import components, words_of

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, class string"


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", "s"), 0, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(spark, name):
    assert difference(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLE[name]) is None


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 40), (40, 30), (50, 50)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 21), 1), 30: 30, 40: 30}
    assert components(edges.limit(0)).count() == 0


def shingles(text, width):
    w = words_of(text)
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def by_force(texts, width):
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def test_minhash_hot_groups(spark):
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(5000)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = [None, "", "one", "One", "a b c", "a b c d", " ".join(base)]
    for _ in range(120):  # a group of near copies, edited more or less
        copy = list(base)
        for _ in range(draw.randrange(9)):
            copy[draw.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(draw.choice([2, 10, 60]))]) for _ in range(80)]
    texts += [texts[10]] * 40
    want, sizes = by_force(texts, 4)
    rows = minhash.near_duplicates(docs_of(spark, texts), width=4, rare=8).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == want and [r.n_shingles for r in rows] == sizes
    assert [r.kept for r in rows] == [i == w for i, w in enumerate(want)]
    kept = {r.doc_id for r in minhash.first_of_group(docs_of(spark, texts[:40]), width=4).collect()}
    want, _ = by_force(texts[:40], 4)
    assert kept == {i for i, w in enumerate(want) if i == w}
    assert minhash.near_duplicates(docs_of(spark, texts).limit(0), width=4).count() == 0


def test_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=16).tolist(), i % 2) for i in range(60)]
    rows += [(100 + i, (np.array(rows[0][1]) + 0.05 * draw.normal(size=16)).tolist(), 0) for i in range(30)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 16, 0),
             (205, [float("nan")] * 16, 0), (206, [1.0], 0), (207, [None] * 16, 0), (208, [1e300] * 16, 0), (209, [2e300] * 16, 0)]
    df = spark.createDataFrame([(i, v, x, 9) for i, v, x in rows], "vec_id long, embedding array<double>, label int, rep int")
    unit = {i: np.array(v) / np.abs(v).max() for i, v, x in rows if x is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    label = {i: x for i, _, x in rows}
    linked = {i: {j for j in unit if i != j and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93}
              if i in unit else set() for i, _, _ in rows}
    got = {r.vec_id: r for r in vectors.linked_vectors(df).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(s) for i, s in linked.items()}
    assert got[105].component_id == 0 and got[209].component_id == 208 and not got[209].kept
    assert vectors.linked_vectors(df.limit(0)).count() == 0


def test_vectors_of_many_cells(spark, monkeypatch):
    draw = np.random.default_rng(2)
    centre = draw.normal(size=32)
    x = np.concatenate([draw.normal(size=(500, 32)), centre + 0.15 * draw.normal(size=(300, 32))])
    monkeypatch.setattr(vectors, "CELL", 100)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.93).sum(axis=1) - 1
    got = np.array([r.n_links for r in vectors.linked_vectors(df).orderBy("vec_id").collect()])
    assert got.sum() >= 0.98 * true.sum() and (got <= true).all()


def test_main_text(spark):
    page = ("<html><head><title>no</title></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class='cookie notice'>We use"
            " cookies.</div><article><h1>A &amp; B</h1><p>Yes.<p>Second  paragraph&nbsp;here, long enough.<br>More</p><script>x('<p>')</script>"
            "</article><aside>Other</aside><form>Name <input></form><div id=comments><p>I like it.</p></div><footer>&copy;</footer")
    assert mincut.main_text(page)[0] == "A & B Yes. Second paragraph here, long enough. More"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "<p")], "page_id long, url string, html string")
    assert [r.n_chars for r in mincut.extracted(pages).orderBy("page_id").collect()][1:] == [0, 0, 0]


def test_main_text_in_odd_wrappers():
    said = "The harbour was quiet on that morning, and nobody had seen the boats leave before the sun was up."
    body = f"<h1>Boats</h1><p>{said}</p><p>{said}</p>"
    want = f"Boats {said} {said}"
    menu = "<nav><a href=x>Menu</a></nav><div class='cookie-banner'>We use cookies.</div>"
    for page in (f"<body class='has-header-image has-sidebar'>{menu}<article>{body}</article></body>",
                 f"<body class='sidebar'>{menu}<article class='post comments-open'>{body}</article></body>",
                 f"<body>{menu}<div id='content' class='with-sidebar'>{body}</div></body>",
                 f"<body>{menu}<div id='search'>{body}</div></body>", f"<body>{menu}<main class='social'>{body}</main></body>",
                 f"<body><form>{menu}<div>{body}</div></form></body>"):
        got = mincut.main_text(page)[0]
        assert got.endswith(f"{said} {said}") and "cookies" not in got and "Menu" not in got, page
    assert mincut.main_text(f"<article>{body}</article><div id=comments>{body * 3}</div>")[0] == want
    formula = "<math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math>"
    assert mincut.main_text(f"<article><p>{said} So {formula} holds.</p></article>")[0] == f"{said} So x=2 holds."
    for tag in ("noscript", "object"):
        assert mincut.main_text(f"<article><{tag}><p>{said}</p></{tag}></article>")[0] == said


def test_minimum_cut_by_force():
    draw = random.Random(5)
    for _ in range(60):
        n = draw.randrange(1, 8)
        scores = [draw.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, draw.uniform(0, 2)) for i in range(n) for j in range(i) if draw.random() < 0.6]
        cost = lambda side: sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(scores, side, strict=True)) + sum(
            w for a, b, w in edges if side[a] != side[b])
        best = min(cost([bits >> i & 1 for i in range(n)]) for bits in range(1 << n))
        assert abs(cost(mincut.source_side(scores, edges)) - best) < 1e-9


def test_records(spark, tmp_path):
    texts = ["Hello, WORLD's 12 cats", None, "", "Straße <|endoftext|> x", "hello " * 3000]
    df = docs_of(spark, texts).unionByName(docs_of(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long")))
    folder = f"file://{tmp_path}/r"
    rows = records.token_records(df, folder).orderBy("start").collect()
    tok, at = records.tokenizer(records.VOCABULARY), 0
    for r, (i, t) in zip(rows, [(None, "null id"), *enumerate(texts)], strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    index = spark.read.parquet(f"{folder}/index")
    got = records.read_records(spark, index.where("doc_id in (0, 3)")).collect()
    assert {r.doc_id: r.ids for r in got} == {i: [*tok.encode(texts[i], add_special_tokens=False).ids, 2] for i in (0, 3)}
    data = bytearray(records.frame(7, np.array([1, 70000], np.uint32)) + b"\n")
    assert records.parsed(data)[0][3].tolist() == [1, 70000]
    data[15] ^= 1
    with pytest.raises(ValueError):
        records.parsed(data)
    assert records.token_records(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_elias_fano():
    draw = np.random.default_rng(4)
    for values in (np.sort(draw.integers(0, 1 << 61, 500)), np.sort(draw.integers(0, 40, 300)), np.zeros(3, int), np.arange(0)):
        code = lm.EliasFano.encode(values)
        at = np.arange(len(values))
        assert (code.get(at) == values.astype(np.uint64)).all()
        asked = np.concatenate([values, values + 1]).astype(np.uint64)
        got = code.search(asked, np.zeros(len(asked), np.int64), np.full(len(asked), len(values)))
        assert (got == np.searchsorted(values.astype(np.uint64), asked)).all()


def test_lm_against_counts(spark, documents):
    extra = spark.createDataFrame([(None, None), (-5, "unseenword the"), (-6, "")], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(extra)
    one, two, starts, texts = {}, {}, 0, {}
    for r in docs.collect():
        w = words_of(r.text)
        texts[r.doc_id] = w
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10:
            starts += 1
            for h, x in zip([None, *w], [*w, "end"], strict=True):
                one[x] = one.get(x, 0) + 1
                two[h, x] = two.get((h, x), 0) + 1
    total, kinds = sum(one.values()), len(one)
    single = lambda x: (one.get(x, 0) + 0.1) / (total + 0.1 * (kinds + 1))
    for r in lm.scored(docs).collect():
        w = texts[r.doc_id]
        pairs = list(zip([None, *w], [*w, "end"], strict=True))
        base = sum(np.log10(single(x)) for _, x in pairs)
        score = 0.0
        for h, x in pairs:
            seen = starts if h is None else one.get(h, 0)
            score += np.log10(lm.WEIGHT * two.get((h, x), 0) / seen + (1 - lm.WEIGHT) * single(x) if seen else single(x))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(pairs), sum(x in one for _, x in pairs), total)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and abs(r.score - score) < 0.002 * len(pairs)


def test_mixture(spark, documents):
    rows = mixing.mixture(documents).collect()
    assert sorted(rows) == sorted(mixing.mixture(documents.repartition(7)).collect())
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert all(0 <= r.taken <= 3 * r.size for r in own) and own[0].target <= 3 * own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(0.02 * own[0].target, max(r.size for r in own) / 2)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))
    odd = docs_of(spark, [None, "", "a b"]).unionByName(docs_of(spark, ["a"] * 5).withColumn("source", F.lit(None).cast("string")))
    assert mixing.mixture(odd).count() == 8 and mixing.mixture(odd.limit(0)).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_flight_keeps_totals():
    words = sorted((random.Random(1).randrange(1, 900) for _ in range(400)), reverse=True)
    out = mixing.flight([0.3] * 400, words, "seed")
    assert sum(1e-9 < v < 1 - 1e-9 for v in out) <= 2
    assert sum(a * b for a, b in zip(out, words, strict=True)) == pytest.approx(0.3 * sum(words))


def test_contamination(spark):
    items = spark.createDataFrame([
        (1, "The baker has 12 loaves and sells 5 loaves to Anna before noon while it rains outside all day"),
        (2, "a short one"), (3, None), (4, "")], "item_id long, text string")
    moved = "The baker has 30 loaves and sells 7 loaves to Boris before noon while it rains outside all day"
    odd = items.first().text.replace("12", "9").replace("has 9 loaves and sells 5", "has 9 loaves and sells 9")
    texts = ["noise first. " + moved + " and noise", "nothing here at all but plain words in a row", "A short one!", None, "",
             items.first().text, "the baker has many loaves", odd]
    got = {r.doc_id: r.item_ids for r in templates.contamination(docs_of(spark, texts), items).collect()}
    # the last one's values are inconsistent, but its tail has four whole windows of the item
    assert got == {0: [1], 1: [], 2: [2], 3: [], 4: [], 5: [1], 6: [], 7: [1]}
    assert templates.decontaminated(docs_of(spark, texts), items).count() == 4
    assert not templates.leaks(docs_of(spark, texts), items.limit(0)).count()


def test_values_stand_at_their_places(spark):
    texts = ["grew 5% Growth now", "in 5 minutes John ran", "the Foo12 ran", "a 5 km2 field", "\uE001 \uE004x 1.5km \uE003"]
    rows = docs_of(spark, texts).select("doc_id", templates.pieces(F.col("text")).alias("pieces"))
    got = {(r.doc_id, r.pos): r.value for r in templates._slots(rows, ["doc_id"]).collect()}
    assert got == {(0, 1): "5", (0, 2): "%", (0, 3): "growth", (1, 1): "5", (1, 2): "minutes", (1, 3): "john", (2, 1): "foo",
                   (3, 1): "5", (3, 2): "km", (4, 1): "1.5", (4, 2): "km"}
    tokens = docs_of(spark, texts).select("doc_id", F.posexplode(templates.template_tokens(F.col("text"))).alias("pos", "token"))
    assert {(r.doc_id, r.pos) for r in tokens.collect() if r.token in (templates.NUMBER, templates.NAME, templates.UNIT)} == set(got)


def test_verbatim_copy_behind_odd_spots(spark):
    passage = "Tom buys 12 apples and 12 pears while Anna picks 7 plums near the old mill before lunch"
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    texts = [f"{head} and we saw that {passage}" for head in ("In 5 minutes John ran", "They grew 5% Growth now", "the Foo12 ran", "a 5 km2 field")]
    assert [r.item_ids for r in templates.contamination(docs_of(spark, texts), items).orderBy("doc_id").collect()] == [[1]] * 4


def test_whole_windows_count_beside_changed_values(spark):
    passage = "Tom buys 12 apples and 12 pears while Anna picks 7 plums near the old mill before lunch on a cold day"
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    changed = [passage.replace("12 pears", "13 pears"), passage.replace("7", "12"), passage.title() + " " + passage.replace("12 pears", "13 pears")]
    # inconsistent values, and no stretch of nine words of the item
    broken = "Tom buys 12 apples and 13 pears while Otto picks 7 plums near her old mill before lunch on that cold day"
    rows = templates.contamination(docs_of(spark, [*changed, broken]), items).orderBy("doc_id").collect()
    assert [r.item_ids for r in rows] == [[1], [1], [1], []]


def test_copies_without_listed_templates(spark):
    passage = "Every morning Clara and Ruth walk past the quiet harbour with Otto before the market opens"
    items = spark.createDataFrame([
        (1, "12 15 18 21 24 27 30 33 36 39"), (2, "Paul Mary John Anna Peter Clara Ruth Otto Emil Ida"), (3, passage),
        (4, "who wrote this old play?")], "item_id long, text string")
    texts = ["so 12 15 18 21 24 27 30 33 36 39 it is", "so Paul Mary John Anna Peter Clara Ruth Otto Emil Ida ran", passage.title(),
             passage.upper(), "x " + passage.lower(), "I asked: who wrote this old play? Nobody knew.", "12 15 18 21 24 27 30 34",
             "who wrote this play", "", None]
    rows = templates.contamination(docs_of(spark, texts), items).orderBy("doc_id").collect()
    assert [r.item_ids for r in rows] == [[1], [2], [3], [3], [3], [4], [], [], [], []]


def test_contamination_by_force(spark, documents):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    grams = lambda t: {tuple(w[i:i + 9]) for w in [t.lower().split()] for i in range(len(w) - 8)}
    known = set().union(*(grams(r.text) for r in items.collect()))
    want = {r.doc_id for r in documents.collect() if grams(r.text) & known}
    assert {r.doc_id for r in templates.contamination(documents, items).where("contaminated").collect()} == want and want


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    hits = urls.listed_hits(keys, keys.where("endswith(canonical, '7')"))
    assert hits.count() == 300
    assert urls.verdicts(spark.createDataFrame([(1, None), (1, "x"), (2, "http://a.COM/")], "page_id long, url string"),
                         keys.limit(0)).where("host = ''").count() == 2


def test_chat_layouts_and_marks(spark):
    records_ = [
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', '{"prompt":"a","response":"b"}',
        '{"instruction":"a","input":"","output":"b"}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"messages":[]}', '{"other":1}', "no json", None]
    df = spark.createDataFrame(list(enumerate(records_)), "conv_id long, record string")
    turns = {r.conv_id: r.turns and [tuple(t) for t in r.turns] for r in chat.canonical_turns(df).collect()}
    pair = [("user", "a"), ("assistant", "b")]
    assert turns == {0: pair, 1: pair, 2: pair, 3: pair, 4: [], 5: None, 6: None, 7: None}
    rows = [(1, 0, "us\ner\\n", "\\p<|im_end|>\\b"), (1, 1, None, None), (1, 2, "assistant", "x\\<|\n")]
    said = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    text = chat.formatted(chat.canonical_turns(chat.conversation_records(said)))
    got = text.select(chat.read_turns(F.col("formatted")).alias("t"), chat.learned_text(F.col("formatted"), F.col("loss_mask")).alias("l")).first()
    assert [tuple(t) for t in got.t] == [("us\ner\\n", "\\p<|im_end|>\\b"), ("", ""), ("assistant", "x\\<|\n")] and got.l == "x\\<|\n"


def test_languages_held_out(spark, documents):
    model = langid.learned(documents)
    rows = langid.languages(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    odd = docs_of(spark, [None, "", "123 !!", "é", "zq" * 50000])
    assert [r.lang_pred for r in langid.languages(odd, model).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert langid.accepted(odd, model).columns == odd.columns
    assert langid.learned(documents.limit(0)) is None
    keys = langid.keys_of(langid.character_codes("the then"))
    small = langid.fitted({"en": np.unique(keys, return_counts=True)})
    context = keys[-1] >> np.uint64(16) << np.uint64(16)
    every = np.arange(langid.CHARACTERS, dtype=np.uint64) | context
    assert np.exp(small.lookup(every).astype(np.float64)).sum() == pytest.approx(1, abs=1e-3)


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, FOLDER).orderBy("start").collect()
    assert rows and [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])


def test_words_are_learned_once(monkeypatch):
    """Only distinct words not known yet are given to the model, also when the memory is full; ids are the library's."""
    texts = ["Plain words, plain WORDS.", None, "", "Straße ΣΟΦΟΣ K İstanbul café x1 日本語!", "plain  new\nwords."]
    plain = records.tokenizer(records.VOCABULARY)
    expected = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    words, learned = records.WordEncoder(records.VOCABULARY), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda fresh: (learned.append(list(fresh)), learn(fresh)))
    assert [x.tolist() for x in words.encode_all(texts)] == expected
    assert [x.tolist() for x in words.encode_all(texts + ["other words"])] == [*expected, plain.encode("other words", add_special_tokens=False).ids]
    assert len(learned) == 2 and len(set(learned[0])) == len(learned[0]) and learned[1] == ["other", "words"]
    monkeypatch.setattr(records, "REMEMBERED", 3)
    assert [x.tolist() for x in words.encode_all(["fresh plain words, again"] + texts)][1:] == expected
